"""Secret scans with multipart credential linking, in DataFrame functions only.

Parts of credentials have roles: identifiers, secrets and endpoints. Strong parts (assigned values, access
identifiers, long hex runs) are always reported. Weak parts (account names, bare 40-character keys, endpoints)
are reported only if a part of a complementary role lies within reach of them in the same text: an interval
join on (text, bucket of positions), so a bucket holds no more parts than its width in characters allows.

Positions are code points. They come from one regular expression per kind that also captures the gap before
each match (anchored where the last match ended, so a text is scanned once) and from running sums of lengths.
Positions in bytes come with them, as bytes can be cut out of a text without walking through it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Code points around a weak part in which a complementary part must lie.
REACH = 200
#: Elements summed directly by the two-level running sum.
BLOCK = 128
MASK = "[SECRET]"


@dataclass(frozen=True)
class Kind:
    """A kind of part: its pattern, the group (0: all) whose length counts, the least length, role, and whether it is reported alone.

    Every match implies `sign`, a pattern that is cheap to look for, and one of `needs`, plain strings that are cheaper still.
    """

    name: str
    pattern: str
    group: int
    least: int
    role: str
    strong: bool
    sign: str
    needs: tuple[str, ...] = ()


#: The patterns of the base kinds; then the weak kinds of the linking.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "secret", True, r"(?i:d|t|n|y)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}", (":", "=")),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, "id", True, "AKIA", ("AKIA",)),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32, "secret", True, r"[0-9a-f]{32}"),
    Kind("account", r"""(?i:user_?name|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+""", 0, 6, "id", False, r"(?i:e|r|n|d|t)[\"']?\x20*[:=]", (":", "=")),
    Kind("key40", r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", 0, 40, "secret", False, r"[A-Za-z0-9/+]{40}"),
    Kind("endpoint", r"""(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3|jdbc:[a-z0-9]+)://[^\s"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])""", 0, 7, "endpoint", False, r"://|[0-9]\.[0-9]{1,3}\.[0-9]", (".", "://")),
)
BASE = tuple(k for k in KINDS if k.strong)
WEAK = tuple(k for k in KINDS if not k.strong)
#: The role that has to be near a weak part of a role.
COMPLEMENT = {"id": "secret", "secret": "id", "endpoint": "secret"}
SPAN = "array<struct<start:int,kind:int,end:int,first:int,last:int>>"
LINKED = "array<struct<start:int,kind:int,end:int,first:int,last:int,to:array<struct<start:int,kind:int,end:int>>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, put: Callable[[Column, Column], Column]) -> Column:
    """What `put` makes of all earlier elements, for each element; in blocks, so that long arrays cost little more than linear time."""
    total = lambda xs: F.aggregate(xs, zero, put)
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda i: F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)))
    inside = lambda b, before: F.transform(b, lambda _, j: F.aggregate(F.slice(b, F.lit(1), j), before, put))
    summed = lambda blocks, sums: F.flatten(F.transform(blocks, lambda b, i: let(total(F.slice(sums, F.lit(1), i)), lambda before: inside(b, before))))
    whole = lambda xs: let(cut(xs), lambda blocks: let(F.transform(blocks, total), lambda sums: summed(blocks, sums)))
    return let(values, lambda xs: F.when(F.size(xs) > 0, whole(xs)))


def spans(text: Column, number: int, kind: Kind) -> Column:
    """Leftmost non-overlapping matches of a kind as array<struct<start, kind, end, first, last>>; matches that are too short are dropped after matching."""
    every = F.lit(rf"(?s)\G(.*?)({kind.pattern})")
    of = lambda group, length: F.transform(F.regexp_extract_all(text, every, F.lit(group)), length)
    both = lambda x: F.struct(F.length(x).alias("n"), F.octet_length(x).alias("b"))
    zipped = F.arrays_zip(of(1, both).alias("gap"), of(2, both).alias("all"), of(2 + kind.group, F.length).alias("part"))
    two = lambda n, b: F.struct(n.alias("n"), b.alias("b"))
    before = lambda zs: running(F.transform(zs, lambda z: two(z["gap"]["n"] + z["all"]["n"], z["gap"]["b"] + z["all"]["b"])), two(F.lit(0), F.lit(0)), lambda a, x: two(a["n"] + x["n"], a["b"] + x["b"]))

    def span(z: Column, at: Column) -> Column:
        start, first = at["n"] + z["gap"]["n"], at["b"] + z["gap"]["b"]
        own = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + z["all"]["n"]).alias("end"), first.alias("first"), (first + z["all"]["b"]).alias("last"))
        return F.when(z["part"] >= kind.least, own)

    placed = let(zipped, lambda zs: F.zip_with(zs, before(zs), span))
    needed = reduce(or_, (text.contains(x) for x in kind.needs), F.lit(not kind.needs))
    return F.when(needed & text.rlike(kind.sign), F.coalesce(F.filter(placed, lambda s: s.isNotNull()), F.array().cast(SPAN))).otherwise(F.array().cast(SPAN))


def parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `_base` and `_weak` (spans in order) and `_key`, the digest of texts that may have parts to link, else null."""
    numbered = list(enumerate(KINDS))
    t = text_or_empty(text)
    found = docs.withColumns({f"_{k.name}": spans(t, i, k) for i, k in numbered})
    both = lambda kinds: F.array_sort(F.concat(*(F.col(f"_{k.name}") for k in kinds)))
    found = found.withColumns({"_base": both(BASE), "_weak": both(WEAK)}).drop(*(f"_{k.name}" for k in KINDS))
    linked = (F.size("_weak") > 0) & (F.size("_base") + F.size("_weak") > 1)
    return found.withColumn("_key", F.when(linked, F.sha2(t, 256)))


def links(some: DataFrame, reach: int = REACH) -> DataFrame:
    """_key and `_linked`, the weak spans that have a complementary part within reach, for each text that has any.

    Each span comes with `to`, the parts it is linked to. Equal texts are linked once. The join meets parts of one
    text in one bucket of positions, merged, as Spark sizes buckets as if each part had one.
    """
    role = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(k.role))))
    needs = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(COMPLEMENT[k.role]))))
    strong = [i for i, k in enumerate(KINDS) if k.strong]
    texts = some.select("_key", "_base", "_weak").dropDuplicates(["_key"])
    width = 4 * reach
    buckets = lambda low, high: F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / width), F.floor(high / width)))
    weak = texts.select("_key", F.explode("_weak").alias("w"))
    weak = weak.select("_key", "w", buckets(F.col("w.start") - reach, F.col("w.end") + reach).alias("_bucket"))
    part = texts.select("_key", F.explode(F.concat("_base", "_weak")).alias("p"))
    part = part.select(F.col("_key").alias("_text"), F.struct("p.start", "p.kind", "p.end").alias("p"), buckets(F.col("p.start"), F.col("p.end")).alias("_at"))
    near = (F.col("p.start") < F.col("w.end") + reach) & (F.col("p.end") > F.col("w.start") - reach)
    fits = (needs[F.col("w.kind")] == role[F.col("p.kind")]) & ((role[F.col("w.kind")] != "endpoint") | F.col("p.kind").isin(strong))
    met = weak.join(part.hint("merge"), (F.col("_key") == F.col("_text")) & (F.col("_bucket") == F.col("_at")) & near & fits)
    each = met.groupBy("_key", "w").agg(F.array_sort(F.collect_set("p")).alias("to"))
    return each.groupBy("_key").agg(F.collect_list(F.struct("w.start", "w.kind", "w.end", "w.first", "w.last", "to")).cast(LINKED).alias("_linked"))


def with_links(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Rows of `parts` (written) with `_linked` and `_spans` in place of `_key` and `_weak`. Only rows with a key are shuffled."""
    some, none = found.where(F.col("_key").isNotNull()), F.array().cast(LINKED)
    met = some.join(links(some, reach), "_key", "left").withColumn("_linked", F.array_sort(F.coalesce("_linked", none)))
    own = F.transform("_linked", lambda s: s.dropFields("to"))
    met = met.withColumn("_spans", F.array_sort(F.concat("_base", own)))
    rest = found.where(F.col("_key").isNull()).withColumns({"_linked": none, "_spans": F.col("_base")})
    return rest.unionByName(met).drop("_key", "_weak")


def scanned(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """`docs` without its text, with `_base` (base spans), `_spans` (base and linked spans) and `_linked` (linked spans with what they are linked to).

    All are in order of start, then kind. A null or empty text has no spans; repeated rows each keep theirs. Columns of
    `docs` named like these, or `_weak` or `_key`, are replaced. The patterns run once: their spans are written.
    """
    return with_links(written(parts(docs, text).drop(text), "spans"), reach)


def written_out(of: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    name = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(k.name))))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and links of every row.

    `links` says of each weak span what it is linked to, as kind:start:end>kind:start:end|..., comma-joined. Null and
    empty texts have no spans, repeated rows each get their own result, other columns of `docs` play no part.
    """
    count = lambda i: F.size(F.filter("_base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i].name}")
    found = scanned(docs.select("doc_id", "text"))
    name = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(k.name))))
    one = lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    to = F.array_join(F.transform("_linked", lambda s: F.concat(one(s), F.lit(">"), F.array_join(F.transform(s["to"], one), "|"))), ",")
    return found.select("doc_id", *(count(i) for i in range(len(BASE))), F.sha2(written_out(F.col("_base")), 256).alias("base_sha256"), written_out(F.col("_spans")).alias("spans"), to.alias("links"))


def replaced(text: Column, found: Column, mask: str) -> Column:
    """The text with its spans (in order), overlapping ones as one, replaced by the mask; a text without spans stays as it is."""
    ends = running(F.transform(found, lambda s: s["last"]), F.lit(-1), lambda a, x: F.greatest(a, x))
    zipped = F.zip_with(found, ends, lambda s, before: F.struct(s["first"].alias("first"), before.alias("before")))
    begun = F.filter(zipped, lambda z: z["first"] >= z["before"])  # a span that begins in no earlier one
    starts = lambda xs: F.concat(F.transform(xs, lambda x: x["first"]), F.array(F.octet_length(text)))
    stops = lambda xs: F.concat(F.array(F.lit(0)), F.transform(F.slice(xs, F.lit(2), F.size(xs)), lambda x: x["before"]), F.array(F.array_max(F.transform(found, lambda s: s["last"]))))
    gaps = lambda xs: F.zip_with(stops(xs), starts(xs), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = lambda data: F.transform(let(begun, gaps), lambda g: F.decode(F.substring(data, g["a"] + 1, g["b"] - g["a"]), "UTF-8"))
    return F.when(F.size(found) > 0, F.array_join(let(F.encode(text, "UTF-8"), kept), mask)).otherwise(text)


def masked(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """`docs` with every reported span, overlapping ones merged, replaced by `mask` in the text.

    Texts without spans stay as they are, nulls included; all rows and columns stay, whatever their names. Texts that
    have nothing to link are masked while they are read; the others are written with their spans and masked after linking.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).cast("string").alias("text"))
    found = parts(held, "text")
    now = F.when(F.col("_key").isNull(), replaced(F.col("text"), F.col("_base"), mask)).otherwise(F.col("text"))
    mine = lambda c: F.when(F.col("_key").isNotNull(), F.col(c)).alias(c)
    stored = written(found.select(F.col("row").withField(f"`{text}`", now).alias("row"), "_key", mine("_base"), mine("_weak")), "masked")
    ready = stored.where(F.col("_key").isNull()).select("row.*")
    late = with_links(stored.where(F.col("_key").isNotNull()))
    late = late.select(F.col("row").withField(f"`{text}`", replaced(F.col(f"row.`{text}`"), F.col("_spans"), mask)).alias("row"))
    return ready.unionByName(late.select("row.*"))
