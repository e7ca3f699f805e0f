"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared only where they meet at an anchor. The 64 bits are read in parts, and the anchors of a
part are the words of a Hamming code: [31, 26] for two parts, [21, 16] for three. Fingerprints that differ in
2 * parts - 1 bits or fewer differ in at most one bit of some part. There the nearest anchor of the one (its home,
within the covering radius) is the home of a point at distance 1 or less of the other. So each fingerprint goes to
its home and is replicated to the homes of all points at distance 1 or less, which are the anchors within covering
radius plus one that such a partner can have: 16 at most of two parts, 22 of three. Homes meet replicas at equal
anchors, so every link is found. A part has 2^26 or 2^16 anchors, so few other fingerprints meet.

Equal fingerprints are one node, so copies never form pairs. Within 2 bits a fingerprint has 2,080 links at most,
so these are joined as pairs; for more bits the anchors' fingerprints are compared as arrays (`ties`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import bloom, checkpointed, maybe, text_or_empty, written
from .components import components

SEED = 42
#: Bits in which linked fingerprints may differ: of the contract, and of the deduplication by five-word shingles.
THRESHOLD, LOOSE = 2, 5
#: Shingles hashed at once, so that a long text needs bounded memory.
BLOCK = 1 << 18
#: Expected fingerprints in a chunk of an anchor's homes and replicas, and pairs compared at once.
HOMES, REPLICAS, COMPARED = 4096, 16384, 1 << 19


def fingerprint(text: str, words: int) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 for a text without words."""
    found = text.encode().lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not found:
        return 0
    if len(found) <= words:
        h = xxhash.xxh64_intdigest(b" ".join(found), SEED)
        return h - (1 << 64) if h >> 63 else h
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """The 64-bit fingerprint of each text as bigint; null counts as empty."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: fingerprint(t, words)).astype("int64")

    return of(text)


def syndrome(part: Column, length: int) -> Column:
    """The Hamming syndrome of the part's bits: the exclusive or of the positions (from 1) of set bits; 0 at an anchor."""
    masks = [sum(1 << (p - 1) for p in range(1, length + 1) if p >> b & 1) for b in range(5)]
    return sum((F.bit_count(part.bitwiseAND(F.lit(m))) % 2 * (1 << b) for b, m in enumerate(masks)), F.lit(0))


def leaders(length: int) -> Column:
    """By syndrome, the fewest bits to flip to reach an anchor: none, one, or two where the code is shortened."""
    bit = [0] + [1 << (p - 1) for p in range(1, length + 1)]
    two = lambda s: next(bit[p] | bit[p ^ s] for p in range(1, length + 1) if 0 < p ^ s <= length)
    return F.array(*(F.lit(bit[s] if s <= length else two(s)).cast("bigint") for s in range(32)))


def anchors(fp: Column, parts: int) -> Column:
    """array<struct<part, home, near>>: the home of each part and the anchors to which the fingerprint is replicated."""
    width = 64 // parts
    length = min(width, 31)
    bits = F.array(*(F.struct(F.lit(i).alias("part"), F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << length) - 1)).alias("x")) for i in range(parts)))
    each = F.transform(bits, lambda b: F.struct(b["part"].alias("part"), b["x"].alias("x"), syndrome(b["x"], length).alias("s")))
    leader = leaders(length)
    flips = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(1 << (i - 1) if i else 0).cast("bigint").alias("bit")) for i in range(length + 1)))
    to = lambda e: F.transform(flips, lambda f: e["x"].bitwiseXOR(f["bit"]).bitwiseXOR(F.get(leader, e["s"].bitwiseXOR(f["i"]))))
    return F.transform(each, lambda e: F.struct(e["part"].alias("part"), e["x"].bitwiseXOR(F.get(leader, e["s"])).alias("home"), F.array_distinct(to(e)).alias("near")))


def edges(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(x, y): pairs of different fingerprints of the column `fp` (distinct) that differ in `threshold` (5 at most) bits or fewer.

    Both sides are merged: Spark sizes what comes after an explode as if each row gave one, 32 or more times too low, and would broadcast it.
    """
    if not 0 < threshold <= 5:
        raise ValueError("the codes cover fingerprints that differ in 1 to 5 bits")
    each = fps.select("fp", F.explode(anchors(F.col("fp"), 2 if threshold <= 3 else 3)).alias("a"))
    home = each.select("a.part", F.col("a.home").alias("anchor"), F.col("fp").alias("x"))
    near = each.select("a.part", F.explode("a.near").alias("anchor"), F.col("fp").alias("y"))
    close = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= threshold
    return home.join(near.hint("merge"), ["part", "anchor"]).where((F.col("x") != F.col("y")) & close).select("x", "y")


def tied(homes: np.ndarray, near: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (larger, smaller) that connect what the links between two sets of fingerprints connect: the links themselves, or fewer where they are many."""
    xs, ys = [], []
    step = max(1, COMPARED // max(1, len(near)))
    for at in range(0, len(homes), step):
        part = homes[at : at + step]
        apart = np.bitwise_count((part[:, None] ^ near[None, :]).view(np.uint64))
        i, j = np.nonzero((apart > 0) & (apart <= threshold))
        if not len(i):
            continue
        x, y = np.maximum(part[i], near[j]), np.minimum(part[i], near[j])
        nodes = np.unique(np.concatenate((x, y)))
        if len(x) >= len(nodes):  # every node to the least one it is connected to
            a, b = np.searchsorted(nodes, x), np.searchsorted(nodes, y)
            label, before = np.arange(len(nodes)), None
            while before is None or (label != before).any():
                before = label.copy()
                least = np.minimum(label[a], label[b])
                np.minimum.at(label, a, least)
                np.minimum.at(label, b, least)
                label = label[label]
            x, y = nodes, nodes[label]
            x, y = x[x != y], y[x != y]
        xs.append(x)
        ys.append(y)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys])


def ties(fps: DataFrame, threshold: int = LOOSE) -> DataFrame:
    """(x, y): pairs with the same components as `edges`, but no more rows for an anchor than fingerprints meet there.

    Within 5 bits a fingerprint can have millions of links. So the fingerprints of an anchor are compared as arrays
    and only what connects them is returned. Large anchors are salted: their homes and replicas are dealt into chunks
    by a hash, and every chunk of homes meets every chunk of replicas. The sizes of anchors that set the number of
    chunks are broadcast: three parts have 3 * 2^16 anchors at most.
    """
    parts = 3
    each = fps.select("fp", F.explode(anchors(F.col("fp"), parts)).alias("a"))
    all_near = each.select("a.part", F.explode("a.near").alias("anchor"), "a.home", "fp")
    sizes = all_near.groupBy("part", "anchor").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("home") == F.col("anchor")).cast("long")).alias("m"))
    sizes = sizes.where("m > 0 and n > 1").select("part", "anchor", F.ceil(F.col("m") / HOMES).alias("m"), F.ceil(F.col("n") / REPLICAS).alias("n"))
    dealt = all_near.join(F.broadcast(sizes), ["part", "anchor"])
    salt = lambda k: F.pmod(F.xxhash64("fp"), F.col(k))
    home = dealt.where("home = anchor").groupBy("part", "anchor", salt("m").alias("chunk")).agg(F.collect_list("fp").alias("homes"))
    near = dealt.groupBy("part", "anchor", "m", salt("n").alias("other")).agg(F.collect_list("fp").alias("near"))
    near = near.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    met = home.join(near.hint("merge"), ["part", "anchor", "chunk"]).select("homes", "near")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tied(h, n, threshold) for h, n in zip(batch["homes"], batch["near"], strict=True)]
            none = np.zeros(0, np.int64)
            yield pd.DataFrame({"x": np.concatenate([none, *(x for x, _ in found)]), "y": np.concatenate([none, *(y for _, y in found)])})

    return met.mapInPandas(run, "x bigint, y bigint").distinct()


def hexadecimal(fp: Column) -> Column:
    """A bigint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def clustered(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """`key`, `fp` and `component_id`, the least key among the rows whose fingerprints are linked, for every row.

    A text without words (null, empty, white space) has fingerprint 0 and is linked like any other. Rows with a
    null key take part, but null is a component's id only where it has no other key. Repeated rows stay.
    """
    own = written(docs.select(F.col(key), fingerprints(text_or_empty(text), words).alias("fp")), "fingerprints")
    least = own.groupBy("fp").agg(F.min(key).alias("least"))
    linked = checkpointed(edges(least.select("fp"), threshold) if threshold <= 3 else ties(least.select("fp"), threshold))
    root = components(linked, "x", "y").withColumnRenamed("x", "fp")
    labelled = least.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return own.join(by_fp, "fp")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row, by 3-word shingles and 2 bits."""
    found = clustered(docs.select("doc_id", "text"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """The rows of `docs` that stay: of each component the row of the least key, once if that row is repeated.

    Texts of linked fingerprints are compared first, then all others that may be similar enough; what links them is the exact similarity of their shingles (`similar`). Texts without words
    are one component. Rows with a null key can't be named and all stay. Only rows whose keys go or are repeated, and
    a few that a Bloom filter takes for such, are shuffled; all others pass as they are read, at every size.
    """
    marked = written(similar.judged(docs, fingerprint, edges, key, text, words).where("rows <> 1"), "marked")
    found = maybe(bloom(marked.select(key), key), key)
    hit = docs.where(found)
    others = hit.join(marked.select(key).hint("merge"), key, "left_anti")
    repeated = hit.join(marked.where("rows > 1").select(key).hint("merge"), key, "left_semi").dropDuplicates([key])
    return docs.where(~found).unionByName(others.select(docs.columns)).unionByName(repeated.select(docs.columns))
