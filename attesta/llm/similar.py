"""Near-duplicates by the exact Jaccard similarity of texts' word shingles, found by a lossless prefix filter.

A text is its set of shingle hashes, and equal sets are one node. All shingles are put in one order, frequent ones
last. Two sets of similarity 0.8 or more then share one of the first n - ceil(0.8 n) + 1 shingles of each (the
prefix), so sets are candidates where prefixes meet. Any order loses nothing: the frequent shingles may be
estimated from a sample, and their number is bounded.

Before two sets are compared, their sketches are: the parity of the number of hashes in each of 1,024 buckets, and
for larger sets also in about as many buckets as hashes. Bits in which sketches differ are at most the shingles in which the sets differ, and two sets of similarity 0.8 or more
differ in a ninth of their sizes' sum at most. So pairs beyond that are left out without loss, and whole texts are
read again only for pairs that are left. These are confirmed on all 64-bit hashes.

A group of many copies is not compared pair by pair. First nodes whose fingerprints are linked (operator 5) are compared,
and what is confirmed becomes a component. Then only pairs of different components are compared: each node with one node
of each of its shingles, up to three times with another choice, while that leaves pairs enough to be worth a round, and
at last all that remain, by their sketches within the join.
No pair of 0.8 or more ends in two components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom, checkpointed, deleted, maybe, small_batches, text_or_empty, written
from .components import components

SEED = 42
#: The least similarity of linked texts, as a fraction; its share of the two sizes' sum that must be common.
LEAST = (4, 5)
#: One text in so many is read for the frequent shingles; a shingle is frequent from so many of these on; so many are kept.
SAMPLED, FREQUENT, KEPT = 16, 8, 200_000
#: Rounds, at most, in which each node is compared with another choice of one node for each of its shingles, before all remaining pairs are.
#: A round that has fewer than one pair to so many rows left is not worth its jobs: all remaining pairs are compared at once.
ROUNDS, WORTH = 3, 100
#: 64-bit words of a sketch (longer ones by powers of two); nodes of a shingle whose pairs one task compares.
SKETCH, NODES = 16, 4096


def shingles(text: str, words: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted; words as in `simhash.fingerprint`. A shorter text is one shingle, a text without words none."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.int64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    last = max(1, len(found) - words + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:last].tolist()
    digest = xxhash.xxh64_intdigest
    part = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[min(words, len(found)) - 1 :].tolist(), strict=True)]
    return np.unique(np.array(part, np.uint64).view(np.int64))


def named(found: np.ndarray) -> int:
    """A set's name: a 64-bit digest of its hashes."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def frequent(docs: DataFrame, key: str, text: str, words: int) -> pd.DataFrame:
    """(shingle, n): the most frequent shingles of a sample of the texts, sorted by shingle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [shingles(t, words) for t in batch["text"]]
            h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *each]), return_counts=True)
            yield pd.DataFrame({"shingle": h, "n": n})

    some = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(SAMPLED)) == 0).select(text_or_empty(text).alias("text"))
    counts = some.mapInPandas(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return counts.orderBy(F.desc("n"), "shingle").limit(KEPT).toPandas().sort_values("shingle")


def prefix(found: np.ndarray, common: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 hashes in the order of (frequency, hash)."""
    if not len(found):
        return found
    seen = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        seen = np.where(common[at] == found, n[at], 0)
    over, under = LEAST
    return found[np.lexsort((found, seen))[: len(found) + (-over * len(found) // under) + 1]]


def sketch(found: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """The parity of the number of hashes in each bucket, as 64-bit words. Halves of a sketch, taken exclusive or, are the sketch of half as many words."""
    odd = np.bincount((found.view(np.uint64) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def longer(found: np.ndarray) -> np.ndarray | None:
    """A sketch of at least as many buckets as hashes, a power of two; None where the first sketch has that many."""
    return sketch(found, 1 << (len(found) - 1 >> 6).bit_length()) if len(found) > 64 * SKETCH else None


def after(n: str) -> Column:
    """How many shingles of a set of this size are not in its prefix."""
    over, under = LEAST
    return F.ceil(F.col(n) * over / under) - 1


def signed(docs: DataFrame, key: str, text: str, words: int, fingerprint: Callable[[str, int], int]) -> DataFrame:
    """`key`, `node`, `fp`, `n`, `prefix`, `sketch` and `longer` of every row."""
    top = frequent(docs, key, text, words)
    known = docs.sparkSession.sparkContext.broadcast((top["shingle"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    @F.pandas_udf("node bigint, fp bigint, n int, prefix array<bigint>, sketch array<bigint>, longer array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [shingles(t, words) for t in batch]
            yield pd.DataFrame({"node": np.array([named(s) for s in each], np.int64), "fp": np.array([fingerprint(t, words) for t in batch], np.int64), "n": np.array([len(s) for s in each], np.int32), "prefix": pd.Series([prefix(s, *known.value) for s in each], dtype=object), "sketch": pd.Series([sketch(s) for s in each], dtype=object), "longer": pd.Series([longer(s) for s in each], dtype=object)})

    return docs.select(F.col(key), of.asNondeterministic()(text_or_empty(text)).alias("s")).select(key, "s.*")


def fitting(n: str, m: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    over, under = LEAST
    return under * F.least(n, m) >= over * F.greatest(n, m)


def near(n: str, m: str, a: str, b: str, long_a: str, long_b: str) -> Column:
    """Whether sets of these sizes and sketches can be similar enough. Longer sketches are looked at where both have one."""
    over, under = LEAST
    most = (under - over) * (F.col(n) + F.col(m))
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    words = F.least(F.size(long_a), F.size(long_b))
    xor = lambda x, y: x.bitwiseXOR(y)
    # Sets of fitting sizes have sketches of equal length, or one of twice the other's.
    fold = lambda c: F.when(F.size(c) > words, F.zip_with(F.slice(c, 1, words), F.slice(c, words + 1, words), xor)).otherwise(F.col(c))
    far = F.aggregate(F.zip_with(fold(long_a), fold(long_b), xor), F.lit(0), lambda t, x: t + F.bit_count(x))
    some = F.col(long_a).isNull() | F.col(long_b).isNull() | (F.greatest(F.size(long_a), F.size(long_b)) > 2 * words)
    return ((over + under) * apart <= most) & (some | ((over + under) * far <= most))


def whole_sets(texts: DataFrame, nodes: DataFrame, text: str, words: int) -> DataFrame:
    """(node, n, set) of the given nodes, which are among the sets of the given texts: the set's size and hashes. No text is shuffled."""

    @F.pandas_udf("node bigint, n int, set array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [shingles(t, words) for t in batch]
            yield pd.DataFrame({"node": np.array([named(s) for s in each], np.int64), "n": np.array([len(s) for s in each], np.int32), "set": pd.Series(each, dtype=object)})

    sets = texts.select(of.asNondeterministic()(text_or_empty(text)).alias("s")).select("s.*")
    return sets.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) of nodes whose sets are similar enough. Sets, like sketches below, are merged: files of near copies are a small part of what they hold, and Spark would broadcast them by the files' size."""
    one = sets.select(F.col("node").alias("x"), F.col("n").alias("_n"), F.col("set").alias("_a"))
    other = sets.select(F.col("node").alias("y"), F.col("n").alias("_m"), F.col("set").alias("_b"))
    over, under = LEAST
    alike = (over + under) * F.size(F.array_intersect("_a", "_b")) >= over * (F.col("_n") + F.col("_m"))
    return checkpointed(pairs.join(one.hint("merge"), "x").join(other.hint("merge"), "y").where(alike).select("x", "y"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def close(own: DataFrame, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(x, y): pairs of nodes by their fingerprints: each node with the least one of its fingerprint, and the least ones of linked fingerprints."""
    marks = own.select("node", "fp").distinct()
    least = marks.groupBy("fp").agg(F.min("node").alias("x"))
    same = marks.join(least, "fp").where("node <> x").select("x", F.col("node").alias("y"))
    of = lambda fp, node: least.select(F.col("fp").alias(fp), F.col("x").alias(node))
    met = edges(least.select("fp")).withColumnsRenamed({"x": "_f", "y": "_g"}).join(of("_f", "x"), "_f").join(of("_g", "y"), "_g")
    return same.unionByName(met.select("x", "y"))


def linked(own: DataFrame, docs: DataFrame, key: str, text: str, words: int, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root): the nodes that have links, with the least node of their component."""
    each = own.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).select("node", "n", F.explode("prefix").alias("shingle"))
    slim = written(own.groupBy("node").agg(F.min(key).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("longer").alias("longer")), "sketches")
    # Summed and joined back instead of a window: a shingle that very many sets have is then no single task.
    several = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = written(each.join(several.select("shingle"), "shingle"), "met")

    def sketched(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) whose sketches are close enough."""
        one = slim.select(F.col("node").alias("x"), F.col("n").alias("_n"), F.col("sketch").alias("_a"), F.col("longer").alias("_c"))
        other = slim.select(F.col("node").alias("y"), F.col("n").alias("_m"), F.col("sketch").alias("_b"), F.col("longer").alias("_d"))
        return pairs.join(one.hint("merge"), "x").join(other.hint("merge"), "y").where(near("_n", "_m", "_a", "_b", "_c", "_d")).select("x", "y")

    def check(pairs: DataFrame) -> DataFrame:
        """The (written) pairs (x, y) that are links. Their texts are read again."""
        wanted = written(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(slim.select("node", "least"), "node"), "wanted")
        # Written, so that a task runs one Python worker: first for the filter, then for the sets.
        texts = written(docs.where(maybe(bloom(wanted, "least"), key)).select(text), "texts")
        sets = written(whole_sets(texts, wanted, text, words), "sets")
        deleted(texts)
        links = confirmed(pairs, sets)
        for done in (pairs, wanted, sets):
            deleted(done)
        return links

    links = check(written(sketched(ordered(close(own, edges))), "pairs"))

    def crossing(k: int) -> DataFrame:
        """Rows of `met` with their components, of shingles that lie in several."""
        root = components(links, "x", "y").withColumnRenamed("x", "node")
        now = met.select("shingle", "node", "n").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        other = F.xxhash64("node", "shingle", F.lit(k))  # another choice for each shingle
        centre = [F.min_by(c, other).alias(n) for c, n in (("node", "x"), ("n", "m"), ("root", "r"))]
        several = now.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"), *centre).where("low <> high").drop("low", "high")
        return written(now.join(several, "shingle"), "crossing")

    for k in range(ROUNDS + 1):
        passed = crossing(k)
        if k == ROUNDS:
            break
        tried = passed.where((F.col("root") != F.col("r")) & fitting("n", "m")).select("x", F.col("node").alias("y"))
        tried = written(sketched(ordered(tried)), "pairs")
        if tried.count() * WORTH < passed.count():
            deleted(tried)
            break
        links = checkpointed(links.unionByName(check(tried)))
        deleted(passed)
    # Pairs of a shingle are compared in parts: each of its nodes in one part, with copies of all in every part.
    now = passed.withColumn("parts", F.ceil(F.col("rows") / NODES)).join(slim.select("node", "sketch", "longer").hint("merge"), "node")
    one = now.select("shingle", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.col("node").alias("x"), "n", "root", F.col("sketch").alias("_a"), F.col("longer").alias("_c"))
    other = now.select("shingle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("sketch").alias("_b"), F.col("longer").alias("_d"))
    over, under = LEAST
    rest = one.join(other, ["shingle", "part"]).where((F.col("x") > F.col("y")) & (F.col("root") != F.col("other")) & fitting("n", "m") & near("n", "m", "_a", "_b", "_c", "_d"))
    rest = rest.groupBy("x", "y", "n", "m").agg(F.count(F.lit(1)).alias("shared"))
    enough = (over + under) * (F.col("shared") + F.greatest(after("n"), after("m"))) >= over * (F.col("n") + F.col("m"))
    links = links.unionByName(check(written(rest.where(enough).select("x", "y"), "pairs")))
    roots = components(links, "x", "y").withColumnRenamed("x", "node")
    for done in (met, slim, passed):
        deleted(done)
    return roots


def judged(docs: DataFrame, fingerprint: Callable[[str, int], int], edges: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """`key` and `rows`, how many of its rows are the least key of their component (1 for most keys), once for every key.

    `fingerprint` of a text and `edges` (x, y) of a column `fp` of fingerprints say which texts are compared first.
    Rows without a key don't take part. Null, empty and blank texts are one component. Repeated rows count each.
    """
    small_batches(docs.sparkSession, 250, 4 << 20)
    # A round's shuffles go when its result is written, not when the driver happens to collect garbage.
    docs.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    docs = docs.where(F.col(key).isNotNull()).select(key, text)
    own = written(signed(docs, key, text, words, fingerprint), "shingles")
    least = own.groupBy("node").agg(F.min(key).alias("least"))
    labelled = least.join(linked(own, docs, key, text, words, edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = labelled.join(ids, "root").select("node", "component_id")
    best = (F.col(key) == F.col("component_id")).cast("long")
    return own.select(key, "node").join(by_node, "node").groupBy(key).agg(F.sum(best).alias("rows"))
