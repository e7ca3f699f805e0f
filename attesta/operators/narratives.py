"""Narratives that are told again in nearly the same words: banded MinHash finds candidates, whole sets decide.

Texts are sets of hashed word shingles. Equal sets are one item from the start, however many texts have them. Items
that share a band meet: first each with the least item of the band, then, where a band still holds items of several
clusters, those across clusters only. So a large group of copies costs a comparison an item, not one a pair.

A set is larger than its text's share of a file, so sets are not kept: bands, names and sizes are, and the sets of the
items that meet are made again from their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .networks import components

Checkpoint = Callable[[DataFrame], DataFrame]
#: Bands and minima to a band: a pair of similarity 0.7 misses all 40 bands of three with probability 5e-8, one of 0.1 meets with 0.04.
BANDS, MINIMA = 40, 3
#: Parts in which bands are shuffled, one after the other, and items whose texts are found by a broadcast of hashes of their keys; beyond, texts are shuffled by these.
PARTS, TOLD = 4, 1_000_000


def tokens(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of the different runs of `size` words, sorted; fewer words are one run, none have none."""
    count = F.greatest(F.size(words) - size + 1, F.lit(0))
    # Shifted copies side by side: slices of `words` inside a lambda would be as many as there are words, each a copy.
    runs = F.transform(F.arrays_zip(*(F.slice(words, k + 1, count).alias(f"w{k}") for k in range(size))), lambda z: F.xxhash64(F.concat_ws(" ", *(z[f"w{k}"] for k in range(size)))))
    short = F.filter(F.array(F.when(F.size(words) > 0, F.xxhash64(F.array_join(words, " ")))), lambda h: h.isNotNull())
    return F.array_sort(F.array_distinct(F.when(F.size(words) < size, short).otherwise(runs)))


def bands(sets: Column, count: int = BANDS, minima: int = MINIMA, seed: int = 1) -> Column:
    """The digest of each band of a set's minima, as an array."""
    r = np.random.default_rng(seed)
    odd, add = r.integers(1, 1 << 63, count * minima, np.uint64) | np.uint64(1), r.integers(0, 1 << 63, count * minima, np.uint64)

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out = []
            for values in column:
                least = np.full(count * minima, np.iinfo(np.uint64).max, np.uint64)
                hashes = np.asarray(values, np.int64).view(np.uint64)
                for at in range(0, len(hashes), 4096):
                    mixed = hashes[at : at + 4096, None] * odd + add
                    least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
                rows = least.reshape(count, minima)
                digest = np.zeros(count, np.uint64)
                for k in range(minima):
                    digest = (digest ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                out.append(digest.view(np.int64))
            yield pd.Series(out)

    return run(sets)


def _sets(df: DataFrame, size: int) -> DataFrame:
    """(key, grams): the sets of the texts (key, text) that have words."""
    once = lambda c, name: F.explode(F.array(c)).alias(name)  # noqa: E731  a row each, so that no later use of the column computes it again
    return df.select("key", once(tokens(F.col("text")), "words")).select("key", once(shingles(F.col("words"), size), "grams")).where(F.size("grams") > 0)


def _named(grams: str = "grams") -> list[Column]:
    """A set's name, 128 bits, without making a string of it."""
    return [F.xxhash64(grams).alias("h"), F.xxhash64(F.lit(1), grams).alias("h2")]


def _similar(pairs: DataFrame, items: DataFrame, df: DataFrame, size: int, least: float, checkpoint: Checkpoint) -> DataFrame:
    """The pairs (a, b) of Jaccard similarity `least` or more, by whole sets, which are made again from the texts (key, text)."""
    short = checkpoint(pairs.where(F.least("na", "nb") >= F.greatest("na", "nb") * least).select("a", "b").distinct())
    ends = short.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    wanted = checkpoint(items.select("item", "h", "h2").join(ends, "item", "left_semi"))
    keys = wanted.select(F.xxhash64("item").alias("_key")).distinct()
    keys = F.broadcast(keys) if wanted.limit(TOLD + 1).count() <= TOLD else keys.hint("merge")
    texts = df.withColumn("_key", F.xxhash64("key")).join(keys, "_key", "left_semi")
    found = _sets(texts, size).select(*_named(), "grams").join(wanted, ["h", "h2"]).groupBy("h", "h2").agg(F.first("item").alias("item"), F.first("grams").alias("grams"))
    sets = checkpoint(found.select("item", "grams"))
    own = lambda c: sets.select(F.col("item").alias(c), F.col("grams").alias(f"_{c}")).hint("merge")
    both = short.join(own("a"), "a").join(own("b"), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return checkpoint(both.where(shared >= least * (F.size("_a") + F.size("_b") - shared)).select("a", "b"))


def clusters(df: DataFrame, key: str, text: str, least: float = 0.7, size: int = 3, checkpoint: Checkpoint = lambda df: df.checkpoint()) -> DataFrame:
    """(key, cluster, members) of the texts that are nearly told again elsewhere: cluster is the least key reachable by similar pairs.

    Null texts and texts without words are compared with nothing. Keys that are null or repeated count as one text each.
    `df` is read three times.
    """
    df = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    told = checkpoint(_sets(df, size).select("key", *_named(), F.size("grams").alias("n"), bands(F.col("grams")).alias("bands")))
    items = checkpoint(told.groupBy("h", "h2").agg(F.min("key").alias("item"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    parts = []
    for k in range(PARTS):
        some = F.filter(F.transform("bands", lambda v, i: F.when(i % PARTS == k, F.xxhash64(i, v))), lambda v: v.isNotNull())
        placed = items.select("item", "n", F.explode(some).alias("band"))
        full = placed.groupBy("band").agg(F.min(F.struct("item", "n")).alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1")
        # Both sides merge: Spark sizes them as if each item had one band.
        parts.append(checkpoint(placed.join(full.drop("size").hint("merge"), "band").select("band", "item", "n", "center")))
    met = reduce(DataFrame.unionByName, parts)
    near = met.where("item <> center.item").select(F.col("center.item").alias("a"), F.col("item").alias("b"), F.col("center.n").alias("na"), F.col("n").alias("nb"))
    first = _similar(near, items, df, size, least, checkpoint)
    sofar = components(first, "a", "b", checkpoint)
    # Pairs across clusters only: in most bands all items are in one by now, and those are left out before the join.
    known = met.join(sofar.select(F.col("node").alias("item"), "component"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    spread = Window.partitionBy("band")
    open_ = known.withColumns({"_least": F.min("component").over(spread), "_most": F.max("component").over(spread)}).where("_least <> _most")
    one = open_.select("band", F.col("item").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    two = open_.select("band", F.col("item").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    across = one.join(two, "band").where("a < b and ca <> cb").select("a", "b", "na", "nb")
    edges = first.unionByName(_similar(across, items, df, size, least, checkpoint))
    same = told.select("key", "h", "h2").distinct().join(items.select("h", "h2", "item"), ["h", "h2"]).select("key", "item")
    root = components(edges, "a", "b", checkpoint).select(F.col("node").alias("item"), "component")
    named = checkpoint(same.join(root, "item", "left").select("key", F.coalesce("component", "item").alias("cluster")))
    sizes = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return named.join(sizes, "cluster").select("key", "cluster", "members")
