"""Sharding by rendezvous hashing over weighted shards, with gapless slots inside each shard.

A record key and a shard name decide a score; the record goes to the shard of the highest score.
Adding a shard only moves the records whose highest score is the new shard's, all of them into it.

The slots are numbered in two levels, so that no shard's rows meet in one task: rows are dealt into
bins by a hash of key and content, numbered inside each bin, and each bin's first slot is the running
sum of the bin counts before it. Only the counts, one row per bin, are summed in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_bytes

#: Bins for each shard: at 8 shards, a billion rows give bins of about 30,000 rows.
BINS = 4096


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Rendezvous score of a key for a shard: -weight / ln(u), u in (0, 1) from 52 bits of an MD5."""
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}"))), 1, 13), 16, 10)
    u = (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a key over shards of these weights; null keys count as the empty string."""
    best = F.greatest(*(F.struct(score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)))
    return (-best["i"]).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] = (), shard: str = "shard", grown_shard: str = "grown_shard") -> DataFrame:
    """`df` with its shard; with `grown` (weights of shards to add) also the shard after growing. No shuffle.

    Null keys share one shard. Rows with equal keys get equal shards. Columns of `df` named like the
    results are replaced.
    """
    out = df.withColumn(shard, rendezvous(F.col(key), weights))
    if grown:
        out = out.withColumn(grown_shard, rendezvous(F.col(key), [*weights, *grown]))
    return out


def with_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", bins: int = BINS) -> DataFrame:
    """`df` with `slot`, the row's gapless number from 0 inside its shard.

    `order` names the columns that tell rows apart; rows equal in all of them are interchangeable.
    One shuffle of the rows by (shard, bin); the bin counts reuse it and are at most `bins` rows a shard.
    """
    cols = [F.col(c) for c in order]
    told = F.md5(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)))
    dealt = df.withColumn("_bin", (F.conv(F.substring(told, 1, 8), 16, 10).cast("bigint") % bins).cast("int"))
    numbered = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(shard, "_bin").orderBy(*cols)))
    counts = dealt.groupBy(F.col(shard).alias("_shard"), F.col("_bin").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_shard").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("_shard", "_of", F.coalesce(before, F.lit(0)).alias("_first"))
    met = numbered.join(first, (F.col(shard) == F.col("_shard")) & (F.col("_bin") == F.col("_of")))
    return met.withColumn(slot, (F.col("_first") + F.col("_in") - 1).cast("long")).drop("_bin", "_in", "_shard", "_of", "_first")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, by the `key` law.

    Null texts have size 1 and the checksum of no bytes; null ids share a shard; repeated rows each get a slot.
    The text is reduced to its size and checksum before anything is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select("doc_id", (n_bytes(text) + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = with_slots(assign(slim, "doc_id", [1.0] * shards, [1.0]), "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
