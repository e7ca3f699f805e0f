"""Helpers shared by the training-data operators: inputs, the shared folder, byte strings."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of keys that may be broadcast: some tens of MB.
TOLD = 1_000_000
#: A Bloom filter's bits for each key, as powers of two: at least so many, at most so many (128 MB), and in one piece of it.
BITS, MOST_BITS, PIECE = 16, 30, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a DataFrame."""
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 16 << 20) -> SparkSession:
    """Bounds the rows and bytes of an Arrow batch of whole texts, unless the session already sets smaller ones."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests), else an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="attesta-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder. Adaptive execution sizes its partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read back, so several consumers share one computation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attesta-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attesta_path = path
    return out


def deleted(df: DataFrame) -> None:
    """Deletes what `written` wrote for `df`. Everything that is read from it must be written by now."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._attesta_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def told(keys: DataFrame, most: int = TOLD) -> DataFrame:
    """`keys` (a few numbers a row, already written) marked for a broadcast if they are at most `most` rows; beyond, Spark shuffles both sides of the join."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys.hint("merge")


def bloom(keys: DataFrame, key: str) -> Broadcast:
    """A broadcast Bloom filter of the column `key` (already written), for `maybe`. About 1.4 % of other keys pass.

    Beyond 67 million keys the filter stays at 128 MB, and more of the others pass: results don't depend on it.
    """
    spark = keys.sparkSession
    size = 1 << min(MOST_BITS, max(PIECE, (BITS * keys.count() - 1).bit_length()))
    h = F.xxhash64(key)
    at = F.array(h.bitwiseAND(F.lit(size - 1).cast("bigint")), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1).cast("bigint")))
    ones = keys.select(F.explode(at).alias("at")).distinct().withColumn("piece", F.shiftright("at", PIECE))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << PIECE, np.uint8)
        bits[part["at"].to_numpy() & ((1 << PIECE) - 1)] = 1
        return pd.DataFrame({"piece": part["piece"][:1].to_numpy(), "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(size >> 3, np.uint8)
    # The iterator runs a job a partition: no more of them than pieces.
    for r in ones.groupBy("piece").applyInPandas(packed, "piece bigint, bits binary").coalesce(size >> PIECE).toLocalIterator():
        out[r.piece << PIECE - 3 : r.piece + 1 << PIECE - 3] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(out)


def maybe(bits: Broadcast, key: str) -> Column:
    """Whether the column `key` may be among a Bloom filter's keys: true for all of them and for a few others. Only hashes of keys reach Python."""

    @F.pandas_udf("boolean")
    def of(h: pd.Series) -> pd.Series:
        h, bit = h.to_numpy(np.int64).view(np.uint64), bits.value
        found = np.ones(len(h), bool)
        for at in (h, h >> np.uint64(32)):
            at = at & np.uint64(8 * len(bit) - 1)
            found &= (bit[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return pd.Series(found)

    return of(F.xxhash64(key))


def text_or_empty(name: str = "text") -> Column:
    """The text column, null taken as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_bytes(c: Column) -> Column:
    """Bytes of a string in UTF-8."""
    return F.octet_length(c).cast("long")
