"""Custody of data sets: one digest for a set of files of any size, by a Merkle tree over blocks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
#: Marks of a digest of data and of a digest of digests, so that neither can stand for the other.
LEAF, INNER = b"\0", b"\1"
#: What the text reader leaves out at the beginning of a file; endings of names of files that it unpacks; bytes of blocks that a task holds before it makes digests of them.
MARK, PACKED, AHEAD = b"\xef\xbb\xbf", (".gz", ".bz2", ".zst", ".deflate", ".snappy", ".lz4"), 1 << 20


def blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, i, digest): SHA-256 of each block of each file. A task reads a range of a file (spark.sql.files.maxPartitionBytes), however long the file is.

    The ranges are those of the text reader, which gives bytes as they are, cut at line feeds: from the lengths in each range
    follows where it begins, and blocks that lie in two ranges are put together. It leaves out a byte order mark at the
    beginning and doesn't tell whether the last line feed is there, but the files' sizes do. One piece without any line feed is
    read by one task (2 GB at most), and so are files whose names make the reader unpack them. Empty files are passed over.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0")
    names_ = {r.path: r.file for r in listed.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file")).collect()}
    packed = [p for p in names_ if p.endswith(PACKED)]
    plain = [p for p in names_ if not p.endswith(PACKED)] if packed else [path] * bool(names_)
    whole = spark.read.format("binaryFile").load(packed) if packed else listed.where("false")
    at = F.sequence(F.lit(0), F.ceil(F.col("length") / block) - 1)
    each = whole.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content", F.explode(at).alias("i"))
    digest = lambda data: F.unhex(F.sha2(F.concat(F.lit(LEAF), data), 256))
    out = each.select("file", F.col("i").cast("long").alias("i"), digest(F.expr(f"substring(content, cast(i * {block} + 1 as int), {block})")).alias("digest"))
    if not plain:
        return out
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(plain).select(F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("range"), "_metadata.*", F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data"))
    ranges = lines.groupBy("range", "file_path", "file_name", "file_size", "file_block_start").agg(F.sum(F.octet_length("data").cast("long")).alias("bytes")).collect()
    named = lambda r: unquote(r.file_name)  # noqa: E731  the reader's names have special signs escaped
    starts, marks, files = {}, [], {}
    for r in sorted(ranges, key=lambda r: (r.file_path, r.file_block_start)):
        files.setdefault(r.file_path, []).append(r)
    for own in files.values():
        now = 0
        if sum(r.bytes for r in own) < own[0].file_size:
            now = len(MARK)
            marks.append(named(own[0]))
        for r in own:
            starts[r.range] = (named(r), now, r.file_size)
            now += r.bytes
    # A file of a mark alone has no lines.
    place = lambda p: re.sub(":/+", ":/", p, count=1)
    have = {place(unquote(p)) for p in files}
    marks += [file for p, file in names_.items() if p not in packed and place(p) not in have]
    assert len(starts) == len(ranges)
    told = spark.sparkContext.broadcast(starts)

    def cut(file: str, start: int, data: bytes) -> Iterator[tuple]:
        """Rows of the blocks that these bytes lie in, from `start` of the file on; those from their beginning to their end are digests."""
        for i in range(start // block, -(-(start + len(data)) // block)):
            part = data[max(0, i * block - start) : (i + 1) * block - start]
            yield (file, i, None, None, hashlib.sha256(LEAF + part).digest()) if len(part) == block else (file, i, max(start, i * block), part, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, held = None, 0, []

        def rows(more: Iterator[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in more], schema=schema)

        def ended(data: bytes) -> Iterator[tuple]:
            file, start, size = told.value[last]
            return cut(file, start + now, data[: size - start - now])

        for batch in batches:
            of, data = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if of[a] != last:
                    if last is not None:
                        yield rows(ended(b"".join(held)))
                    last, now, held = int(of[a]), 0, []
                held.append(b"".join(data.slice(a, b - a).to_pylist()))
                _, start, _ = told.value[last]
                full = (start + now + sum(map(len, held))) // block * block - start - now  # up to the last end of a block
                if full > max(0, AHEAD - block):
                    every = b"".join(held)
                    yield rows(ended(every[:full]))
                    now, held = now + full, [every[full:]]
        if last is not None:
            yield rows(ended(b"".join(held)))

    names = ("file", "i", "at", "data", "digest")
    schema = pa.schema([("file", pa.string()), ("i", pa.int64()), ("at", pa.int64()), ("data", pa.binary()), ("digest", pa.binary())])
    kinds = "file string, i bigint, at bigint, data binary, digest binary"
    found = lines.select("range", "data").mapInArrow(run, kinds)
    if marks:
        found = found.unionByName(spark.createDataFrame([x for file in marks for x in cut(file, 0, MARK)], kinds))
    parts = F.array_sort(F.collect_list(F.when(F.col("digest").isNull(), F.struct("at", "data"))))
    put = F.aggregate("parts", F.lit(b""), lambda all_, x: F.concat(all_, x["data"]))
    by = found.groupBy("file", "i").agg(F.first("digest", ignorenulls=True).alias("digest"), parts.alias("parts"))
    return out.unionByName(by.select("file", "i", F.coalesce("digest", digest(put)).alias("digest")))


def roots(leaves: DataFrame, *by: str) -> DataFrame:
    """(by, n, root): the root of the Merkle tree over each group's leaves (i from 0, digest), and their number.

    Each level joins two neighbours by a groupBy on half their number; a last one without a neighbour goes up as it is.
    Levels are as many as the largest group's count has bits, and each has half the rows of the one before.
    """
    sizes = leaves.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    now = leaves.select(*by, "i", "digest")
    for _ in range(max(most - 1, 0).bit_length()):
        pair = F.array_sort(F.collect_list(F.struct("i", "digest")))
        up = now.groupBy(*by, F.floor(F.col("i") / 2).alias("up")).agg(pair.alias("two"))
        joined = F.unhex(F.sha2(F.concat(F.lit(INNER), F.col("two")[0]["digest"], F.try_element_at("two", F.lit(2))["digest"]), 256))
        now = up.select(*by, F.col("up").alias("i"), F.when(F.size("two") == 1, F.col("two")[0]["digest"]).otherwise(joined).alias("digest"))
    return now.join(sizes, list(by)).select(*by, "n", F.lower(F.hex("digest")).alias("root"))


def datasets(spark: SparkSession, paths: dict[str, str], block: int = BLOCK, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(dataset, files, blocks, root): a root for each data set (a file or folder), over its files' roots by their names. `checkpoint` keeps the digests, so that files are read for them once."""
    every = None
    for name, path in paths.items():
        own = blocks(spark, path, block).withColumn("dataset", F.lit(name))
        every = own if every is None else every.unionByName(own)
    files = checkpoint(roots(checkpoint(every), "dataset", "file"))
    number = files.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("blocks"))
    leaf = F.unhex(F.sha2(F.concat(F.lit(LEAF), F.encode("file", "UTF-8"), F.lit(b"\0"), F.unhex("root")), 256))
    at = F.row_number().over(Window.partitionBy("dataset").orderBy("file")) - 1
    return roots(files.select("dataset", at.cast("long").alias("i"), leaf.alias("digest")), "dataset").join(number, "dataset").select("dataset", "files", "blocks", "root")
