"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes of lower-cased text, white space runs as one space, order 4. Tasks count 4-grams of trusted
rows and the counts are summed by gram. Lower orders count the different bytes in front of a gram. Discounts come
from the counts of counts of each order; contexts' totals and the next lower order's probabilities meet the grams
in equi-joins sharded by gram, which gives every seen gram its probability.

For scoring, the probability of a 4-gram is its backed-off value plus, if it was seen, a difference. Orders 1 to 3
fit dense tables of proven size (256^3 entries); the differences are broadcast in shards of at most ENTRIES, one
after the other. Each further shard is a pass over the documents of its own, which writes its part of each text's
log-likelihood under the text's digest; the parts are summed. So memory doesn't grow with the model, and no text is shuffled.

Rows are kept if their perplexity lies between two quantiles of the trusted rows of their language: text unlike the
trusted is junk above, and text that repeats itself is junk below. Quantiles are exact on a fixed grid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import text_or_empty, written
from .toxicity import held_out

ORDER = 4
#: Differences in one broadcast shard; bytes of text looked at together.
ENTRIES, SLAB = 4_000_000, 1 << 20
#: Quantiles of trusted rows between which a row is kept, and the grid of the logarithm of perplexity.
LOW, HIGH, GRID = 0.005, 0.995, 1e-3
#: Stands in front of each text, once for each byte of a context.
START = b"\x02" * (ORDER - 1)

_space = re.compile(rb"[\x00-\x20]+")


def normal(text: str) -> bytes:
    return _space.sub(b" ", text.lower().encode())


def grams(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first text, all 4-grams as numbers, and where each text's grams begin (one more at the end)."""
    padded = [START + t for t in texts]
    for low, high in words.pieces(padded, SLAB):
        data = np.frombuffer(b"".join(padded[low:high]), np.uint8).astype(np.uint32)
        size = np.fromiter(map(len, padded[low:high]), np.int64)
        number = np.zeros(len(data), np.uint32)
        for k in range(ORDER):
            number[: len(data) - k] |= data[k:] << np.uint32(8 * (ORDER - 1 - k))
        begin = np.cumsum(size) - size
        inside = np.arange(len(data)) - np.repeat(begin, size) < np.repeat(size - ORDER + 1, size)
        count = size - ORDER + 1
        yield low, number[inside], np.concatenate(([0], np.cumsum(count)))


def counted(trusted: DataFrame) -> DataFrame:
    """(gram, a): how often each 4-gram occurs in `text` of the trusted rows."""

    def run(batches):
        held, number = [], 0

        def summed():
            every, n = np.concatenate([g for g, _ in held]), np.concatenate([c for _, c in held])
            gram, of = np.unique(every, return_inverse=True)
            return gram, np.bincount(of, weights=n).astype(np.int64)

        for batch in batches:
            for _, g, _ in grams([normal(t) for t in batch["text"]]):
                held.append(np.unique(g, return_counts=True))
                number += len(held[-1][0])
                if number > 2_000_000:
                    held = [summed()]
                    number = len(held[0][0])
        if number:
            gram, n = summed()
            yield pd.DataFrame({"gram": gram.astype(np.int64), "a": n})

    return trusted.select("text").mapInPandas(run, "gram bigint, a bigint").groupBy("gram").agg(F.sum("a").alias("a"))


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """The discounts of grams counted once, twice and more often, from how many grams are counted one to four times."""
    found = {r["a"]: r["n"] for r in table.where("a <= 4").groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n2, n3, n4 = (max(1, found.get(i, 0)) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    return tuple(float(min(max(d, 0.05), k - 0.05)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


@dataclass
class Lower:
    """Orders 1 to 3 and the weights of the highest order's contexts, as sparse (number, log value) arrays."""

    p: dict[int, tuple[np.ndarray, np.ndarray]]
    back: dict[int, tuple[np.ndarray, np.ndarray]]

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every 3-gram, seen or backed off, and the log weight of every context of three."""

        def weights(k: int, n: int) -> np.ndarray:
            out = np.zeros(n, np.float32)
            number, value = self.back[k]
            out[number] = value
            return out

        log = np.full(1, -np.log(256), np.float32)
        for k in range(1, ORDER):
            n = 256 ** (k - 1)
            weight = weights(k, n)
            tail = log.reshape(n // 256 if n > 1 else 1, -1)  # a gram's last k - 1 bytes
            log = (weight.reshape(256 if n > 1 else 1, -1, 1) + tail.reshape(1, -1, 256 if n > 1 else 1)).astype(np.float32).reshape(-1)
            if n == 1:
                log = np.repeat(log, 256)
            number, value = self.p[k]
            log[number] = value
        return log, weights(ORDER, 256 ** (ORDER - 1))


def trained(trusted: DataFrame) -> tuple[DataFrame, Lower]:
    """(gram, diff) of the seen 4-grams, and the lower orders."""
    tables = {ORDER: written(counted(trusted), "grams")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(256**k - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("a"))
    below, p, back, top = None, {}, {}, None
    for k in range(1, ORDER + 1):
        own = tables[k]
        d = discounts(own)
        less = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
        own = own.withColumn("context", F.shiftright("gram", 8)).withColumn("rest", F.col("gram").bitwiseAND(F.lit(256 ** (k - 1) - 1)))
        contexts = own.groupBy("context").agg(F.sum("a").alias("total"), F.sum(less).alias("taken"))
        met = own.join(contexts, "context")
        met = met.join(below, "rest") if below is not None else met.withColumn("lower", F.lit(1 / 256))
        weight = F.col("taken") / F.col("total")
        value = (F.col("a") - less) / F.col("total") + weight * F.col("lower")
        found = met.select("gram", value.alias("p"), (F.log(value) - F.log(weight) - F.log("lower")).alias("diff"))
        sparse = contexts.select("context", F.log(weight).alias("w")).toPandas()  # at most 256^(k - 1) rows
        back[k] = sparse["context"].to_numpy(np.int64), sparse["w"].to_numpy(np.float32)
        if k < ORDER:
            found = written(found, f"order{k}")
            seen = found.select("gram", F.log("p").alias("l")).toPandas()  # at most 256^k rows
            p[k] = seen["gram"].to_numpy(np.int64), seen["l"].to_numpy(np.float32)
            below = found.select(F.col("gram").alias("rest"), F.col("p").alias("lower"))
        else:
            top = written(found.select("gram", "diff"), "differences")
    return top, Lower(p, back)


def summed(texts: pd.Series, value) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of grams and the sum of `value` (of an array of grams) over them."""
    n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for low, g, begin in grams([normal(t) for t in texts]):
        sums = np.concatenate(([0.0], np.cumsum(value(g))))
        total[low : low + len(begin) - 1] = sums[begin[1:]] - sums[begin[:-1]]
        n[low : low + len(begin) - 1] = np.diff(begin)
    return n, total


def looked_up(g: np.ndarray, gram: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """The difference of each gram, 0 for those that the shard doesn't hold."""
    if not len(gram):
        return np.zeros(len(g))
    at = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
    return np.where(gram[at] == g, diff[at], 0).astype(float)


def log_likelihoods(docs: DataFrame, model: tuple[DataFrame, Lower], text: str = "text") -> DataFrame:
    """`docs` with `_n`, the bytes of the normalised text, and `_log`, its log-likelihood; null counts as empty.

    Columns named `_n`, `_log`, `_b`, `_text` or `_part` are replaced. Repeated rows each get their own result. With
    more than one shard the rows meet their sums by the text's digest, so give no columns that aren't needed later.
    """
    top, lower = model
    spark, t = docs.sparkSession, text_or_empty(text)
    shards = max(1, -(-top.count() // ENTRIES))
    top = top.withColumn("_shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))

    def shard(s: int):
        mine = top.where(F.col("_shard") == s).select("gram", "diff").toPandas().sort_values("gram")  # about ENTRIES rows
        return spark.sparkContext.broadcast((mine["gram"].to_numpy(np.uint32), mine["diff"].to_numpy(np.float32)))

    told, first = spark.sparkContext.broadcast(lower), shard(0)

    @F.pandas_udf("struct<n:bigint,log:double>")
    def likelihood(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        log, weight = told.value.dense()
        value = lambda g: log[g & np.uint32(0xFFFFFF)].astype(float) + weight[g >> np.uint32(8)] + looked_up(g, *first.value)
        for texts in batches:
            n, total = summed(texts, value)
            yield pd.DataFrame({"n": n, "log": total})

    out = docs.withColumn("_b", likelihood(t)).withColumns({"_n": F.col("_b.n"), "_log": F.col("_b.log")}).drop("_b")
    parts = []
    for s in range(1, shards):
        more = shard(s)

        @F.pandas_udf("double")
        def differences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(summed(texts, lambda g: looked_up(g, *more.value))[1])  # noqa: B023

        parts.append(written(docs.select(F.md5(F.encode(t, "UTF-8")).alias("_text"), differences(t).alias("_part")).dropDuplicates(["_text"]), "part"))
        more.destroy()
    if parts:
        total = reduce(DataFrame.unionByName, parts).groupBy("_text").agg(F.sum("_part").alias("_part"))
        out = out.withColumn("_text", F.md5(F.encode(t, "UTF-8"))).join(total, "_text")
        out = out.withColumn("_log", F.col("_log") + F.col("_part")).drop("_text", "_part")
    return out


def bounds(scored: DataFrame, lang: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(lang, low, high): quantiles of `_grid` (a whole number) of trusted rows by language, and of all under a null language."""
    counts = scored.groupBy(F.col(lang).alias("lang"), F.col("_grid")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.unionByName(counts.groupBy("_grid").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    order = Window.partitionBy("lang").orderBy("_grid")
    ranked = both.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("_grid")))
    return ranked.groupBy("lang").agg(at(low).alias("low"), at(high).alias("high"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, low, high, held_out and keep of every row.

    Trusted rows are labelled quality 1 and aren't held out (crc32 of the id is 2 modulo 4). Null languages are one
    language; a language without trusted rows takes the bounds of all. A text without bytes has perplexity 256 and
    isn't kept. Without trusted rows every other text is kept.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    slim = docs.select("doc_id", text_or_empty().alias("text"), lang.alias("lang"))
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    # Merged at every size: the labelled ids grow with the input, so they are never broadcast.
    model = trained(slim.where(~held_out(F.col("doc_id"))).select("doc_id", "text").join(good.hint("merge"), "doc_id", "left_semi"))
    scored = log_likelihoods(slim, model).drop("text")
    nats = F.when(F.col("_n") > 0, -F.col("_log") / F.col("_n")).otherwise(F.log(F.lit(256.0)))
    scored = written(scored.select("doc_id", "lang", F.col("_n").alias("n_bytes"), F.round(nats / GRID).cast("bigint").alias("_grid")), "scores")
    limits = bounds(scored.where("n_bytes > 0").join(good, "doc_id", "left_semi"), "lang")
    every = limits.where("lang is null").select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    each = limits.where("lang is not null")
    # One row per language and one for all: at most as many rows as there are languages.
    met = scored.join(each, "lang", "left").join(F.broadcast(every.groupBy().agg(F.first("_low").alias("_low"), F.first("_high").alias("_high"))), F.lit(True), "left")
    low, high = F.coalesce("low", "_low"), F.coalesce("high", "_high")
    inside = F.coalesce(F.col("_grid").between(low, high), F.lit(True)) & (F.col("n_bytes") > 0)
    value = lambda c: F.round(F.exp(c * GRID), 4)
    return met.select("doc_id", "lang", "n_bytes", value(F.col("_grid")).alias("perplexity"), value(low).alias("low"), value(high).alias("high"), held_out(F.col("doc_id")).alias("held_out"), inside.alias("keep"))
