"""Screening of names against lists: candidate pairs, scores, classes, best matches, calibration.

Only pairs that can reach the threshold are formed, by equi-joins. Pairs of equal Soundex meet on the code. For other
pairs the score is bounded by what the names have in common: with c common letters of names of n and s letters,
Levenshtein gives at most c / n and Jaro at most (c / n + c / s + 1) / 3, raised if the names begin alike. A name's
signature is its first letter and how many of its letters fall into each of a few groups; the lesser counts of two
signatures, summed, are at least c. So signatures are compared first, as arrays of numbers, and only names of
signatures that may reach the threshold meet. There are far fewer signatures than names, as their number is bounded:
if there are more than SIGNATURES, coarser groups are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S

#: Letters from common to rare, dealt into groups in turn; any other sign is in a group of its own with its like.
COMMON = "eaionrtlsudcmpghbyfvkwzxjq"
#: Groups of letters, the most first; different signatures of one side that are broadcast; pairs of signatures compared at once.
GROUPS, SIGNATURES, COMPARED = (16, 8, 4, 2, 1), 50_000, 1 << 20
#: Half a step of the rounded score, left to it when pairs are dropped by an upper bound.
SLACK = 0.005
#: Pairs of names to a task at most, unless the tasks would be more than PARTS; slices into which the names of one key are dealt at most.
PAIRS, PARTS, SLICES = 2_000_000, 2_000, 16
Checkpoint = Callable[[DataFrame], DataFrame]
CLAUSE = "The absence of a match in the lists consulted is not a determination of absence of risk."


def signature(name: Column) -> Column:
    """array<int>: the first letter's code, then the number of letters in each of the most groups and of other signs.

    Counted from arrays of code points: as an expression it would be so long that compiling it took most of a small job's time.
    """
    most = GROUPS[0]
    group = np.full(128, most)
    group[[ord(c) for c in COMMON]] = np.arange(len(COMMON)) % most

    @F.pandas_udf("array<int>")
    def of(lower: pd.Series) -> pd.Series:
        codes, size = S.code_points(lower.fillna("").tolist())
        at = np.where(np.arange(codes.shape[1]) < size[:, None], np.where(codes < 128, group[np.minimum(codes, 127)], most), -1)
        return pd.Series(list(np.stack([codes[:, 0], *((at == g).sum(axis=1) for g in range(most + 1))], axis=1).astype(np.int32)))

    return of(F.lower(name))


def coarser(fine: Column, groups: int) -> Column:
    """The signature with this many groups, each a sum of the most: groups are dealt in turn, and their numbers are powers of two."""
    most = GROUPS[0]
    if groups == most:
        return fine
    counts = [sum((F.get(fine, F.lit(1 + i)) for i in range(g + groups, most, groups)), F.get(fine, F.lit(1 + g))) for g in range(groups)]
    return F.array(F.get(fine, F.lit(0)), *counts, F.get(fine, F.lit(1 + most)))


def reachable(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The largest score that names of these signatures (rows x signatures) can have without equal Soundex."""
    n, m = one[:, 1:].sum(axis=1)[:, None], other[:, 1:].sum(axis=1)[None, :]
    common = sum(np.minimum(one[:, None, g], other[None, :, g]) for g in range(1, one.shape[1]))
    long, short = np.maximum(n, m), np.minimum(n, m)
    jaro = np.where(common > 0, (common / long + common / short + 1) / 3, 0)
    alike = 0.1 * np.minimum(4, short) * (one[:, None, 0] == other[None, :, 0])
    return 100 * (S.WEIGHTS["jaro_winkler"] * np.where(jaro > 0.7, jaro + alike * (1 - jaro), jaro) + S.WEIGHTS["levenshtein"] * common / long)


def meeting(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(_s, _t): pairs of the signatures in columns `_s` and `_t` whose names may reach the threshold."""
    theirs = np.array([r["_t"] for r in right.select("_t").distinct().collect()], np.int32)  # at most SIGNATURES rows, or the fewest there can be
    told = left.sparkSession.sparkContext.broadcast(theirs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        other = told.value
        for batch in batches:
            if not len(other):
                continue
            mine = np.array(batch["_s"].tolist(), np.int32)
            step = max(1, COMPARED // len(other))
            for at in range(0, len(mine), step):
                i, j = np.nonzero(reachable(mine[at : at + step], other) >= threshold - SLACK)
                yield pd.DataFrame({"_s": list(mine[at : at + step][i]), "_t": list(other[j])})

    return left.select("_s").distinct().mapInPandas(run, "_s array<int>, _t array<int>")


def together(left: DataFrame, right: DataFrame, keys: list[str], by: str, parts: int) -> DataFrame:
    """The join of both on equal keys, in at least so many tasks: rows of `left` are dealt by the column `by` into slices of each key, and `right` meets each.

    Names are few bytes, but their pairs are many: tasks cut by the bytes they read would be a few, however many pairs they make.
    """
    slices = min(parts, SLICES)
    if slices == 1:
        return left.join(right, keys)
    mine = left.withColumn("_slice", F.pmod(F.xxhash64(by), F.lit(slices)).cast("int")).repartition(parts, *keys, "_slice")
    theirs = right.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(parts, *keys, "_slice")
    return mine.join(theirs, [*keys, "_slice"]).drop("_slice")


def candidates(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float = 60.0, checkpoint: Checkpoint = lambda df: df) -> DataFrame:
    """Pairs of rows (names `a` of `left` and `b` of `right`, null and empty names left out) that may score `threshold` or more, with sdx and lev.

    `checkpoint` keeps the names with their signatures, which are read several times.
    """
    x, y = F.col(a), F.col(b)
    left = checkpoint(left.where(F.length(a) > 0).withColumns({"_c": F.soundex(x), "_s": signature(x)}))
    right = checkpoint(right.where(F.length(b) > 0).withColumns({"_c": F.soundex(y), "_t": signature(y)}))
    parts = max(1, min(PARTS, -(-left.count() * right.count() // PAIRS)))
    loose = together(left.drop("_s"), right.drop("_t"), ["_c"], a, parts).drop("_c").withColumn("sdx", F.lit(1.0))
    if threshold - SLACK <= 100 * (S.WEIGHTS["jaro_winkler"] + S.WEIGHTS["levenshtein"]):
        few = lambda g: g == GROUPS[-1] or right.select(coarser(F.col("_t"), g)).distinct().limit(SIGNATURES + 1).count() <= SIGNATURES
        groups = next(g for g in GROUPS if few(g))
        p, q = left.withColumn("_s", coarser(F.col("_s"), groups)), right.withColumn("_t", coarser(F.col("_t"), groups)).withColumnRenamed("_c", "_d")
        met = together(p.join(meeting(p, q, threshold), "_s").drop("_s"), q, ["_t"], a, parts).where("_c <> _d").drop("_t", "_c", "_d")
        loose = loose.unionByName(met.withColumn("sdx", F.lit(0.0)))
    scored = loose.withColumn("lev", S.levenshtein_share(x, y))
    return scored.where(50 + 20 * F.col("sdx") + 30 * F.col("lev") >= threshold - SLACK)


def scored(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with jw, score and class; sdx and lev are added if missing."""
    x, y = F.col(a), F.col(b)
    if "sdx" not in pairs.columns:
        pairs = pairs.withColumns({"sdx": S.same_soundex(x, y), "lev": S.levenshtein_share(x, y)})
    out = pairs.withColumn("jw", S.jaro_winkler(x, y))
    out = out.withColumn("score", S.score(F.col("jw"), F.col("sdx"), F.col("lev")))
    return out.withColumn("class", S.classified(F.col("score")))


def screened(subjects: DataFrame, entries: DataFrame, subject: str, entry: str, threshold: float = 60.0, quality: str | None = None, checkpoint: Checkpoint = lambda df: df) -> DataFrame:
    """Matches of subjects with list entries at or above the threshold; with `quality` (a column of the entries) the bonus counts."""
    most = max(S.BONUS.values()) if quality else 0.0
    out = scored(candidates(subjects, entries, subject, entry, threshold - most, checkpoint), subject, entry)
    if quality:
        out = out.withColumnRenamed("score", "base_score").withColumn("score", S.adjusted(F.col("base_score"), F.col(quality)))
        out = out.withColumn("class", S.classified(F.col("score")))
    return out.where(F.col("score") >= threshold).withColumn("match_type", S.match_type(F.col(subject), F.col(entry), F.col("sdx")))


def best(matches: DataFrame, subject: str, *ties: str) -> DataFrame:
    """One match of each subject: the highest score, ties by the given columns."""
    rank = F.row_number().over(Window.partitionBy(subject).orderBy(F.desc("score"), *ties))
    return matches.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def calibration(scores: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision and recall: each row is compared with the few thresholds in one pass."""
    each = scores.select(F.col(score).alias("s"), (F.col(truth) == 1).alias("t"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = each.groupBy("threshold").agg(n(hit & F.col("t")).alias("tp"), n(hit & ~F.col("t")).alias("fp"), n(~hit & F.col("t")).alias("fn"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 4)
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def match_records(matches: DataFrame, subject: str, alias: str, entry: dict[str, Column]) -> DataFrame:
    """The twelve attributes of a match record; `entry` gives those that come from the list's snapshot."""
    return matches.select(
        F.col(subject).alias("subject_name"), F.col(alias).alias("alias_detected"), entry["alias_quality"].alias("alias_quality"), entry["list_matched"].alias("list_matched"),
        entry["list_authority"].alias("list_authority"), F.col("match_type"), F.col("score"), F.lit(None).cast("double").alias("confidence"), entry["source_url"].alias("source_url"),
        entry["source_version"].alias("source_version"), entry["dataset_sha256"].alias("dataset_sha256"), entry["consulted_at"].alias("consulted_at"),
    )
