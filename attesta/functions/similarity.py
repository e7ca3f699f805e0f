"""Name similarity and the composite alias score, from 0 to 100."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the score, bonus by alias quality, and lower bounds of the classes.
WEIGHTS = {"jaro_winkler": 0.5, "soundex": 0.2, "levenshtein": 0.3}
BONUS = {"good": 10.0, "low": 5.0}
BANDS = {"CONFIRMED": 95.0, "LIKELY": 80.0, "POTENTIAL": 60.0}


def code_points(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names as rows of code points, filled up with 0, and their lengths."""
    size = np.array([len(x) for x in names], np.int64)
    out = np.zeros((len(names), max(1, int(size.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    return out, size


def jaro_winkler_values(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of pairs, for all pairs at once.

    Jaro: the share of common letters within half the longer name, less half the share of them that are out of order.
    It is raised by a common beginning of up to 4 letters if above 0.7. An empty name is like no other.
    """
    (x, n), (y, m) = code_points(a), code_points(b)
    place = np.arange(y.shape[1])
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    free, mine = place < m[:, None], np.zeros(x.shape, bool)
    for i in range(x.shape[1]):  # each letter takes the first free one within reach
        meets = free & (y == x[:, i : i + 1]) & (np.abs(place - i) <= reach) & (i < n[:, None])
        hit = np.flatnonzero(meets.any(axis=1))
        free[hit, meets[hit].argmax(axis=1)] = False
        mine[hit, i] = True
    theirs = ~free & (place < m[:, None])
    common = mine.sum(axis=1)
    # The common letters of both sides in order: pair by pair as many on either side.
    moved = np.bincount(np.repeat(np.arange(len(a)), common), weights=x[mine] != y[theirs], minlength=len(a)).astype(int) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(common > 0, (common / n + common / m + (common - moved) / common) / 3, 0.0)
    first = min(4, x.shape[1], y.shape[1])
    same = (x[:, :first] == y[:, :first]) & (x[:, :first] > 0)
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def jaro_winkler_value(a: str, b: str) -> float:
    return float(jaro_winkler_values([a], [b])[0])


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of pairs; null if a name is."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        if known.any():
            out[known] = jaro_winkler_values(x[known].tolist(), y[known].tolist())
        return pd.Series(out)

    return F.when(a.isNotNull() & b.isNotNull(), of(a, b))


def same_soundex(a: Column, b: Column) -> Column:
    return F.when(F.soundex(a) == F.soundex(b), 1.0).otherwise(0.0)


def levenshtein_share(a: Column, b: Column) -> Column:
    """1 less the edits as a share of the longer name."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def score(jw: Column, sdx: Column, lev: Column) -> Column:
    """The weighted sum as a percentage with two decimals."""
    w = WEIGHTS
    return F.round((w["jaro_winkler"] * jw + w["soundex"] * sdx + w["levenshtein"] * lev) * 100, 2)


def bonus(quality: Column) -> Column:
    """Points by alias quality; unclassified names get none."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in BONUS.items() for x in kv))[quality], F.lit(0.0))


def adjusted(base: Column, quality: Column) -> Column:
    """The score with its bonus, 100 at most, with two decimals."""
    return F.round(F.least(base + bonus(quality), F.lit(100.0)), 2)


def classified(s: Column) -> Column:
    """Class of a score by half-open bands; below the lowest it is CLEAR."""
    out = F.when(s >= BANDS["CONFIRMED"], "CONFIRMED")
    for name in ("LIKELY", "POTENTIAL"):
        out = out.when(s >= BANDS[name], name)
    return out.otherwise("CLEAR")


def match_type(a: Column, b: Column, sdx: Column, transliterated: Column | None = None) -> Column:
    """exact before transliteration before phonetic before fuzzy."""
    out = F.when(a == b, "exact")
    if transliterated is not None:
        out = out.when(transliterated, "transliteration")
    return out.when(sdx == 1.0, "phonetic").otherwise("fuzzy")
