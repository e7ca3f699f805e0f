"""Cross-referencing of sources without a shared key: Fellegi-Sunter weights, fitted by EM without labels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocked(a: DataFrame, b: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of rows that agree in all block columns; null agrees with nothing. An equi-join, so a block should be small on one side at least; AQE splits hot ones."""
    return a.join(b, block)


def fit(counts: dict[tuple[bool, ...], int], rounds: int = 100, tolerance: float = 1e-12) -> tuple[float, list[float], list[float]]:
    """Share of matches, and for each comparison the chance of agreement among matches (m) and others (u).

    Comparisons are taken as independent given the match. EM starts at a share of 0.1, m of 0.9 and u of 0.1, and ends
    after `rounds` or when nothing moves by more than `tolerance`. Chances stay within 1e-6 of 0 and 1, so weights are finite.
    """
    seen = np.array(list(counts), float).reshape(len(counts), -1)
    n, k = np.array(list(counts.values()), float), seen.shape[1]
    p, m, u = 0.1, np.full(k, 0.9), np.full(k, 0.1)
    inside = lambda x: np.clip(x, 1e-6, 1 - 1e-6)
    for _ in range(rounds):
        yes, no = p * np.prod(np.where(seen, m, 1 - m), axis=1), (1 - p) * np.prod(np.where(seen, u, 1 - u), axis=1)
        match, other = n * (yes / (yes + no)), n * (no / (yes + no))
        new = float(inside(match.sum() / n.sum())), inside(match @ seen / match.sum()), inside(other @ seen / other.sum())
        moved = max(abs(new[0] - p), float(np.abs(new[1] - m).max()), float(np.abs(new[2] - u).max()))
        p, m, u = new
        if moved <= tolerance:
            break
    return p, m.tolist(), u.tolist()


def linked(pairs: DataFrame, comparisons: dict[str, Column], rounds: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """`pairs` with `weight` (bits for or against a match) and `probability`. A comparison that is null counts as no agreement.

    All pairs count towards the fit, as numbers of each pattern of agreement; there are 2^k patterns at most for k
    comparisons, and only those numbers reach the driver. No pairs give no rows.
    """
    names = [f"_{i}" for i in range(len(comparisons))]
    seen = pairs.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in zip(names, comparisons.values(), strict=True)})
    counts = {tuple(r[:-1]): r[-1] for r in seen.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}
    p, m, u = fit(counts, rounds, tolerance) if counts else (0.1, [0.9] * len(names), [0.1] * len(names))
    weight = sum((F.when(F.col(n), math.log2(a / b)).otherwise(math.log2((1 - a) / (1 - b))) for n, a, b in zip(names, m, u, strict=True)), F.lit(0.0))
    odds = F.pow(F.lit(2.0), F.col("weight")) * (p / (1 - p))
    return seen.withColumn("weight", weight).withColumn("probability", odds / (1 + odds)).drop(*names)
