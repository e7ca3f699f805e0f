"""Embedding whitening with an exact integer scatter.

Components of a vector become whole numbers x = floor(64 c) + 1000000. The shift of 1000000 is taken off again before
anything is multiplied, so numbers are small; each task adds the sums and cross-products of its vectors exactly (whole
numbers in floating-point products that can't round, else Python's integers), and sends them as digits of base 2^32,
which Spark adds by position. From these n XᵀX - SSᵀ is formed exactly; only then it is turned into floating point,
divided by n², and decomposed by eigh.

The fit counts each different vector once. Vectors that are null or hold null, NaN or infinite components are left out.
Vectors of different lengths have nothing in common and are whitened apart; empty ones have no components. A component
without variance (its eigenvalue is zero to double precision, as for a single vector) has null `whitened` values and
no part in `identity_error`. Numbers beyond 64 bits are no trouble, as long as
64 c is a finite double; vectors with components beyond that are left out too.
No vectors give no rows; repeated rows are whitened alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Vectors that are multiplied at once, and bits of a part of a number, so that sums of products stay below 2^53.
ROWS, BITS = 2048, 20
DIGIT = 32


def finite(c: Column) -> Column:
    """Whether a vector is there and all its components, 64-fold, are finite numbers."""
    return c.isNotNull() & ~F.exists(c.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf")))


def whole(c: Column) -> Column:
    """floor(64 c) of each component, as doubles, which hold such numbers exactly; zero has one sign."""
    return F.transform(c.cast("array<double>"), lambda x: _floor(x * SCALE) + F.lit(0.0))


def _floor(x: Column) -> Column:
    """The floor as a double. Doubles of 2^53 and more are whole numbers already, and SQL's floor would make them 64-bit integers."""
    return F.when(F.abs(x) >= 2.0**53, x).otherwise(F.floor(x).cast("double"))


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and cross-products of the columns of whole numbers `x` (doubles)."""
    d = x.shape[1]
    if not len(x):
        return [0] * d, [[0] * d for _ in range(d)]
    if np.abs(x).max() >= 2.0**62:
        own = np.array([[int(v) for v in row] for row in x], dtype=object)
        return list(own.sum(axis=0)), (own.T @ own).tolist()
    rest, parts = x.astype(np.int64), []
    while rest.any():
        low = rest & ((1 << BITS) - 1) if np.abs(rest).max() >= 1 << BITS else rest
        parts.append(low.astype(float))
        rest = (rest - low) >> BITS
    sums, cross = [0] * d, np.zeros((d, d), dtype=object)
    for k, p in enumerate(parts):
        for at in range(0, len(x), ROWS):
            sums = [s + (int(v) << BITS * k) for s, v in zip(sums, p[at : at + ROWS].sum(axis=0), strict=True)]
        for m, q in enumerate(parts):
            for at in range(0, len(x), ROWS):
                cross += (p[at : at + ROWS].T @ q[at : at + ROWS]).astype(np.int64).astype(object) * (1 << BITS * (k + m))
    return sums, cross.tolist()


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number in base 2^32, signed alike; zeros are left out."""
    sign, value, place = (1, value, 0) if value >= 0 else (-1, -value, 0)
    while value:
        if low := value & ((1 << DIGIT) - 1):
            yield place, sign * low
        value >>= DIGIT
        place += 1


def _by_length(column: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and the vectors as a matrix."""
    sizes = np.fromiter(map(len, column), np.int64, len(column))
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        yield at, np.stack([np.asarray(column.iloc[i], dtype=float) for i in at])


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(d, i, j, place, digit): what a task's vectors add to n (i = -1), to S (j = -1) and to XᵀX (i <= j)."""
    totals: dict[int, tuple[int, list[int], np.ndarray]] = {}
    for batch in batches:
        for at, x in _by_length(batch["x"]):
            d = x.shape[1]
            n, s, c = totals.get(d, (0, [0] * d, np.zeros((d, d), dtype=object)))
            more, cross = scatter(x)
            totals[d] = n + len(at), [a + b for a, b in zip(s, more, strict=True)], c + np.array(cross, dtype=object).reshape(d, d)
    for d, (n, s, c) in totals.items():
        told = [(-1, -1, n), *((i, -1, v) for i, v in enumerate(s)), *((i, j, c[i, j]) for i in range(d) for j in range(i, d))]
        rows = [(d, i, j, place, digit) for i, j, v in told for place, digit in digits(int(v))]
        yield pd.DataFrame(rows, columns=["d", "i", "j", "place", "digit"])


def _model(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row for all vectors of a length: n, sums, eigenvectors and eigenvalues of the largest components, and their shares."""
    d, values = int(key[0]), {}
    for i, j, place, digit in zip(rows["i"], rows["j"], rows["place"], rows["digit"], strict=True):
        values[i, j] = values.get((i, j), 0) + (int(digit) << DIGIT * int(place))
    n, s = values[-1, -1], [values.get((i, -1), 0) for i in range(d)]
    exact = {(i, j): n * values.get((i, j), 0) - s[i] * s[j] for i in range(d) for j in range(i, d)}
    unit = max(0, max(abs(x).bit_length() for x in exact.values()) - 900) // 2  # bits that are taken off where squares go beyond a double
    cov = np.empty((d, d))
    for (i, j), x in exact.items():
        cov[i, j] = cov[j, i] = x / (n * n << 2 * unit)  # the division of whole numbers rounds once
    e, v = np.linalg.eigh(cov)
    k = min(COMPONENTS, d)
    e, v, trace = e[::-1][:k], v[:, ::-1][:, :k], float(np.trace(cov))
    e = np.where(e > d * np.finfo(float).eps * max(float(e[0]), 0.0), e, 0.0)
    return pd.DataFrame({"d": [d], "n": [str(n)], "unit": [unit], "sums": [[str(x) for x in s]], "axes": [v.T.ravel()], "values": [e], "shares": [e / trace if trace > 0 else np.full(k, np.nan)]})


def fit(vectors: DataFrame) -> dict[int, dict]:
    """Models by length of the different vectors `x`: n and sums as whole numbers, axes (k x d), values, shares, and the identity error.

    A model has 16 d + d numbers; what it is made from is d² numbers a task, added by Spark.
    """
    sums = vectors.mapInPandas(_sums, "d int, i int, j int, place int, digit bigint").groupBy("d", "i", "j", "place").agg(F.sum("digit").alias("digit"))
    made = sums.groupBy("d").applyInPandas(_model, "d int, n string, unit int, sums array<string>, axes array<double>, values array<double>, shares array<double>")
    models = {r["d"]: {"n": int(r["n"]), "unit": r["unit"], "sums": [int(x) for x in r["sums"]], "axes": np.array(r["axes"]).reshape(-1, r["d"]), "values": np.array(r["values"]), "shares": list(r["shares"])} for r in made.collect()}

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in _by_length(batch["x"]):
                w = projected(x, models[x.shape[1]])[1]
                mean = w.mean(axis=0)
                held[x.shape[1]] = _merged(held.get(x.shape[1]), (len(w), mean, (w - mean).T @ (w - mean)))
        yield pd.DataFrame([(d, n, m, c.ravel()) for d, (n, m, c) in held.items()], columns=["d", "n", "mean", "m2"])

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for n, mean, m2 in zip(rows["n"], rows["mean"], rows["m2"], strict=True):
            total = _merged(total, (int(n), np.asarray(mean), np.asarray(m2).reshape(len(mean), len(mean))))
        live = models[int(key[0])]["values"] > 0
        off = np.abs(total[2] / total[0] - np.eye(len(live)))[np.ix_(live, live)]
        return pd.DataFrame({"d": [key[0]], "error": [float(off.max()) if off.size else None]})

    told = vectors.mapInPandas(moments, "d int, n bigint, mean array<double>, m2 array<double>").groupBy("d").applyInPandas(merged, "d int, error double")
    for r in told.collect():
        models[r["d"]]["error"] = r["error"]
    return models


def _merged(a, b):
    """Count, mean and centred cross-products of two sets together."""
    if a is None:
        return b
    (n, mean, m2), (k, other, more) = a, b
    gap = other - mean
    return n + k, mean + gap * (k / (n + k)), m2 + more + np.outer(gap, gap) * (n * k / (n + k))


def projected(x: np.ndarray, model: dict) -> tuple[list[int], np.ndarray]:
    """The exact deviation of each vector, sum over dimensions of (n x - S)², and its whitened components (zero where there is no variance)."""
    n, sums = model["n"], model["sums"]
    if np.abs(x).max(initial=0) * n < 2.0**61 and max(map(abs, sums)) < 1 << 61 and not model["unit"]:
        off = x.astype(np.int64) * n - np.array(sums, np.int64)
        most = int(np.abs(off).max(initial=0))
        deviation = (off * off).sum(axis=1).tolist() if most * most * x.shape[1] < 1 << 63 else [sum(int(v) ** 2 for v in row) for row in off]
        centred = off / n
    else:
        rows = [[n * int(v) - s for v, s in zip(row, sums, strict=True)] for row in x]
        deviation, centred = [sum(v * v for v in row) for row in rows], np.array([[v / (n << model["unit"]) for v in row] for row in rows])
    scale = np.where(model["values"] > 0, 1 / np.sqrt(np.where(model["values"] > 0, model["values"], 1)), 0.0)
    return deviation, centred @ model["axes"].T * scale


def whitened(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """`df`'s rows of finite vectors with `whitening`: n, deviation (as text, exact), and the arrays whitened, explained and the identity error."""
    small_batches(df.sparkSession)
    rows = df.where(finite(F.col(vector)))
    vectors = written(rows.select(whole(F.col(vector)).alias("x")).distinct(), "vectors")
    models = fit(vectors)

    @F.pandas_udf("n string, deviation string, whitened array<double>, explained array<double>, identity_error double")
    def apply(column: pd.Series) -> pd.DataFrame:
        out: list = [(None, None, [], [], None)] * len(column)
        for at, x in _by_length(column):
            model = models[x.shape[1]]
            live, error = model["values"] > 0, model["error"]
            for i, v, w in zip(at, *projected(x, model), strict=True):
                out[i] = str(model["n"]), str(v), [float(c) if ok else None for c, ok in zip(w, live, strict=True)], model["shares"], error
        return pd.DataFrame(out, columns=["n", "deviation", "whitened", "explained", "identity_error"])

    return rows.withColumn("whitening", apply(whole(F.col(vector))))


def report(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    n and deviation are longs; a deviation beyond 64 bits is null there and in full in `deviation_exact`.
    """
    each = whitened(df.select(key, vector), vector).select(key, "whitening.*")
    pairs = F.arrays_zip("whitened", "explained")
    rows = each.select(key, "n", "deviation", "identity_error", F.posexplode(pairs).alias("i", "c"))
    return rows.select(key, (F.col("i") + 1).cast("int").alias("component"), F.col("n").cast("long").alias("n"), "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error").select(key, "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))
