"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt into cells by the nearest of a bounded number of directions and by their norm, and cells into
shards of bounded size, each with its ball tree. So a shard's ball is narrow where the data are, and whole shards can
be skipped. Queries are packed into blocks by the same cells. In a pair of block and shard the tree is walked for all
queries of the block at once, nodes with the larger upper bounds on the inner product first, and a query leaves a
branch whose bound is below its current kth score. That score is shared: it starts from a bounded sample of all
vectors, a first round searches a shard of the block's own cell, the second round begins with what the first one
found, and it is carried from shard to shard of a slot. In the second round blocks go to all slots. Shards of a slot
come first in its rows and are held, a bounded number of vectors, while its blocks stream past: no pair of block and
shard is a row, nothing is broadcast but samples. A slot's results, k rows a query at most, are ranked per query.

Components are whole numbers held as floating point. Products are summed as such where they are exact (below 2^52 by
the norms), else as Python's integers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from operator import mul

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a shard, in a leaf, and in a block of queries; vectors in the sample that gives directions and the first kth scores; directions.
SHARD, LEAF, BLOCK, SAMPLE, DIRECTIONS = 4_096, 128, 1_024, 2_048, 256
#: Shards of a slot at most (of vectors of WIDTH components), slots up to which a slot has one, and the inner product (by the norms) below which floating point is exact.
SLOT, WIDTH, SLOTS, EXACT = 16, 64, 24, float(1 << 52)
NONE = np.iinfo(np.int64).min


@dataclass
class Ball:
    center: np.ndarray
    radius: float
    size: float  # of the center
    low: int
    high: int
    children: tuple[Ball, ...] = ()


@dataclass
class Shard:
    """Vectors in the order of their tree's leaves."""

    ids: np.ndarray
    vectors: np.ndarray
    root: Ball

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Shard:
        order = np.argsort(ids, kind="stable")

        def ball(low: int, high: int) -> Ball:
            mine = vectors[order[low:high]]
            center = mine.mean(axis=0)
            far = norms(mine - center)
            # A little wider than computed, so that rounding never cuts a vector off.
            here = Ball(center, float(far.max()) * (1 + 1e-9) + 1e-6, float(norms(center[None])[0]), low, high)
            if high - low > LEAF:
                a = mine[far.argmax()]
                b = mine[norms(mine - a).argmax()]
                side = mine @ ((b - a) / norms((b - a)[None])[0])
                half = (high - low) // 2
                order[low:high] = order[low:high][np.argsort(side, kind="stable")]
                here.children = ball(low, low + half), ball(low + half, high)
            return here

        root = ball(0, len(ids))
        return cls(ids[order], vectors[order], root)


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id, and the kth score, which nothing below can enter."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.found = np.zeros((n, k), bool)
        self.floor = np.full(n, NONE) if floor is None else floor.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        """Takes the scores (rows x ids) that are valid."""
        k = self.score.shape[1]
        valid = valid & (scores >= self.floor[rows, None])
        some = valid.any(axis=1)
        rows, scores, valid = rows[some], scores[some], valid[some]
        if not len(rows):
            return
        score = np.concatenate((self.score[rows], scores), axis=1)
        known = np.concatenate((self.id[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        real = np.concatenate((self.found[rows], valid), axis=1)
        order = np.lexsort((known, ~score, ~real), axis=1)[:, :k]  # ~x turns the order of whole numbers round
        self.score[rows], self.id[rows], self.found[rows] = (np.take_along_axis(x, order, 1) for x in (score, known, real))
        full = rows[self.found[rows, -1]]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, -1])


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths of vectors, a little more than exact; also of components whose squares no float holds."""
    most = np.abs(vectors).max(axis=1, initial=1.0)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as int64; what a long can't hold becomes its largest or smallest value."""
    large, other = norms(queries), norms(vectors).max(initial=0.0)
    out = np.empty((len(queries), len(vectors)), np.int64)
    small = large * other < EXACT
    out[small] = queries[small] @ vectors.T
    if not small.all():
        theirs = [[int(x) for x in v] for v in vectors]
        for row in np.flatnonzero(~small).tolist():
            mine = [int(x) for x in queries[row]]
            out[row] = [max(NONE, min(~NONE, sum(map(mul, mine, v)))) for v in theirs]
    return out


def search(ids: np.ndarray, queries: np.ndarray, shard: Shard, best: Best) -> int:
    """Adds a shard's vectors to the best of each query, its own row left out. Returns how many products were computed."""
    size = norms(queries)
    scored = 0

    def bound(ball: Ball, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            slack = size[rows] * (ball.radius + 1e-9 * ball.size) + 1e-6
            return np.nan_to_num(queries[rows] @ ball.center + slack, nan=np.inf)

    stack = [(shard.root, np.arange(len(ids)))]
    while stack:
        ball, rows = stack.pop()
        rows = rows[bound(ball, rows) * (1 + 1e-12) + 1 >= best.floor[rows]]
        if not len(rows):
            continue
        if ball.children:
            order = sorted(ball.children, key=lambda c: float(bound(c, rows).mean()))
            stack += [(c, rows) for c in order]  # the larger bound is taken first
            continue
        theirs = shard.ids[ball.low : ball.high]
        scored += len(rows) * len(theirs)
        best.add(rows, products(queries[rows], shard.vectors[ball.low : ball.high]), ids[rows, None] != theirs[None, :], theirs)
    return scored


def whole(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as array<double>; null if the vector is null or has a null or non-finite component."""
    x = lambda v: v.cast("double") * scale
    # From 2^53 on every double is whole.
    each = F.transform(vector, lambda v: F.when(F.abs(x(v)) < float(1 << 53), F.floor(x(v)).cast("double")).otherwise(x(v)))
    fit = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) < float("inf")))
    return F.when(vector.isNotNull() & fit, each)


def directions(sample: np.ndarray, n: int) -> np.ndarray:
    """n unit vectors (or fewer) of a sample, each as far as can be from those before."""
    size = norms(sample)
    unit = sample[size > 0] / size[size > 0, None]
    if not len(unit) or n < 2:
        return unit[:1]
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < n and near.min() < 0.99:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def celled(rows: DataFrame, told: Broadcast, size: int) -> DataFrame:
    """(id, v, dim, cell, chunk): the cell by direction and norm (a factor of 2), and a part of the cell of about `size` rows."""

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            length = batch.map(len).to_numpy()
            for dim in np.unique(length).tolist():
                at = np.flatnonzero(length == dim)
                v = np.array(batch.iloc[at].tolist(), float).reshape(len(at), dim)
                far = norms(v)
                unit, known = v / np.maximum(far, 1e-300)[:, None], told.value.get(dim)
                out[at] = np.log2(np.maximum(far, 1.0)).astype(int) * DIRECTIONS + ((unit @ known.T).argmax(axis=1) if known is not None and len(known) else 0)
            yield pd.Series(out)

    placed = written(rows.select("id", "v", F.size("v").alias("dim"), cell("v").alias("cell")), "cells")
    # One row for each direction, power of two and length of vectors.
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("chunks"))
    return placed.join(F.broadcast(sizes), ["dim", "cell"]).select("id", "v", "dim", "cell", F.pmod(F.xxhash64("id", "v"), "chunks").alias("chunk"))


def packed(rows: DataFrame, size: int, tree: bool) -> DataFrame:
    """One row (dim, cell, chunk, part, n, data) for each chunk of vectors of one cell; larger chunks are cut into parts."""

    def run(batches):
        held, now, part = [], None, 0

        def pack():
            ids, vectors = np.array([i for i, _ in held], np.int64), np.array([v for _, v in held], float).reshape(len(held), now[0])
            data = pickle.dumps(Shard.of(ids, vectors) if tree else (ids, vectors), protocol=5)
            return pd.DataFrame({"dim": [now[0]], "cell": [now[1]], "chunk": [now[2]], "part": [part], "n": [len(held)], "data": [data]})

        for batch in batches:
            for i, v, *place in zip(*(batch[c] for c in ("id", "v", "dim", "cell", "chunk")), strict=True):
                if held and (place != now or len(held) >= 2 * size):
                    yield pack()
                    held, part = [], part + 1 if place == now else 0
                now = place
                held.append((i, v))
        if held:
            yield pack()

    dealt = rows.repartition("dim", "cell", "chunk").sortWithinPartitions("dim", "cell", "chunk")
    return dealt.mapInPandas(run, "dim int, cell int, chunk bigint, part bigint, n bigint, data binary")


def neighbours(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and vectors given as (id, v): array<double> of whole numbers.

    Vectors meet queries of their own length only. Fewer than k candidates give fewer rows; no queries give none.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample: dict[int, list] = {}
    for r in vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE).collect():
        sample.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
    arrays = {d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], float).reshape(len(x), d)) for d, x in sample.items()}
    seeds = spark.sparkContext.broadcast(arrays)
    ways = spark.sparkContext.broadcast({d: directions(v, min(DIRECTIONS, max(1, total // SHARD))) for d, (_, v) in arrays.items()})

    def seeded(batches):
        for batch in batches:
            out = []
            for dim, data in zip(batch["dim"], batch["data"], strict=True):
                ids, mine = pickle.loads(data)
                best = Best(len(ids), k)
                if dim in seeds.value:
                    theirs, v = seeds.value[dim]
                    best.add(np.arange(len(ids)), products(mine, v), ids[:, None] != theirs[None, :], theirs)
                out.append(pickle.dumps((ids, mine, best.floor), protocol=5))
            yield batch[["dim", "cell", "chunk"]].assign(block=[md5(b).hexdigest() for b in out], data=out)

    def met(shards: DataFrame, blocks: DataFrame, on: list[str], first: bool) -> DataFrame:
        """(block, query_id, vec_id, score): the best of the shards that have the same `on` for each query, without the pairs of the first round unless this is it."""

        def run(batches):
            held, now = [], None
            for batch in batches:
                for key, block, place, part, data in zip(batch["key"], batch["block"], zip(batch["cell"], batch["chunk"], strict=True), batch["part"], batch["data"], strict=True):
                    if key != now:
                        held, now = [], key
                    if part >= 0:
                        held.append((place if part == 0 and not first else None, pickle.loads(data)))
                        continue
                    ids, mine, floor = pickle.loads(data)
                    best = Best(len(ids), k, floor)
                    for done, shard in held:
                        if done != place:
                            search(ids, mine, shard, best)
                    row, column = np.nonzero(best.found)
                    yield pd.DataFrame({"block": block, "query_id": ids[row], "vec_id": best.id[row, column], "score": best.score[row, column]})

        key = F.concat_ws(":", *on).alias("key")
        rows = shards.select(key, F.lit("").alias("block"), "cell", "chunk", "part", "data").unionByName(blocks.select(key, "block", "cell", "chunk", F.lit(-1).cast("bigint").alias("part"), "data"))
        # Shards of a key first: no block is "".
        return rows.repartition("key").sortWithinPartitions("key", "block").mapInPandas(run, "block string, query_id bigint, vec_id bigint, score bigint")

    def raised(batches):
        """Blocks whose queries know the kth score that their own cell gave."""
        for batch in batches:
            out = []
            for asked, known, score in zip(batch["data"], batch["ids"], batch["floors"], strict=True):
                ids, mine, floor = pickle.loads(asked)
                if known is not None and len(known):
                    order = np.argsort(ids)
                    at = order[np.searchsorted(ids[order], np.array(known, np.int64))]
                    floor[at] = np.maximum(floor[at], np.array(score, np.int64))
                out.append(pickle.dumps((ids, mine, floor), protocol=5))
            yield batch.assign(data=out)[["dim", "cell", "chunk", "block", "data"]]

    kind = "dim int, cell int, chunk bigint, block string, data binary"
    blocks = written(packed(celled(queries, ways, BLOCK), BLOCK, False).mapInPandas(seeded, kind), "queries")
    shards = written(packed(celled(vectors, ways, SHARD), SHARD, True), "shards")
    own = written(met(shards.where("part = 0"), blocks, ["dim", "cell", "chunk"], True), "own")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = own.withColumn("rank", rank).where(F.col("rank") == k).groupBy("block").agg(F.collect_list("query_id").alias("ids"), F.collect_list("score").alias("floors"))
    width = max([WIDTH, *arrays])
    slots = max(1, -(-total * width // (SLOT * SHARD * WIDTH)), min(SLOTS, -(-total // SHARD)))
    second = blocks.join(kth, "block", "left").mapInPandas(raised, kind).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
    others = shards.withColumn("slot", F.pmod(F.xxhash64("dim", "cell", "chunk", "part"), F.lit(slots)))
    found = own.unionByName(met(others, second, ["slot", "dim"], False))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: of each row whose vec_id is divisible by `every` the k best other rows.

    Rows without an id and vectors that are null or hold null or non-finite components take no part; empty vectors
    meet each other with score 0. Rows with the query's id are its own. Of several queries with one id the least vector
    is asked; repeated candidates each take part. A score that a long can't hold becomes its largest or smallest value.
    """
    rows = embeddings.select(F.col("vec_id").alias("id"), whole(F.col("embedding")).alias("v")).where("id is not null and v is not null")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    return neighbours(asked, rows, k)
