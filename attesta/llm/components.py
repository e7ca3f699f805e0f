"""Connected components of a graph given as edges, by alternating large and small stars.

Each round replaces edges by edges to smaller labels, so chains shorten quickly; rounds end when nothing changes.
Hubs cost no single task: minima are aggregated on both sides of the shuffle, and the joins are plain equi-joins
whose large groups adaptive execution may split. Each round is cut by a reliable checkpoint and takes six stages: where
there are more partitions than rows, its tasks are what it costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than a node is tied to the least label around that node."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them. Edges may be repeated."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return tied.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(`a`, `root`): each node of an edge with the least node reachable from it. Loops and repeated edges are harmless; no edges give no rows."""
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    state = None
    while True:
        now = checkpointed(_small_star(_large_star(now)))
        # The sum of the rows' hashes tells one set of edges from another.
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == state:
            break
        state = told
    roots = now.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct()
    return now.select("a", F.col("b").alias("root")).unionByName(roots).withColumnRenamed("a", a)
