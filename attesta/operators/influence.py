"""Who stands behind an entity, and who matters in a network: sums over all paths of a weighted graph, circles included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Checkpoint = Callable[[DataFrame], DataFrame]


#: Rounds between two checkpoints, and stakes that may be broadcast: up to so many the sums stay in their partitions, and no round shuffles them.
ROUNDS, TOLD = 5, 4_000_000


def integrated(stakes: DataFrame, subjects: DataFrame | None = None, tolerance: float = 1e-12, most: int = 200, checkpoint: Checkpoint = lambda df: df.checkpoint()) -> DataFrame:
    """(entity, owner, share): direct and indirect shares of each owner in each entity, X = A + A X, over all chains of stakes (entity, owner, share).

    Only rows of `subjects` (entity) are solved for, all by default. Each round carries what was added last one stake
    further; circles converge as long as the shares that leave a circle do, and rounds end when no entity has more than
    `tolerance` left to carry (what is left out is at most that over the part of a round that leaves). A circle that
    keeps everything to itself, which has no solution, is an error after `most` rounds. Stakes of null, of nothing and
    of less are left out; several between the same two count together; no stakes give no rows.

    A row holds both the sum so far and what the last round added, so there is one table, not one a round.
    """
    direct = checkpoint(stakes.where("entity is not null and owner is not null and share > 0").groupBy("entity", "owner").agg(F.sum("share").cast("double").alias("share")))
    # Where a row goes in a round: what it got last to the owner's owners, its sum to where it is.
    further = direct.select(F.col("entity").alias("owner"), F.col("owner").alias("_next"), F.col("share").alias("_share"), F.lit(0.0).alias("_stays"))
    stays = direct.select("owner").distinct().select("owner", F.col("owner").alias("_next"), F.lit(0.0).alias("_share"), F.lit(1.0).alias("_stays"))
    ways = checkpoint(further.unionByName(stays))
    if direct.limit(TOLD + 1).count() <= TOLD:
        ways = F.broadcast(ways)
    now = direct if subjects is None else direct.join(subjects.select("entity").distinct(), "entity", "left_semi")
    now = now.select("entity", "owner", "share", F.col("share").alias("all"))
    for done in range(0, most, ROUNDS):
        # A checkpoint forgets how its rows lie: dealt again, no round until the next one shuffles, where stakes are broadcast.
        now = now.repartition("entity")
        for _ in range(min(ROUNDS, most - done)):
            added = F.sum(F.col("share") * F.col("_share"))
            now = now.join(ways, "owner").groupBy("entity", F.col("_next").alias("owner")).agg(added.alias("share"), (F.sum(F.col("all") * F.col("_stays")) + added).alias("all"))
        now = checkpoint(now)
        left = now.groupBy("entity").agg(F.sum("share").alias("left")).agg(F.max("left")).first()[0]
        if left is None or left <= tolerance:
            return now.select("entity", "owner", F.col("all").alias("share"))
    raise ValueError(f"stakes in a circle still carry {left:g} after {most} rounds")


def pagerank(edges: DataFrame, src: str, dst: str, weight: str | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-12, checkpoint: Checkpoint = lambda df: df.checkpoint()) -> DataFrame:
    """(node, rank): PageRank by power iteration; ranks sum to 1. What nodes without outgoing edges hold goes to all nodes alike.

    Rounds end when ranks change by `tolerance` or less in sum, or after `rounds`. Repeated edges count together, loops
    count, edges with a null end or without a positive weight are left out; no edges give no rows.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), w.alias("w")).where("src is not null and dst is not null and w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("all"))
    e = checkpoint(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("part")))
    # For each node, whether edges leave it and whether they reach it.
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    nodes = checkpoint(ends.groupBy("node").agg((F.max("out") == 0).alias("dangling"), (F.max("in") == 0).alias("first")))
    n, firsts, dangling = nodes.agg(F.count(F.lit(1)), F.count_if("first"), F.count_if("dangling")).first()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    # Nodes that no edge reaches all have the same rank in every round, so what they give is one sum a node, and no round shuffles their edges.
    first = nodes.where("first").select(F.col("node").alias("src"))
    fixed = e.join(first, "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("fixed"))
    now = checkpoint(nodes.where("not first").join(fixed, "node", "left").select("node", "dangling", F.coalesce("fixed", F.lit(0.0)).alias("fixed"), F.lit(1.0 / n).alias("rank")))
    inner = checkpoint(e.join(first, "src", "left_anti").select(F.col("src").alias("node"), "dst", "part"))
    several = not inner.isEmpty()
    theirs, loose = 1.0 / n, dangling / n
    for _ in range(rounds):
        base = (1 - damping + damping * loose) / n
        old = now.withColumnRenamed("rank", "_old")
        if several:
            given = now.join(inner, "node").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("part")).alias("given"))
            old = old.join(given, "node", "left")
        else:
            old = old.withColumn("given", F.lit(0.0))
        rank = F.lit(base) + damping * (F.coalesce("given", F.lit(0.0)) + F.lit(theirs) * F.col("fixed"))
        new = checkpoint(old.withColumn("rank", rank).select("node", "dangling", "fixed", "rank", "_old"))
        loose, moved = new.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)), F.lit(0.0)), F.coalesce(F.sum(F.abs(F.col("rank") - F.col("_old"))), F.lit(0.0))).first()
        moved += firsts * abs(base - theirs)
        now, theirs = new.drop("_old"), base
        if moved <= tolerance:
            break
    return now.select("node", "rank").unionByName(first.select(F.col("src").alias("node"), F.lit(theirs).alias("rank")))
