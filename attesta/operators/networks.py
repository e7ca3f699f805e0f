"""Networks: address ranges, certificates, lists of hosts, links between entities, owners, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def address(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    p = F.split(ip, r"\.")
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")
    return F.when(ok, sum((p[i].cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0)))


def located(ips: DataFrame, ip: str, ranges: DataFrame) -> DataFrame:
    """`ips` with the columns of the range (first, last) that holds each address, or nulls.

    A range join on buckets of 65,536 addresses: an address is in one bucket, a range in those it touches. Ranges
    that span many buckets are few, as registries hand out few of them.
    """
    each = ranges.withColumns({"_low": address(F.col("first")), "_high": address(F.col("last"))})
    each = each.withColumn("_bucket", F.explode(F.sequence(F.shiftright("_low", 16), F.shiftright("_high", 16)))).drop("first", "last")
    n = address(F.col(ip))
    met = ips.withColumns({"_n": n, "_at": F.shiftright(n, 16)}).join(each, (F.col("_at") == F.col("_bucket")) & F.col("_n").between(F.col("_low"), F.col("_high")), "left")
    return met.drop("_n", "_at", "_low", "_high", "_bucket")


def certificates(df: DataFrame, asof: str) -> DataFrame:
    """Certificates (host, not_before, not_after as dates) with status and days left on a day."""
    day = F.lit(asof).cast("date")
    status = F.when(F.col("not_before") > day, "not yet valid").when(F.col("not_after") < day, "expired").otherwise("valid")
    return df.withColumns({"status": status, "days_left": F.datediff("not_after", day)})


def listed(df: DataFrame, other: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Rows whose key is (or isn't) in another table."""
    return df.join(other.select(key), key, "left_semi" if present else "left_anti")


def registered(entities: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """`entities` with `exists`, whether the registry has them."""
    known = registry.select(key).distinct().withColumn("_known", F.lit(True))
    return entities.join(known, key, "left").withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known")


def agreement(sources: list[DataFrame], names: list[str], key: str, value: str) -> DataFrame:
    """key, sources (how many have it), values (how many different), and whether all that have it agree."""
    each = [s.select(key, F.col(value).cast("string").alias("v"), F.lit(n).alias("source")) for s, n in zip(sources, names, strict=True)]
    both = each[0]
    for e in each[1:]:
        both = both.unionByName(e)
    out = both.groupBy(key).agg(F.count_distinct("source").alias("sources"), F.count_distinct("v").alias("values"))
    return out.withColumn("agree", F.col("values") <= 1)


def owners(stakes: DataFrame, least: float, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """(entity, owner, share): direct and indirect shares along chains of stakes (entity, owner, share), summed, from `least` on.

    Each round makes all chains one stake longer, summed by entity and owner, until there are no new ones. Where
    stakes go round in circles, chains end when they are as long as there are owners, or weigh less than 1e-12.
    """
    step = checkpoint(stakes.groupBy("entity", "owner").agg(F.sum("share").alias("share")))
    further = step.select(F.col("entity").alias("owner"), F.col("owner").alias("_next"), F.col("share").alias("_share"))
    now, every = step, [step]
    for _ in range(step.select("owner").distinct().count()):
        now = now.join(further, "owner").select("entity", F.col("_next").alias("owner"), (F.col("share") * F.col("_share")).alias("share")).where("entity <> owner")
        now = checkpoint(now.groupBy("entity", "owner").agg(F.sum("share").alias("share")).where("share >= 1e-12"))
        if now.isEmpty():
            break
        every.append(now)
    return reduce(DataFrame.unionByName, every).groupBy("entity", "owner").agg(F.round(F.sum("share"), 6).alias("share")).where(F.col("share") >= least)


def shell_signs(df: DataFrame, signs: dict[str, Column], least: int) -> DataFrame:
    """Entities with the number of signs that hold and whether they are suspicious; an unknown sign doesn't hold."""
    n = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in signs.values()), F.lit(0))
    return df.withColumn("signs", n).withColumn("suspicious", F.col("signs") >= least)


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """node, outgoing and incoming weight and distinct neighbours."""
    ends = edges.select(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col(dst).alias("other"))
    ends = ends.unionByName(edges.select(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.col(src).alias("other")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count_distinct("other").alias("neighbours"))


def link_degrees(links: DataFrame, left: str, right: str) -> DataFrame:
    """side (0 left, 1 right), id, n_out, n_in and neighbours of the nodes of different links from left nodes to right ones. Ids stay numbers and links are counted once for both sides."""
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).cast("bigint").alias("id")) for k, c in enumerate((left, right)))))
    n = links.select(ends.alias("e")).groupBy("e.side", "e.id").agg(F.count(F.lit(1)).alias("neighbours"))
    here = lambda k: F.when(F.col("side") == k, F.col("neighbours")).otherwise(F.lit(0).cast("bigint"))
    return n.select("side", "id", here(0).alias("n_out"), here(1).alias("n_in"), "neighbours")


def group_components(members: DataFrame, group: str, member: str, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """(side, id, component): groups (side 0) and members (side 1) that hang together by rows (group, member); component is the least member's id.

    Each group ties its members to the least of them, which leaves a graph of members alone: its different edges are
    far fewer than the rows, and only they go round. Rows without a group or a member tie nothing.
    """
    rows = members.select(F.col(group).cast("bigint").alias("g"), F.col(member).cast("bigint").alias("m")).where("g is not null and m is not null")
    least = rows.groupBy("g").agg(F.min("m").alias("low"))
    tied = checkpoint(rows.join(least, "g").select("low", "m").distinct())
    met = components(tied.where("low <> m"), "low", "m", checkpoint)
    own = tied.select("m").distinct().join(met, F.col("m") == F.col("node"), "left").select("m", F.coalesce("component", "m").alias("component"))
    groups = least.join(own.withColumnRenamed("m", "low"), "low").select(F.lit(0).alias("side"), F.col("g").alias("id"), "component")
    return groups.unionByName(own.select(F.lit(1).alias("side"), F.col("m").alias("id"), "component"))


def components(edges: DataFrame, a: str, b: str, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """(node, component): the least node reachable from each node of an edge. Labels spread to neighbours and jump to the label's own label, so rounds grow with the logarithm of a chain's length."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = checkpoint(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpoint(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("next"))
        new = labels.join(near, "u").join(jump, "label", "left").select("u", F.least("label", "near", "next").alias("new"), "label")
        new = checkpoint(new)
        if new.where("new <> label").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("new").alias("component"))
        labels = new.select("u", F.col("new").alias("label"))
