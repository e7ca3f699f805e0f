"""Routes of a case: which steps its evidence takes, in order, and the chain of transformations they make."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The steps of each kind of evidence, in order, and the modes of a request.
ROUTES = {
    "suspicious document": ("DOC", "ALIAS", "OSINT", "NET"),
    "entity or platform": ("ALIAS", "OSINT", "NET", "CYBER"),
    "incident": ("CYBER", "NET", "OSINT", "ALIAS"),
    "narrative": ("NARRATIVE", "OSINT", "ALIAS", "NET"),
    "person": ("ALIAS", "OSINT", "NET", "CYBER"),
    "document and entity": ("DOC", "ALIAS", "OSINT", "NET", "CYBER"),
}
#: What a step is limited to in a route.
LIMITS = {("entity or platform", "CYBER"): "passive", ("incident", "CYBER"): "logs, IOCs", ("incident", "NET"): "IPs", ("person", "CYBER"): "passive", ("document and entity", "CYBER"): "passive"}
MODES = ("DOC", "OSINT", "NET", "CYBER", "ALIAS", "NARRATIVE", "TIMELINE", "INTEGRADO")


def steps(evidence: str, mode: str = "INTEGRADO") -> tuple[str, ...]:
    """The steps of a case: the whole route, or only the mode's step if one is chosen."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    route = ROUTES[evidence]
    return route if mode == "INTEGRADO" else tuple(s for s in route if s == mode) or (mode,)


def run(df: DataFrame, evidence: str, transformations: Mapping[str, Callable[[DataFrame], DataFrame]], mode: str = "INTEGRADO") -> DataFrame:
    """`df` through the transformations of the route's steps, one lazy plan."""
    return reduce(lambda d, s: d.transform(transformations[s]), steps(evidence, mode), df)


def limits(spark: SparkSession) -> DataFrame:
    """trigger, pos, step and limit (null: none) of every step of every route."""
    known = spark.createDataFrame([(t, s, x) for (t, s), x in LIMITS.items()], "trigger string, step string, limit string")
    return table(spark).select("trigger", "pos", "step").join(F.broadcast(known), ["trigger", "step"], "left")


def table(spark: SparkSession) -> DataFrame:
    """trigger, pos (from 0), step and whether another follows."""
    df = spark.createDataFrame([(k, list(v)) for k, v in ROUTES.items()], "trigger string, flow array<string>")
    return df.select("trigger", F.size("flow").alias("n"), F.posexplode("flow").alias("pos", "step")).select("trigger", "pos", "step", (F.col("pos") < F.col("n") - 1).alias("more"))
