"""Networks by prefix: the narrowest of the prefixes that hold an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .networks import address


def network(number: Column, length: Column) -> Column:
    """The first address of the network of an address's first `length` bits."""
    return number - F.pmod(number, F.call_function("shiftleft", F.lit(1).cast("bigint"), (32 - length).cast("int")))


def table(prefixes: DataFrame, prefix: str) -> DataFrame:
    """`prefixes` (written a.b.c.d/n; bits behind the prefix are put to zero) with `network` and `bits`; malformed ones are left out, of equal ones the first by its text stays."""
    cut = F.split(F.col(prefix), "/")
    bits = F.when(F.col(prefix).rlike(r"^[0-9.]+/(?:[0-9]|[12][0-9]|3[0-2])$"), cut[1].cast("int"))
    made = prefixes.withColumns({"bits": bits, "_n": address(cut[0])}).where("bits is not null and _n is not null").withColumn("network", network(F.col("_n"), F.col("bits"))).drop("_n")
    rest = [c for c in made.columns if c not in ("network", "bits")]
    return made.groupBy("network", "bits").agg(F.min(F.struct(prefix, *(c for c in rest if c != prefix))).alias("_")).select("network", "bits", "_.*")


def narrowest(addresses: DataFrame, ip: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """`addresses` with the columns of the longest prefix that holds each address, nulls where none does; one row for each row.

    One hash join: each different address is looked up under each prefix length that the table has, 33 at most, and
    keeps its longest hit; nested and overlapping prefixes need nothing more. Malformed addresses stay, with nulls.
    """
    known = table(prefixes, prefix)
    lengths = [r.bits for r in known.select("bits").distinct().orderBy("bits").collect()]
    rest = [c for c in known.columns if c not in ("network", "bits")]
    numbers = addresses.select(address(F.col(ip)).alias("_number")).where("_number is not null").distinct()
    tried = numbers.select("_number", F.explode(F.array(*(F.lit(n) for n in lengths)).cast("array<int>")).alias("bits")).withColumn("network", network(F.col("_number"), F.col("bits")))
    hits = tried.join(known, ["network", "bits"]).groupBy("_number").agg(F.max_by(F.struct("bits", *rest), "bits").alias("_hit"))
    found = hits.select("_number", *(F.col(f"_hit.{c}").alias(c) for c in ("bits", *rest)))
    return addresses.withColumn("_number", address(F.col(ip))).join(found, "_number", "left").drop("_number")
