"""Documentary checks: sums, dates, rules, entities in text, fonts, keywords."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of entities that can be told by their form.
ENTITIES = {"date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "money": r"[$€£]\s?[0-9][0-9.,]*[0-9]", "phone": r"\+[0-9]{1,3}[ -]?[0-9]{2,4}[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}"}


def sums(headers: DataFrame, lines: DataFrame, key: str, line_key: str, total: Column, amount: Column, tolerance: float = 0.01) -> DataFrame:
    """key, stated, computed, difference and whether they agree; a header without lines has computed 0. Lines are summed before the join."""
    added = lines.groupBy(F.col(line_key).alias(key)).agg(F.sum(amount).alias("computed"))
    both = headers.select(key, total.alias("stated")).join(added, key, "left").withColumn("computed", F.coalesce("computed", F.lit(0.0)))
    both = both.withColumn("difference", F.round(F.col("stated") - F.col("computed"), 2))
    return both.withColumns({"stated": F.round("stated", 2), "computed": F.round("computed", 2), "consistent": F.abs("difference") <= tolerance})


def early(df: DataFrame, value: str, issue: str) -> DataFrame:
    """Rows whose value date lies before the issue date, with the gap in days."""
    return df.where(F.col(value) < F.col(issue)).withColumn("gap_days", F.datediff(issue, value))


def outside(facts: DataFrame, rules: DataFrame, kind: str, value: str) -> DataFrame:
    """Facts that break a rule of their kind (kind, low, high; null is open), with the rule's bounds."""
    met = facts.join(rules.select(F.col("kind").alias(kind), "low", "high"), kind)
    return met.where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def conformity(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """`df` with `failed`, the names of the checks that don't hold, and `conforming`; an unknown check counts as failed."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return df.withColumn("failed", failed).withColumn("conforming", F.size("failed") == 0)


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity_type, value, n) of entities told by their form."""
    values = F.create_map(*(x for k, p in ENTITIES.items() for x in (F.lit(k), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)))))
    found = F.flatten(F.transform(F.map_entries(values), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("entity_type"), v.alias("value")))))
    return df.select(key, F.explode(found).alias("e")).groupBy(key, "e.entity_type", "e.value").agg(F.count(F.lit(1)).alias("n"))


def odd_fonts(fields: DataFrame, key: str, field: str, font: str) -> DataFrame:
    """Fields whose font differs from the most frequent one of their document (ties to the least name)."""
    counts = fields.groupBy(key, font).agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy(key).agg(F.min_by(F.col(font), F.struct(-F.col("n"), F.col(font))).alias("usual_font"))
    return fields.join(usual, key).where(F.col(font) != F.col("usual_font")).select(key, field, font, "usual_font")


def keywords(df: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, keyword, n): how often listed words occur as whole words, in either case."""
    counted = F.array(*(F.struct(F.lit(w).alias("keyword"), F.size(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}]){w.lower()}(?![\p{{L}}\p{{N}}])"), F.lit(0))).alias("n")) for w in words))
    return df.select(key, F.explode(counted).alias("k")).select(key, "k.keyword", "k.n").where("n > 0")


def first_errors(df: DataFrame, order: str) -> DataFrame:
    """The first report of each error (message, filename, lineno), with message cut to 500 and stack to 2,000 characters."""
    rank = F.row_number().over(Window.partitionBy("message", "filename", "lineno").orderBy(order))
    kept = df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return kept.withColumns({"message": F.substring("message", 1, 500), "stack": F.substring("stack", 1, 2000)})
