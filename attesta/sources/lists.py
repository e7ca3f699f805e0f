"""Lists as sources: the catalogue, readers of their formats into one schema, and versioned snapshots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One listed name: the schema that all readers give.
ENTRY = "list_name string, entry_id string, primary_name string, alias string, alias_quality string"
#: Name, authority and formats of the lists.
CATALOGUE = [
    ("OFAC SDN", "U.S. Treasury", "XML, CSV"), ("OFAC Consolidated", "U.S. Treasury", "XML, CSV"), ("UN Consolidated", "UN Security Council", "XML, HTML"), ("EU Consolidated", "European Union", "XML, CSV"),
    ("Interpol Red Notices", "Interpol", "HTML"), ("Interpol-UN Special", "Interpol, UN", "HTML"), ("FBI Most Wanted", "FBI", "JSON"), ("Europol Wanted", "Europol", "HTML"),
    ("Blocked Persons", "Mexico", "HTML, PDF"), ("UK Sanctions", "UK Treasury", "CSV, XML"), ("DFAT Consolidated", "Australia", "HTML, CSV"), ("OSFI", "Canada", "CSV, XML"),
]
#: Further lists by type. They are commercial or national and have no common format; rows come as ENTRY tables.
FURTHER = [
    ("PEPs (Dow Jones, Refinitiv)", "political exposure"), ("SEC Litigation Releases", "regulatory US"), ("CFTC Enforcement Actions", "regulatory US"),
    ("FCA Warning List", "regulatory UK"), ("CNBV Sanctions", "regulatory MX"), ("UIF Alerts", "financial intelligence MX"),
]


def further(spark: SparkSession) -> DataFrame:
    """name and type of each further list."""
    return spark.createDataFrame(FURTHER, "name string, type string")


def taken(entries: DataFrame, known: DataFrame) -> DataFrame:
    """`entries` (of any list, with the columns of ENTRY) with the `type` of the further list they are of; entries of no list in `known` go."""
    return entries.join(known.select(F.col("name").alias("list_name"), "type"), "list_name").select("list_name", "type", "entry_id", "primary_name", "alias", "alias_quality")


def catalogue(spark: SparkSession) -> DataFrame:
    """name, authority and formats (array) of each list."""
    df = spark.createDataFrame(CATALOGUE, "name string, authority string, format string")
    return df.select("name", "authority", F.split("format", ", ").alias("formats"))


def _entries(df: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    get = lambda c: F.col(columns[c]).cast("string") if c in columns else F.lit(None).cast("string")
    alias = F.explode_outer(F.filter(F.transform(F.split(get("alias"), ";"), lambda x: F.trim(x)), lambda x: x != ""))
    return df.select(F.lit(name).alias("list_name"), get("entry_id").alias("entry_id"), get("primary_name").alias("primary_name"), alias.alias("alias"), F.coalesce(get("alias_quality"), F.lit("unclassified")).alias("alias_quality"))


def read_csv(spark: SparkSession, path: str, name: str, columns: dict[str, str]) -> DataFrame:
    """A list in CSV; `columns` says which column holds entry_id, primary_name, alias (several by semicolons) and alias_quality."""
    return _entries(spark.read.option("header", True).csv(path), name, columns)


def read_json(spark: SparkSession, path: str, name: str, columns: dict[str, str]) -> DataFrame:
    return _entries(spark.read.json(path), name, columns)


def read_xml(spark: SparkSession, path: str, name: str, row_tag: str, columns: dict[str, str]) -> DataFrame:
    return _entries(spark.read.format("xml").option("rowTag", row_tag).load(path), name, columns)


def read_html(spark: SparkSession, path: str, name: str, columns: dict[str, str]) -> DataFrame:
    """A list published as an HTML table: the row of header cells names the columns, each further row is an entry; markup in cells is left out."""
    page = spark.read.text(path, wholetext=True)
    row = page.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("i", "row"), F.input_file_name().alias("file"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    text = lambda c: F.replace(F.replace(F.replace(F.replace(plain(c), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    cells = row.withColumn("cells", F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), text))
    head = cells.where("row rlike '(?i)<th'").groupBy("file").agg(F.min_by("cells", "i").alias("head"))
    body = cells.where("not row rlike '(?i)<th'").join(head, "file")
    named = body.select(*(F.nullif(F.try_element_at("cells", F.nullif(F.array_position("head", c).cast("int"), F.lit(0))), F.lit("")).alias(c) for c in columns.values()))
    return _entries(named, name, columns)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, time of change and SHA-256 of evidence files."""
    read = spark.read.format("binaryFile").load(path)
    return read.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def snapshot(entries: DataFrame, path: str, version: str, sha256: str, taken: str) -> None:
    """Writes entries as the list's snapshot of a version, replacing that version only."""
    stamped = entries.withColumns({"source_version": F.lit(version), "dataset_sha256": F.lit(sha256), "consulted_at": F.lit(taken).cast("timestamp")})
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list_name", "source_version").parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of each list."""
    every = spark.read.parquet(path)
    newest = every.groupBy("list_name").agg(F.max_by("source_version", F.struct("consulted_at", "source_version")).alias("source_version"))
    return every.join(newest, ["list_name", "source_version"], "left_semi")


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): entries of two snapshots that are `added`, `removed` or `changed`, by a digest of each key's rows; only digests are shuffled.

    Rows of one key are compared as a bag: order makes no difference, repeats and nulls do. Both have the same columns; a key may hold nulls.
    """
    rest = sorted(set(new.columns) - set(key))
    row = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    side = lambda df, name: df.groupBy(*key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ","), 256).alias(name))
    a, b = side(old, "_old").alias("a"), side(new, "_new").alias("b")
    met = a.join(b, reduce(lambda x, y: x & y, (F.equal_null(F.col(f"a.{k}"), F.col(f"b.{k}")) for k in key)), "full")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return met.where("not _old <=> _new").select(*(F.when(F.col("_new").isNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in key), kind.alias("change"))


def rescreened(before: DataFrame, changed: DataFrame, key: str, screen: Callable[[DataFrame], DataFrame], new: DataFrame) -> DataFrame:
    """Matches against a new snapshot, from those against the one before: entries that went or changed lose theirs, those that came or changed are screened, the rest isn't touched.

    `screen` gives matches with the column `key` for entries of that key; `changed` is what `changes` gives.
    """
    kept = before.join(changed.select(key), key, "left_anti")
    fresh = new.join(changed.where("change <> 'removed'").select(key), key, "left_semi")
    return kept.unionByName(screen(fresh).select(*before.columns))
