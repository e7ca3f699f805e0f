"""Evidence: custody digests, duplicates, indicators of compromise and their defanged form, pages and mail policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of indicators, by type.
INDICATORS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "hash": r"\b(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b",
    "url": r"https?://[A-Za-z0-9./?&=#:_%-]+",
}
#: Signs of techniques in a page's source.
STACK = {"script": r"(?i)<script", "style": r"(?i)<style", "form": r"(?i)<form", "frame": r"(?i)<iframe", "article": r"(?i)<article"}


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def custody(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, bytes and SHA-256 of each piece of evidence; null content has none."""
    return df.select(key, F.octet_length(content).cast("long").alias("n_bytes"), digest(F.col(content)).alias("sha256"))


def duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """Digests that occur more than once, how often, and the least key; only digests are shuffled."""
    return custody(df, key, content).groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id")).where("copies > 1")


def indicators(df: DataFrame, key: str, text: str, kinds: tuple[str, ...] = tuple(INDICATORS)) -> DataFrame:
    """(key, ioc_type, value, evidence_sha256): distinct indicators of each text."""
    values = F.create_map(*(x for k in kinds for x in (F.lit(k), F.regexp_extract_all(F.col(text), F.lit(INDICATORS[k]), F.lit(0)))))
    found = F.flatten(F.transform(F.map_entries(values), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("ioc_type"), v.alias("value")))))
    each = df.select(key, digest(F.col(text)).alias("evidence_sha256"), F.explode(F.array_distinct(found)).alias("i"))
    return each.select(key, "i.ioc_type", "i.value", "evidence_sha256")


def defanged(value: Column, kind: Column) -> Column:
    """Indicators that can't be followed: [.] and [@], hxxp, and addresses without their middle."""
    ip = F.regexp_replace(value, r"^([0-9]+)\.[0-9]+\.[0-9]+\.([0-9]+)$", "$1.XX.XX.$2")
    return F.when(kind == "ip", ip).when(kind == "hash", value).otherwise(F.replace(F.replace(F.replace(value, F.lit("http"), F.lit("hxxp")), F.lit("."), F.lit("[.]")), F.lit("@"), F.lit("[@]")))


def redacted(text: Column, names: Column, mask: str = "[redacted]") -> Column:
    """A text without the names in an array<string> (null and empty ones left out), whatever their case; longer names first."""
    given = F.array_sort(F.filter(F.array_distinct(names), lambda x: F.length(F.trim(x)) > 0), lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(given, lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}\s])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(given) > 0, F.regexp_replace(text, pattern, F.lit(mask))).otherwise(text)


def hosts(df: DataFrame, url: str) -> DataFrame:
    """host and number of pages."""
    return df.select(F.lower(F.parse_url(F.col(url), F.lit("HOST"))).alias("host")).where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


def stack(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, technique) for each sign found in a page."""
    found = F.filter(F.array(*(F.when(F.col(html).rlike(p), F.lit(k)) for k, p in STACK.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(found).alias("technique"))


def mail_policy(df: DataFrame, domain: str, record: str) -> DataFrame:
    """domain, kind (spf, dkim, dmarc) and policy of mail TXT records; other records are left out."""
    t = F.lower(F.trim(F.col(record)))
    kind = F.when(t.startswith("v=spf1"), "spf").when(t.startswith("v=dkim1"), "dkim").when(t.startswith("v=dmarc1"), "dmarc")
    policy = F.when(kind == "spf", F.regexp_extract(t, r"([-~?+]?)all\b", 0)).when(kind == "dmarc", F.regexp_extract(t, r"\bp=([a-z]+)", 1)).when(kind == "dkim", F.when(t.rlike(r"\bp=[a-z0-9+/]"), "key").otherwise("revoked"))
    return df.select(domain, kind.alias("kind"), policy.alias("policy")).where("kind is not null")
