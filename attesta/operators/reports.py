"""Reports: findings, materiality, determination, sections, and the plain text of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .screening import CLAUSE

#: Levels of materiality, the weightiest first.
LEVELS = ("SUSTANCIAL", "RELEVANTE", "MENOR")
#: Fixed value: what stands for an empty field.
PENDING = "[pendiente]"


def materiality(confidence: Column) -> Column:
    """The level of a finding by confidence: our rule, as none is given: 95 and over, 80 and over, and the rest."""
    return F.when(confidence >= 95, LEVELS[0]).when(confidence >= 80, LEVELS[1]).otherwise(LEVELS[2])


def numbered(findings: DataFrame, case: str, *order: str) -> DataFrame:
    """Findings with `finding` H1, H2, ... in each case."""
    return findings.withColumn("finding", F.concat(F.lit("H"), F.row_number().over(Window.partitionBy(case).orderBy(*order)).cast("string")))


def complete(findings: DataFrame) -> DataFrame:
    """`findings` with `complete`: source, method and a confidence from 0 to 100 are given."""
    given = F.col("source").isNotNull() & F.col("method").isNotNull() & F.coalesce(F.col("confidence").between(0, 100), F.lit(False))
    return findings.withColumn("complete", given)


def weight(findings: DataFrame, case: str) -> DataFrame:
    """case, its materiality (that of its weightiest finding), and the number of findings of each level."""
    level = materiality(F.col("confidence"))
    rank = sum((F.when(level == name, i).otherwise(0) for i, name in enumerate(LEVELS)), F.lit(0))
    n = [F.sum(F.when(level == name, 1).otherwise(0)).alias(f"n_{name.lower()}") for name in LEVELS]
    return findings.groupBy(case).agg(F.element_at(F.array(*map(F.lit, LEVELS)), F.min(rank) + 1).alias("materiality"), *n)


def determination(checks: DataFrame, case: str, standard: str, ok: str) -> DataFrame:
    """case, standard, number of checks, and whether all conform."""
    return checks.groupBy(case, standard).agg(F.count(F.lit(1)).alias("checks"), F.bool_and(ok).alias("conforming"))


def stale(df: DataFrame, reported: Column, downloaded: Column, most_hours: int = 24) -> DataFrame:
    """`df` with the age of the list at the report, in hours, and whether it is too old."""
    age = F.timestamp_diff("SECOND", downloaded, reported) / 3600
    return df.withColumn("age_hours", F.round(age, 2)).withColumn("stale", age > most_hours)


def annex(sources: DataFrame, case: str) -> DataFrame:
    """The annex of sources of each case, numbered A1, A2, ...: each different (source, url, consulted_at) once."""
    order = Window.partitionBy(case).orderBy("source", "url", "consulted_at")
    one = sources.select(case, "source", "url", "consulted_at").distinct()
    return one.withColumn("annex", F.concat(F.lit("A"), F.row_number().over(order).cast("string")))


def texts(findings: DataFrame, matches: DataFrame, case: str, checks: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """case and the plain text of its report, section by section; the clause is always there, matches or none.

    `checks` (rows of `determination`) give section 5 a line for each standard, `sources` (case, source, url,
    consulted_at) give section 6 its annex; without them the sections say that there is none.
    """
    line = F.concat(F.lit("   "), F.col("finding"), F.lit(": "), F.col("field"), F.lit(" = "), F.col("value"), F.lit(" ("), F.col("method"), F.lit(", "), F.col("source"), F.lit(", "), F.format_number("confidence", 0), F.lit("%)"))
    told = findings.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(F.length("finding").alias("n"), F.col("finding").alias("f"), line.alias("line")))).alias("_f"))
    hit = F.concat(F.lit("   - "), F.col("alias_detected"), F.lit(" / "), F.col("list_matched"), F.lit(": "), F.format_number("score", 2), F.lit(" "), F.col("class"))
    found = matches.groupBy(case).agg(F.array_sort(F.collect_list(hit)).alias("_m"))
    both = told.join(weight(findings, case), case).join(found, case, "left")
    none = F.lit(None).cast("array<string>")
    if checks is None:
        both = both.withColumn("_d", none)
    else:
        each = F.concat(F.lit("   - "), F.col("standard"), F.lit(": "), F.when(F.col("conforming"), "conforming").otherwise("not conforming"), F.lit(" ("), F.col("checks").cast("string"), F.lit(" checks)"))
        both = both.join(checks.groupBy(case).agg(F.array_sort(F.collect_list(each)).alias("_d")), case, "left")
    if sources is None:
        both = both.withColumn("_a", none)
    else:
        each = F.concat(F.lit("   "), F.col("annex"), F.lit(": "), F.col("source"), F.lit(", "), F.col("url"), F.lit(", consulted "), F.date_format("consulted_at", "yyyy-MM-dd"))
        listed = F.array_sort(F.collect_list(F.struct(F.length("annex").alias("n"), F.col("annex").alias("a"), each.alias("line"))))
        both = both.join(annex(sources, case).groupBy(case).agg(F.transform(listed, lambda x: x["line"]).alias("_a")), case, "left")
    joined = lambda c, empty: F.array_join(F.coalesce(c, F.array(F.lit(empty))), "\n")
    parts = [
        F.lit("1. OBJECT"), F.concat(F.lit("   Case "), F.col(case).cast("string")), F.concat(F.lit("2. MATERIALITY: "), F.col("materiality")), F.lit("3. FINDINGS"), F.array_join(F.transform("_f", lambda x: x["line"]), "\n"),
        F.lit("4. ALIASES AND LISTS"), joined(F.col("_m"), "   CLEAR"), F.lit(f"   >> {CLAUSE}"), F.lit("5. DETERMINATION"), joined(F.col("_d"), "   No standard was checked."), F.lit("   The legal assessment is up to the recipient."),
        F.lit("6. ANNEXES"), joined(F.col("_a"), "   None."),
    ]
    return both.select(case, F.concat_ws("\n", *parts).alias("report"))


def file_name(system: str, case: Column, day: Column) -> Column:
    """The name of a report's file: system, case and date."""
    return F.concat(F.lit(f"{system}_CASO-"), case.cast("string"), F.lit("_"), F.date_format(day, "yyyy-MM-dd"), F.lit(".txt"))


def write_texts(reports: DataFrame, path: str, system: str, day: str) -> None:
    """Every report as plain text; `file` of the folder in which Spark puts its part is the report's file name."""
    case = F.col(reports.columns[0])
    named = reports.select(file_name(system, case, F.lit(day).cast("date")).alias("file"), F.col("report").alias("value"))
    named.write.mode("overwrite").partitionBy("file").text(path)


#: The fields of an invocation, with their labels, section by section.
INVOCATION = {
    "Natural person": {"subject_name": "Name(s)", "aliases": "Known aliases", "dob": "Date of birth", "nationality": "Nationality", "documents": "Documents"},
    "Legal person": {"entity_name": "Company name", "entity_variants": "Variants", "jurisdiction": "Jurisdiction", "tax_id": "Tax registration"},
}


def invocation(requests: DataFrame, system: str = "System", version: str = "v3.1") -> DataFrame:
    """`requests` with `text`: the whole request in plain text, section by section, empty and missing fields pending."""

    def field(c: str) -> Column:
        given = F.col(c).cast("string") if c in requests.columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.lit(PENDING))

    lines = [F.lit(f"{system} ready. {version}"), F.lit(""), F.concat(F.lit("Mode: ["), field("mode"), F.lit("]")), F.concat(F.lit("Evidence: ["), field("evidence_type"), F.lit("]")), F.lit(""), F.lit("Subjects to compare with restrictive lists:")]
    for section, fields in INVOCATION.items():
        lines += [F.lit(f"  - {section}:"), *(F.concat(F.lit(f"      {label}: "), field(c)) for c, label in fields.items())]
    return requests.withColumn("text", F.concat_ws("\n", *lines, F.lit(""), F.lit("Which evidence is analysed?")))
