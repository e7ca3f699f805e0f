"""The registered queries of the library over the star schema and text tables, and their DuckDB SQL.

Stand-ins: part names are screened as if they were names of people, orders and lines as documents, events as logs.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import identifiers, names, phonetics
from .functions import similarity as S
from .operators import documents, evidence, influence, linkage, mentions, narratives, networks, prefixes, reports, screening, timelines
from .plans import routes
from .sources import custody, lists

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Bytes of a table's files to a shuffle partition before adaptive execution joins small ones, to which size it joins them, and bytes of files to a task that reads: tasks don't grow with the input.
PIECE, JOINED, SPLIT = 2 << 20, 4 << 20, 16 << 20
#: Rows and bytes of an Arrow batch of whole texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bounded(spark: SparkSession, path: str) -> SparkSession:
    """Bounds the tasks of shuffles over a table of this size, and Arrow batches, unless the session already sets more partitions or less."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(files).getLength()
    number = lambda name: int(now) if str(now := spark.conf.get(name, None)).isdigit() else 0
    parts, advised = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if size // PIECE > max(number(parts), number("spark.sql.shuffle.partitions")):
        spark.conf.set(parts, str(size // PIECE))
    if spark.conf.get(advised, None) in (None, "67108864b", "64MB"):
        spark.conf.set(advised, str(JOINED))
    # What a task sums by key before the shuffle grows with what it reads.
    if spark.conf.get("spark.sql.files.maxPartitionBytes", None) in (None, "134217728b", "128MB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT))
    for name, most in BATCH.items():
        if not 0 < number(name) <= most:
            spark.conf.set(name, str(most))
    return spark


def tidied(spark: SparkSession) -> None:
    """From now on the shuffles of a checkpoint or a write go when it is done, not when the driver happens to collect garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    return bounded(spark, path).read.parquet(path)


def part_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; where it is unset, in a temporary folder in local mode (tests), else an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="attesta-"))
    return df.checkpoint()


# Screening ---------------------------------------------------------------------------------------


def soundex_sql(c: str) -> str:
    """Soundex of an upper-cased ASCII name as DuckDB SQL."""
    code = f"translate(regexp_replace(substr(upper({c}), 2), '[HW]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', '012301200224550126230102020')"
    first = f"translate(substr(upper({c}), 1, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    one = f"({first} || {code})"
    for n in "0123456":
        one = f"regexp_replace({one}, '{n}+', '{n}', 'g')"
    return f"(substr(upper({c}), 1, 1) || substr(rpad(replace(substr({one}, 2), '0', ''), 3, '0'), 1, 3))"


PAIRS_SQL = f"""
with n as (select distinct p_name as name from part), p as (
    select a.name as a, b.name as b, jaro_winkler_similarity(a.name, b.name) as jw,
        case when {soundex_sql("a.name")} = {soundex_sql("b.name")} then 1.0 else 0.0 end as sdx,
        1 - levenshtein(a.name, b.name)::double / greatest(length(a.name), length(b.name), 1) as lev
    from n a join n b on a.name < b.name
), s as (select *, round((0.5 * jw + 0.2 * sdx + 0.3 * lev) * 100, 2) as score from p), c as (
    select *, case when score >= 95 then 'CONFIRMED' when score >= 80 then 'LIKELY' when score >= 60 then 'POTENTIAL' else 'CLEAR' end as class from s
)
"""


def name_pairs(spark: SparkSession, d: str, threshold: float = 60.0) -> DataFrame:
    """Pairs a < b of part names that score `threshold` or more."""
    return pairs_of(checkpoint(part_names(spark, d)), threshold)


def pairs_of(n: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Pairs a < b of different names that score `threshold` or more."""
    pairs = screening.candidates(n.select(F.col("name").alias("a")), n.select(F.col("name").alias("b")), "a", "b", threshold, checkpoint).where("a < b")
    return screening.scored(pairs, "a", "b").where(F.col("score") >= threshold)


@query(PAIRS_SQL + "select a, b, round(jw, 6) as jw, sdx::double as sdx, round(lev, 6) as lev, score, class from c where score >= 60")
def alias_score(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round("jw", 6).alias("jw"), "sdx", F.round("lev", 6).alias("lev"), "score", "class")


@query(PAIRS_SQL + "select class, count(*) as pairs from c group by class")
def alias_classify(spark, d):
    n = checkpoint(part_names(spark, d))
    found = checkpoint(pairs_of(n).groupBy("class").agg(F.count(F.lit(1)).alias("pairs")))  # read twice, so that the pairs are scored once
    total = n.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("bigint").alias("all"))
    clear = total.join(found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("some"))).select(F.lit("CLEAR").alias("class"), (F.col("all") - F.col("some")).alias("pairs"))
    return found.unionByName(clear.where("pairs > 0"))


@query(PAIRS_SQL + ", m as (select a, b, score from c where score >= 60 union all select b, a, score from c where score >= 60) select a as subject, b as entry, score from m qualify row_number() over (partition by a order by score desc, b) = 1")
def alias_best_match(spark, d):
    p = checkpoint(name_pairs(spark, d).select("a", "b", "score"))
    both = p.select(F.col("a").alias("subject"), F.col("b").alias("entry"), "score").unionByName(p.select(F.col("b").alias("subject"), F.col("a").alias("entry"), "score"))
    return screening.best(both, "subject", "entry")


QUALITY_SQL = "case length(b) % 3 when 0 then 'good' when 1 then 'low' else 'unclassified' end"


@query(PAIRS_SQL + f", q as (select a, b, score as base_score, {QUALITY_SQL} as quality from c), r as (select *, round(least(base_score + case quality when 'good' then 10 when 'low' then 5 else 0 end, 100), 2) as score from q) select a, b, base_score, quality, score, case when score >= 95 then 'CONFIRMED' when score >= 80 then 'LIKELY' else 'POTENTIAL' end as class from r where score >= 60")
def alias_quality_adjust(spark, d):
    n = checkpoint(part_names(spark, d))
    quality = F.when(F.length("name") % 3 == 0, "good").when(F.length("name") % 3 == 1, "low").otherwise("unclassified")
    out = screening.screened(n.select(F.col("name").alias("a")), n.select(F.col("name").alias("b"), quality.alias("quality")), "a", "b", quality="quality", checkpoint=checkpoint)
    return out.where("a < b").select("a", "b", "base_score", "quality", "score", "class")


@query(PAIRS_SQL + "select a, b, score from c where score >= 80")
def phonetic_block_join(spark, d):
    return name_pairs(spark, d, 80.0).select("a", "b", "score")


@query(PAIRS_SQL + "select sdx::int as soundex_equal, class, count(*) as pairs, grouping(sdx, class)::int as level from c where score >= 60 group by rollup (sdx, class)")
def match_summary_rollup(spark, d):
    p = name_pairs(spark, d).withColumn("soundex_equal", F.col("sdx").cast("int"))
    return p.rollup("soundex_equal", "class").agg(F.count(F.lit(1)).alias("pairs"), F.grouping_id().cast("int").alias("level"))


@query(PAIRS_SQL + "select a as subject_name, case when sdx = 1 then 'phonetic' else 'fuzzy' end as match_type, count(*) as aliases from c where score >= 60 group by all")
def match_type_counts(spark, d):
    p = name_pairs(spark, d).withColumn("match_type", S.match_type(F.col("a"), F.col("b"), F.col("sdx")))
    return p.groupBy(F.col("a").alias("subject_name"), "match_type").agg(F.count(F.lit(1)).alias("aliases"))


@query(PAIRS_SQL + "select a as subject_name, b as alias_detected, 'unclassified' as alias_quality, 'parts' as list_matched, 'stand-in' as list_authority, case when sdx = 1 then 'phonetic' else 'fuzzy' end as match_type, score, null::double as confidence, 'part.parquet' as source_url, '1' as source_version, sha256('part') as dataset_sha256, '2024-12-14 03:00:00' as consulted_at from c where score >= 60")
def screening_matches(spark, d):
    p = name_pairs(spark, d).withColumn("match_type", S.match_type(F.col("a"), F.col("b"), F.col("sdx")))
    given = {"alias_quality": "unclassified", "list_matched": "parts", "list_authority": "stand-in", "source_url": "part.parquet", "source_version": "1", "consulted_at": "2024-12-14 03:00:00"}
    return screening.match_records(p, "a", "b", {k: F.lit(v) for k, v in given.items()} | {"dataset_sha256": F.sha2(F.lit("part"), 256)})


@query("""
with s as (select doc_id, n_chars % 101 as s, toxic as t from documents join labels using (doc_id) where toxic is not null),
x as (select unnest([60.0, 80.0, 95.0]) as threshold),
c as (select threshold::double as threshold, count(*) filter (s >= threshold and t = 1) as tp, count(*) filter (s >= threshold and t <> 1) as fp, count(*) filter (s < threshold and t = 1) as fn from s, x group by threshold)
select *, round(tp / nullif(tp + fp, 0)::double, 4) as precision, round(tp / nullif(tp + fn, 0)::double, 4) as recall from c
""")
def calibration_sweep(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels").where("toxic is not null"), "doc_id").select((F.col("n_chars") % 101).alias("s"), "toxic")
    return screening.calibration(rows, "s", "toxic", [60.0, 80.0, 95.0])


BRAND_SQL = PAIRS_SQL.split("), p as (")[0] + f"""), k as (select distinct upper(p_brand) as b from part union select distinct upper(name) from n), p as (
    select a.name as a, k.b, jaro_winkler_similarity(a.name, k.b) as jw, case when {soundex_sql("a.name")} = {soundex_sql("k.b")} then 1.0 else 0.0 end as sdx, 1 - levenshtein(a.name, k.b)::double / greatest(length(a.name), length(k.b), 1) as lev
    from (select name from n union select upper(name) from n) a, k)"""


@query(BRAND_SQL + " select a as subject, b as entry, round((0.5 * jw + 0.2 * sdx + 0.3 * lev) * 100, 2) as score, case when a = b then 'exact' when upper(a) = b then 'transliteration' when sdx = 1 then 'phonetic' else 'fuzzy' end as match_type from p where round((0.5 * jw + 0.2 * sdx + 0.3 * lev) * 100, 2) >= 60")
def match_types(spark, d):
    """All four types: names in both cases against names and brands in upper case, which stands in for another alphabet's letters."""
    n = checkpoint(part_names(spark, d))
    subjects = n.select(F.col("name").alias("subject")).union(n.select(F.upper("name"))).distinct()
    entries = read(spark, d, "part").select(F.upper("p_brand").alias("entry")).union(n.select(F.upper("name"))).distinct()
    pairs = screening.scored(screening.candidates(subjects, entries, "subject", "entry", checkpoint=checkpoint), "subject", "entry").where("score >= 60")
    return pairs.select("subject", "entry", "score", S.match_type(F.col("subject"), F.col("entry"), F.col("sdx"), F.upper("subject") == F.col("entry")).alias("match_type"))


#: Names and their published Metaphone keys.
KEYS = {"Thompson": "TMSN", "Church": "XRX", "Knight": "NT", "Wright": "RT", "Which": "WX", "Phone": "FN", "Smith": "SM0", "Smyth": "SM0", "Xavier": "SFR", "Physics": "FSKS", "Science": "SNS", "Bridge": "BRJ", "Lamb": "LM", "Watch": "WX", "Nation": "NXN", "Judge": "JJ", "Thumb": "0M", "Jackson": "JKSN", "Whale": "WL", "Catherine": "K0RN"}


@query("select * from (values " + ", ".join(f"('{n}', '{k}')" for n, k in KEYS.items()) + ") t(name, key)")
def metaphone_keys(spark, d):
    return spark.createDataFrame([(n,) for n in KEYS], "name string").withColumn("key", phonetics.metaphone(F.col("name")))


#: Made-up first names, and the number of made-up names, that are screened against each other.
FIRST = "maria jose juan ana luis carlos pedro laura elena david marta paula jorge diego sofia lucia pablo hugo irene ruben"
MADE_UP = 3000


@query()
def screening_of_many_names(spark, d):
    """3,000 made-up names against each other, for the bench: candidates, scores, classes."""
    made = spark.range(MADE_UP).select(F.concat_ws(" ", F.element_at(F.split(F.lit(FIRST), " "), (F.col("id") % 20 + 1).cast("int")), F.translate(F.substring(F.md5(F.floor(F.col("id") / 20).cast("string")), 1, 8), "0123456789", "lmnrstuvio")).alias("a"))
    return screening.screened(made, made.select(F.col("a").alias("b")), "a", "b", 80.0, checkpoint=checkpoint).where("a < b").select("a", "b", "score", "class", "match_type")


# Names -------------------------------------------------------------------------------------------


@query(r"select doc_id, token, count(*) as n from (select doc_id, unnest(list_filter(regexp_split_to_array(text, '[\s,\-]+'), lambda x: x <> '')) as token from documents) group by all")
def name_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(names.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query(r"select p_partkey, trim(regexp_replace(lower(trim(p_name)), '\s+', ' ', 'g')) as name from part")
def name_normalize(spark, d):
    return read(spark, d, "part").select("p_partkey", names.normalized(F.col("p_name")).alias("name"))


@query("select doc_id, nfc_normalize(text) = text as is_nfc, regexp_matches(regexp_replace(text, '[^\\p{L}]', '', 'g'), '[^\\p{Latin}]') as non_latin, sha256(strip_accents(substr(text, 1, length(text)))) as plain_sha256 from documents")
def name_forms(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", (names.nfc(t) == t).alias("is_nfc"), names.needs_transliteration(t).alias("non_latin"), F.sha2(names.strip_marks(t), 256).alias("plain_sha256"))


@query("select * from (values ('iso233', 'باريس', 'bʾrys'), ('ala-lc', 'باريس', 'bārys'), ('bgn', 'москва', 'moskva'), ('bgn', 'щука', 'shchuka')) t(standard, name, latin)")
def transliterations(spark, d):
    rows = spark.createDataFrame([("iso233", "باريس"), ("ala-lc", "باريس"), ("bgn", "москва"), ("bgn", "щука")], "standard string, name string")
    latin = F.coalesce(*(F.when(F.col("standard") == t, names.transliterated(F.col("name"), t)) for t in names.LETTERS))
    return rows.withColumn("latin", latin)


@query()
def phonetic_variants(spark, d):
    return part_names(spark, d).select("name", F.explode(phonetics.variants(F.col("name"))).alias("v")).select("name", "v.kind", "v.key")


@query("select * from (values (1, 'Juan'), (1, 'El Chico'), (2, 'Ana')) t(id, alias)")
def alias_split(spark, d):
    rows = spark.createDataFrame([(1, " Juan, El Chico,, "), (2, "Ana"), (3, "")], "id int, aliases string")
    return rows.select("id", F.explode(names.aliases(F.col("aliases"))).alias("alias"))


# Documents ---------------------------------------------------------------------------------------

#: Identifiers and whether they are valid.
IDENTIFIERS = [("IBAN", "GB29NWBK60161331926819", True), ("IBAN", "GB28NWBK60161331926819", False), ("IBAN", "DE89 3704 0044 0532 0130 00", True), ("ISIN", "US0378331005", True), ("ISIN", "US0378331006", False), ("LEI", "5493001KJTIIGC8Y1R12", True), ("LEI", "5493001KJTIIGC8Y1R13", False), ("BIC", "TVMUS33XXX", False), ("BIC", "DEUTDEFF", True), ("BIC", "DEUTDEFF500", True)]


@query("select * from (values " + ", ".join(f"('{k}', '{v}', {str(ok).lower()})" for k, v, ok in IDENTIFIERS) + ") t(kind, value, valid)")
def identifier_checks(spark, d):
    rows = spark.createDataFrame([(k, v) for k, v, _ in IDENTIFIERS], "kind string, value string")
    return rows.withColumn("valid", identifiers.valid(F.col("kind"), F.col("value")))


#: Identifiers as a table would hold them: made from keys, most of them with wrong check digits, some malformed.
MADE_SQL = """select c_custkey as id, 'ISIN' as kind, case when c_custkey % 50 = 7 then 'us' || c_custkey else 'US' || lpad(cast(c_custkey * 7919 % 1000000000 as varchar(9)), 9, '0') || c_custkey % 10 end as value from customer
union all select o_orderkey, 'IBAN', case when o_orderkey % 50 = 7 then 'GB' || o_orderkey else 'GB' || lpad(cast(2 + o_orderkey % 97 as varchar(2)), 2, '0') || ' NWBK ' || lpad(cast(o_orderkey * 104729 % 100000000000000 as varchar(14)), 14, '0') end from orders
union all select s_suppkey, 'BIC', upper(substr(s_name, 1, 4)) || 'DE' || lpad(cast(s_suppkey % 100 as varchar(2)), 2, '0') || case when s_suppkey % 3 = 0 then 'XXX' when s_suppkey % 3 = 1 then '' else 'X' end from supplier"""


@query(f"""
with m as ({MADE_SQL}), i as (select id, value, ('3028' || substr(value, 3))::hugeint as n from m where kind = 'ISIN' and length(value) = 12),
g as (select id, value, list_transform(range(1, length(n::varchar) + 1), lambda k: substr(reverse(n::varchar), k, 1)::int * (1 + (k + 1) % 2)) as t from i),
isin as (select id, value, list_sum(list_transform(t, lambda x: x // 10 + x % 10)) % 10 = 0 as ok from g),
iban as (select id, value, (('23321120' || substr(replace(value, ' ', ''), 9) || '1611' || substr(value, 3, 2))::hugeint % 97) = 1 as ok from m where kind = 'IBAN' and value like '% %')
select m.kind, m.id, m.value, case m.kind when 'BIC' then regexp_matches(m.value, '^[A-Z]{{4}}DE[0-9]{{2}}([A-Z0-9]{{3}})?$') else coalesce(a.ok, b.ok, false) end as valid, case when m.kind = 'BIC' then m.value in (select upper(substr(s_name, 1, 4)) || 'DE' || lpad(cast(s_suppkey % 100 as varchar(2)), 2, '0') || 'XXX' from supplier where s_acctbal >= 0) end as listed
from m left join isin a on m.kind = 'ISIN' and a.id = m.id left join iban b on m.kind = 'IBAN' and b.id = m.id
""")
def identifier_audit(spark, d):
    """Check digits and structure of identifiers in tables; bank codes are also looked up in a directory, which lists head offices of suppliers without debt."""
    for t in ("customer", "orders", "supplier"):
        read(spark, d, t).createOrReplaceTempView(f"_made_{t}")
    rows = spark.sql(re.sub(r"from (customer|orders|supplier)\b", r"from _made_\1", MADE_SQL))
    code = F.concat(F.upper(F.substring("s_name", 1, 4)), F.lit("DE"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.lit("XXX"))
    directory = read(spark, d, "supplier").where("s_acctbal >= 0").select(code.alias("value"))
    banks = networks.registered(rows.where("kind = 'BIC'"), directory, "value").withColumnRenamed("exists", "listed")
    every = rows.where("kind <> 'BIC'").withColumn("listed", F.lit(None).cast("boolean")).unionByName(banks)
    return every.select("kind", "id", "value", identifiers.valid(F.col("kind"), F.col("value")).alias("valid"), "listed")


@query("""
with l as (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as computed from lineitem group by l_orderkey)
select o_orderkey, round(o_totalprice, 2) as stated, round(coalesce(computed, 0), 2) as computed, round(o_totalprice - coalesce(computed, 0), 2) as difference, abs(round(o_totalprice - coalesce(computed, 0), 2)) <= 0.01 as consistent
from orders left join l on l_orderkey = o_orderkey
""")
def arithmetic_consistency(spark, d):
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return documents.sums(read(spark, d, "orders"), read(spark, d, "lineitem"), "o_orderkey", "l_orderkey", F.col("o_totalprice"), amount)


@query("select l_orderkey, l_linenumber, date_diff('day', l_shipdate::date, o_orderdate::date)::int as gap_days from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate")
def temporal_inconsistency(spark, d):
    both = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return documents.early(both, "l_shipdate", "o_orderdate").select("l_orderkey", "l_linenumber", "gap_days")


RULES = [("1-URGENT", 1000.0, 300000.0), ("2-HIGH", None, 250000.0), ("3-MEDIUM", 5000.0, None)]


@query("with r(kind, low, high) as (values ('1-URGENT', 1000, 300000), ('2-HIGH', null, 250000), ('3-MEDIUM', 5000, null)) select o_orderkey, o_orderpriority, o_totalprice, low::double as low, high::double as high from orders join r on kind = o_orderpriority where o_totalprice < low or o_totalprice > high")
def parametric_comparison(spark, d):
    rules = spark.createDataFrame(RULES, "kind string, low double, high double")
    facts = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return documents.outside(facts, rules, "o_orderpriority", "o_totalprice").select("o_orderkey", "o_orderpriority", "o_totalprice", "low", "high")


@query("select l_orderkey, l_linenumber, concat_ws(',', case when not l_quantity between 1 and 45 then 'quantity' end, case when not l_discount <= 0.09 then 'discount' end, case when not l_tax <= 0.07 then 'tax' end) as failed from lineitem where not (l_quantity between 1 and 45 and l_discount <= 0.09 and l_tax <= 0.07)")
def document_conformity(spark, d):
    checks = {"quantity": F.col("l_quantity").between(1, 45), "discount": F.col("l_discount") <= 0.09, "tax": F.col("l_tax") <= 0.07}
    out = documents.conformity(read(spark, d, "lineitem"), checks).where("not conforming")
    return out.select("l_orderkey", "l_linenumber", F.array_join("failed", ",").alias("failed"))


@query(r"""
with e as (
    select doc_id, 'date' as entity_type, unnest(regexp_extract_all(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) as value from documents
    union all select doc_id, 'money', unnest(regexp_extract_all(text, '[$€£]\s?[0-9][0-9.,]*[0-9]')) from documents
    union all select doc_id, 'phone', unnest(regexp_extract_all(text, '\+[0-9]{1,3}[ -]?[0-9]{2,4}[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}')) from documents
) select doc_id, entity_type, value, count(*) as n from e group by all
""")
def pattern_entities(spark, d):
    return documents.entities(read(spark, d, "documents"), "doc_id", "text")


@query("with c as (select l_orderkey, l_returnflag, count(*) as n from lineitem group by all), u as (select l_orderkey, l_returnflag as usual_font from c qualify row_number() over (partition by l_orderkey order by n desc, l_returnflag) = 1) select l_orderkey, l_linenumber, l_returnflag, usual_font from lineitem join u using (l_orderkey) where l_returnflag <> usual_font")
def odd_fonts(spark, d):
    return documents.odd_fonts(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query(r"select doc_id, k as keyword, len(regexp_extract_all(lower(text), '\b' || k || '\b')) as n from documents, (select unnest(['password', 'token', 'licensed']) as k) where len(regexp_extract_all(lower(text), '\b' || k || '\b')) > 0")
def keyword_indicators(spark, d):
    out = documents.keywords(read(spark, d, "documents"), "doc_id", "text", ["password", "token", "licensed"])
    return out.withColumn("n", F.col("n").cast("bigint"))


# Evidence ----------------------------------------------------------------------------------------


@query("select doc_id, strlen(text) as n_bytes, sha256(text) as sha256 from documents")
def evidence_sha256(spark, d):
    return evidence.custody(read(spark, d, "documents"), "doc_id", "text")


@query("select sha256(text) as sha256, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def duplicate_evidence(spark, d):
    return evidence.duplicates(read(spark, d, "documents"), "doc_id", "text")


IOC_SQL = """
with i as (select doc_id, kind as ioc_type, unnest(list_distinct(regexp_extract_all(text, re))) as value, sha256(text) as evidence_sha256
from documents, (values """ + ", ".join(f"('{k}', '{p}')" for k, p in evidence.INDICATORS.items()) + ") t(kind, re))"


@query(r"select p_partkey, regexp_replace(p_name || ' (' || upper(p_name) || ') by ' || p_brand, '(?i)\b' || p_name || '\b', '[redacted]', 'g') as text from part")
def subject_redaction(spark, d):
    said = F.concat("p_name", F.lit(" ("), F.upper("p_name"), F.lit(") by "), "p_brand")
    return read(spark, d, "part").select("p_partkey", evidence.redacted(said, F.array("p_name", F.lit(""))).alias("text"))


@query(IOC_SQL + " select * from i")
def ioc_extract(spark, d):
    return evidence.indicators(read(spark, d, "documents"), "doc_id", "text")


@query(IOC_SQL + r" select doc_id, ioc_type, case ioc_type when 'ip' then regexp_replace(value, '^([0-9]+)\.[0-9]+\.[0-9]+\.([0-9]+)$', '\1.XX.XX.\2') when 'hash' then value else replace(replace(replace(value, 'http', 'hxxp'), '.', '[.]'), '@', '[@]') end as shown from i")
def ioc_defanged(spark, d):
    found = evidence.indicators(read(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "ioc_type", evidence.defanged(F.col("value"), F.col("ioc_type")).alias("shown"))


@query("select lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host, count(*) as pages from pages group by 1")
def url_hosts(spark, d):
    return evidence.hosts(read(spark, d, "pages"), "url")


@query("select page_id, technique from (values " + ", ".join(f"('{k}', '{p}')" for k, p in evidence.STACK.items()) + ") t(technique, re), pages where regexp_matches(html, re)")
def tech_stack(spark, d):
    return evidence.stack(read(spark, d, "pages"), "page_id", "html")


@query("select * from (values ('a.com', 'spf', '-all'), ('a.com', 'dmarc', 'reject'), ('b.com', 'spf', '~all'), ('b.com', 'dkim', 'key')) t(domain, kind, policy)")
def mail_policy(spark, d):
    rows = [("a.com", "v=spf1 ip4:10.0.0.0/8 -all"), ("a.com", "v=DMARC1; p=reject; pct=100"), ("b.com", "v=spf1 include:x ~all"), ("b.com", "v=DKIM1; k=rsa; p=MIGf"), ("b.com", "other")]
    return evidence.mail_policy(spark.createDataFrame(rows, "domain string, record string"), "domain", "record")


#: Text records as a name server would give them for the pages' hosts, made from the pages' numbers and the length of their addresses.
RECORDS_SQL = """select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as domain, case page_id % 4 when 0 then 'v=spf1 include:mail.example ' || substr('-~?', cast(length(url) % 3 + 1 as int), 1) || 'all'
when 1 then 'v=DMARC1; p=' || case length(url) % 3 when 0 then 'none' when 1 then 'quarantine' else 'reject' end || '; pct=100' when 2 then 'v=DKIM1; k=rsa; p=MIG' || page_id else 'verification=' || page_id end as record from pages"""


@query(f"with r as ({RECORDS_SQL}) select domain, case page_id % 4 when 0 then 'spf' when 1 then 'dmarc' else 'dkim' end as kind, case page_id % 4 when 0 then right(record, 4) when 1 then split_part(split_part(record, 'p=', 2), ';', 1) else 'key' end as policy from r where page_id % 4 < 3")
def host_mail_policies(spark, d):
    """What the hosts' text records say of mail."""
    read(spark, d, "pages").createOrReplaceTempView("_pages")
    return evidence.mail_policy(spark.sql(RECORDS_SQL.replace("from pages", "from _pages")), "domain", "record")


# Networks ----------------------------------------------------------------------------------------

RANGES = [("10.0.0.0", "59.255.255.255", "AS1"), ("60.0.0.0", "60.0.255.255", "AS2"), ("61.0.0.0", "99.255.255.255", "AS3")]
_number = lambda c: "(" + " + ".join(f"split_part({c}, '.', {i + 1})::bigint * {256 ** (3 - i)}" for i in range(4)) + ")"


@query(IOC_SQL + ", r(first, last, asn) as (values " + ", ".join(map(str, RANGES)) + f"), k as (select doc_id, value as ip from i where ioc_type = 'ip' and list_max(list_transform(string_split(value, '.'), lambda x: x::int)) <= 255) select doc_id, ip, asn from k left join r on {_number('ip')} between {_number('first')} and {_number('last')}")
def ip_ranges(spark, d):
    ips = evidence.indicators(read(spark, d, "documents"), "doc_id", "text", ("ip",)).select("doc_id", F.col("value").alias("ip"))
    ranges = spark.createDataFrame(RANGES, "first string, last string, asn string")
    return networks.located(ips.where(networks.address(F.col("ip")).isNotNull()), "ip", ranges)


@query("select o_orderkey, case when o_orderdate::date > date '1998-01-01' then 'not yet valid' when o_orderdate::date + 365 < date '1998-01-01' then 'expired' else 'valid' end as status, date_diff('day', date '1998-01-01', o_orderdate::date + 365)::int as days_left from orders")
def certificate_audit(spark, d):
    certs = read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("not_before"), F.date_add(F.to_date("o_orderdate"), 365).alias("not_after"))
    return networks.certificates(certs, "1998-01-01").select("o_orderkey", "status", "days_left")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def block_list(spark, d):
    bad = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return networks.listed(read(spark, d, "customer"), bad, "c_custkey").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def without_license(spark, d):
    have = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return networks.listed(read(spark, d, "customer"), have, "c_custkey", present=False).select("c_custkey", "c_name")


@query("select p_partkey, p_partkey in (select l_partkey from lineitem) as exists from part")
def legal_existence(spark, d):
    known = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return networks.registered(read(spark, d, "part").select("p_partkey"), known, "p_partkey").select("p_partkey", "exists")


STAKES = [("A", "B", 0.6), ("A", "C", 0.4), ("B", "D", 0.5), ("B", "E", 0.5), ("C", "D", 1.0), ("D", "F", 0.9)]


@query("with recursive s(entity, owner, share) as (values " + ", ".join(map(str, STAKES)) + "), w as (select entity, owner, share::double as share, 1 as n from s union all select w.entity, s.owner, w.share * s.share, n + 1 from w join s on s.entity = w.owner where n < 8) select entity, owner, round(sum(share), 6) as share from w group by all having round(sum(share), 6) >= 0.25")
def beneficial_owners(spark, d):
    return networks.owners(spark.createDataFrame(STAKES, "entity string, owner string, share double"), 0.25, checkpoint)


@query("select s_suppkey, (s_acctbal < 0)::int + (n.n_regionkey = 0)::int + (coalesce(l.lines, 0) < 5)::int as signs, (s_acctbal < 0)::int + (n.n_regionkey = 0)::int + (coalesce(l.lines, 0) < 5)::int >= 2 as suspicious from supplier join nation n on n_nationkey = s_nationkey left join (select l_suppkey, count(*) as lines from lineitem group by 1) l on l_suppkey = s_suppkey")
def shell_companies(spark, d):
    lines = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("lines"))
    both = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(lines, "s_suppkey", "left")
    signs = {"debt": F.col("s_acctbal") < 0, "region": F.col("n_regionkey") == 0, "idle": F.coalesce("lines", F.lit(0)) < 5}
    return networks.shell_signs(both, signs, 2).select("s_suppkey", "signs", "suspicious")


@query("with a as (select c_nationkey as k, 'customer' as s, n_name as v from customer join nation on c_nationkey = n_nationkey), b as (select s_nationkey, 'supplier', case when s_acctbal < 0 then n_name || '?' else n_name end from supplier join nation on s_nationkey = n_nationkey) select k as nationkey, count(distinct s) as sources, count(distinct v) as values, count(distinct v) <= 1 as agree from (select * from a union all select * from b) group by k")
def cross_source_agreement(spark, d):
    nation = read(spark, d, "nation")
    c = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_nationkey").alias("nationkey"), F.col("n_name").alias("v"))
    s = read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("s_nationkey").alias("nationkey"), F.when(F.col("s_acctbal") < 0, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name")).alias("v"))
    return networks.agreement([c, s], ["customer", "supplier"], "nationkey", "v")


EDGES_SQL = "select distinct o_custkey as customer, l_suppkey as supplier from orders join lineitem on l_orderkey = o_orderkey"
#: Labels spread along edges; only a node's least label so far is kept.
COMPONENTS_SQL = f"""
with recursive e as ({EDGES_SQL}), u as (select 'c' || customer as a, 's' || supplier as b from e), s as (select a, b from u union select b, a from u),
c(node, component) using key (node) as (
    select distinct a as node, a as component from s
    union (select distinct on (x.node) x.node, y.component from recurring.c x join s on s.a = x.node join c y on y.node = s.b where y.component < x.component order by x.node, y.component)
) select node, component from c
"""
DEGREES_SQL = f"with e as ({EDGES_SQL}), n as (select 'c' || customer as node, 1 as o, 0 as i, 's' || supplier as x from e union all select 's' || supplier, 0, 1, 'c' || customer from e) select node, sum(o)::bigint as n_out, sum(i)::bigint as n_in, count(distinct x) as neighbours from n group by node"


def entity_lines(spark: SparkSession, d: str) -> DataFrame:
    """The customer and supplier of every line, repeats included."""
    o, i = read(spark, d, "orders"), read(spark, d, "lineitem")
    return o.join(i, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier"))


def entity_edges(spark: SparkSession, d: str) -> DataFrame:
    """All customers with the suppliers of their lines."""
    return entity_lines(spark, d).distinct()


def named_nodes(df: DataFrame) -> DataFrame:
    """Rows of (side, id, ...) with the names of customers (on the left side) and suppliers as `node`."""
    name = F.concat(F.when(F.col("side") == 0, "c").otherwise("s"), F.col("id").cast("string"))
    return df.select(name.alias("node"), *(c for c in df.columns if c not in ("side", "id")))


@query(EDGES_SQL)
def entity_links(spark, d):
    return entity_edges(spark, d)


@query(COMPONENTS_SQL)
def entity_components(spark, d):
    found = checkpoint(networks.group_components(entity_lines(spark, d), "customer", "supplier", checkpoint))
    named = named_nodes(found)
    return named.join(named.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))


@query(DEGREES_SQL)
def influence_degrees(spark, d):
    return named_nodes(networks.link_degrees(entity_edges(spark, d), "customer", "supplier"))


# The same under the names that they had while the three above were an excerpt.
for _f in (entity_links, entity_components, influence_degrees):
    QUERIES[f"all_{_f.__name__}"], SQL[f"all_{_f.__name__}"] = _f, SQL[_f.__name__]


#: Whom a supplier depends on: the three that most often share its orders, ties to the lesser key. Half of it is theirs, by those counts; the rest stays outside.
STAKES_SQL = """
o as (select distinct l_orderkey as k, l_suppkey as s from lineitem), m as (select a.s as entity, b.s as owner, count(*) as n from o a join o b on b.k = a.k and b.s <> a.s group by all),
stake as (select entity, owner, 0.5 * n / sum(n) over (partition by entity) as share from (select * from m qualify row_number() over (partition by entity order by n desc, owner) <= 3))
"""


@query(f"""with recursive {STAKES_SQL}, w(entity, owner, share, k) as (
    select entity, owner, share, 1 from stake where entity in (select s_suppkey from supplier where s_acctbal < 0)
    union all select w.entity, t.owner, sum(w.share * t.share), k + 1 from w join stake t on t.entity = w.owner where k < 45 group by w.entity, t.owner, k
) select entity, owner, round(sum(share), 4) as share from w group by all having round(sum(share), 4) >= 0.01""")
def integrated_owners(spark, d):
    """Who stands behind the suppliers in debt, through all chains and circles of stakes."""
    tidied(spark)
    # An order's suppliers are shuffled as a list, to each of them; pairs are made, counted and ranked where their entity is.
    o = read(spark, d, "lineitem").where("l_orderkey is not null").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("all")).where(F.size("all") > 1)
    pairs = o.select(F.explode("all").alias("entity"), "all").repartition("entity").select("entity", F.explode("all").alias("owner")).where("entity <> owner")
    met = pairs.groupBy("entity", "owner").agg(F.count(F.lit(1)).alias("n"))
    three = met.withColumn("i", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "owner"))).where("i <= 3")
    stakes = three.withColumn("share", 0.5 * F.col("n") / F.sum("n").over(Window.partitionBy("entity")))
    subjects = read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("entity"))
    return influence.integrated(stakes, subjects, 1e-10, checkpoint=checkpoint).select("entity", "owner", F.round("share", 4).alias("share")).where("share >= 0.01")


@query("""
with recursive l as (select 'c' || o_custkey as src, 's' || l_suppkey as dst, count(*) as w from orders join lineitem on l_orderkey = o_orderkey group by all),
node as (select node, not bool_or(o) as dangling from (select src as node, true as o from l union all select dst, false from l) group by node), size as (select count(*) as n from node),
e as (select src, dst, w / sum(w) over (partition by src) as part from l union all select node, node, 0 from node),
r(node, rank, k) as (
    select node, 1.0::double / n, 0 from node, size
    union all select e.dst, (0.15 + 0.85 * any_value(loose)) / any_value(n) + 0.85 * sum(x.rank * e.part), k + 1
    from (select r.node, rank, k, n, sum(case when dangling then rank else 0 end) over () as loose from r join node using (node), size) x join e on e.src = x.node where k < 30 group by e.dst, k
) select node, round(rank, 9) as rank from r where k = 30
""")
def influence_ranks(spark, d):
    """PageRank of customers and suppliers, an edge from each customer to each supplier by their lines; suppliers have no way on."""
    o, i = read(spark, d, "orders"), read(spark, d, "lineitem")
    lines = o.join(i, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("w"))
    e = lines.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), "w")
    return influence.pagerank(e, "a", "b", "w", rounds=30, checkpoint=checkpoint).select("node", F.round("rank", 9).alias("rank"))


_clip = lambda x: f"least(greatest({x}, 1e-6), 1 - 1e-6)"
_side = lambda v: " * ".join(f"(case when g{i} then {v}{i} else 1 - {v}{i} end)" for i in (1, 2, 3))


@query(f"""
with recursive g as (
    select c_custkey, s_suppkey, c_custkey % 10 = s_suppkey % 10 as g1, abs(c_acctbal - s_acctbal) <= 25 as g2, coalesce(o, 0) > 0 as g3
    from customer join supplier on c_nationkey = s_nationkey and floor(c_acctbal / 500) = floor(s_acctbal / 500)
    left join (select o_custkey, l_suppkey, count(*) as o from orders join lineitem on l_orderkey = o_orderkey group by all) on o_custkey = c_custkey and l_suppkey = s_suppkey
), c as (select g1, g2, g3, count(*)::double as n from g group by all),
r(k, p, m1, m2, m3, u1, u2, u3) as (
    select 0, 0.1::double, 0.9::double, 0.9::double, 0.9::double, 0.1::double, 0.1::double, 0.1::double
    union all select any_value(k) + 1, {_clip("sum(n * w) / sum(n)")}, {", ".join(_clip(f"sum(n * w * g{i}::int) / sum(n * w)") for i in (1, 2, 3))}, {", ".join(_clip(f"sum(n * (1 - w) * g{i}::int) / sum(n * (1 - w))") for i in (1, 2, 3))}
    from (select *, p * {_side("m")} / (p * {_side("m")} + (1 - p) * {_side("u")}) as w from r, c where k < 50) having count(*) > 0
), f as (select * from r where k = 50), x as (select c_custkey, s_suppkey, p, {" + ".join(f"(case when g{i} then log2(m{i} / u{i}) else log2((1 - m{i}) / (1 - u{i})) end)" for i in (1, 2, 3))} as weight from g, f)
select c_custkey, s_suppkey, round(weight, 4) as weight, round(pow(2.0, weight) * (p / (1 - p)) / (1 + pow(2.0, weight) * (p / (1 - p))), 4) as probability from x
""")
def cross_references(spark, d):
    """How likely customers and suppliers of a nation with balances alike are the same party: by their numbers, balances and dealings."""
    c, p = read(spark, d, "customer"), read(spark, d, "supplier")
    band = lambda x: F.floor(F.col(x) / 500).alias("band")
    left = c.select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"), band("c_acctbal"))
    right = p.select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"), band("s_acctbal"))
    # Dealings within a block, by customer: they are few, so they travel with the customer and no pair is shuffled.
    places = lambda df, key, name: df.select(key, F.struct("nation", "band").alias(name))
    o, i = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    placed = o.join(places(left, "c_custkey", "_c"), F.col("o_custkey") == F.col("c_custkey"))
    sold = i.join(places(right, "s_suppkey", "_s"), F.col("l_suppkey") == F.col("s_suppkey"))
    dealt = placed.join(sold, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("_c") == F.col("_s"))).groupBy("c_custkey").agg(F.collect_set("s_suppkey").alias("dealt"))
    told = linkage.blocked(left.join(checkpoint(dealt), "c_custkey", "left"), right, ["nation", "band"])
    checks = {"number": F.col("c_custkey") % 10 == F.col("s_suppkey") % 10, "balance": F.abs(F.col("c_acctbal") - F.col("s_acctbal")) <= 25, "dealt": F.array_contains("dealt", F.col("s_suppkey"))}
    return linkage.linked(told, checks, 50, 0.0).select("c_custkey", "s_suppkey", F.round("weight", 4).alias("weight"), F.round("probability", 4).alias("probability"))


#: Made from the keys of customers and of events, as the tables have no networks: prefixes of 8 to 24 bits, and addresses.
PREFIX_SQL = "((c_custkey * 7919) % 223 + 1) || '.' || ((c_custkey * 31) % 256) || '.' || (c_nationkey * 10) || '.0/' || (8 + c_custkey % 17)"
ADDRESS_SQL = "((user_id * 31 + event_id * 17) % 223 + 1) || '.' || ((event_id * 11) % 256) || '.' || (user_id % 256) || '.' || ((event_id * 7) % 256)"


@query(IOC_SQL + f""", p as (select {PREFIX_SQL} as prefix, c_custkey, 8 + c_custkey % 17 as bits from customer), n as (select *, {_number("split_part(prefix, '/', 1)")} as net from p),
a as (select 'event' as kind, event_id as id, {ADDRESS_SQL} as ip from events union all select 'document', doc_id, value from i where ioc_type = 'ip'),
k as (select distinct ip, {_number('ip')} as x from a where list_max(list_transform(string_split(ip, '.'), lambda y: y::int)) <= 255),
h as (select ip, bits, prefix, c_custkey from k join n on x - x % (1::bigint << (32 - bits)) = net - net % (1::bigint << (32 - bits)) qualify row_number() over (partition by ip order by bits desc, prefix, c_custkey) = 1)
select kind, id, ip, bits::int as bits, prefix, c_custkey from a left join h using (ip)
""")
def narrowest_prefixes(spark, d):
    e, c = read(spark, d, "events"), read(spark, d, "customer")
    ips = e.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.expr(ADDRESS_SQL).alias("ip"))
    found = evidence.indicators(read(spark, d, "documents"), "doc_id", "text", ("ip",)).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("value").alias("ip"))
    return prefixes.narrowest(ips.unionByName(found), "ip", c.select(F.expr(PREFIX_SQL).alias("prefix"), "c_custkey"), "prefix").select("kind", "id", "ip", "bits", "prefix", "c_custkey")


# Timelines ---------------------------------------------------------------------------------------


@query("select user_id::varchar as entity, ts, 'events' as source, event_type from events union all select o_custkey::varchar, o_orderdate, 'orders', 'order ' || o_orderstatus from orders")
def unified_timeline(spark, d):
    e, o = read(spark, d, "events"), read(spark, d, "orders")
    return timelines.unified((e, "events", F.col("user_id"), F.col("ts"), F.col("event_type")), (o, "orders", F.col("o_custkey"), F.col("o_orderdate"), F.concat(F.lit("order "), F.col("o_orderstatus"))))


@query("with l as (select event_id, user_id, ts, date_sub('second', lag(ts) over (partition by user_id order by ts, event_id), ts) as gap_seconds from events) select * from l where gap_seconds >= 86400")
def activity_gaps(spark, d):
    return timelines.gaps(read(spark, d, "events"), "user_id", "ts", "event_id", 86_400).select("event_id", "user_id", "ts", "gap_seconds")


@query("""
with l as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes, true)::int as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts range unbounded preceding) as n from l)
select user_id, min(ts) as started, max(ts) as ended, count(*) as events from s group by user_id, n
""")
def activity_sessions(spark, d):
    return timelines.sessions(read(spark, d, "events"), "user_id", "ts")


@query("with l as (select user_id, date_sub('second', lag(ts) over (partition by user_id order by ts, event_id), ts) as step from events) select user_id, count(step) as steps, round(avg(step), 2) as mean_seconds, round(stddev_samp(step), 2) as sd_seconds from l group by user_id")
def periodicity(spark, d):
    return timelines.rhythm(read(spark, d, "events"), "user_id", "ts", "event_id")


@query("select (isodow(ts) - 1)::int as weekday, hour(ts)::int as hour, count(*) as events from events group by all")
def activity_hours(spark, d):
    return timelines.hours(read(spark, d, "events"), "ts")


@query("select event_type, ts::date as day, count(*) as events, count(distinct user_id) as users, round(sum(value), 4) as total, max((props::json ->> 'k')::int) as top_k from events group by all")
def log_analysis(spark, d):
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.max(k).alias("top_k"))


@query(r"""
with t as (select turn, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as token from conversations), c as (select turn, token, count(*) as n from t where token <> '' group by all)
select a.turn, a.token, a.n, a.n - coalesce(b.n, 0) as change from c a left join c b on b.turn = a.turn - 1 and b.token = a.token where a.n >= 2
""")
def narrative_evolution(spark, d):
    return timelines.narrative(read(spark, d, "conversations"), "turn", "text")


@query(r"""
with t as (select turn, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as token from conversations), c as (select turn, token, count(*) as n from t where token <> '' group by all)
select a.turn + 1 as turn, a.token, 0::bigint as n, -a.n as change from c a where a.n >= 2 and a.turn + 1 in (select turn from c) and not exists (select 1 from c b where b.turn = a.turn + 1 and b.token = a.token)
""")
def narrative_vanished(spark, d):
    return timelines.vanished(read(spark, d, "conversations"), "turn", "text")


@query(r"with l as (select doc_id, unnest(list_distinct(string_split(text, chr(10)))) as line from documents) select sha256(line) as line_sha256, length(line)::int as length, count(distinct doc_id) as texts from l where length(line) >= 20 group by line having count(distinct doc_id) > 1")
def shared_narrative(spark, d):
    return timelines.shared_lines(read(spark, d, "documents"), "doc_id", "text")


@query("select lang, round(covar_pop(n_chars, quality) / nullif(stddev_pop(n_chars) * stddev_pop(quality), 0), 6) as correlation, count(*) as n from documents join labels using (doc_id) group by lang")
def discourse_correlation(spark, d):
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return timelines.correlated(both, "lang", "n_chars", "quality")


NEAR_SQL = r"""
with recursive t as (select conv_id || ':' || turn as key, text from conversations union all select 'document:' || doc_id, text from documents),
w as (select key, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from t),
g as (select key, list_distinct(case when len(w) < 3 then [list_aggregate(w, 'string_agg', ' ')] else list_transform(range(1, len(w) - 1), lambda i: list_aggregate(w[i:i + 2], 'string_agg', ' ')) end) as g from w where len(w) > 0),
z as (select key, len(g) as n, hash(unnest(g)) as h from g),
x as (select a.key as a, b.key as b, count(*) as n, any_value(a.n) as na, any_value(b.n) as nb from z a join z b on a.h = b.h and a.key < b.key and least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) group by a.key, b.key),
e as (select a, b from x where n >= 0.7 * (na + nb - n)), s as (select a, b from e union all select b, a from e),
c(node, cluster) using key (node) as (
    select distinct a as node, a as cluster from s
    union (select distinct on (x.node) x.node, y.cluster from recurring.c x join s on s.a = x.node join c y on y.node = s.b where y.cluster < x.cluster order by x.node, y.cluster)
) select node as key, cluster, count(*) over (partition by cluster) as members from c
"""


@query(NEAR_SQL)
def near_narratives(spark, d):
    """Turns and documents that are told again in nearly the same words, Jaccard similarity of three-word shingles of 0.7 and more."""
    tidied(spark)
    turns = read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    told = turns.union(read(spark, d, "documents").select(F.concat(F.lit("document:"), "doc_id"), "text"))
    return narratives.clusters(told, "key", "text", 0.7, 3, checkpoint)


BURST_SQL = r"""
with recursive t as (select turn, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as token from conversations where turn is not null), c as (select turn, token, count(*) as r from t where token <> '' group by all),
d as (select turn, sum(r) as d, row_number() over (order by turn) as k from c group by turn), e as (select count(*) as m, sum(d) as d from d),
p as (select token, sum(r) / any_value(e.d)::double as p0, any_value(m) as m from c, e group by token having sum(r) >= 10), q as (select token, p0, least(2 * p0, 0.9999) as p1, ln(m)::double as g from p),
x as (select q.token, k, d.turn, coalesce(r, 0) as r, g, -(coalesce(r, 0) * ln(p0) + (d - coalesce(r, 0)) * ln(1 - p0)) as x0, -(coalesce(r, 0) * ln(p1) + (d - coalesce(r, 0)) * ln(1 - p1)) as x1 from q cross join d left join c on c.token = q.token and c.turn = d.turn),
v(token, k, c0, c1, s0, s1) as (
    select token, 0::bigint, 0::double, 1e300::double, '', '' from q
    union all select v.token, v.k + 1, least(c0, c1) + x0, least(c0 + g, c1) + x1, case when c0 <= c1 then s0 else s1 end || '0', case when c1 <= c0 + g then s1 else s0 end || '1' from v join x on x.token = v.token and x.k = v.k + 1
), s as (select token, case when c0 <= c1 then s0 else s1 end as s from v, e where k = m),
h as (select token, turn, r, k - row_number() over (partition by token order by k) as run from s join x using (token) where substr(s, k::int, 1) = '1')
select token, min(turn) as first_turn, max(turn) as last_turn, sum(r)::bigint as n from h group by token, run
"""


@query(BURST_SQL)
def narrative_bursts(spark, d):
    """From which turn to which a word is used far more than elsewhere."""
    return timelines.bursts(read(spark, d, "conversations"), "turn", "text")


DISCOURSE_SQL = r"""
with t as (select distinct doc_id, source, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as term from documents), c as (select source, term, count(*) as a from t where term <> '' group by all),
g as (select source, count(*) as docs from documents where source is not null group by source), o as (select term, sum(a) as has from c where source is not null group by term), e as (select sum(docs) as n from g),
x as (select c.source, c.term, a::double as a, (has - a)::double as b, (docs - a)::double as c, (n - docs - has + a)::double as d, n::double as n from c join g on g.source = c.source join o on o.term = c.term, e where has >= 5),
y as (select source, term, a::bigint as texts, round(2 * (case when a > 0 then a * ln(a * n / ((a + b) * (a + c))) else 0 end + case when b > 0 then b * ln(b * n / ((a + b) * (b + d))) else 0 end + case when c > 0 then c * ln(c * n / ((c + d) * (a + c))) else 0 end + case when d > 0 then d * ln(d * n / ((c + d) * (b + d))) else 0 end), 6) as llr from x where a * n > (a + b) * (a + c))
select source, term, texts, llr from y qualify row_number() over (partition by source order by llr desc, term) <= 50
"""


@query(DISCOURSE_SQL)
def discourse_terms(spark, d):
    """The words that set each source's documents apart."""
    return timelines.distinctive(read(spark, d, "documents"), "doc_id", "source", "text")


#: Periods in seconds, from half an hour to a week.
PERIODS = [1800, 3600, 7200, 10800, 21600, 43200, 86400, 172800, 302400, 604800]


@query("""
with a as (select user_id, p, (epoch_us(ts) % (p * 1000000::bigint)) / (p * 1000000.0::double) * 2 * 3.141592653589793 as x from events, (select unnest(""" + str(PERIODS) + """) as p)),
b as (select user_id, p, count(*) as n, round((pow(sum(cos(x)), 2) + pow(sum(sin(x)), 2)) / count(*), 9) as z from a group by all), c as (select * from b qualify row_number() over (partition by user_id order by z desc, p) = 1)
select user_id, p::int as period_seconds, n, round(z, 6) as power, round(least(exp(sqrt(1 + 4 * n + 4 * (n * n - n * z)) - (1 + 2 * n)), 1), 6) as p_value from c
""")
def strongest_periods(spark, d):
    return timelines.rayleigh(read(spark, d, "events"), "user_id", "ts", PERIODS)


# Lists -------------------------------------------------------------------------------------------

#: The names to look for: part names, and the first two and four words of the benchmark's items, which documents may hold.
LISTED_SQL = r"""select distinct p_name as name from part union select regexp_extract(text, '^\S+ \S+') from benchmark union select regexp_extract(text, '^\S+ \S+ \S+ \S+') from benchmark"""


@query(rf"""
with n as (select distinct lower(trim(name)) as name from ({LISTED_SQL}) where trim(name) <> ''),
t as (select 'document' as kind, doc_id as id, lower(text) as t from documents union all select 'page', page_id, lower(html) from pages),
m as (select kind, id, t, name from t join n on contains(t, name)), p as (select kind, id, t, name, unnest(list_filter(range(1, length(t) - length(name) + 2), lambda i: substr(t, i, length(name)) = name)) as start from m)
select kind, id, name, start::int as start from p
where not (regexp_matches(substr(t, start - 1, case when start > 1 then 1 else 0 end), '[\p{{L}}\p{{N}}]') and regexp_matches(name, '^[\p{{L}}\p{{N}}]')) and not (regexp_matches(substr(t, start + length(name), 1), '[\p{{L}}\p{{N}}]') and regexp_matches(name, '[\p{{L}}\p{{N}}]$'))
""")
def listed_mentions(spark, d):
    """Where documents and pages name what is listed, as whole words."""
    first = lambda n: F.regexp_extract("text", r"^\S+" + r" \S+" * n, 0)
    b = read(spark, d, "benchmark")
    names = read(spark, d, "part").select(F.col("p_name").alias("name")).union(b.select(first(1))).union(b.select(first(3)))
    texts = read(spark, d, "documents").select(F.struct(F.lit("document").alias("kind"), F.col("doc_id").alias("id")).alias("key"), "text")
    texts = texts.union(read(spark, d, "pages").select(F.struct(F.lit("page").alias("kind"), F.col("page_id").alias("id")), "html"))
    keyed = texts.select(F.concat_ws(":", "key.kind", "key.id").alias("key"), "text")
    out = mentions.mentions(keyed, "key", "text", names, "name")
    return out.select(F.split_part("key", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("key", F.lit(":"), F.lit(2)).cast("long").alias("id"), "name", "start")


@query("select p_partkey, p_name as name, p_brand as alias from part")
def stated_aliases(spark, d):
    said = F.concat(F.lit('the goods "'), "p_name", F.lit('", also known as '), "p_brand", F.lit(", are here"))
    return mentions.stated_aliases(read(spark, d, "part").select("p_partkey", said.alias("text")), "p_partkey", "text")


#: A list that grows by the day: parts that have been shipped, with the last sign of their returns.
SHIPPED = ("1995-01-20", "1995-01-30")
_shipped = lambda day: f"select p_partkey as entry_id, p_name as primary_name, max(l_returnflag) as alias_quality from part join lineitem on l_partkey = p_partkey where l_shipdate < timestamp '{day}' group by all"


def shipped(spark: SparkSession, d: str, day: str) -> DataFrame:
    """The list as it stood before a day."""
    lines = read(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit(day).cast("timestamp_ntz")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_returnflag").alias("alias_quality"))
    return lines.join(read(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("primary_name"), "alias_quality")


@query(f"with a as ({_shipped(SHIPPED[0])}), b as ({_shipped(SHIPPED[1])}) select entry_id, case when a.entry_id is null then 'added' when b.entry_id is null then 'removed' else 'changed' end as change from a full join b using (entry_id) where (a.primary_name, a.alias_quality) is distinct from (b.primary_name, b.alias_quality)")
def list_changes(spark, d):
    return lists.changes(shipped(spark, d, SHIPPED[0]), shipped(spark, d, SHIPPED[1]), ["entry_id"])


@query(PAIRS_SQL + f", b as ({_shipped(SHIPPED[1])}), m as (select a, b, score from c where score >= 80 union all select b, a, score from c where score >= 80 union all select name, name, 100 from n) select entry_id, m.a as subject, score::double as score, alias_quality from b join m on m.b = primary_name")
def list_rescreening(spark, d):
    """Matches of all part names with the list of the later day, from those of the earlier day and what changed between."""
    subjects = checkpoint(part_names(spark, d).select(F.col("name").alias("subject")))

    def screen(entries: DataFrame) -> DataFrame:
        names_ = entries.select(F.col("primary_name").alias("entry")).distinct()
        pairs = screening.scored(screening.candidates(subjects, names_, "subject", "entry", 80.0, checkpoint), "subject", "entry").where("score >= 80").select("subject", "entry", "score")
        return entries.join(pairs, F.col("primary_name") == F.col("entry")).select("entry_id", "subject", "score", "alias_quality")

    # Each is read several times.
    old, new = checkpoint(shipped(spark, d, SHIPPED[0])), checkpoint(shipped(spark, d, SHIPPED[1]))
    return lists.rescreened(screen(old), checkpoint(lists.changes(old, new, ["entry_id"])), "entry_id", screen, new)


@query()
def dataset_custody(spark, d):
    """The Merkle root of each given table's files."""
    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    return custody.datasets(spark, {t: f"{d}/{t}.parquet" for t in tables}, checkpoint=checkpoint)


# Reports -----------------------------------------------------------------------------------------


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of orders: lines that ship before the order, and totals that don't add up."""
    early = temporal_inconsistency(spark, d).select(F.col("l_orderkey").alias("case_id"), F.lit("ship date").alias("field"), F.col("gap_days").cast("string").alias("value"), F.lit("date comparison").alias("method"), F.lit("lineitem").alias("source"), (F.when(F.col("gap_days") > 300, 100.0).otherwise(90.0)).alias("confidence"), F.col("l_linenumber").alias("n"))
    off = arithmetic_consistency(spark, d).where("not consistent").select(F.col("o_orderkey").alias("case_id"), F.lit("total").alias("field"), F.lit("off").alias("value"), F.lit("sum").alias("method"), F.lit("orders").alias("source"), F.lit(75.0).alias("confidence"), F.lit(0).alias("n"))
    return early.unionByName(off)


FINDINGS_SQL = """
with f as (
    select l_orderkey as case_id, 'ship date' as field, date_diff('day', l_shipdate::date, o_orderdate::date)::varchar as value, 'date comparison' as method, 'lineitem' as source, case when date_diff('day', l_shipdate::date, o_orderdate::date) > 300 then 100.0 else 90.0 end::double as confidence, l_linenumber as n
    from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate
    union all select o_orderkey, 'total', 'off', 'sum', 'orders', 75.0, 0
    from orders left join (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as s from lineitem group by 1) on l_orderkey = o_orderkey where abs(round(o_totalprice - coalesce(s, 0), 2)) > 0.01
)
"""


@query(FINDINGS_SQL + "select case_id, 'H' || row_number() over (partition by case_id order by source, n, value) as finding, field, value, method, source, confidence, case when confidence >= 95 then 'SUSTANCIAL' when confidence >= 80 then 'RELEVANTE' else 'MENOR' end as materiality from f")
def report_findings(spark, d):
    out = reports.complete(reports.numbered(findings(spark, d), "case_id", "source", "n", "value")).where("complete")
    return out.select("case_id", "finding", "field", "value", "method", "source", "confidence", reports.materiality(F.col("confidence")).alias("materiality"))


@query(FINDINGS_SQL + "select case_id, case when max(confidence) >= 95 then 'SUSTANCIAL' when max(confidence) >= 80 then 'RELEVANTE' else 'MENOR' end as materiality, count(*) filter (confidence >= 95) as n_sustancial, count(*) filter (confidence >= 80 and confidence < 95) as n_relevante, count(*) filter (confidence < 80) as n_menor from f group by case_id")
def case_materiality(spark, d):
    return reports.weight(findings(spark, d), "case_id")


@query("select l_orderkey as case_id, s as standard, count(*) as checks, bool_and(ok) as conforming from (select l_orderkey, 'quantity' as s, l_quantity between 1 and 45 as ok from lineitem union all select l_orderkey, 'discount', l_discount <= 0.09 from lineitem) group by all")
def technical_determination(spark, d):
    each = F.array(F.struct(F.lit("quantity").alias("standard"), F.col("l_quantity").between(1, 45).alias("ok")), F.struct(F.lit("discount").alias("standard"), (F.col("l_discount") <= 0.09).alias("ok")))
    checks = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.explode(each).alias("c")).select("case_id", "c.standard", "c.ok")
    return reports.determination(checks, "case_id", "standard", "ok")


def case_sources(spark: SparkSession, d: str) -> DataFrame:
    """case_id, source, url and time of consultation of what the findings rest on."""
    told = findings(spark, d).select("case_id", "source").distinct().join(read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderdate"), "case_id")
    return told.select("case_id", "source", F.concat(F.lit("https://tables.example/"), "source").alias("url"), F.date_add(F.to_date("o_orderdate"), 1).alias("consulted_at"))


@query(FINDINGS_SQL + ", s as (select distinct case_id, source, 'https://tables.example/' || source as url, (o_orderdate::date + 1)::date as consulted_at from f join orders on o_orderkey = case_id) select case_id, source, url, consulted_at, 'A' || row_number() over (partition by case_id order by source, url, consulted_at) as annex from s")
def source_annex(spark, d):
    return reports.annex(case_sources(spark, d), "case_id")


@query("select o_orderkey, 'SYSTEM_CASO-' || o_orderkey || '_' || strftime(o_orderdate, '%Y-%m-%d') || '.txt' as file from orders")
def report_files(spark, d):
    return read(spark, d, "orders").select("o_orderkey", reports.file_name("SYSTEM", F.col("o_orderkey"), F.col("o_orderdate")).alias("file"))


@query()
def case_reports(spark, d):
    numbered = reports.numbered(findings(spark, d), "case_id", "source", "n", "value")
    matches = name_pairs(spark, d).select(F.length("a").cast("bigint").alias("case_id"), F.col("b").alias("alias_detected"), F.lit("parts").alias("list_matched"), "score", "class")
    return reports.texts(numbered, matches, "case_id", technical_determination(spark, d), case_sources(spark, d))


@query("select o_orderkey, round(date_sub('second', o_orderdate, timestamp '1998-08-02 14:32:07') / 3600.0, 2)::double as age_hours, date_sub('second', o_orderdate, timestamp '1998-08-02 14:32:07') / 3600.0 > 24 as stale from orders")
def list_staleness(spark, d):
    o = read(spark, d, "orders")
    return reports.stale(o, F.lit("1998-08-02 14:32:07").cast("timestamp_ntz"), F.col("o_orderdate")).select("o_orderkey", "age_hours", "stale")


INVOCATION_SQL = (
    "'System ready. v3.1' || chr(10) || chr(10) || 'Mode: [ALIAS]' || chr(10) || 'Evidence: [[pendiente]]' || chr(10) || chr(10) || 'Subjects to compare with restrictive lists:' || chr(10) || '  - Natural person:' || chr(10) || '      Name(s): ' || c_name || chr(10) || '      Known aliases: [pendiente]' || chr(10)"
    " || '      Date of birth: [pendiente]' || chr(10) || '      Nationality: ' || n_name || chr(10) || '      Documents: [pendiente]' || chr(10) || '  - Legal person:' || chr(10) || '      Company name: [pendiente]' || chr(10) || '      Variants: [pendiente]' || chr(10) || '      Jurisdiction: [pendiente]' || chr(10)"
    " || '      Tax registration: [pendiente]' || chr(10) || chr(10) || 'Which evidence is analysed?'"
)


@query(f"select c_custkey, {INVOCATION_SQL} as text from customer join nation on c_nationkey = n_nationkey")
def invocation_text(spark, d):
    both = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = both.select("c_custkey", F.lit("ALIAS").alias("mode"), F.col("c_name").alias("subject_name"), F.lit(" ").alias("aliases"), F.col("n_name").alias("nationality"))
    return reports.invocation(asked).select("c_custkey", "text")


@query("with r(trigger, flow) as (values " + ", ".join(f"('{k}', {list(v)})" for k, v in routes.ROUTES.items()) + ") select trigger, pos::int - 1 as pos, flow[pos] as step, pos < len(flow) as more from r, lateral (select unnest(range(1, len(flow) + 1)) as pos)")
def case_routes(spark, d):
    return routes.table(spark)


@query("select t.trigger, step, limit_ as \"limit\" from (values " + ", ".join(f"('{k}', '{x}', " + (f"'{routes.LIMITS[k, x]}'" if (k, x) in routes.LIMITS else "null") + ")" for k, v in routes.ROUTES.items() for x in v) + ") t(trigger, step, limit_)")
def route_limits(spark, d):
    return routes.limits(spark).select("trigger", "step", "limit")


TRIGGERS = list(routes.ROUTES)


@query("with r(trigger, flow, i) as (values " + ", ".join(f"('{k}', {list(v)}, {i})" for i, (k, v) in enumerate(routes.ROUTES.items())) + "), l(trigger, step, lim) as (values " + ", ".join(f"('{k}', '{x}', '{v}')" for (k, x), v in routes.LIMITS.items()) + f"), o as (select o_orderkey, (substr(o_orderpriority, 1, 1)::int + (o_orderstatus = 'F')::int) % {len(TRIGGERS)} as i from orders), s as (select o_orderkey, r.trigger, flow, unnest(range(1, len(flow) + 1)) as pos from o join r using (i)) select o_orderkey, s.trigger, pos::int - 1 as pos, flow[pos] as step, pos < len(flow) as more, lim as limit from s left join l on l.trigger = s.trigger and l.step = flow[pos]")
def order_routes(spark, d):
    """The steps that each order would go through as a case, its kind of evidence told by priority and status, with the limits of each step."""
    kind = (F.substring("o_orderpriority", 1, 1).cast("int") + (F.col("o_orderstatus") == "F").cast("int")) % len(TRIGGERS)
    orders = read(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, TRIGGERS)), kind + 1).alias("trigger"))
    return orders.join(routes.table(spark), "trigger").join(routes.limits(spark), ["trigger", "pos", "step"], "left").select("o_orderkey", "trigger", "pos", "step", "more", "limit")


@query("select * from (values " + ", ".join(f"('{n}', '{t}')" for n, t in lists.FURTHER) + ") t(name, type)")
def further_lists(spark, d):
    return lists.further(spark)


@query("with n as (select p_partkey, p_name, (p_partkey % 8)::int as k from part), l(k, list_name, type) as (values " + ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(lists.FURTHER)) + ") select list_name, type, p_partkey::varchar as entry_id, p_name as primary_name, null::varchar as alias, 'unclassified' as alias_quality from n join l using (k)")
def further_list_entries(spark, d):
    """Rows of the further lists and of two that aren't among them, by the entries' common schema."""
    named = F.coalesce(F.try_element_at(F.array(*(F.lit(n) for n, _ in lists.FURTHER)), (F.col("p_partkey") % 8 + 1).cast("int")), F.lit("other"))
    entries = read(spark, d, "part").select(named.alias("list_name"), F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_name").alias("primary_name"), F.lit(None).cast("string").alias("alias"), F.lit("unclassified").alias("alias_quality"))
    return lists.taken(entries, lists.further(spark))


@query("select * from (values " + ", ".join(f"('{n}', '{a}', '{x}')" for n, a, f in lists.CATALOGUE for x in f.split(", ")) + ") t(name, authority, format)")
def list_formats(spark, d):
    return lists.catalogue(spark).select("name", "authority", F.explode("formats").alias("format"))


@query("select event_type as message, user_id::varchar as filename, (event_id % 7)::int as lineno, min(event_id) as event_id from events group by all")
def first_error_reports(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("message"), F.col("user_id").cast("string").alias("filename"), (F.col("event_id") % 7).cast("int").alias("lineno"), F.col("props").alias("stack"))
    return documents.first_errors(e, "event_id").select("message", "filename", "lineno", "event_id")


@query("select doc_id, format('{:.1f} KB', round(strlen(text) / 1024.0, 1)) as size from documents")
def evidence_sizes(spark, d):
    return read(spark, d, "documents").select("doc_id", F.format_string("%.1f KB", F.octet_length("text") / 1024.0).alias("size"))
