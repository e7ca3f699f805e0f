"""Every registered query with SQL against DuckDB at the smallest scale, and operators on literal rows."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from attesta import queries
from attesta.operators import documents, evidence, networks, reports, timelines
from attesta.plans import routes
from attesta.sources import lists
from attesta.streaming import errors


@pytest.fixture(scope="module")
def oracle(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, oracle, tmp_path, name):
    queries.QUERIES[name](spark, small).coalesce(1).write.parquet(str(tmp_path / "out"))
    oracle.execute(f"create or replace table g as select * from '{tmp_path}/out/*.parquet'")
    if name not in queries.SQL:
        assert oracle.execute("select count(*) from g").fetchall()[0][0] > 0
        return
    oracle.execute(f"create or replace table o as {queries.SQL[name]}")
    told = lambda t: {r[0] for r in oracle.execute(f"describe {t}").fetchall()}
    assert told("g") == told("o")
    cols = ", ".join(f'"{c}"' for c in sorted(told("o")))
    for a, b in (("g", "o"), ("o", "g")):
        assert oracle.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchall() == [(0,)]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in networks.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", queries.checkpoint).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100} | {200 + i: 100 for i in range(30)}


def test_components_of_all_entities(spark, small, oracle):
    edges = oracle.execute("select distinct 'c' || o_custkey, 's' || l_suppkey from orders join lineitem on l_orderkey = o_orderkey").fetchall()
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want: dict[str, str] = {}
    for x in sorted(near):
        todo = [] if x in want else [x]
        while todo:
            if (y := todo.pop()) not in want:
                want[y] = x
                todo += near[y]
    assert {r.node: r.component for r in queries.QUERIES["all_entity_components"](spark, small).collect()} == want
    assert queries.QUERIES["all_entity_links"](spark, small).count() == len(edges) == queries.QUERIES["entity_links"](spark, small).count()


def test_nothing_from_nothing(spark, small):
    none = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    assert documents.entities(none, "doc_id", "text").count() == 0
    assert timelines.shared_lines(none, "doc_id", "text").count() == 0


def test_report_keeps_its_clause(spark):
    found = spark.createDataFrame([(1, "H1", "f", "v", "m", "s", 99.0)], "case_id int, finding string, field string, value string, method string, source string, confidence double")
    none = spark.createDataFrame([], "case_id int, alias_detected string, list_matched string, score double, class string")
    text = reports.texts(found, none, "case_id").first().report
    assert "CLEAR" in text and "not a determination of absence" in text and "SUSTANCIAL" in text


def test_report_sections(spark, tmp_path):
    found = spark.createDataFrame([(1, "H1", "f", "v", "m", "s", 99.0)], "case_id int, finding string, field string, value string, method string, source string, confidence double")
    none = spark.createDataFrame([], "case_id int, alias_detected string, list_matched string, score double, class string")
    checks = spark.createDataFrame([(1, "ISO 9362", 2, False)], "case_id int, standard string, checks int, conforming boolean")
    sources = spark.createDataFrame([(1, "bic", "https://a.example", "2024-12-14"), (1, "bic", "https://a.example", "2024-12-14")], "case_id int, source string, url string, consulted_at string")
    text = reports.texts(found, none, "case_id", checks, sources)
    said = text.first().report
    assert "ISO 9362: not conforming (2 checks)" in said and said.endswith("6. ANNEXES\n   A1: bic, https://a.example, consulted 2024-12-14")
    reports.write_texts(text, str(tmp_path / "out"), "SYS", "2024-12-15")
    folder = tmp_path / "out" / "file=SYS_CASO-1_2024-12-15.txt"
    assert [p.read_text() for p in folder.glob("part-*")] == [said + "\n"]


def test_owners_of_long_chains_and_circles(spark):
    chain = [(f"e{i}", f"e{i + 1}", 0.99) for i in range(12)] + [("x", "y", 0.5), ("y", "x", 0.5), ("y", "z", 0.5)]
    got = {(r.entity, r.owner): r.share for r in networks.owners(spark.createDataFrame(chain, "entity string, owner string, share double"), 0.1, queries.checkpoint).collect()}
    assert got["e0", "e12"] == round(0.99**12, 6) and got["x", "z"] == 0.25 and got["y", "z"] == 0.5
    whole = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)]
    assert networks.owners(spark.createDataFrame(whole, "entity string, owner string, share double"), 0.1, queries.checkpoint).count() >= 4


def test_redaction(spark):
    df = spark.createDataFrame([("Ann Lee met ann LEE, Annabel and A.B. (x)", ["Ann", "Ann Lee", "A.B.", " ", None]), ("Ann", []), (None, ["Ann"])], "t string, n array<string>")
    assert [r.x for r in df.select(evidence.redacted(F.col("t"), F.col("n")).alias("x")).collect()] == ["[redacted] met [redacted], Annabel and [redacted] (x)", "Ann", None]


def test_routes(spark):
    assert routes.steps("incident") == ("CYBER", "NET", "OSINT", "ALIAS") and routes.steps("incident", "NET") == ("NET",)
    add = {s: (lambda df, s=s: df.withColumn(s, F.lit(1))) for s in routes.MODES}
    assert routes.run(spark.range(1), "person", add).columns == ["id", "ALIAS", "OSINT", "NET", "CYBER"]
    with pytest.raises(ValueError):
        routes.steps("person", "NONE")


def test_list_readers_and_snapshots(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ref,name,aka\n1,Ann,A; An\n2,Bob,\n")
    (tmp_path / "a.json").write_text('{"ref": 1, "name": "Ann", "aka": "A; An"}\n{"ref": 2, "name": "Bob"}\n')
    (tmp_path / "a.xml").write_text("<l><e><ref>1</ref><name>Ann</name><aka>A; An</aka></e><e><ref>2</ref><name>Bob</name></e></l>")
    (tmp_path / "a.html").write_text("<h1>L</h1><table><tr><th>ref</th><th>name</th><th>aka</th></tr>\n<tr class=x><td>1</td><td><b>Ann</b></td><td>A;\n An</td></tr><tr><td>2</td><td>Bob</td><td></td></tr></table>")
    columns = {"entry_id": "ref", "primary_name": "name", "alias": "aka"}
    read = [lists.read_csv(spark, str(tmp_path / "a.csv"), "L", columns), lists.read_json(spark, str(tmp_path / "a.json"), "L", columns), lists.read_xml(spark, str(tmp_path / "a.xml"), "L", "e", columns), lists.read_html(spark, str(tmp_path / "a.html"), "L", columns)]
    told = [sorted(map(str, df.collect())) for df in read]
    assert told[0] == told[1] == told[2] == told[3] and len(told[0]) == 3
    path = str(tmp_path / "snap")
    lists.snapshot(read[0], path, "1", "aa", "2024-01-01 00:00:00")
    lists.snapshot(read[0].limit(1), path, "2", "bb", "2024-02-01 00:00:00")
    assert [r.source_version for r in lists.latest(spark, path).collect()] in (["2"], [2])
    assert lists.files(spark, str(tmp_path / "a.csv")).first().length == (tmp_path / "a.csv").stat().st_size


def test_error_stream(spark, tmp_path):
    rows = [("m", "f", 1, "s", "2024-01-01 00:00:00"), ("m", "f", 1, "s", "2024-01-01 00:01:00"), ("n", "f", 1, "s", "2024-01-01 00:02:00")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, "message string, filename string, lineno int, stack string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(src)
    stream = errors.first_errors(spark.readStream.schema(df.schema).parquet(src))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination(60)
    assert sorted(r.message for r in spark.read.parquet(out).collect()) == ["m", "n"]


def test_tasks_that_read_are_bounded(spark, small):
    """What a task sums before a shuffle grows with what it reads."""
    queries.read(spark, small, "lineitem")
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) <= 16 << 20
