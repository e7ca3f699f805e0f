"""The pipeline's stages on the smallest tables, and what each must leave alone."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm.common import table

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    now, sizes = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = corpus_pipeline.written(stage(spark, now, small), name)
        sizes.append(now.count())
        assert k + 1 == len(corpus_pipeline.STAGES) or now.columns == docs.columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    assert now.where("not decodes").count() == 0 and now.where("n_tokens <> size(token_ids)").count() == 0
    assert now.where(r"text rlike 'AKIA[A-Z0-9]{12}'").count() == 0
    assert corpus_pipeline.run(spark, small).count() == sizes[-1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with labels and a benchmark that fit `made`."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away from all of us today"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def made():
    r = random.Random(5)
    words = ["".join(r.choice("bcdfglnrst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, said(60) + (" zuggle zugglex you zuggle" if i % 5 == 0 else "")) for i in range(300)]
    base, long = said(200).split(), said(200_000)
    rows += [(1001, " ".join(base)), (1002, " ".join(base)), (1003, " ".join([*base[:100], "changed", *base[101:]])), (1004, " ".join([*base[:100], *words[:150]]))]
    rows += [(1010, None), (1011, ""), (1012, ""), (1013, rows[1][1]), (1014, rows[1][1]), (1014, rows[1][1]), (None, said(30)), (None, None)]
    rows += [(1020, said(5) + " The quick, brown fox jumps over the lazy dog and runs away from all of us today!"), (1021, said(2000) + " the quick brown fox jumps over the lazy dog and runs away from all of us today")]
    rows += [(1030, said(20) + " token=abcdefgh12 " + said(5)), (1040, long), (1041, long + " end")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def test_decisions_of_the_stages(spark, folder):
    rows = made()
    docs = spark.createDataFrame(rows, KINDS)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        left[name] = docs.select("doc_id", "text").collect()
    ids = lambda name: [x.doc_id for x in left[name]]
    toxic = {i for i, t, *_ in rows if "zuggle" in (t or "")}
    assert sorted(map(str, ids("toxicity"))) == sorted(str(i) for i, *_ in rows if i not in toxic)
    kept = ids("near_duplicates")
    assert {1001, 1004, 1010, 1040, 1} <= set(kept) and not {1002, 1003, 1011, 1012, 1013, 1014, 1041} & set(kept)
    assert kept.count(None) == 2 and len(kept) == len(ids("toxicity")) - 8
    assert sorted(map(str, ids("decontamination"))) == sorted(str(i) for i in kept if i != 1020)
    texts = {x.doc_id: x.text for x in left["secrets"]}
    before = {x.doc_id: x.text for x in left["decontamination"]}
    assert "[SECRET]" in texts[1030] and "abcdefgh12" not in texts[1030]
    assert all(texts[i] == before[i] for i in before if i not in (1030, None))
    assert sorted(map(str, ids("tokens"))) == sorted(map(str, ids("secrets"))) and docs.where("decodes").count() == len(ids("secrets"))


def test_clashing_columns_and_empty_tables_pass_every_stage(spark, folder):
    odd = ("_key", "_rows", "_found", "row", "score", "node", "spans", "key", "best", "_text", "_base", "_n", "_log", "n_words")
    docs = spark.createDataFrame(made()[:40], KINDS).withColumns({c: F.lit("x") for c in odd})
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.written(stage(spark, now, folder), name)
            assert now.columns == docs.columns
            assert now.where(" or ".join(f"{c} <> 'x'" for c in odd)).count() == 0
        assert stage(spark, now, folder).columns == docs.columns


def test_linked_fingerprints_are_compared_first(spark, monkeypatch):
    """Near copies come by operator 5's fingerprints, and pairs that those lose by the exact join."""
    from attesta.llm import similar, simhash

    firsts, seen = [], similar.close

    def close(own, edges):
        found = seen(own, edges)
        firsts.extend((x.x, x.y) for x in found.collect())
        return found

    monkeypatch.setattr(similar, "close", close)
    r = random.Random(9)
    said = [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(900)]
    rows = [(1, " ".join(said)), (2, " ".join([*said, "end"])), (3, " ".join([*said[:800], *(str(i) for i in range(60))])), (4, " ".join(reversed(said)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    node = {i: similar.named(similar.shingles(t, 5)) for i, t in rows}
    apart = lambda a, b: ((simhash.fingerprint(rows[a - 1][1], 5) ^ simhash.fingerprint(rows[b - 1][1], 5)) & (1 << 64) - 1).bit_count()
    assert apart(1, 2) <= 2 < apart(1, 3)
    assert sorted(x.doc_id for x in simhash.deduplicated(docs).collect()) == [1, 4]
    assert {node[1], node[2]} in [set(p) for p in firsts] and {node[1], node[3]} not in [set(p) for p in firsts]


def test_sets_of_near_copies_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Spark sizes them by their files, and files of near copies are a small part of what they hold."""
    from attesta.llm import similar

    monkeypatch.setattr(similar, "checkpointed", lambda df: df)
    spark.range(3000).selectExpr("id as node", "2000 as n", "sequence(0L, 1999L) as set").coalesce(1).write.parquet(str(tmp_path / "sets"))
    spark.range(1, 3000).selectExpr("id as x", "0L as y").write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "sets").iterdir()) < 10 << 20 < 3000 * 2000 * 8
    links = similar.confirmed(spark.read.parquet(str(tmp_path / "pairs")), spark.read.parquet(str(tmp_path / "sets")))
    assert "BroadcastExchange" not in links._jdf.queryExecution().executedPlan().toString()
    assert links.count() == 2999
