"""Literal cases of scores, identifiers, phonetic keys and name preparation."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta import queries
from attesta.functions import identifiers, names, phonetics
from attesta.functions import similarity as S
from attesta.operators import screening

SCORES = [
    ("MARTHA", "MARHTA", 0.9611, 88.06, "LIKELY"), ("DIXON", "DICKSONX", 0.8133, 55.67, "CLEAR"), ("ROBERT", "RUPERT", 0.8, 80.0, "LIKELY"), ("ROBERT", "ROBERT", 1.0, 100.0, "CONFIRMED"),
    ("JOHN SMITH", "JON SMYTH", 0.917, 89.85, "LIKELY"), ("ABC", "XYZ", 0.0, 0.0, "CLEAR"), ("MUNOZ", "MUNHOZ", 0.9611, 93.06, "LIKELY"), ("GARCIA LOPEZ", "LOPEZ GARCIA", 0.2778, 13.89, "CLEAR"),
]


def test_scores(spark):
    rows = screening.scored(spark.createDataFrame([r[:2] for r in SCORES], "a string, b string"), "a", "b").collect()
    assert {(r.a, r.b): (round(r.jw, 4), r.score, r["class"]) for r in rows} == {r[:2]: r[2:] for r in SCORES}


def test_bands_are_half_open_and_bonus_is_clamped(spark):
    rows = spark.createDataFrame([(59.99, "good"), (94.5, "low"), (79.5, None), (95.0, "unclassified")], "s double, q string")
    out = rows.select(S.classified(F.col("s")).alias("c"), S.adjusted(F.col("s"), F.col("q")).alias("t")).collect()
    assert [(r.c, r.t) for r in out] == [("CLEAR", 69.99), ("LIKELY", 99.5), ("POTENTIAL", 79.5), ("CONFIRMED", 95.0)]


@given(st.text(alphabet="abcd e", max_size=9), st.text(alphabet="abcd e", max_size=9))
def test_jaro_winkler_is_symmetric_and_bounded(a, b):
    s = S.jaro_winkler_value(a, b)
    assert 0 <= s <= 1 and abs(s - S.jaro_winkler_value(b, a)) < 1e-9
    assert (s == 1) == (a == b != "")


def test_pruned_pairs_are_all_pairs(spark):
    import random

    r = random.Random(4)
    words = sorted({"".join(r.choice("abcdeinrst") for _ in range(r.randint(1, 9))) for _ in range(60)})
    n = spark.createDataFrame([(w,) for w in words], "name string")
    a, b = n.select(F.col("name").alias("a")), n.select(F.col("name").alias("b"))
    every = screening.scored(a.crossJoin(b), "a", "b").where("score >= 60")
    some = screening.scored(screening.candidates(a, b, "a", "b", 60.0), "a", "b").where("score >= 60")
    told = lambda df: sorted((x.a, x.b, x.score) for x in df.collect())
    assert told(every) == told(some)


@pytest.mark.parametrize("threshold, most", [(60.0, 50_000), (50.0, 50_000), (85.0, 50_000), (60.0, 3)])
def test_candidates_lose_nothing(spark, monkeypatch, threshold, most):
    import random

    monkeypatch.setattr(screening, "SIGNATURES", most)
    r = random.Random(7)
    parts = ["maria", "jose", "ana", "lopez", "Garcia", "o'neil", "müller", "de", "la", "li", "9th"]
    words = sorted({" ".join(r.choice(parts)[: r.randint(1, 9)] for _ in range(r.randint(1, 3))) for _ in range(90)})
    n = spark.createDataFrame([(w,) for w in words], "name string")
    a, b = n.select(F.col("name").alias("a")), n.select(F.col("name").alias("b"))
    told = lambda df: sorted((x.a, x.b, x.score) for x in df.where(F.col("score") >= threshold).collect())
    assert told(screening.scored(a.crossJoin(b), "a", "b")) == told(screening.scored(screening.candidates(a, b, "a", "b", threshold), "a", "b"))


def test_bonus_counts_in_screening(spark):
    subjects = spark.createDataFrame([("MARTHA",), ("DIXON",), ("ABC",)], "a string")
    entries = spark.createDataFrame([("MARHTA", "good"), ("DICKSONX", "low"), ("XYZ", "good"), (None, "good"), ("", None)], "b string, q string")
    got = {(r.a, r.b): (r.base_score, r.score, r["class"]) for r in screening.screened(subjects, entries, "a", "b", quality="q").collect()}
    assert got == {("MARTHA", "MARHTA"): (88.06, 98.06, "CONFIRMED"), ("DIXON", "DICKSONX"): (55.67, 60.67, "POTENTIAL")}


def test_candidates_are_far_fewer_than_pairs():
    import random

    import numpy as np

    r = random.Random(3)
    names_ = ["".join(r.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(r.randint(4, 14))) for _ in range(2000)]
    of = lambda x: [ord(x[0])] + [sum(screening.COMMON.find(c) % 16 == g for c in x) for g in range(16)] + [0]
    s = np.array([of(x) for x in names_])
    assert (screening.reachable(s, s) >= 60).mean() < 0.05


def test_candidates_are_equi_joins(spark):
    n = spark.createDataFrame([("ann",), ("bob",)], "name string")
    plan = screening.candidates(n.select(F.col("name").alias("a")), n.select(F.col("name").alias("b")), "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("kind, value, ok", [("IBAN", "GB29NWBK60161331926819", True), ("IBAN", "GB28NWBK60161331926819", False), ("ISIN", "US0378331005", True), ("ISIN", "US0378331006", False), ("LEI", "5493001KJTIIGC8Y1R12", True), ("BIC", "TVMUS33XXX", False), ("BIC", "DEUTDEFF500", True), ("IBAN", "", False), ("IBAN", None, None), ("XXX", "1", None)])
def test_identifiers(spark, kind, value, ok):
    row = spark.createDataFrame([(kind, value)], "k string, v string").select(identifiers.valid(F.col("k"), F.col("v")).alias("ok")).first()
    assert row.ok is ok


def test_phonetic_keys():
    assert {x: phonetics.metaphone_key(x) for x in queries.KEYS} == queries.KEYS and phonetics.metaphone_key("") == ""
    assert phonetics.nysiis_key("Knuth") == phonetics.nysiis_key("Nuth")
    assert phonetics.nysiis_key("MacDonald").startswith("MC") and phonetics.nysiis_key("") == ""


def test_name_preparation(spark):
    row = spark.createDataFrame([("  Dr. José  MUÑOZ-Peña, jr ", None)], "a string, b string").select(names.normalized(F.col("a")).alias("n"), names.tokens(names.normalized(F.col("a"))).alias("t"), names.normalized(F.col("b")).alias("none"), names.needs_transliteration(F.lit("Иван")).alias("cyr"), names.needs_transliteration(F.col("a")).alias("lat")).first()
    assert row.n == "jose munoz-pena, jr" and row.t == ["jose", "munoz", "pena", "jr"] and row.none is None and row.cyr and not row.lat


def test_candidates_deal_the_pairs_of_a_few_names(spark, monkeypatch):
    """Pairs are dealt by their number, not by the bytes of the names, and no pair is lost or doubled."""
    monkeypatch.setattr(screening, "PAIRS", 500)
    n = spark.range(120).select(F.concat(F.element_at(F.array(*map(F.lit, ("large ring", "hot bolt", "blue ring"))), (F.col("id") % 3 + 1).cast("int")), F.lit(" "), F.col("id").cast("string")).alias("name"))
    a, b = n.select(F.col("name").alias("a")), n.select(F.col("name").alias("b"))
    found = screening.candidates(a, b, "a", "b", 60.0)
    assert len({x.p for x in found.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 8
    told = lambda df: sorted((x.a, x.b, x.score) for x in df.where("score >= 60").collect())
    assert told(screening.scored(a.crossJoin(b), "a", "b")) == told(screening.scored(found, "a", "b"))


def test_signatures_are_counts_of_letters(spark):
    words = ["", "Maria", "o'neil 9", "MÜLLER", "\U0001f600x", "zz"]
    rows = spark.createDataFrame([(w,) for w in words], "name string").select("name", screening.signature(F.col("name")).alias("s"))
    for g in screening.GROUPS:
        for x in rows.select("name", screening.coarser(F.col("s"), g).alias("s")).collect():
            w = x.name.lower()
            counts = [sum(c in screening.COMMON and screening.COMMON.index(c) % g == k for c in w) for k in range(g)]
            assert x.s == [ord(w[0]) if w else 0, *counts, len(w) - sum(counts)]
