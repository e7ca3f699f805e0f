"""Narratives, mentions, prefixes, influence, periods, custody and list refresh against brute force."""

import hashlib
import ipaddress
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta import queries
from attesta.operators import influence, linkage, mentions, narratives, networks, prefixes, timelines
from attesta.sources import custody, lists


def grams(text, size=3):
    w = [x for x in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if x]
    return {" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def joined(nodes, edges):
    root = {n: n for n in nodes}
    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_near_narratives(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(20, 60))] for _ in range(12)]
    rows = [(i, " ".join(x if r.random() < 0.96 else r.choice(words) for x in r.choice(base))) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, "..."), (2003, "One two"), (2004, "one, TWO!"), (2005, "one")]
    sets = {i: grams(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])]
    want = joined([i for i in sets if sets[i]], near)
    got = {x.key: x.cluster for x in narratives.clusters(spark.createDataFrame(rows, "id long, text string"), "id", "text", checkpoint=queries.checkpoint).collect()}
    sizes = [list(want.values()).count(c) for c in want.values()]
    assert got == {k: c for (k, c), n in zip(want.items(), sizes, strict=True) if n > 1} and len(near) > 500
    assert narratives.clusters(spark.createDataFrame([], "id long, text string"), "id", "text", checkpoint=queries.checkpoint).count() == 0


@pytest.mark.parametrize("letters", [mentions.LETTERS, 12])
def test_mentions(spark, letters):
    names = [("Ann Lee",), ("ann",), ("A.B.",), ("lee",), ("ELBA",), (" Ann ",), ("",), (None,), ("Ümit",), ("x" * 30,)]
    texts = [(1, "Ann Lee met ann LEE, Annabel and A.B. in Elba"), (2, None), (3, ""), (4, "İann ümit xann ann"), (1, "lee-lee"), (5, "x" * 30 + " " + "x" * 31)]
    low = lambda t: "".join(c if c == "İ" else c.lower() for c in t)
    want = []
    for n in {low(x[0].strip()) for x in names if x[0] and x[0].strip()}:
        for k, t in texts:
            t = low(t or "")
            for i in range(len(t) - len(n) + 1):
                before, after = t[i - 1 : i] if i else "", t[i + len(n) : i + len(n) + 1]
                if t[i : i + len(n)] == n and not (before.isalnum() and n[0].isalnum()) and not (after.isalnum() and n[-1].isalnum()):
                    want.append((k, n, i + 1))
    df = spark.createDataFrame(texts, "id long, text string")
    got = mentions.mentions(df, "id", "text", spark.createDataFrame(names, "name string"), "name", letters)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10
    assert mentions.mentions(df, "id", "text", spark.createDataFrame([], "name string"), "name").count() == 0


def test_stated_aliases(spark):
    rows = [(1, 'The man John A. Smith, also known as "el Chico", met Maria Lopez (a.k.a. La Reina) and Bob alias: Rob.'), (2, "nothing also known as that"), (3, None)]
    got = sorted(map(tuple, mentions.stated_aliases(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()))
    assert got == [(1, "Bob", "Rob."), (1, "John A. Smith", "el Chico"), (1, "Maria Lopez", "La Reina")]


def test_narrowest_prefixes(spark):
    r = random.Random(1)
    nets = [f"{r.randrange(4)}.{r.randrange(3)}.{r.randrange(3)}.{r.randrange(256)}/{r.choice([0, 6, 8, 15, 16, 17, 24, 25, 32])}" for _ in range(400)] + ["1.2.3.4/33", "x/8", "300.1.1.1/8", None]
    ips = [f"{r.randrange(5)}.{r.randrange(4)}.{r.randrange(4)}.{r.randrange(256)}" for _ in range(300)] + ["999.1.1.1", "x", None, "255.255.255.255", "0.0.0.0"]
    ips += ips[:5]
    good = {}
    for n in sorted(x for x in nets[:400]):
        good.setdefault(ipaddress.ip_network(n, strict=False), n)
    def best(ip):
        try:
            a = ipaddress.ip_address(ip or "")
        except ValueError:
            return None
        hits = [(n.prefixlen, good[n]) for n in good if a in n]
        return max(hits)[1] if hits else None
    got = prefixes.narrowest(spark.createDataFrame([(x,) for x in ips], "ip string"), "ip", spark.createDataFrame([(x,) for x in nets], "net string"), "net").collect()
    assert sorted(((x.ip, x.net) for x in got), key=str) == sorted(((x, best(x)) for x in ips), key=str)
    assert prefixes.narrowest(spark.createDataFrame([("1.2.3.4",)], "ip string"), "ip", spark.createDataFrame([], "net string"), "net").first().net is None


def test_integrated_shares(spark):
    r = random.Random(2)
    stakes = [(i, r.randrange(20), r.uniform(0.05, 0.3)) for i in range(20) for _ in range(3)] + [(0, 1, None), (None, 1, 0.5), (2, 3, -1.0), (2, 3, 0.0)]
    a = np.zeros((20, 20))
    for e, o, s in stakes[:60]:
        a[e, o] += s
    x = np.linalg.inv(np.eye(20) - a) @ a
    df = spark.createDataFrame(stakes, "entity int, owner int, share double")
    got = {(x.entity, x.owner): x.share for x in influence.integrated(df, checkpoint=queries.checkpoint).collect()}
    assert all(abs(got.get((i, j), 0) - x[i, j]) < 1e-9 for i in range(20) for j in range(20))
    some = influence.integrated(df, spark.createDataFrame([(4,), (4,), (99,)], "entity int"), checkpoint=queries.checkpoint).collect()
    assert {x.entity for x in some} == {4} and all(abs(y.share - x[4, y.owner]) < 1e-9 for y in some)
    closed = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "entity string, owner string, share double")
    with pytest.raises(ValueError, match="circle"):
        influence.integrated(closed, most=5, checkpoint=queries.checkpoint)
    assert influence.integrated(closed.limit(0), checkpoint=queries.checkpoint).count() == 0


def test_pagerank(spark):
    r = random.Random(3)
    edges = [(r.randrange(12), r.randrange(15), r.randint(1, 4)) for _ in range(40)] + [(3, 3, 1), (None, 2, 1), (2, None, 1), (1, 2, 0)]
    w = np.zeros((15, 15))
    for a, b, k in edges[:41]:
        w[a, b] += k
    used = sorted({n for a, b, _ in edges[:41] for n in (a, b)})
    w = w[np.ix_(used, used)]
    out = w.sum(axis=1)
    rank = np.full(len(used), 1 / len(used))
    for _ in range(300):
        rank = 0.15 / len(used) + 0.85 * (np.where(out > 0, rank / np.where(out > 0, out, 1), 0) @ w + rank[out == 0].sum() / len(used))
    got = {x.node: x["rank"] for x in influence.pagerank(spark.createDataFrame(edges, "a int, b int, k int"), "a", "b", "k", tolerance=1e-9, checkpoint=queries.checkpoint).collect()}
    assert sorted(got) == used and all(abs(got[n] - rank[i]) < 1e-8 for i, n in enumerate(used)) and abs(sum(got.values()) - 1) < 1e-9
    assert influence.pagerank(spark.createDataFrame([], "a int, b int"), "a", "b", checkpoint=queries.checkpoint).count() == 0


def test_strongest_period(spark):
    r = random.Random(4)
    rows = [("daily", 86400 * i + r.randrange(1800)) for i in range(60)] + [("any", r.randrange(86400 * 60)) for _ in range(300)] + [("once", 5), ("none", None), (None, 7)]
    df = spark.createDataFrame(rows, "who string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {x.who: x for x in timelines.rayleigh(df, "who", "ts", [3600, 86400, 604800]).collect()}
    assert set(got) == {"daily", "any", "once"}
    assert got["daily"].period_seconds == 86400 and got["daily"].power > 55 and got["daily"].p_value == 0
    assert got["any"].p_value > 0.001 and got["once"].period_seconds == 3600 and got["once"].power == 1
    z = abs(sum(complex(math.cos(a), math.sin(a)) for a in (2 * math.pi * (s % 86400) / 86400 for w, s in rows[:60]))) ** 2 / 60
    assert abs(got["daily"].power - z) < 1e-5


def plain_root(leaves):
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + b"".join(leaves[i : i + 2])).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def test_custody(spark, tmp_path):
    r = random.Random(6)
    sizes = {"b": 1, "c": 1000, "d": 1001, "e": 12_345}
    data = {k: r.randbytes(n) for k, n in sizes.items()}
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "a.bin").write_bytes(b"")  # passed over
    for k, v in data.items():
        (tmp_path / "set" / f"{k}.bin").write_bytes(v)
    (tmp_path / "one.bin").write_bytes(data["e"])
    root = lambda v: plain_root([hashlib.sha256(b"\0" + v[i : i + 100]).digest() for i in range(0, len(v), 100)])
    whole = lambda names: plain_root([hashlib.sha256(b"\0" + f.encode() + b"\0" + root(data[k])).digest() for f, k in names]).hex()
    got = {x.dataset: (x.files, x.blocks, x.root) for x in custody.datasets(spark, {"set": str(tmp_path / "set"), "one": str(tmp_path / "one.bin")}, 100).collect()}
    assert got == {"set": (4, 1 + 10 + 11 + 124, whole([(f"{k}.bin", k) for k in sorted(data)])), "one": (1, 124, whole([("one.bin", "e")]))}


def test_custody_reads_ranges_of_a_file(spark, tmp_path):
    r = random.Random(8)
    lines = bytes(r.choice(b"abc\n\r") for _ in range(30_000))
    data = {"a": lines, "b": lines + b"\n", "c": b"\xef\xbb\xbf" + lines, "d": b"\xef\xbb\xbf", "e": b"\n", "f": r.randbytes(30_000) + b"\n\n", "g": b"x" * 5000, "h": b"\xef\xbb\xbf\n\xff", "i j%20": b"\xef\xbb\xbf" + lines[:999]}
    for k, v in data.items():
        (tmp_path / f"{k}.bin").write_bytes(v)
    (tmp_path / "z.gz").write_bytes(lines)  # not packed, for all its name
    want = {(f"{k}.bin", i // 100, hashlib.sha256(b"\0" + v[i : i + 100]).hexdigest()) for k, v in {**data, "z": lines}.items() for i in range(0, len(v), 100)}
    want = {(f.replace("z.bin", "z.gz"), i, x) for f, i, x in want}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1234")
    try:
        found = custody.blocks(spark, str(tmp_path), 100)
        got = [(x.file, x.i, x.digest.hex()) for x in found.collect()]
        one = custody.blocks(spark, str(tmp_path / "a.bin"), 100)
        assert one.count() == 300 and one.inputFiles()
        assert "binaryFile" not in one._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(got) == len(want) and set(got) == want


def test_list_changes_and_rescreening(spark):
    old = [(1, "ann", None), (2, "bob", "x"), (2, "bob", "x"), (3, "cy", "y"), (None, "dee", "z"), (5, "eve", None)]
    new = [(1, "ann", None), (2, "bob", "x"), (3, "cy", "w"), (None, "dee", "z"), (5, "eve", ""), (6, "ann", None)]
    a, b = (spark.createDataFrame(x, "id int, name string, alias string") for x in (old, new))
    changed = lists.changes(a, b, ["id"])
    assert sorted((x.id, x.change) for x in changed.collect()) == [(2, "changed"), (3, "changed"), (5, "changed"), (6, "added")]
    assert lists.changes(b, a, ["id"]).where("change = 'removed'").first().id == 6 and lists.changes(a, a, ["id"]).count() == 0
    screen = lambda df: df.where("name <> 'bob'").select("id", "name", "alias")
    assert sorted(map(str, lists.rescreened(screen(a), changed, "id", screen, b).collect())) == sorted(map(str, screen(b).collect()))


def test_bursts(spark):
    r = random.Random(7)
    rows = [(t, " ".join(r.choice("abcdefgh") for _ in range(30)) + (" war war WAR" if 4 <= t <= 6 else " peace")) for t in range(12) for _ in range(4)] + [(None, "war war"), (3, None), (4, "")]
    out = timelines.bursts(spark.createDataFrame(rows, "turn int, text string"), "turn", "text").collect()
    counts = [{}, *({} for _ in range(11))]
    for t, text in rows:
        for w in (text or "").lower().split() if t is not None else ():
            counts[t][w] = counts[t].get(w, 0) + 1
    d, want = [sum(c.values()) for c in counts], []
    for w in {w for c in counts for w in c}:
        p0 = sum(c.get(w, 0) for c in counts) / sum(d)
        p = (p0, min(2 * p0, 0.9999))
        cost = lambda t, s: -(counts[t].get(w, 0) * math.log(p[s]) + (d[t] - counts[t].get(w, 0)) * math.log(1 - p[s]))  # noqa: B023, E731
        # By hand: the cheapest of all 2^12 sequences of states.
        best = min(range(1 << 12), key=lambda m: (round(sum(cost(t, m >> t & 1) for t in range(12)) + math.log(12) * sum(m >> t & 1 and not (t and m >> t - 1 & 1) for t in range(12)), 9), m))  # noqa: B023
        runs = [t for t in range(12) if best >> t & 1]
        while runs:
            n = next((i for i in range(1, len(runs)) if runs[i] != runs[i - 1] + 1), len(runs))
            want.append((w, runs[0], runs[n - 1], sum(counts[t].get(w, 0) for t in runs[:n])))
            runs = runs[n:]
    assert sorted((x.token, x.first_turn, x.last_turn, x.n) for x in out) == sorted(want) and ("war", 4, 6, 36) in want


def test_distinctive_terms(spark):
    rows = [(i, "a" if i % 3 else "b", "the same words" + (" tax tax" if i % 3 and i % 2 else "") + (" rain" if not i % 3 else "")) for i in range(60)] + [(100, None, "rain"), (101, "a", None)]
    got = {(x.source, x.term): x for x in timelines.distinctive(spark.createDataFrame(rows, "id int, source string, text string"), "id", "source", "text").collect()}
    assert set(got) == {("a", "tax"), ("b", "rain"), ("b", "the"), ("b", "same"), ("b", "words")} and got["b", "rain"].texts == 20
    a, b, c, d = 20.0, 0.0, 0.0, 41.0
    g2 = 2 * sum(v * math.log(v * 61 / (x * y)) for v, x, y in ((a, 20, 20), (d, 41, 41)) if v)
    assert b == c == 0 and abs(got["b", "rain"].llr - g2) < 1e-5


def test_linkage(spark):
    r = random.Random(8)
    true = [r.random() < 0.2 for _ in range(3000)]
    m, u = (0.95, 0.8, 0.7), (0.05, 0.2, 0.1)
    rows = [(i, *(r.random() < (m if t else u)[k] for k in range(3))) for i, t in enumerate(true)] + [(9999, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a boolean, b boolean, c boolean")
    out = {x.id: x for x in linkage.linked(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}).collect()}
    # By hand: EM over the rows themselves.
    g = np.array([[bool(v) for v in x[1:]] for x in rows], float)
    p, pm, pu = 0.1, np.full(3, 0.9), np.full(3, 0.1)
    for _ in range(100):
        yes, no = p * np.prod(np.where(g, pm, 1 - pm), axis=1), (1 - p) * np.prod(np.where(g, pu, 1 - pu), axis=1)
        w = yes / (yes + no)
        p, pm, pu = w.mean(), w @ g / w.sum(), (1 - w) @ g / (1 - w).sum()
    assert abs(p - 0.2) < 0.05 and np.allclose(pm, m, atol=0.08) and np.allclose(pu, u, atol=0.05)
    weights = np.where(g, np.log2(pm / pu), np.log2((1 - pm) / (1 - pu))).sum(axis=1)
    assert all(abs(out[x[0]].weight - weights[i]) < 1e-6 for i, x in enumerate(rows))
    odds = 2.0 ** weights[0] * p / (1 - p)
    assert abs(out[0].probability - odds / (1 + odds)) < 1e-9
    assert sum((out[i].probability > 0.5) == t for i, t in enumerate(true)) > 2700
    assert linkage.linked(df.limit(0), {"a": F.col("a")}).count() == 0
    assert linkage.blocked(df.withColumn("k", F.lit(None).cast("int")), df.withColumn("k", F.lit(None).cast("int")), ["k"]).count() == 0


def test_integrated_shuffles_once_between_checkpoints(spark):
    stakes = spark.range(3000).selectExpr("id % 1000 as entity", "id * 7919 % 1000 as owner", "0.1 as share")
    plans = []
    influence.integrated(stakes, checkpoint=lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or queries.checkpoint(x))
    rounds = plans[2:]  # after the stakes and the ways
    assert len(rounds) > 1 and [p.count("Exchange hashpartitioning") for p in rounds] == [1] * len(rounds)


def test_integrated_keeps_one_table(spark):
    """Rounds share checkpoints, and the table that each leaves holds the sums of all rounds before it."""
    r = random.Random(3)
    df = spark.createDataFrame([(i, r.randrange(12), 0.2) for i in range(12) for _ in range(2)], "entity int, owner int, share double")
    kept = []
    got = influence.integrated(df, tolerance=1e-6, checkpoint=lambda x: kept.append(queries.checkpoint(x)) or kept[-1])
    assert len(kept) <= 2 + 16 // influence.ROUNDS + 1 and "Union" not in got._jdf.queryExecution().toString()


def test_cross_references_shuffle_no_pairs(spark, small):
    """Dealings come with the customers, so pairs of a block are never dealt by both their keys."""
    plan = queries.QUERIES["cross_references"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(c_custkey#\d+L?, s_suppkey#", plan)


def test_link_degrees(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a long, b long")
    got = {tuple(x) for x in networks.link_degrees(links, "a", "b").collect()}
    assert got == {(0, 1, 2, 0, 2), (0, 2, 1, 0, 1), (1, 1, 0, 2, 2), (1, 2, 0, 1, 1)}
    assert networks.link_degrees(links.limit(0), "a", "b").count() == 0


def test_group_components(spark):
    r = random.Random(4)
    tied = [(r.randrange(60), r.randrange(80)) for _ in range(70)] * 2 + [(100, 100)]
    label = {(0, g): 1000 for g, _ in tied} | {(1, m): m for _, m in tied}
    for _ in tied:
        for g, m in tied:
            label[0, g] = label[1, m] = min(label[0, g], label[1, m])
    df = spark.createDataFrame([*tied, (None, 7), (5, None)], "g long, m long")
    got = {(x.side, x.id): x.component for x in networks.group_components(df, "g", "m", queries.checkpoint).collect()}
    assert got == label
    assert networks.group_components(df.limit(0), "g", "m", queries.checkpoint).count() == 0


def test_tables_are_read_with_bounded_tasks(spark, small):
    """Batches of texts and the pieces of shuffles are bounded before a table is used."""
    queries.read(spark, small, "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    queries.bounded(spark, f"{small}/documents.parquet")
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) == before


def test_pagerank_carries_no_edges_of_nodes_that_none_reaches(spark):
    """What such nodes give is summed once: rounds keep the other nodes only."""
    rows = [(f"c{i}", f"s{i % 3}", 1.0 + i % 4) for i in range(40)] + [("s0", "s1", 2.0)]
    kept = []

    def checkpoint(df):
        out = df.localCheckpoint()
        kept.append((set(out.columns), out.count()))
        return out

    got = {x.node: x.rank for x in influence.pagerank(spark.createDataFrame(rows, "a string, b string, w double"), "a", "b", "w", rounds=20, checkpoint=checkpoint).collect()}
    nodes = sorted({x for r in rows for x in r[:2]})
    out = {n: sum(w for a, _, w in rows if a == n) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        loose = sum(rank[n] for n in nodes if not out[n])
        new = dict.fromkeys(nodes, (0.15 + 0.85 * loose) / len(nodes))
        for a, b, w in rows:
            new[b] += 0.85 * rank[a] * w / out[a]
        rank = new
    assert got == pytest.approx(rank, abs=1e-12)
    assert {n for columns, n in kept if "rank" in columns} == {3}


def test_near_narratives_shuffle_no_set_before_it_is_kept(spark):
    """The first checkpoint holds the sets as they are read; keys that are repeated or told alike are still one item."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.checkpoint()

    text = " ".join(f"word{i}" for i in range(30))
    rows = [("a", text), ("b", text), ("b", text), ("c", text + " more"), ("d", None), ("e", "other words entirely here")]
    found = narratives.clusters(spark.createDataFrame(rows, "key string, text string"), "key", "text", checkpoint=kept)
    assert sorted(map(tuple, found.collect())) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3)]
    assert "Exchange" not in plans[0]


@pytest.mark.parametrize("told", [1_000_000, 0])
def test_near_narratives_keep_sets_of_what_meets_only(spark, monkeypatch, told):
    """Beyond TOLD items texts are found by a shuffle instead of a broadcast, with the same result."""
    monkeypatch.setattr(narratives, "TOLD", told, raising=False)
    kept = []
    rows = [(f"k{i}", " ".join(f"w{i}x{j}" for j in range(40))) for i in range(60)]
    rows += [("near", rows[7][1] + " more"), ("k7", "a text of its own under a key that is repeated")]
    found = narratives.clusters(spark.createDataFrame(rows, "key string, text string"), "key", "text", checkpoint=lambda x: kept.append(queries.checkpoint(x)) or kept[-1])
    assert sorted(map(tuple, found.collect())) == [("k7", "k7", 3), ("k7", "k7", 3), ("near", "k7", 3)]
    assert all(x.count() <= 3 for x in kept if "grams" in x.columns)
