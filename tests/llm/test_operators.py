"""Each operator against a brute-force version on small rows with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attesta.llm import bpe, common, components, decontamination, quality, repeats, secrets, sharding, simhash, similar, suffixes, topk, toxicity
from attesta.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def clashing(df):
    """`df` with columns named like the operators' own."""
    return df.withColumns({c: F.lit("x") for c in ("_key", "_score", "_bin", "row", "spans", "score", "fp", "key", "law")})


# 1 -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("chunk, open_", [(bpe.CHUNK, bpe.OPEN), (50, 8)])
def test_bpe_streams_like_the_library(tokenizer, monkeypatch, chunk, open_):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "OPEN", open_)
    r, v = random.Random(1), bpe.Vocabulary(tokenizer_path())
    parts = ["a", "b", "the", "tion", " ", "  ", "\n", "1", "23", "'s", "'re", "'", "!", "---", "====", "é", "<|endoftext|>", "<|endo", "　", "中", "😀", "\t", "aaaa", " " * 9, "\x1c", "\u0085"]
    encoder = bpe.Encoder(v)
    for _ in range(400):
        some = r.sample(parts, r.randint(1, 6))
        text = "".join(r.choice(some) for _ in range(r.randint(0, 300)))
        got, decoder = [i for pieces in encoder.encode(text) for ids, _, _ in pieces for i in ids], bpe.Decoder(v)
        assert got == tokenizer.encode(text, add_special_tokens=False).ids
        back = "".join(decoder.feed([i]) for i in got) + decoder.feed((), True)
        assert back == text


def test_bpe_merges_together_as_alone():
    r, v = random.Random(3), bpe.Vocabulary(tokenizer_path())
    pieces = [b"".join(r.choice([b"a", b"aa", b" the", b"tion", b"\xc3", "é中".encode(), b"!", b"ing"]) for _ in range(r.randint(0, 12))) for _ in range(3000)] + [b"a" * n for n in range(30)]
    assert v.merged_together(pieces) == [v.merged(p) for p in pieces]
    assert v.merged_together([]) == []


def test_bpe_lookahead_is_sufficient():
    r, v = random.Random(2), bpe.Vocabulary(tokenizer_path())
    for _ in range(60):
        some = [v.token[r.randrange(50_000)] for _ in range(r.randint(1, 4))]
        text = b"".join(r.choice(some) for _ in range(300))[:4000]
        t = bpe.Transducer(v)
        got = [i for k in range(0, len(text), 37) for i in t.feed(text[k : k + 37])] + t.finish()
        assert got == v.merged(text) and len(t.held) == 0


def test_bpe_query(spark, tokenizer):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (4, "x" * 30_000), (None, "ünï <|endoftext|>")]
    got = sorted(map(tuple, bpe.digests(spark.createDataFrame(rows, DOCS), tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    exp = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        exp.append((i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert got == sorted(exp, key=str)
    both = bpe.decoded(bpe.encoded(clashing(spark.createDataFrame(rows, DOCS)), tokenizer_path()), tokenizer_path(), text="back")
    assert all(r.back == (r.text or "") for r in both.collect())
    odd = clashing(spark.createDataFrame(rows, DOCS)).withColumn("_both", F.lit("x"))
    for r in bpe.checked(odd, tokenizer_path()).collect():
        assert r.decodes and r["_both"] == "x" and r.token_ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.checked(odd.limit(0), tokenizer_path()).count() == 0
    assert bpe.digests(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


# 2 -----------------------------------------------------------------------------------------------


def base_spans(t):
    out = []
    for n, (name, p, f, k) in enumerate((("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 8), ("access", r"(AKIA[A-Z0-9]+)", 0, 16), ("hex", r"([0-9a-f]+)", 0, 32))):
        out += [(m.start(), n, m.end(), name) for m in re.finditer(p, t, f) if len(m[1]) >= k]
    return sorted(out)


def cut_spans(t, spans):
    out, at = [], 0
    for a, b in repeats.merged([(a, b - 1) for a, b in spans]):  # adjoining spans stay apart
        out += [t[at:a], secrets.MASK]
        at = b + 1
    return "".join([*out, t[at:]])


def brute_links(t):
    """By hand: all weak spans with a complementary part within reach, and the parts."""
    every = [(s, n, e) for n, k in enumerate(secrets.KINDS) for m in re.finditer(k.pattern.replace("(?i:password", "(?ai:password"), t) for s, e in [m.span()] if len(m[k.group]) >= k.least]
    out = []
    for w in sorted(x for x in every if not secrets.KINDS[x[1]].strong):
        mine = secrets.KINDS[w[1]].role
        to = [p for p in sorted(every) if p != w and p[0] < w[2] + 200 and p[2] > w[0] - 200 and secrets.COMPLEMENT[mine] == secrets.KINDS[p[1]].role and (mine != "endpoint" or secrets.KINDS[p[1]].strong)]
        if to:
            one = lambda x: f"{secrets.KINDS[x[1]].name}:{x[0]}:{x[2]}"
            out.append(f"{one(w)}>{'|'.join(map(one, to))}")
    return ",".join(out)


def test_many_secrets_in_one_text(spark):
    import time

    rows = [(1, "token=abcdefgh é " * 64_000), (2, "login=bobby99 token=abcdefgh12 " * 3000)]
    began = time.time()
    got = {x.doc_id: x.text for x in secrets.masked(spark.createDataFrame(rows, DOCS)).collect()}
    assert time.time() - began < 90  # a quadratic way takes several minutes
    assert got == {1: "[SECRET] é " * 64_000, 2: "[SECRET] [SECRET] " * 3000}


def test_secrets(spark):
    r = random.Random(3)
    parts = ["token", "PASSWD", "Api_Key", "=", ":", '"', " ", "AKIA", "ABCDEFGH1234", "abcdef0123456789abcdef", "deadbeefdeadbeef", "é😀", "\n", "x", "http://h.com/a", "10.1.2.3", "login=bobby99", "token=token:abcdefgh"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 100)))) for i in range(150)] + [(900, None), (901, ""), (901, ""), (902, "token=abcdefgh1 " * 700)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = {x.doc_id: x for x in secrets.report(df).collect()}
    masked = {x.doc_id: x.text for x in secrets.masked(df).collect()}
    for i, t in rows:
        spans = base_spans(t or "")
        assert got[i].base_sha256 == sha(",".join(f"{n}:{s}:{e}" for s, _, e, n in spans))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
        assert {f"{n}:{s}:{e}" for s, _, e, n in spans} <= set(got[i].spans.split(",")) or not spans
        assert got[i].links == brute_links(t or "")
        told = [tuple(map(int, x.split(":")[1:])) for x in got[i].spans.split(",") if x]
        assert masked[i] == (cut_spans(t, told) if t else t)
    assert secrets.masked(df).columns == df.columns and masked[900] is None
    assert secrets.report(spark.createDataFrame([], DOCS)).count() == 0


def test_weak_parts_need_a_partner(spark):
    far = "word " * 100
    rows = [(1, "see http://x.com/a for more"), (2, "http://x.com/a token=abcdefgh12"), (3, f"http://x.com/a {far} token=abcdefgh12"), (4, "login=bobby99 and token=abcdefgh12")]
    got = {x.doc_id: x.spans for x in secrets.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert "endpoint" not in got[1] and "endpoint" in got[2] and "endpoint" not in got[3] and "account" in got[4]


# 4 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [suffixes.BUCKETS, 0, 10**6])
def test_suffix_arrays(monkeypatch, buckets):
    monkeypatch.setattr(suffixes, "BUCKETS", buckets)
    r, deep, real = random.Random(1), [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda s, symbols: deep.append(len(s)) or real(s, symbols))
    for _ in range(250):
        b = "".join(r.choice(r.choice(["ab", "abc", "a"])) for _ in range(r.randint(0, 90))).encode()
        s = np.concatenate((np.frombuffer(b, np.uint8).astype(np.int64) + 1, [0]))
        assert suffixes.suffix_array(s, 257).tolist() == sorted(range(len(b) + 1), key=lambda i: b[i:])
    assert len(deep) > 400  # names repeat, so the names are sorted by induction too


@pytest.mark.parametrize("shard, told", [(1 << 20, 10**6), (1500, 0)])
def test_repeats(spark, monkeypatch, shard, told):
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(common.told, "__defaults__", (told,))
    r, size = random.Random(5), 400
    source = ["".join(r.choice("abcdé ") for _ in range(3000)) for _ in range(3)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(r.randint(0, 4)):
            kind = r.random()
            at = r.randrange(2000)
            t += r.choice(source)[at : at + r.randint(10, 900)] if kind < 0.5 else r.choice("ab") * r.randint(1, 700) if kind < 0.6 else "".join(r.choice("xyzw é") for _ in range(r.randint(1, 400)))
        rows.append((i, t))
    rows += [(500, None), (501, ""), (502, rows[3][1]), (502, rows[3][1])]
    begun = Counter(b[p : p + size] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - size + 1))
    exp = []
    for i, t in rows:
        b = (t or "").encode()
        gone = {q for p in range(len(b) - size + 1) if begun[b[p : p + size]] > 1 for q in range(p, p + size)}
        exp.append((i, len(b), len(gone), sum(q - 1 not in gone for q in gone), sha(bytes(c for q, c in enumerate(b) if q not in gone))))
    got = [tuple(x) for x in repeats.report(clashing(spark.createDataFrame(rows, DOCS))).collect()]
    assert sorted(got) == sorted(exp)
    assert repeats.report(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_of_texts_above_a_slab(spark):
    r = random.Random(8)
    shared = "".join(r.choice("abcdefgh ") for _ in range(300_000))
    own = ["".join(r.choice("ijklmnop ") for _ in range(1_000_000)) for _ in range(2)]
    rows = [(1, own[0] + shared + own[0][:500]), (2, shared[:200_000] + own[1])]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in repeats.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (201_000, 3), 2: (200_000, 1)}


# 5 -----------------------------------------------------------------------------------------------


def slow_fingerprint(t, words):
    w = t.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in ("", " \t", "a", "A b", "a b c", "a b c d e É x", "The the THE the " * 9):
        assert simhash.fingerprint(t, 3) % (1 << 64) == slow_fingerprint(t, 3)


def test_fingerprints_of_long_texts(monkeypatch):
    r = random.Random(3)
    text = " ".join(r.choice("abcdefgh") for _ in range(400))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text, 3) == whole and whole % (1 << 64) == slow_fingerprint(text, 3)


@pytest.mark.parametrize("bits", [2, 3, 5])
def test_anchors_find_every_link(spark, bits):
    r = random.Random(1)
    found = {r.getrandbits(64) for _ in range(40)}
    for x in list(found):
        for _ in range(10):
            for _ in range(r.randint(1, bits + 1)):
                x ^= 1 << r.randrange(64)
            found.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in found)
    got = {tuple(sorted((e.x, e.y))) for e in simhash.edges(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()}
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= bits}


@pytest.mark.parametrize("size", [4096, 3])
def test_ties_connect_what_links_connect(spark, monkeypatch, size):
    for name in ("HOMES", "REPLICAS", "COMPARED"):
        monkeypatch.setattr(simhash, name, size)
    r = random.Random(4)
    found = {0, -1, 1 << 62}
    for x in [r.getrandbits(63) for _ in range(6)]:  # groups in which most are linked; 0 and 1 << 62 are the seventh
        found |= {x ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 3))) for _ in range(60)}
    fps = spark.createDataFrame([(x,) for x in found], "fp long")
    roots = [{tuple(e) for e in components.components(made(fps, 5), "x", "y").collect()} for made in (simhash.edges, simhash.ties)]
    assert roots[0] == roots[1] and len({root for _, root in roots[0]}) == 7
    assert simhash.ties(fps.limit(0)).count() == 0


def test_fingerprints_and_their_replicas_are_not_broadcast(spark):
    """Spark sizes them before the explode: a few thousand fingerprints look small."""
    fps = spark.range(5000).select(F.xxhash64("id").alias("fp"))
    for made, told in ((simhash.edges(fps, 2), 0), (simhash.edges(fps, 5), 0), (simhash.ties(fps, 5), 2)):  # ties broadcast the sizes of anchors for both sides; their number is bounded
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") == told


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 10), (7, 8), (8, 7), (20, 21), (22, 21), (22, 23), (24, 23), (30, 30)]
    got = {r.x: r.root for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 7: 7, 8: 7} | {i: 20 for i in range(20, 25)}


def test_simhash_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text), (3, text.upper()), (9, "other words here and more of them"), (1, None), (2, " "), (2, " "), (None, text)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.report(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 9), (1, 1), (2, 1), (2, 1), (None, 3)], key=str)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 9, 1, None], key=str)
    assert simhash.report(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("often", [10**6, 1])
def test_deduplicated_links_similarity(spark, monkeypatch, often):
    monkeypatch.setattr(similar, "SAMPLED", 1)
    monkeypatch.setattr(similar, "FREQUENT", often)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    common = [word() for _ in range(40)]  # a passage of texts that are otherwise different
    texts = ["", "one two", "ONE  two", "one three"] + [" ".join(common + [word() for _ in range(k)]) for k in (6, 9, 12, 60, 70)]
    for _ in range(25):
        base = [word() for _ in range(r.randint(40, 200))]
        for edits in (0, 1, 1, 2, 3, 5):
            now = list(base)
            for _ in range(edits):
                now[r.randrange(len(now))] = word()
            texts.append(" ".join(now))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for t in texts]
    root = list(range(len(texts)))
    far = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                far.append((simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)) % (1 << 64))
                x, y = root[i], root[j]
                root = [min(x, y) if z in (x, y) else z for z in root]
    assert max(x.bit_count() for x in far) > 5
    got = {x.doc_id for x in simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == set(root)


def test_sketches_lose_nothing_and_bloom_filters_pass_their_keys(spark):
    r = np.random.default_rng(7)
    for n, edits in ((1, 0), (40, 5), (150, 16), (150, 30), (5000, 400)):
        a = np.unique(r.integers(-(2**63), 2**63 - 1, n))
        b = np.unique(np.concatenate((a[edits:], r.integers(-(2**63), 2**63 - 1, edits))))
        apart = sum(((x ^ y) % 2**64).bit_count() for x, y in zip(similar.sketch(a).tolist(), similar.sketch(b).tolist(), strict=True))
        assert apart <= len(np.setxor1d(a, b)) and (apart > 0) == (edits > 0)
        if n > 64 * similar.SKETCH:
            two = similar.longer(a)
            assert len(two) * 64 >= len(a) and (similar.sketch(a, len(two) // 2) == two[: len(two) // 2] ^ two[len(two) // 2 :]).all()
    rows = []  # sets of fitting sizes around a power of two, and their real distance
    for n, m, same in ((1000, 1060, 940), (1024, 1100, 1000), (1000, 1100, 500), (900, 1000, 870), (600, 500, 490), (4000, 4200, 3000)):
        h = np.unique(r.integers(-(2**63), 2**63 - 1, n + m - same))
        a, b = h[:n], h[n - same :]
        rows.append((n, m, *(similar.sketch(s).tolist() for s in (a, b)), *(None if (t := similar.longer(s)) is None else t.tolist() for s in (a, b)), 5 * same >= 4 * (n + m - same)))
    df = spark.createDataFrame(rows, "n int, m int, a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>, linked boolean")
    assert df.where(~similar.near("n", "m", "a", "b", "c", "d") & F.col("linked")).count() == 0
    assert df.where(similar.near("n", "m", "a", "b", "c", "d")).count() == 4
    assert similar.sketch(np.zeros(0, np.int64)).tolist() == [0] * similar.SKETCH
    keys, rest = spark.range(-20_000, 40_000, 2), spark.range(-19_999, 40_000, 2)
    bits = common.bloom(keys, "id")
    assert keys.where(common.maybe(bits, "id")).count() == 30_000 and rest.where(common.maybe(bits, "id")).count() < 900
    none = common.bloom(keys.limit(0), "id")
    assert rest.where(common.maybe(none, "id")).count() == 0


def test_long_pairs_at_the_least_similarity(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    same = words("s", 96_004)
    at = [" ".join(same + words(x, 12_000)) for x in "ab"]  # 96,000 of 120,000 shingles
    under = " ".join(same + words("c", 12_001))
    assert [x.doc_id for x in simhash.deduplicated(spark.createDataFrame([(1, at[0]), (2, at[1])], DOCS)).collect()] == [1]
    assert simhash.deduplicated(spark.createDataFrame([(1, at[0]), (3, under)], DOCS)).count() == 2


@pytest.mark.parametrize("nodes", [4096, 3])
def test_a_group_whose_members_are_mostly_just_too_far(spark, monkeypatch, nodes):
    monkeypatch.setattr(similar, "NODES", nodes)
    r = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        now = list(base)
        for i in r.sample(range(150), r.choice((1, 2, 3, 4))):
            now[i] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(now))
    sets = [{tuple(w[i : i + 5]) for i in range(146)} for w in map(str.split, texts)]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if z in (root[i], root[j]) else z for z in root]
    got = {x.doc_id for x in simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == set(root) and 2 < len(got) < 60


def test_close_fingerprints_are_not_enough(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**6)}"
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    base = [word() for _ in range(60)]
    fp = simhash.fingerprint(" ".join(base), 5)
    while True:
        other = list(base)
        other[10 + r.randrange(10)], other[30 + r.randrange(10)] = word(), word()
        if ((simhash.fingerprint(" ".join(other), 5) ^ fp) % (1 << 64)).bit_count() <= 5:
            break
    assert 5 * len(sets(base) & sets(other)) < 4 * len(sets(base) | sets(other))
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], DOCS)
    assert simhash.deduplicated(docs).count() == 2


# 6 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard, block", [(4096, 1024), (40, 3)])
def test_topk(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(150)] + [(200, [0.5] * 8), (201, [0.5] * 8), (202, None), (203, [1.0, None] * 4), (204, [math.nan] * 8), (205, [math.inf] * 8), (None, [1.0] * 8)]
    rows += [(206, []), (220, []), (207, [0.0] * 8), (240, [0.0] * 8), (300, [2e6, 1.0]), (301, [3.0, 2e6]), (320, [2.0**30, -3.0]), (302, [2.0**30 + 64, 5.0]), (303, [1e38, 1.0])]
    rows += [(i, [r.gauss(0, 1) * 10 for _ in range(3)]) for i in range(340, 346)]
    good = {i: [math.floor(64 * x) for x in np.array(v, np.float32).astype(float)] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    exp = []
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-clip(sum(a * b for a, b in zip(good[q], v, strict=True))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
        exp += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(3)
    assert sorted(map(tuple, topk.report(df).collect())) == sorted(exp)
    assert topk.report(df.limit(0)).count() == 0
    twice = topk.report(df.unionByName(df.where("vec_id in (1, 20)"))).where("query_id = 20").count()
    assert twice == 20


def test_topk_broadcasts_no_vectors(spark, monkeypatch):
    """Blocks meet shards without a join: packed vectors are many times their files, by whose size Spark would broadcast them."""
    plans, kept = {}, topk.written
    monkeypatch.setattr(topk, "written", lambda df, what: plans.update({what: df._jdf.queryExecution().executedPlan().toString()}) or kept(df, what))
    monkeypatch.setattr(topk, "SHARD", 100)
    df = spark.range(1000).selectExpr("id as vec_id", "transform(sequence(1, 8), i -> float(sin(id * i))) as embedding")
    found = topk.report(df)
    assert "Join" not in plans["own"] and found._jdf.queryExecution().executedPlan().toString().count("Join") == 1  # the kth scores of blocks
    assert found.count() == 50 * 20


def test_topk_skips_shards(monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 16)
    r = np.random.default_rng(1)
    centers = r.normal(size=(20, 16)) * 300
    vectors = np.floor(np.concatenate([c + r.normal(size=(200, 16)) * 10 for c in centers]))
    ways = topk.directions(vectors, 20)
    assert len(ways) > 10
    cell = (vectors @ ways.T).argmax(axis=1)
    ids, queries = np.arange(0, 4000, 40), vectors[::40]
    best, scored = topk.Best(len(ids), 20), 0
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        scored += topk.search(ids, queries, topk.Shard.of(at, vectors[at]), best)
    assert scored < 0.5 * len(ids) * len(vectors)
    for q, i in enumerate(ids.tolist()):
        s = (vectors @ vectors[i]).astype(int)
        assert best.id[q].tolist() == sorted((x for x in range(4000) if x != i), key=lambda x: (-s[x], x))[:20]


# 7 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("entries", [10**6, 9])
def test_kneser_ney(spark, monkeypatch, entries):
    monkeypatch.setattr(quality, "ENTRIES", entries)
    train, test = ["hello world hello", "the world is", "hello there the end", "aaaa bbb"], ["hello the", "zzz", "", "wor ld é", None, "hello the"]
    c = {4: Counter(b[i : i + 4] for t in train for b in [quality.START + quality.normal(t)] for i in range(len(b) - 3))}
    for k in (3, 2, 1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d, total, taken = {}, {}, {}
    for k, counts in c.items():
        n = [max(1, sum(v == i for v in counts.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]))]
        total[k], taken[k] = Counter(), Counter()
        for g, a in counts.items():
            total[k][g[:-1]] += a
            taken[k][g[:-1]] += d[k][min(a, 3) - 1]

    def p(g):
        k = len(g)
        if not k or g[:-1] not in total[k]:
            return p(g[1:]) if k else 1 / 256
        a = c[k].get(g, 0)
        return (a - (d[k][min(a, 3) - 1] if a else 0) + taken[k][g[:-1]] * p(g[1:])) / total[k][g[:-1]]

    model = quality.trained(spark.createDataFrame([(t,) for t in train], "text string"))
    got = quality.log_likelihoods(spark.createDataFrame(list(enumerate(test)), "i int, text string"), model).orderBy("i").collect()
    for t, r in zip(test, got, strict=True):
        b = quality.START + quality.normal(t or "")
        assert r["_n"] == len(b) - 3 and r["_log"] == pytest.approx(sum(math.log(p(b[i : i + 4])) for i in range(len(b) - 3)), abs=1e-4)


def test_quality_rows(spark):
    docs = [(i, "some plain words in a row " * 3, "en" if i % 2 else None) for i in range(12)] + [(50, None, "en"), (51, "#$%^ @!~ ^^&" * 9, "xx"), (51, "#$%^ @!~ ^^&" * 9, "xx")]
    labels = [(i, 1) for i in range(12)] + [(51, 0), (None, 1), (3, None)]
    d, n = clashing(spark.createDataFrame(docs, "doc_id long, text string, lang string")), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.report(d, n).collect()
    got = {r.doc_id: r.keep for r in rows}
    assert len(rows) == len(docs)
    assert all(got[i] for i in range(12)) and not got[50] and not got[51]
    assert quality.report(d, n.limit(0)).where("keep").count() == 14
    assert quality.report(d.limit(0), n).count() == 0
    long = spark.createDataFrame([(99, "some plain words in a row " * 100_000, "en")], "doc_id long, text string, lang string")
    assert quality.report(d.select("doc_id", "text", "lang").unionByName(long), n).where("doc_id = 99 and n_bytes = 2600000").count() == 1


# 8 -----------------------------------------------------------------------------------------------


def test_sharding(spark):
    import zlib

    rows = [(i, "é" * (i % 5)) for i in range(400)] + [(None, None), (None, None), (7, "again")]
    got = sharding.shard_documents(clashing(spark.createDataFrame(rows, DOCS))).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in got)
    assert 20 < sum(r.grown_shard == 8 for r in got) < 80
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    heavy = spark.range(3000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in heavy}[1] == pytest.approx(2250, abs=150)


# 9 -----------------------------------------------------------------------------------------------


def test_automaton_is_levenshtein():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(9)
    terms = ["abcabc", "abcd", "bcabca", "aabbcc", "cab"]
    automaton = toxicity.Automaton({t: (2.0, 1.0) for t in terms})
    for _ in range(4000):
        w = "".join(r.choice("abcd") for _ in range(r.randint(1, 8)))
        hit = automaton.hit(w)
        want = max([(2.0 - distance(w, t), t) for t in terms if distance(w, t) <= (len(t) >= toxicity.FUZZY)], default=None)
        assert (hit[0] if hit else None) == (want[0] if want else None), w
    assert toxicity.Automaton({"stemma*": (1.0, 0.5)}).hit("stenmaxyz")[2] == 1


def test_quotation_is_told_from_abuse():
    reader = toxicity.Reader({"moron": (4.0, 0.0)})
    assert reader.features("you are a moron")[:3] == (4.0, 4.0, 0.0) and reader.features('they said "moron" again')[0] == 0.0


def test_toxicity_rows(spark):
    r = random.Random(2)
    words = ["".join(r.choice("bcdfglnrst") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    docs = [(i, " ".join(r.choice(words) for _ in range(40)) + (" zugglex zugglexes" if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, "zuggIex ".lower() * 3), (None, "")]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(900, None), (None, 1)]
    d, n = clashing(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.report(d, n).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400)) and 0 <= got[900].score < 0.3 and got[901].score > got[900].score
    assert toxicity.accepted(d, n).columns == d.columns
    assert toxicity.report(d.limit(0), n).count() == 0 and toxicity.accepted(d.limit(0), n).count() == 0
    more = clashing(spark.createDataFrame([(901, "zuggIex ".lower() * 3), (950, ("plain words " * 200_000) + "zugglex"), (951, "")], DOCS))
    again = [(x.doc_id, x.score) for x in toxicity.report(d.unionByName(more), n).collect()]
    assert len(again) == 406 and len({s for i, s in again if i == 901}) == 1 and dict(again)[951] == got[900].score
    assert toxicity.report(d, n.limit(0)).where("predicted = 1").count() == 0


def test_short_terms_are_found_misspelled(spark):
    r = random.Random(3)
    words = ["".join(r.choice("bcdfglnrst") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    bad = ["idiot", "stupid", "moron", "scum"]
    rows = [(i, " ".join(r.choice(words) for _ in range(30)) + (" you " + " ".join(r.sample(bad, 2)) if i % 4 == 0 else " moroz scam")) for i in range(400)]
    tests = {1000: "iidiot", 1001: "stpid", 1002: "mooron", 1003: "scumm", 1004: "idiot"}
    rows += [(k, " ".join(words[:30]) + " you " + " ".join([w] * 2)) for k, w in tests.items()] + [(1010, " ".join(words[:30]) + " you moroz scam")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.report(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert all(got[k] > got[1010] + 0.05 for k in tests), got
    assert got[1010] < toxicity.THRESHOLD


# 10 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [10**6, 40])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (*decontamination.blocks.__defaults__[:-1], most))
    r, vocabulary = random.Random(2), ["a", "B", "c", "dé", "é", "1x", "ZZ", "q", "w", "e"]
    sentence = lambda n, v: "".join(r.choice(v) + r.choice([" ", ", ", "\n", "."]) for _ in range(n))
    items = [(i, sentence(r.choice([0, 1, 2, 5, 12, 13, 14, 20, 30]), vocabulary)) for i in range(25)] + [(90, None), (91, "")]
    docs = [(i, sentence(r.randint(0, 60), [*vocabulary, "zz9", "y"]) + "".join(f" {r.choice(items)[1] or ''} {sentence(r.randint(0, 100), ['u', 'v', 'w'])}" for _ in range(r.randint(0, 2)))) for i in range(120)]
    docs += [(900, None), (901, ""), (902, docs[5][1]), (902, docs[5][1])]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def brute(t):
        w, ids = low(t), set()
        hit = [0] * len(w)
        for i, x in items:
            b = low(x)
            for j in range(max(1, len(b) - 12) if b else 0):
                for p in range(len(w) - len(b[j : j + 13]) + 1):
                    if w[p : p + 13][: len(b[j : j + 13])] == b[j : j + 13]:
                        ids.add(str(i))
                        hit[p : p + len(b[j : j + 13])] = [1] * len(b[j : j + 13])
        return len(w), sum(hit), len(ids), sha(",".join(sorted(ids))), sum(hit) > 0 and 20 * sum(hit) >= len(w)

    d, b = clashing(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontamination.report(d, b).collect()}
    assert got == {i: brute(t) for i, t in docs}
    kept = decontamination.decontaminated(d, b)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i, t in docs if not brute(t)[4]}
    assert not decontamination.report(d, b.limit(0)).where("contaminated").count()
    assert decontamination.report(d.limit(0), b).count() == 0 and decontamination.decontaminated(d.limit(0), b).count() == 0


def test_decontamination_of_long_texts():
    block = decontamination.Windows.of(decontamination.windows([("7", " ".join(f"w{i}" for i in range(20)))]))
    text = "filler words " * 120_000 + " ".join(f"W{i}" for i in range(20)) + " tail" * 1000
    assert len(text) > decontamination.SHARD
    (n, spans, items), (m, none, _) = decontamination.scan([text.encode(), b""], block)
    assert (n, m, items, none) == (241_020, 0, {"7"}, []) and [s[:2] for s in spans] == [(240_000, 240_020)]


def test_many_partitions_cost_near_copies_few_tasks(spark):
    """Where partitions are many and rows few, tasks are what components and Bloom filters cost."""
    sc, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)] + [(i, i + 2) for i in range(0, 20, 2)], "x long, y long").cache()
    keys = pairs.select("x")

    def run(group, work):
        sc.setJobGroup(group, group)
        found = work()
        sc.setLocalProperty("spark.jobGroup.id", None)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
        return found, jobs, sum(info.numCompletedTasks for s in {s for j in jobs for s in j.stageIds} if (info := sc.statusTracker().getStageInfo(s)))

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        roots, _, tasks = run("components", lambda: components.components(pairs, "x", "y").collect())
        bits, jobs, _ = run("bloom", lambda: common.bloom(keys, "x"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.x: r.root for r in roots} == {i: 0 if i < 22 else i // 2 * 2 for i in range(41) if i < 40}
    assert keys.where(common.maybe(bits, "x")).count() == keys.count()
    assert len(jobs) < 20 and tasks < 2300, (len(jobs), tasks)
