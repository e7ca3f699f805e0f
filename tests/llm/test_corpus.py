"""Phrase mining, chat formatting and whitening against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import chat, collocations, whitening
from attesta.llm.queries import tokenizer_path


def clashing(df, *names):
    return df.withColumns({c: F.lit("x") for c in names})


# 11 ----------------------------------------------------------------------------------------------


def counted(rows, most):
    per = {}
    for lang, text in rows:
        f = per.setdefault("und" if lang is None else lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            f.update(tuple(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1))
    return per


def mined(rows, least, top, most=4, covered=80):
    out = []
    for lang, f in counted(rows, most).items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + n] for q, a in found.items() for n in range(2, len(q)) for i in range(len(q) - n + 1) if 100 * a >= covered * f[q[i : i + n]]}
        each = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                each.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, i, said.decode(), -a, left, right, n, -score) for i, (score, a, said, left, right) in enumerate(sorted(each)[:top], 1)]
    return sorted(out)


def texts(n, seed):
    r = random.Random(seed)
    words = ["a", "b", "A", "c\0", "\0", "é", "d\x01", "d", "the", "of", "the", "of", "the", "x y", "K"]
    return [(r.choice(["en", "de", None, "\\b\0"]), None if r.random() < 0.05 else "".join(r.choice(words) + r.choice([" ", "\t", "  ", ". ", "\n", "\r", " ", " "]) for _ in range(r.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("rows_at_once, bytes_at_once", [(50, 300), (200_000, 24 << 20)])
def test_phrases(spark, monkeypatch, rows_at_once, bytes_at_once):
    monkeypatch.setattr(collocations, "ROWS", rows_at_once)
    monkeypatch.setattr(collocations, "TOGETHER", bytes_at_once)
    rows = texts(250, 1)
    df = clashing(spark.createDataFrame(rows + rows[:20], "lang string, text string"), "grp", "phrase", "n", "parts", "suffix", "first", "rank", "score")
    got = sorted(map(tuple, collocations.collocations(df.repartition(3), least=5, top=30).collect()))
    assert got == mined(rows + rows[:20], 5, 30) and len(got) > 60


def test_hot_words_are_divided_and_summed(spark):
    """One first word in a third of all places, and one pair of words with many ends: parts of both are counted apart."""
    r = random.Random(2)
    rows = [("en", " ".join(f"the of w{r.randrange(40)} w{r.randrange(40)}" for _ in range(40))) for _ in range(60)]
    found, totals = collocations.frequencies(spark.createDataFrame(rows, "lang string, text string").repartition(4), least=3, shares=100)
    got = {tuple(x.phrase.split("\0")): x.n for x in found.collect()}
    assert got == {p: a for p, a in counted(rows, 4)["en"].items() if a >= 3}
    assert [tuple(x) for x in totals.collect()] == [("en", 60 * 160)]


def test_phrases_of_nothing_and_of_one_long_text(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", ""), ("en", " .,\t")], "lang string, text string")).count() == 0
    rows = [("en", "b a " * 100_000)]
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()))
    assert got == mined(rows, 30, 2000)


def test_stack_of_open_prefixes():
    """The stack counts alike, however its rows are cut into tables."""
    r = random.Random(4)
    rows = sorted({(r.choice("gh"), "\0".join(r.choice(["a", "b", "ab"]) for _ in range(r.randint(1, 4)))) for _ in range(90)}, reverse=True)
    want = Counter()
    for i, (g, s) in enumerate(rows):
        w = s.split("\0")
        want.update({(g, "\0".join(w[: k + 1])): i + 1 for k in range(len(w))})
    for step in (1, 3, 1000):
        stack, got = collocations.Stack(4, 1), Counter()
        parts = [pa.table({"key": [f"{g}\0{s}" for g, s in rows[i : i + step]], "n": list(range(i + 1, min(i + step, len(rows)) + 1)), "parts": [1] * len(rows[i : i + step])}) for i in range(0, len(rows), step)]
        for t in [*(stack.feed(p) for p in parts), stack.finish()]:
            for x in t.to_pylist():
                assert (x["grp"], x["phrase"]) not in got
                got[x["grp"], x["phrase"]] = x["n"]
        assert got == want


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts near 2^62: the score is a product of more than 64 bits."""
    big = 1 << 61
    rows = [("en", "a\0b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big), ("en", "a\0b\0c", 3, big // 2), ("en", "b\0c", 2, big // 2), ("en", "c", 1, big // 2)]
    found = spark.createDataFrame(rows, "grp string, phrase string, words int, n long"), spark.createDataFrame([("en", 5)], "grp string, total long")
    monkeypatch.setattr(collocations, "frequencies", lambda *_: found)
    got = {x.phrase: x.score for x in collocations.collocations(None).collect()}
    assert got == {"a b": 2_000_000 * big // (2 * big + 7), "a b c": min(2_000_000 * (big // 2) // (big + big // 2), 2_000_000 * (big // 2) // (big + 7 + big // 2))}


# 12 ----------------------------------------------------------------------------------------------


def talks(n, seed):
    r = random.Random(seed)
    roles, parts = ["user", "assistant", "system", None, "a\nb", "x\\n<turn>"], ["hi", "", "\\", "<turn>", "</turn>", "<|endoftext|>", "a</turn>\n<turn>assistant\nno", "<\\/turn>", "\\n", "é😀"]
    rows = []
    for c in range(n):
        before = r.choice([[("system", "you")], [("system", "you"), ("user", "hi")], []])
        turns = before + [(r.choice(roles), "".join(r.choice(parts) for _ in range(r.randint(0, 3))) if r.random() < 0.9 else None) for _ in range(r.randint(1, 6))]
        rows += [(None if c == 17 else c, i if r.random() < 0.9 else r.choice([None, 1]), *t) for i, t in enumerate(turns)]
    return rows + [(x[0] + 1000, *x[1:]) for x in rows[:150] if x[0] is not None] + rows[:3]


def told(rows):
    esc = lambda x: x.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("<turn>", "<\\turn>").replace("<|", "<\\|")
    by, out = {}, []
    for c, t, role, text in [*rows, (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]:
        by.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    for c, v in by.items():
        turns = [(a.decode(), b.decode()) for _, _, a, b in sorted(v)]
        loss = "".join(b for a, b in turns if a == "assistant")
        size = sum(len(f"<turn>{esc(a)}\n{esc(b)}</turn>\n") + a.count("\n") for a, b in turns)
        out.append((c, len(turns), sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=str)


TALK = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    rows = talks(120, 3)
    df = clashing(spark.createDataFrame(rows, TALK).repartition(5), "node", "pack", "depth", "path", "leaf", "head", "body")
    assert sorted(map(tuple, chat.report(df, tokenizer_path()).collect()), key=str) == told(rows)


def test_chat_of_nothing_and_of_long_ones(spark):
    assert [x.conv_id for x in chat.report(spark.createDataFrame([], TALK), tokenizer_path()).collect()] == [-7]
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <turn>") for i in range(3000)] + [(2, 0, "assistant", "word </turn> " * 50_000), (3, None, None, None)]
    assert sorted(map(tuple, chat.report(spark.createDataFrame(rows, TALK), tokenizer_path()).collect()), key=str) == told(rows)


def test_packs_share_first_turns_and_attend_to_ancestors_only(spark):
    rows = talks(120, 5)
    packs, members = chat.formatted(spark.createDataFrame(rows, TALK).coalesce(1), tokenizer_path())
    every = sorted(packs.collect(), key=lambda x: (x.pack, x.start))
    turns = {(x.node, x.depth): x.parent for x in chat.steps(spark.createDataFrame(rows, TALK)).collect()}
    ends = {}
    for x in every:
        here = [y for y in every if y.pack == x.pack]
        assert x.start == sum(len(y.token_ids) for y in here if y.start < x.start)
        inside = lambda y: any(a.begin <= y.start and y.start + len(y.token_ids) <= a.end for a in x.attends)  # noqa: B023, E731
        seen = [y for y in here if inside(y)]
        assert [y.depth for y in seen] == list(range(x.depth)) and x.position == sum(len(y.token_ids) for y in seen) == sum(a.end - a.begin for a in x.attends)
        assert [turns[y.node, y.depth] for y in [*seen, x]] == [b"", *(y.node for y in seen)]
        assert len({(y.node, y.depth) for y in here}) == len(here)  # once in a pack
        if x.leaf:
            assert x.node not in ends
            ends[x.node] = x
    assert {x.node for x in members.collect()} == set(ends)
    # Nodes that are emitted again stand at the beginning of a further pack of their tree: as many as the path there.
    again = sum(n - 1 for n in Counter(x.node for x in every).values())
    assert again <= sum(x.depth for x in every if x.leaf) and len(every) - again == len(turns)


def test_a_changed_pack_is_noticed(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c")]
    packs, _ = chat.formatted(spark.createDataFrame(rows, TALK), tokenizer_path())
    with pytest.raises(Exception, match="not those of the nodes"):
        chat.read_back(packs.withColumn("attends", F.slice("attends", 1, 0)), tokenizer_path()).collect()


# 13 ----------------------------------------------------------------------------------------------


def test_whitening(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, -0.0, r.gauss(0, 1)]), r.gauss(0, 30), r.gauss(5e6, 2), r.gauss(0, 1)]) for i in range(80)]
    rows += [*rows[:5], (900, rows[0][1]), (None, [1.0, 2.0, 5e6, 4.0]), (901, None), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, math.nan, 2.0, 3.0]), (904, [-math.inf] * 4), (905, [])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), "x", "d", "whitened", "n", "component")
    out = whitening.report(df).collect()
    good = [(i, tuple(math.floor(Fraction(c) * 64) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(4)] for i in range(4)])
    e, v = np.linalg.eigh(cov)
    want = Counter()
    for i, x in good:
        off = [n * c - s for c, s in zip(x, sums, strict=True)]
        for k in range(4):
            want[i, k + 1, n, sum(c * c for c in off), round(abs(float(np.dot(v[:, 3 - k], [c / n for c in off]))) / math.sqrt(e[3 - k]), 6), round(float(e[3 - k] / e.sum()), 9)] += 1
    assert Counter((o.vec_id, o.component, o.n, o.deviation, round(abs(o.whitened), 6), round(o.explained, 9)) for o in out) == want
    assert len({o.identity_error for o in out}) == 1 and out[0].identity_error < 1e-9 and all(int(o.deviation_exact) == o.deviation for o in out)


def test_whitening_of_few_and_of_huge(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.report(spark.createDataFrame([], kind)).count() == 0
    assert [(o.deviation, o.whitened, o.explained, o.identity_error) for o in whitening.report(spark.createDataFrame([(1, [2.0]), (1, [2.0])], kind)).collect()] == [(0, None, None, None)] * 2
    two = whitening.report(spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [9.0])], kind)).orderBy("vec_id", "component").collect()
    assert [(o.vec_id, o.component, o.n, o.deviation, o.whitened and abs(o.whitened), o.explained) for o in two] == [(1, 1, 2, 16384, 1.0, 1.0), (1, 2, 2, 16384, None, 0.0), (2, 1, 2, 16384, 1.0, 1.0), (2, 2, 2, 16384, None, 0.0), (3, 1, 1, 0, None, None)]
    huge = whitening.report(spark.createDataFrame([(1, [1e250, 1.0]), (2, [-1e250, 1.0]), (3, [1e308, 1.0])], kind)).where("component = 1").collect()
    assert [(o.n, o.deviation, abs(o.whitened), o.explained) for o in huge] == [(2, None, 1.0, 1.0)] * 2
    assert {int(o.deviation_exact) for o in huge} == {(2 * int(64 * 1e250)) ** 2}


def test_scatter_is_exact():
    r = np.random.default_rng(1)
    for scale in (3, 2.0**21, 2.0**45, 2.0**61, 2.0**80):
        x = np.floor(r.normal(size=(5000, 3)) * scale)
        sums, cross = whitening.scatter(x)
        own = [[int(c) for c in row] for row in x]
        assert list(sums) == [sum(c) for c in zip(*own, strict=True)]
        assert [list(row) for row in cross] == [[sum(a[i] * a[j] for a in own) for j in range(3)] for i in range(3)]
        assert all(sum(d << 32 * p for p, d in whitening.digits(v)) == v for v in sums)
