"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

From a bounded sample of labelled rows a lexicon is learned: words and stems (beginnings of words) that are far
more frequent in toxic rows than in others. Its trie is intersected with Levenshtein automata of distance 1, as a
deterministic automaton that is built state by state as words ask for it, so misspelled terms are found in one pass
over a word's letters. Each hit is weighed by how its term (exact or misspelled) separates the sample, and its
context window says whether it is quoted or reported, or aimed at someone. A logistic model over the sums turns
this into a score. The documents pass through one map and nothing of them is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import deleted, text_or_empty, written

#: Labelled rows in the sample that the lexicon and the model are fitted on (expected number, chosen by a hash of the id).
SAMPLE = 20_000
#: Stems are this long; a term needs so many toxic rows and this log ratio of frequencies.
STEMS, LEAST_ROWS, LEAST_RATIO = range(4, 9), 5, 3.5
#: Letters from which a word, and a stem, may be misspelled by one edit. Many ordinary words begin within an edit of a short stem.
FUZZY, FUZZY_STEM = 4, 6
#: Shorter words of the lexicon count as misspelled only in words that the sample doesn't know as ordinary.
SHORT = 6
#: Words on either side of a hit that are its context, and the most words inside a quotation.
WINDOW, QUOTED = 8, 60
#: Where a score counts as toxic.
THRESHOLD = 0.3

WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»‹›\n]")
QUOTES = frozenset("\"“”„«»‹›")
#: Words that report what others say, and words that address someone.
REPORTS = frozenset("said says say saying quote quoted quotes quoting wrote writes written called calls calling term word words phrase slur insult insults reported reportedly according so-called".split())
ADDRESS = frozenset("you your yours you're youre u ur du dich dir dein deine tu toi te ton ta tes vous votre vos ti tus usted vosotros".split())


def may_be_misspelled(term: str) -> bool:
    return len(term) >= FUZZY if not term.endswith("*") else len(term) > FUZZY_STEM


class Automaton:
    """Finds the lexicon's terms in words, up to one edit. States are sets of (trie node, edits), made when first needed."""

    def __init__(self, terms: dict[str, tuple[float, float]]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.loose: list[bool] = [False]
        for term in terms:
            letters = term.rstrip("*")
            node = 0
            for c in letters:
                if may_be_misspelled(term):
                    self.loose[node] = True
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.loose.append(False)
                node = self.child[node][c]
            if may_be_misspelled(term):
                self.loose[node] = True
            (self.stem if term.endswith("*") else self.word)[node] = term
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[tuple | None, tuple | None]] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        todo = [x for x in items if not x[1]]
        while todo:  # a letter of the term may be missing from the word
            node, _ = todo.pop()
            for n in self.child[node].values():
                if self.loose[n]:
                    items.add((n, 1))
        items = {(n, e) for n, e in items if not e or (n, 0) not in items}
        key = frozenset(items)
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            hits = [[(self.terms[t][e], t, e) for n, e in key if (t := where[n]) and (not e or may_be_misspelled(t))] for where in (self.stem, self.word)]
            self.found.append(tuple(max(h, default=None) for h in hits))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if (n := self.child[node].get(c)) is not None:
                out.add((n, e))
            if not e:
                if self.loose[node]:
                    out.add((node, 1))  # a letter too many
                out.update((n, 1) for x, n in self.child[node].items() if x != c and self.loose[n])
        to = self._state(out) if out else -1
        self.next[state][c] = to
        return to

    def hit(self, word: str) -> tuple[float, str, int] | None:
        """(weight, term, edits) of the heaviest term in a word, or None."""
        state, best = self.start, None
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return best
            stem = self.found[state][0]
            if stem and (best is None or stem > best):
                best = stem
        end = self.found[state][1]
        return end if end and (best is None or end > best) else best


@dataclass
class Model:
    """The lexicon's weights (exact, misspelled) and the logistic coefficients over `features`."""

    terms: dict[str, tuple[float, float]] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()
    coefficients: tuple[float, ...] = (-2.2, 0, 0, 0, 0, 0, 0)

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = self.coefficients[0] + features @ np.array(self.coefficients[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Reader:
    """Features of texts under a lexicon; remembers which words have no hit. Ordinary words are no misspellings."""

    def __init__(self, terms: dict[str, tuple[float, float]], ordinary: frozenset[str] = frozenset(), remembered: int = 150_000):
        self.ordinary = ordinary
        self.automaton = Automaton(terms)
        self.known: dict[str, tuple | None] = {}
        self.remembered = remembered

    def hits(self, text: str) -> tuple[list[str], dict[str, tuple]]:
        """The words and quotation marks of a text, and the hits of its distinct words."""
        words = WORDS.findall(text.lower())
        if len(self.known) > self.remembered:
            self.known.clear()
        known, found = self.known, {}
        for w in set(words):
            try:
                h = known[w]
            except KeyError:
                h = self.automaton.hit(w) if len(w) > 2 else None
                h = known[w] = None if h and h[2] and w in self.ordinary else h
            if h:
                found[w] = h
        return words, found

    def features(self, text: str) -> tuple[float, ...]:
        """Sum and largest weight of hits outside quotation, the same inside, sum of hits aimed at someone, and hits by length."""
        words, found = self.hits(text)
        if not found:
            return (0.0,) * 6
        quoted = quotations(words)
        plain, said, aimed, n = [], [], 0.0, 0
        for i, w in enumerate(words):
            if w in found:
                weight = found[w][0]
                window = words[max(0, i - WINDOW) : i + WINDOW + 1]
                n += 1
                if quoted[i] or not REPORTS.isdisjoint(window):
                    said.append(weight)
                else:
                    plain.append(weight)
                    if not ADDRESS.isdisjoint(window):
                        aimed += weight
        top = lambda xs: max([0.0, *xs])
        total = lambda xs: float(min(20.0, sum(max(x, 0.0) for x in xs)))
        return total(plain), top(plain), total(said), top(said), min(20.0, aimed), n / np.sqrt(len(words))


def quotations(words: list[str]) -> list[bool]:
    """Whether each word lies between two quotation marks of one line that are at most QUOTED words apart."""
    out, begun = [False] * len(words), None
    for i, w in enumerate(words):
        if w == "\n":
            begun = None
        elif w in QUOTES:
            if begun is not None and i - begun <= QUOTED:
                out[begun:i] = [True] * (i - begun)
                begun = None
            else:
                begun = i
    return out


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is 2 modulo 4. A null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def candidate_terms(text: str) -> set[str]:
    words = set(WORDS.findall(text.lower()))
    return {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def counted(rows: DataFrame) -> DataFrame:
    """(term, a, b): in how many toxic and in how many other rows (text, _toxic) each candidate term occurs; summed inside tasks first."""

    def run(batches):
        seen: dict[str, list[int]] = {}

        def table():
            return pd.DataFrame([(t, *n) for t, n in seen.items()], columns=["term", "a", "b"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["_toxic"], strict=True):
                for term in candidate_terms(text):
                    seen.setdefault(term, [0, 0])[0 if toxic else 1] += 1
            if len(seen) > 200_000:
                yield table()
                seen.clear()
        if seen:
            yield table()

    return rows.select("text", "_toxic").mapInPandas(run, "term string, a bigint, b bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def log_ratio(toxic: float, other: float, n_toxic: int, n_other: int) -> float:
    return float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1)))


def chosen_terms(counts: dict[str, tuple[int, int]], n_toxic: int, n_other: int) -> dict[str, float]:
    """Terms by weight: the shortest stems first; longer ones only if they separate clearly better than the stem in front of them.

    A stem that is too short to be misspelled is joined by the whole words it stands for, which can be.
    """
    weight = {t: log_ratio(a, b, n_toxic, n_other) for t, (a, b) in counts.items()}
    good = sorted((t for t, w in weight.items() if w >= LEAST_RATIO), key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t))
    out: dict[str, float] = {}
    for t in good:
        letters = t.rstrip("*")
        before = [out[s] for n in STEMS if n <= len(letters) and (s := letters[:n] + "*") in out]
        beside = not t.endswith("*") and len(t) >= FUZZY and not any(len(s) > FUZZY_STEM and t.startswith(s[:-1]) for s in out if s.endswith("*"))
        if not before or weight[t] > max(before) + 1 or beside:
            out[t] = weight[t]
    return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic coefficients, intercept first, by Newton steps with a ridge on all but the intercept."""
    x = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from about `sample` labelled rows that aren't held out; without toxic or other rows, one that knows nothing.

    Null labels and null ids aren't learned from; of several labels of one id the largest counts. The sample is written
    once. What comes to the driver (the lexicon, the misspellings met, a few numbers a row) is bounded by the sample.
    """
    spark = docs.sparkSession
    told = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("_toxic"))
    share = min(1.0, sample / max(1, told.count()))
    told = told.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = written(docs.select(key, text_or_empty(text).alias("text")).join(F.broadcast(told), key).select("text", "_toxic"), "labelled")
    n = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    n_toxic, n_other = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_other:
        deleted(rows)
        return Model()
    ratio = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_other + 1))
    separating = counted(rows).where((F.col("a") >= LEAST_ROWS) & (ratio >= LEAST_RATIO - 1e-9)).collect()
    exact = chosen_terms({r["term"]: (r["a"], r["b"]) for r in separating}, n_toxic, n_other)
    draft = spark.sparkContext.broadcast({t: (w, 0.0) for t, w in exact.items()})

    def misspelled(batches):
        reader, seen = Reader(draft.value), Counter()
        for batch in batches:
            for t, y in zip(batch["text"], batch["_toxic"], strict=True):
                seen.update({(h[1], w, int(y)) for w, h in reader.hits(t)[1].items() if h[2]})
        if seen:
            yield pd.DataFrame([(t, w, y, c) for (t, w, y), c in seen.items()], columns=["term", "word", "_toxic", "n"])

    met_words = rows.mapInPandas(misspelled, "term string, word string, _toxic int, n bigint").groupBy("term", "word", "_toxic").agg(F.sum("n").alias("n")).collect()
    by_word: dict[tuple[str, str], list[int]] = {}
    for r in met_words:
        by_word.setdefault((r["term"], r["word"]), [0, 0])[r["_toxic"]] += r["n"]
    ordinary = frozenset(w for (t, w), (other, bad) in by_word.items() if len(t.rstrip("*")) < SHORT and other and log_ratio(bad, other, n_toxic, n_other) < LEAST_RATIO)
    loose: Counter[tuple[str, int]] = Counter()
    for (t, w), (other, bad) in by_word.items():
        if w not in ordinary:
            loose.update({(t, 0): other, (t, 1): bad})
    terms = {}
    for t, w in exact.items():
        met = loose.get((t, 1), 0) + loose.get((t, 0), 0)
        own = log_ratio(loose.get((t, 1), 0), loose.get((t, 0), 0), n_toxic, n_other) if met else w / 2
        terms[t] = (w, max(0.0, min(own, w)))
    final = spark.sparkContext.broadcast((terms, ordinary))

    def read(batches):
        reader = Reader(*final.value)
        for batch in batches:
            yield pd.DataFrame({"x": [list(map(float, reader.features(t))) for t in batch["text"]], "y": batch["_toxic"]})

    got = rows.mapInPandas(read, "x array<double>, y int").collect()
    deleted(rows)
    w = fitted(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))
    return Model(terms, ordinary, tuple(map(float, w)))


def scores(text: Column, model: Model, session) -> Column:
    """The score of each text, from 0 to 1; null counts as empty."""
    told = session.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(told.value.terms, told.value.ordinary)
        for batch in batches:
            yield pd.Series(told.value.scores(np.array([reader.features(t) for t in batch], float).reshape(-1, 6)))

    return of(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts score as a text without hits, repeated rows each get their own result, other columns play no part.
    """
    model = learned(docs, labels)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(text_or_empty(), model, docs.sparkSession).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that score below the threshold, unchanged, whatever their columns are named; null and empty texts stay."""
    model = learned(docs, labels, text=text)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), scores(text_or_empty(text), model, docs.sparkSession).alias("score"))
    return held.where(F.col("score") < THRESHOLD).select("row.*")
