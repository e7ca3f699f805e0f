"""Benchmark decontamination with an FM-index per training shard.

The benchmark gives windows of 13 consecutive words (all words of a shorter item). A shard is a run of documents
inside a task. Its words become symbols: a word of the benchmark is its rank in the benchmark's vocabulary, any
other word and any end of a text is a separator. Runs of benchmark words shorter than the shortest window can't
hold one and aren't indexed. Over the rest the shard's suffix array, its Burrows-Wheeler transform in a wavelet
matrix, and sampled suffix positions are built. All windows are searched backwards at once, one word at a time,
by ranks in the wavelet matrix; occurrences are located by walking back to a sampled position; and the words
they cover are merged into spans of each document.

The benchmark's vocabulary and windows are broadcast in blocks of about WINDOWS windows, one after the other. Each
further block is a pass over the documents of its own, which writes the hits of the texts that have any under the
text's digest; they are merged by digest. So memory doesn't grow with the benchmark, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import deleted, text_or_empty, written

WIDTH = 13
#: Windows searched in one pass.
WINDOWS = 200_000
#: Every so many suffix positions one is kept for locating.
SAMPLE = 8
#: Bytes of text in a shard.
SHARD = 1 << 20

_word_byte = np.zeros(256, bool)
_word_byte[ord("0") : ord("9") + 1] = _word_byte[ord("a") : ord("z") + 1] = _word_byte[128:] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: each word's hash, text number, first byte in its text, and the past-the-last byte."""
    data, begin = words.joined(texts, 0)
    data = _lower[data]
    first, last = words.spans(_word_byte[data])
    of = np.searchsorted(begin, first, side="right") - 1
    return words.hashes(data, first, last), of, first - begin[of], last - begin[of]


@dataclass
class Windows:
    """A block of the benchmark: its vocabulary (sorted hashes), windows as rows of symbols padded left with 0, lengths, and items."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    length: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, rows: list[tuple[tuple[int, ...], list[str]]]) -> Windows:
        flat = np.array(sorted({h for w, _ in rows for h in w}), np.uint64)
        table = np.zeros((len(rows), max((len(w) for w, _ in rows), default=1)), np.int32)
        for row, (w, _) in zip(table, rows, strict=True):
            row[len(row) - len(w) :] = np.searchsorted(flat, np.array(w, np.uint64)) + 1
        return cls(flat, table, np.array([len(w) for w, _ in rows], np.int64), [i for _, i in rows])


def windows(items: Iterable[tuple[str, str]], width: int = WIDTH) -> list[tuple[tuple[int, ...], list[str]]]:
    """Distinct windows, as word hashes, with the ids of the items that hold them. Items without words have none."""
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        h = tuple(hashed_words([text.encode()])[0].tolist())
        for i in range(max(1, len(h) - width + 1) if h else 0):
            found.setdefault(h[i : i + width], set()).add(item)
    return [(w, sorted(ids)) for w, ids in sorted(found.items())]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by doubling the compared length until all differ."""
    n = len(s)
    rank, k = s.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank, k = new, 2 * k
        if k >= n or rank[order[-1]] == n - 1:
            return order


class Wavelet:
    """A wavelet matrix: ranks of symbols in a sequence, for many queries at once."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.levels = []
        for level in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = (s >> level & 1).astype(bool)
            zeros = np.concatenate(([0], np.cumsum(~bit)))
            self.levels.append((level, zeros, int(zeros[-1])))
            s = np.concatenate((s[~bit], s[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at
        for level, zeros, total in self.levels:
            one = (symbol >> level & 1).astype(bool)
            low = np.where(one, total + low - zeros[low], zeros[low])
            high = np.where(one, total + high - zeros[high], zeros[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these positions."""
        out = np.zeros_like(at)
        for level, zeros, total in self.levels:
            zero = zeros[at + 1] > zeros[at]
            out |= np.where(zero, 0, 1 << level)
            at = np.where(zero, zeros[at], total + at - zeros[at])
        return out


class FMIndex:
    """Backward search and locating over a sequence of symbols (1 and above; 0 separates)."""

    def __init__(self, s: np.ndarray, symbols: int):
        s = np.concatenate((s + 1, [0])).astype(np.int64)  # one least symbol ends the sequence
        symbols += 1
        order = suffix_array(s)
        last = s[order - 1]
        self.n = len(s)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
        self.wavelet = Wavelet(last, symbols)
        self.sampled = order % SAMPLE == 0
        self.number = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern (rows, padded left with 0)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in patterns.T[::-1].astype(np.int64):
            go = (column > 0) & (low < high)
            c = column[go] + 1
            low[go], high[go] = self.before[c] + self.wavelet.rank(c, low[go]), self.before[c] + self.wavelet.rank(c, high[go])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The positions of suffixes by their place in the order."""
        out, steps = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        at = at.astype(np.int64)
        while len(todo):
            known = self.sampled[at[todo]]
            done = todo[known]
            out[done] = self.position[self.number[at[done]]] + steps[done]
            todo = todo[~known]
            c = self.wavelet.access(at[todo])
            at[todo] = self.before[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
        return out


def occurrences(symbol: np.ndarray, block: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of each occurrence of the block's windows in a sequence of symbols, 0 separating."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(block.length):
        return none
    padded = np.concatenate(([False], symbol > 0, [False]))
    edge = np.flatnonzero(np.diff(padded.view(np.int8)))
    first, last = edge[0::2], edge[1::2]
    long = last - first >= block.length.min()
    first, last = first[long], last[long]
    if not len(first):
        return none
    size = last - first + 1
    starts = np.cumsum(size) - size
    source = np.repeat(first - starts, size) + np.arange(size.sum())
    kept = np.where(source < np.repeat(last, size), symbol[np.minimum(source, len(symbol) - 1)], 0)
    index = FMIndex(kept, len(block.vocabulary) + 1)
    low, high = index.search(block.symbols)
    hits = high - low
    which = np.repeat(np.arange(len(hits)), hits)
    at = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
    return source[index.locate(at)], which


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping or adjoining ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(texts: list[bytes], block: Windows) -> Iterator[tuple[int, list[tuple[int, int, int, int]], set[str]]]:
    """For each text: its number of words, the hit spans (first word, past the last, first byte, past the last), and the items."""
    for low, high in words.pieces(texts, SHARD):
        h, of, first, last = hashed_words(texts[low:high])
        count = np.bincount(of, minlength=high - low)
        symbol = np.zeros(len(h), np.int64)
        if len(block.vocabulary) and len(h):
            at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
            symbol = np.where(block.vocabulary[at] == h, at + 1, 0)
        begins = np.cumsum(count) - count
        # A separator in front of each text but the first keeps windows inside texts.
        place = np.arange(len(h)) + of
        spread = np.zeros(len(h) + high - low, np.int64)
        spread[place] = symbol
        origin = np.zeros(len(spread), np.int64)
        origin[place] = np.arange(len(h))
        at, which = occurrences(spread, block)
        at = origin[at]
        hits: dict[int, tuple[list, set]] = {}
        for w, n, k in zip(at.tolist(), block.length[which].tolist(), which.tolist(), strict=True):
            spans, items = hits.setdefault(int(of[w]), ([], set()))
            spans.append((w, w + n))
            items.update(block.items[k])
        for i in range(high - low):
            spans, items = hits.get(i, ([], set()))
            b = int(begins[i])
            yield int(count[i]), [(x - b, y - b, int(first[x]), int(last[y - 1])) for x, y in merged(spans)], items


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH, most: int = WINDOWS) -> Iterator[Windows]:
    """The benchmark's windows in blocks of about `most`; null texts have none, null ids count as the empty string."""
    kind = "window array<bigint>, items array<string>"

    def run(batches):
        for batch in batches:
            found = windows(zip(batch["item"], batch["text"], strict=True), width)
            if found:
                yield pd.DataFrame({"window": [np.array(w, np.uint64).view(np.int64) for w, _ in found], "items": [i for _, i in found]})

    slim = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), text_or_empty(text).alias("text"))
    each = slim.mapInPandas(run, kind).groupBy("window").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    each = written(each, "windows")
    n = max(1, -(-each.count() // most))
    for b in range(n):
        rows = each.where(F.pmod(F.xxhash64("window"), F.lit(n)) == b).collect()  # about `most` rows
        yield Windows.of(sorted((tuple(x % (1 << 64) for x in r["window"]), list(r["items"])) for r in rows))
    deleted(each)


HIT = "struct<first:bigint,last:bigint,begin:bigint,end:bigint>"
FOUND = f"struct<n_words:bigint,hits:array<{HIT}>,items:array<string>>"


def searched(text: Column, told: Broadcast) -> Column:
    """Struct of n_words, hits (merged spans by words and by bytes) and items (sorted ids) of each text, for one block of windows."""

    @F.pandas_udf(FOUND)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = list(scan([t.encode() for t in texts], told.value))
            named = [[dict(zip(("first", "last", "begin", "end"), s, strict=True)) for s in spans] for _, spans, _ in got]
            yield pd.DataFrame({"n_words": [n for n, _, _ in got], "hits": named, "items": [sorted(i) for _, _, i in got]})

    return of(text)


def united(hits: Column) -> Column:
    """Hit spans of several blocks, sorted by their words, those that overlap or adjoin as one."""

    @F.pandas_udf(f"array<{HIT}>")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([union([tuple(x[f] for f in ("first", "last", "begin", "end")) for x in spans]) for spans in batch], dtype=object)

    return of(hits)


def union(spans: list[tuple[int, int, int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], s[1]), max(out[-1][3], s[3])
        else:
            out.append(list(s))
    return [dict(zip(("first", "last", "begin", "end"), s, strict=True)) for s in out]


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str, found: str = "_found", width: int = WIDTH) -> DataFrame:
    """`docs` with a struct `found` of n_words, hits and items for its text (null: empty). No shuffle while the benchmark fits one block."""
    spark, t = docs.sparkSession, text_or_empty(text)
    digest = F.md5(F.encode(t, "UTF-8"))
    out, more = docs, []
    for number, block in enumerate(blocks(benchmark, width=width)):
        told = spark.sparkContext.broadcast(block)
        if not number:
            out = docs.withColumn(found, searched(t, told))
            continue
        part = docs.select(digest.alias("_text"), searched(t, told).alias("_part")).where(F.size("_part.hits") > 0).dropDuplicates(["_text"])
        more.append(written(part, "hits"))
        told.destroy()
    if more:
        total = reduce(DataFrame.unionByName, more).groupBy("_text").agg(F.flatten(F.collect_list("_part.hits")).alias("_hits"), F.flatten(F.collect_list("_part.items")).alias("_items"))
        none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
        out = out.withColumn("_text", digest).join(total, "_text", "left")
        hits = united(F.concat(f"{found}.hits", none("_hits", f"array<{HIT}>")))
        items = F.array_sort(F.array_distinct(F.concat(f"{found}.items", none("_items", "array<string>"))))
        out = out.withColumn(found, F.struct(F.col(f"{found}.n_words").alias("n_words"), hits.alias("hits"), items.alias("items"))).drop("_text", "_hits", "_items")
    return out


def n_hit(found: str) -> Column:
    """The number of words that are hit."""
    return F.aggregate(f"{found}.hits", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hit spans (bytes) of every row.

    A null or empty text has no words and isn't contaminated; repeated rows each get their own result; an empty
    benchmark gives no hits.
    """
    found = with_hits(docs.select("doc_id", "text"), benchmark, "text").drop("text").withColumn("n_hit", n_hit("_found")).select("doc_id", "n_hit", "_found.*")
    spans = F.array_join(F.transform("hits", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), spans.alias("hit_bytes"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that aren't contaminated, unchanged, whatever their columns are named; null and empty texts stay."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    mark = with_hits(held, benchmark, "text")
    return mark.where(~((n_hit("_found") > 0) & (20 * n_hit("_found") >= F.col("_found.n_words")))).select("row.*")
