"""Phrase collocation mining by suffix-sigma.

Each word starts a suffix of at most `most` words of its piece. Suffixes are counted where they are read, shuffled by
group (language) and first word, sorted in reverse lexicographic order, and one stack of open prefixes counts every
prefix of every suffix in a single pass; the parts of a phrase are joined afterwards.

A first word that starts more than its share of all words (`shares`) is dealt over several parts by the whole suffix,
in proportion; its prefixes are then counted by part and summed. Everything else is counted in one place and dropped
there if it is rarer than `least`. Between words stands NUL, which sorts before all other bytes; a NUL inside a word
is a tab meanwhile, which no word holds.

Null texts are empty, a null group is `und`, repeated rows count again, empty tables give no phrases. Texts are read
whole, in batches; sums are 64-bit and products decimals, so counts are exact. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .words import hashes

#: Letters in lower case, piece ends as line feeds, tabs as spaces, NUL as the tab that no word can hold.
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t\x00", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n \t")
GAP = "\0"
#: Bytes of text that are counted together before anything leaves a task, rows that the stack takes at once, rows of a batch on the way out.
TOGETHER, ROWS, OUT = 6 << 20, 50_000, 4_000


@dataclass
class Words:
    """The words of some texts: their ranks (from 1) in the sorted vocabulary, their groups' ranks, and their pieces."""

    vocabulary: pa.Array
    groups: pa.Array
    rank: np.ndarray
    group: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], groups: list[str]) -> Words:
        data = np.frombuffer(b"\n".join(texts).translate(FOLDED) + b"\n", np.uint8)
        apart = (data == 10) | (data == 32)
        change = np.flatnonzero(np.diff(~apart, prepend=False))
        cuts = np.append(change, len(data)).astype(np.int32)
        n = len(change) // 2
        each = pa.Array.from_buffers(pa.string(), len(change), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())]).take(pa.array(np.arange(n) * 2))
        coded = each.dictionary_encode()
        known, of_text = np.unique(np.array(groups, dtype=object), return_inverse=True) if groups else (np.array([], object), np.array([], np.int64))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes)
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        starts = change[0::2]
        return cls(coded.dictionary.take(pa.array(order)), pa.array(list(known), pa.string()), rank[coded.indices.to_numpy()], of_text[np.searchsorted(ends, starts, "right")].astype(np.int32), np.cumsum(data == 10, dtype=np.int32)[starts])

    def counted(self) -> pa.Table:
        """group, word, n."""
        key, n = np.unique(self.group.astype(np.int64) * (len(self.vocabulary) + 1) + self.rank, return_counts=True)
        return pa.table({"grp": self.groups.take(pa.array(key // (len(self.vocabulary) + 1))), "word": self.vocabulary.take(pa.array(key % (len(self.vocabulary) + 1) - 1)), "n": n})

    def suffixes(self, most: int, hot: pa.Table) -> pa.Table:
        """group, first word, parts, part, rests: the different suffixes behind each first word, one a line, with their number if it isn't 1.

        Lines are in order, so that neighbours compress well. A word of `hot` has its lines in as many parts as it says there.
        """
        base, parts, size = len(self.vocabulary) + 1, [self.rank], len(self.rank)
        for k in range(1, most):
            here = np.zeros(size, np.int32)
            if k < size:
                here[:-k] = np.where(self.piece[k:] == self.piece[:-k], self.rank[k:], 0)
            parts.append(here)
        keys, now = [], self.group.astype(np.int64)
        for p in parts:  # as many words to a key as 63 bits hold
            if (int(now.max(initial=0)) + 1) * base >= 1 << 63:
                keys.append(now)
                now = np.zeros(size, np.int64)
            now = now * base + p
        keys.append(now)
        order = np.lexsort(keys[::-1])
        fresh = np.ones(size, bool)
        fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
        del keys, now
        at = np.flatnonzero(fresh)
        first, n = order[at], np.diff(np.append(at, size))
        words = [self.vocabulary.take(pa.array(p[first] - 1, mask=p[first] == 0)) for p in parts[1:]]
        rests = pc.binary_join_element_wise(pc.fill_null(words[0], ""), *words[1:], GAP, null_handling="skip") if words else pa.array([""] * len(first))
        code = self.group[first].astype(np.int64) * base + self.rank[first]
        into, part = self._parts(hot, base, code), np.zeros(len(first), np.int64)
        if (many := np.flatnonzero(into > 1)).size:
            some = rests.take(pa.array(many))
            ends = np.frombuffer(some.buffers()[1], np.int32)[: len(many) + 1].astype(np.int64)
            data = np.frombuffer(some.buffers()[2] or b"", np.uint8) if some.buffers()[2] else np.zeros(0, np.uint8)
            part[many] = (hashes(np.append(data, np.uint8(0)), ends[:-1], ends[1:]) % into[many].astype(np.uint64)).astype(np.int64)
        lines = pc.if_else(pa.array(n > 1), pc.binary_join_element_wise(rests, pa.array(n).cast(pa.string()), "\r"), rests)
        order = np.lexsort((part, code))
        code, part, into, first = code[order], part[order], into[order], first[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (part[1:] != part[:-1])
        heads = np.flatnonzero(fresh)
        rows = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype(np.int32)), lines.take(pa.array(order)))
        of = first[heads]
        return pa.table({"grp": self.groups.take(pa.array(self.group[of])), "first": self.vocabulary.take(pa.array(self.rank[of] - 1)), "parts": into[heads].astype(np.int32), "part": part[heads].astype(np.int32), "rests": pc.binary_join(rows, "\n")})

    def _parts(self, hot: pa.Table, base: int, code: np.ndarray) -> np.ndarray:
        """The number of parts of each (group, first word); 1 where it isn't hot."""
        g, w = pc.index_in(hot["grp"], self.groups), pc.index_in(hot["first"], self.vocabulary)
        here = pc.and_(pc.is_valid(g), pc.is_valid(w)).to_numpy(zero_copy_only=False)
        if not here.any():
            return np.ones(len(code), np.int64)
        known = pc.fill_null(g, 0).to_numpy()[here].astype(np.int64) * base + pc.fill_null(w, 0).to_numpy()[here] + 1
        sort = np.argsort(known)
        known, into = known[sort], hot["parts"].to_numpy()[here][sort]
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return np.where(known[at] == code, into[at], 1)


def _told(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(OUT)
    pa.default_memory_pool().release_unused()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    texts, groups, size = [], [], 0
    for batch in batches:
        for text, group in zip(batch["text"].to_pylist(), batch["grp"].to_pylist(), strict=True):
            texts.append(text.encode())
            groups.append(group)
            size += len(texts[-1]) + 1
            if size >= TOGETHER:
                yield Words.of(texts, groups)
                texts, groups, size = [], [], 0
    if texts:
        yield Words.of(texts, groups)


class Stack:
    """Counts all prefixes of sorted suffixes. It holds the open prefixes, one of each length; a prefix is told once it can't go on.

    A suffix stands behind its group, so the open prefixes begin with the group itself, which isn't told.
    """

    def __init__(self, most: int, least: int):
        self.most, self.least = most, least
        self.open: list[tuple[list[str], int, bool]] = []  # group and words, count, whether it is counted in parts

    def _closed(self, depth: int) -> pa.Table:
        """Pops the prefixes longer than `depth`; those that can still matter are returned."""
        gone, self.open = self.open[depth:], self.open[:depth]
        rows = [(key[0], GAP.join(key[1:]), len(key) - 1, n) for key, n, divided in gone if len(key) > 1 and (n >= self.least or divided and len(key) <= self.most)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], ["grp", "phrase", "words", "n"])

    def feed(self, table: pa.Table) -> pa.Table:
        """group, phrase, words, n of the prefixes that end in these rows (key, n, parts)."""
        rows, n, divided = table.num_rows, table["n"].to_numpy(), table["parts"].to_numpy() > 1
        cut = pc.split_pattern(table["key"].combine_chunks(), GAP)
        offsets, sizes = cut.offsets.to_numpy(), np.diff(cut.offsets.to_numpy())
        words = [cut.values.take(pa.array(offsets[:-1] + k, mask=sizes <= k)) for k in range(self.most + 1)]
        key = [words[k][0].as_py() for k in range(int(sizes[0]))]
        depth = 0  # what stays open of the rows before
        while depth < min(len(self.open), len(key)) and self.open[depth][0][depth] == key[depth]:
            depth += 1
        found, still, same = [self._closed(depth)], [], np.ones(rows - 1, bool)
        for k, word in enumerate(words):
            same = same & pc.fill_null(pc.equal(word[1:], word[:-1]), False).to_numpy(zero_copy_only=False)
            have = np.flatnonzero(sizes > k)
            if not len(have):
                break
            starts = np.flatnonzero(~np.concatenate(([False], same))[have])
            counts, heads = np.add.reduceat(n[have], starts), have[starts]
            if k < depth and heads[0] == 0:
                counts[0] += self.open[k][1]
            keep = (counts >= self.least) | (divided[heads] & (k < self.most))
            if sizes[-1] > k:  # the last one may go on
                i = int(heads[-1])
                still.append(([w[i].as_py() for w in words[: k + 1]], int(counts[-1]), bool(divided[i])))
                keep[-1] = False
            if k:
                at = pa.array(heads[keep])
                each = [w.take(at) for w in words[1 : k + 1]]
                found.append(pa.table({"grp": words[0].take(at), "phrase": pc.binary_join_element_wise(*each, GAP) if k > 1 else each[0], "words": np.full(len(at), k, np.int32), "n": counts[keep]}))
        self.open = still
        return pa.concat_tables(found)

    def finish(self) -> pa.Table:
        return self._closed(0)


def frequencies(docs: DataFrame, text: str = "text", by: str = "lang", most: int = 4, least: int = 30, shares: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(grp, phrase, words, n) of all phrases of 1 to `most` words met `least` times or more, words joined by NUL; and (grp, total) of words."""
    group = F.coalesce(F.col(by).cast("string"), F.lit("und"))
    slim = docs.select(F.replace(F.replace(group, F.lit("\\"), F.lit("\\b")), F.lit(GAP), F.lit("\\0")).alias("grp"), text_or_empty(text).alias("text"))  # no NUL in groups

    def words(batches):
        for w in _together(batches):
            yield from _told(w.counted())

    firsts = written(slim.mapInArrow(words, "grp string, word string, n bigint").groupBy("grp", "word").agg(F.sum("n").alias("n")), "words")
    # At most `shares` words can have that share of all words each, so this list stays small at every size.
    shares = max(shares, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = firsts.agg(F.sum("n")).first()[0] or 0
    hot = firsts.where(F.col("n").cast("decimal(38,0)") * shares > every).select("grp", F.col("word").alias("first"), F.ceil(F.col("n") * shares / every).cast("long").alias("parts")).toArrow()

    def suffixes(batches):
        for w in _together(batches):
            yield from _told(w.suffixes(most, hot))

    def prefixes(batches):
        stack, held, rows = Stack(most, least), [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                yield from _told(stack.feed(pa.Table.from_batches(held)))
                held, rows = [], 0
        if rows:
            yield from _told(stack.feed(pa.Table.from_batches(held)))
        yield from _told(stack.finish())

    dealt = slim.mapInArrow(suffixes, "grp string, first string, parts int, part int, rests string").repartition("grp", "first", "part")
    line = dealt.select("grp", "first", "parts", F.explode(F.split("rests", "\n")).alias("line"))
    rest = F.substring_index("line", "\r", 1)
    key = F.concat("grp", F.lit(GAP), "first", F.when(rest == "", "").otherwise(F.concat(F.lit(GAP), rest)))
    n = F.when(F.contains("line", F.lit("\r")), F.substring_index("line", "\r", -1).cast("long")).otherwise(1)
    order = line.select(key.alias("key"), n.alias("n"), "parts").sortWithinPartitions(F.desc("key"))
    partial = order.mapInArrow(prefixes, "grp string, phrase string, words int, n bigint")
    found = partial.groupBy("grp", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    plain = F.replace(F.replace("grp", F.lit("\\0"), F.lit(GAP)), F.lit("\\b"), F.lit("\\"))
    return found.withColumn("grp", plain), firsts.groupBy("grp").agg(F.sum("n").alias("total")).withColumn("grp", plain)


def collocations(docs: DataFrame, text: str = "text", by: str = "lang", most: int = 4, least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """The `top` phrases of 2 to `most` words of each group: lang, rank, phrase, a, l, r, n, score.

    A phrase cut after its first words scores floor(2000000 a / (l + r)); its lowest-scoring cut counts, ties go to the
    earliest. Phrases inside a longer one that has `covered` percent of their count or more are left out. Ties of the
    score go to the larger count, then to the lesser phrase by bytes.
    """
    found, totals = frequencies(docs, text, by, most, least)
    f = written(found, "phrases")
    candidates = f.where("words >= 2")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cut = candidates.select("grp", "phrase", F.col("n").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.withColumns({"left": F.expr("substring_index(phrase, '\\0', k)"), "right": F.expr("substring_index(phrase, '\\0', k - words)")})
    part = lambda name, n: f.select("grp", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cut.join(part("left", "l"), ["grp", "left"]).join(part("right", "r"), ["grp", "right"])
    both = both.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    # All phrases of two words and more inside a longer candidate.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: F.array_join(F.slice("_each", i, size), GAP))))
    within = candidates.where("words >= 3").withColumn("_each", F.split("phrase", "\\x00")).select("grp", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("n").alias("over"))
    none = lambda kind: F.lit(None).cast(kind)
    best = F.struct("score", "k", "l", "r", "a")
    rows = both.select("grp", "phrase", best.alias("cut"), none("bigint").alias("over")).unionByName(within.select("grp", "phrase", none(both.select(best).schema[0].dataType).alias("cut"), "over"))
    each = rows.groupBy("grp", "phrase").agg(F.min("cut").alias("cut"), F.max("over").alias("over")).select("grp", "phrase", "cut.*", "over")
    kept = each.where(F.col("over").isNull() | (wide("over") * 100 < wide("a") * covered))
    kept = kept.withColumn("phrase", F.replace(F.replace("phrase", F.lit(GAP), F.lit(" ")), F.lit("\t"), F.lit("\0")))
    ranked = _ranked(_ranked(kept.withColumn("_bin", F.pmod(F.xxhash64("phrase"), F.lit(256))), top, "grp", "_bin").drop("_bin"), top, "grp")
    return ranked.join(totals, "grp").select(F.col("grp").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


def _ranked(df: DataFrame, top: int, *by: str) -> DataFrame:
    """The first `top` rows of each group; first by bins, so that no task ranks all of a language."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
