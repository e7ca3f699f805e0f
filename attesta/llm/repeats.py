"""Exact substring deduplication with suffix arrays of shards.

A byte goes if it is covered by a string of LENGTH bytes that begins anywhere else too. To bring equal strings
together, each window of LENGTH bytes is named after its anchor, the least hash of its ANCHOR-byte substrings
(the leftmost of equals). Equal windows have equal anchors at equal offsets. Successive windows with one anchor are
a segment; a class is all segments with one anchor hash.

1. Tasks emit segments (anchor, digest, text, place), equal ones of a batch once with their number.
2. Segments whose anchor occurs once can't repeat and go. Of the others equal ones are summed. A segment that occurs
   twice repeats as a whole, so copies cost no more than counting; a class in which all do needs nothing further.
3. The other classes are dealt into shards by anchor. Over a shard's segments a suffix array is built by induced
   sorting, and permuted common prefixes tell which windows are equal.
4. A class of more than SHARD bytes (a passage in very many contexts) is dealt into several shards. Each one's suffix
   array finds what repeats inside it and sums its equal windows; the digests of the different windows are packed into
   as many buckets as the class has shards, and each bucket finds what repeats over the shards.
5. Repeated windows go back to all places of their segment, are merged per text, and are cut out of the text.

Texts are known by a digest, so equal texts are one everywhere and row ids don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import deleted, text_or_empty, told, written
from .suffixes import runs

LENGTH, ANCHOR = 400, 128
#: Bytes of text looked at together (positions fit 24 bits), and about the bytes of a shard's suffix array.
SLAB, SHARD = 1 << 20, 1 << 20
SPANS = "array<struct<start:int,end:int>>"
#: A window of a class that is several shards: its digest, 1 or 2 (more than once), and a place.
WINDOW = np.dtype([("digest", "<u8", 2), ("seg", "<i8"), ("start", "<i4"), ("n", "<i4")])
#: The digest of a text, in two parts.
KEY = ("key", "key2")


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each `width` successive ones, by running minima of blocks from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(text, start, number of windows, anchor hash, bytes) of each segment."""
    parts: list[tuple[int, int, bytes]] = []
    for t, text in enumerate(texts):
        # A text too long for a slab is read in parts that share all but one byte of a window.
        for at in range(0, max(1, len(text) - length + 1), SLAB - length):
            if len(text) - at >= length:
                parts.append((t, at, text[at : at + SLAB - 1]))
    for low, high in words.pieces([p for _, _, p in parts], SLAB):
        mine = [p for _, _, p in parts[low:high]]
        data, begin = words.joined(mine, 0)
        up, down = words.powers(len(data))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
        n = len(data) - anchor + 1
        if n < length - anchor + 1:
            continue
        h = words.mixed((sums[anchor:] - sums[:-anchor]) * down[:n])
        ranked = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
        least = sliding_least(ranked, length - anchor + 1)
        of = np.repeat(np.arange(len(mine)), np.diff(begin))[: len(least)]
        valid = np.arange(len(least)) + length <= begin[of + 1] - 1
        starts = np.flatnonzero(valid)
        if not len(starts):
            continue
        name = least[starts]
        fresh = np.concatenate(([True], (name[1:] != name[:-1]) | (of[starts][1:] != of[starts][:-1])))
        first = starts[fresh]
        size = np.diff(np.append(np.flatnonzero(fresh), len(starts)))
        hashes = h[(name[fresh] & np.uint64((1 << 24) - 1)).astype(np.int64)].view(np.int64)
        where = first - begin[of[first]]
        for p, at, k, a in zip(of[first].tolist(), where.tolist(), size.tolist(), hashes.tolist(), strict=True):
            t, offset, text = parts[low + p]
            yield t, offset + at, k, a, text[at : at + k + length - 1]


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, overlapping or adjoining ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def as_rows(spans) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2")]


def digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def emitted(docs: DataFrame, length: int) -> DataFrame:
    """Rows of `docs` (key, key2, text) as segments (anchor, seg, key, key2, start, size in bytes, n) and, with anchor null, spans that repeat inside a batch."""

    def run(batches):
        for batch in batches:
            number: dict[tuple[int, int], list] = {}
            for k, l, t in zip(batch["key"].tolist(), batch["key2"].tolist(), batch["text"], strict=True):
                number.setdefault((k, l), [t.encode(), 0])[1] += 1
            own, texts, times = list(number), [t for t, _ in number.values()], [c for _, c in number.values()]
            seen: dict[tuple[int, int], list] = {}
            known: dict[int, list] = {}
            for t, start, size, anchor, data in segments(texts, length):
                here = (t, start, size + length - 1)
                held = seen.get(name := (anchor, digest(data)))
                if held is None:
                    seen[name] = [here, times[t]]
                else:
                    held[1] += times[t]
                    known.setdefault(t, []).append((start, start + here[2]))
                    known.setdefault(held[0][0], []).append((held[0][1], held[0][1] + held[0][2]))
            rows = [(a, d, *own[t], start, size, n, None) for (a, d), ((t, start, size), n) in seen.items()]
            rows += [(None, None, *own[t], None, None, None, as_rows(merged(spans))) for t, spans in known.items()]
            if rows:
                frame = pd.DataFrame(rows, columns=["anchor", "seg", "key", "key2", "start", "size", "n", "spans"])
                yield frame.astype({"anchor": "Int64", "seg": "Int64", "start": "Int32", "size": "Int32", "n": "Int64"})

    return docs.mapInPandas(run, f"anchor bigint, seg bigint, key bigint, key2 bigint, start int, size int, n bigint, spans {SPANS}")


def sharded(rows: DataFrame, length: int) -> DataFrame:
    """The repeated windows of segments (anchor, shards, seg, n, data) that occur once, by suffix arrays.

    Rows (anchor, seg, spans) are those that repeat inside a shard. Where a class is several shards, rows (anchor,
    bucket, windows) hold what the others have to know: of each different window its digest, how often it occurs (2:
    more than once), and, if it occurs once here, its place. They are packed by the digest's bucket.
    """

    def solve(held: list[tuple[int, int, int, int, bytes]]):
        data = b"".join(h[4] for h in held)
        size = np.array([len(h[4]) for h in held])
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(held)), size)
        place = np.arange(len(data)) - begin[of]
        valid = place + length <= size[of]
        times = np.array([h[3] for h in held])
        run, total = runs(data, valid, times[of], length)
        again = valid & (total[run] >= 2)
        out = []
        for (anchor, _, seg, n, _), b, k in zip(held, begin.tolist(), size.tolist(), strict=True):
            if n == 1 and len(at := np.flatnonzero(again[b : b + k])):
                out.append((anchor, None, seg, as_rows(merged((int(x), int(x) + length) for x in at)), None))
        split = np.flatnonzero(valid & np.array([h[1] > 1 for h in held])[of])
        split = split[np.unique(run[split], return_index=True)[1]]  # one place of each different window
        told = np.zeros(len(split), WINDOW)
        for i, p in enumerate(split.tolist()):
            told["digest"][i] = np.frombuffer(blake2b(data[p : p + length], digest_size=16).digest(), "<u8")
        told["n"], told["start"] = np.minimum(total[run[split]], 2), place[split]
        told["seg"] = np.array([h[2] for h in held])[of[split]]
        shards = np.array([h[1] for h in held])[of[split]]
        anchor = np.array([h[0] for h in held])[of[split]]
        bucket = (told["digest"][:, 0] % shards.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((bucket, anchor))
        for group in np.split(order, np.flatnonzero(np.diff(anchor[order]) | np.diff(bucket[order])) + 1) if len(order) else ():
            out.append((int(anchor[group[0]]), int(bucket[group[0]]), None, None, told[group].tobytes()))
        return pd.DataFrame(out, columns=["anchor", "bucket", "seg", "spans", "windows"]).astype({"seg": "Int64", "bucket": "Int64"})

    def solved(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for anchor, salt, shards, seg, n, data in zip(*(batch[c] for c in ("anchor", "salt", "shards", "seg", "n", "data")), strict=True):
                if size >= SHARD and (anchor, salt) != last:
                    if len(found := solve(held)):
                        yield found
                    held, size = [], 0
                held.append((anchor, shards, seg, int(n), data))
                size, last = size + len(data), (anchor, salt)
        if held and len(found := solve(held)):
            yield found

    salted = rows.select("anchor", F.pmod("seg", "shards").alias("salt"), "shards", "seg", "n", "data")
    dealt = salted.repartition(F.col("anchor"), F.col("salt")).sortWithinPartitions("anchor", "salt")
    return dealt.mapInPandas(solved, f"anchor bigint, bucket bigint, seg bigint, spans {SPANS}, windows binary")


def across(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, seg, spans): of rows (anchor, bucket, windows) the places of windows that repeat over the shards of their class."""

    def run(batches):
        held, last = [], None

        def solve():
            told = np.frombuffer(b"".join(held), WINDOW)
            order = np.lexsort((told["digest"][:, 1], told["digest"][:, 0]))
            told = told[order]
            number = np.cumsum(np.concatenate(([0], (np.diff(told["digest"], axis=0) != 0).any(axis=1)))) if len(told) else np.zeros(0, int)
            found = told[(np.bincount(number, told["n"])[number] >= 2) & (told["n"] == 1)]
            found = found[np.lexsort((found["start"], found["seg"]))]
            groups = np.split(found, np.flatnonzero(np.diff(found["seg"])) + 1) if len(found) else ()
            return pd.DataFrame([(last[0], int(g["seg"][0]), as_rows(merged((x, x + length) for x in g["start"].tolist()))) for g in groups], columns=["anchor", "seg", "spans"])

        for batch in batches:
            for anchor, bucket, windows in zip(batch["anchor"], batch["bucket"], batch["windows"], strict=True):
                if held and (anchor, bucket) != last:
                    yield solve()
                    held = []
                held.append(windows)
                last = anchor, bucket
        if held:
            yield solve()

    dealt = rows.repartition("anchor", "bucket").sortWithinPartitions("anchor", "bucket")
    return dealt.mapInPandas(run, f"anchor bigint, seg bigint, spans {SPANS}")


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, key2, spans): for each text that has any, by the digest of the text, spans of bytes (not merged) that repeat."""
    t = text_or_empty(text)
    slim = docs.select(*keys(t), t.alias("text")).where(F.octet_length("text") >= length)
    raw = written(emitted(slim, length), "segments")
    places = raw.where("anchor is not null").drop("spans")
    shared = places.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    live = written(places.join(shared, "anchor", "left_semi"), "live")
    known = written(raw.where("anchor is null").select(*KEY, "spans"), "known")
    deleted(raw)

    one = [F.first(c).alias(c) for c in (*KEY, "start", "size")]  # of any one place: equal segments have equal bytes
    each = written(live.groupBy("anchor", "seg").agg(F.sum("n").alias("n"), *one), "distinct")
    classes = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.sum("size").alias("bytes"))
    classes = classes.where("m > 1 and least = 1").select("anchor", F.ceil(F.col("bytes") / SHARD).alias("shards"))
    part = F.struct("anchor", "shards", "seg", "n", "start", F.col("size").alias("bytes"))
    wanted = written(each.join(classes, "anchor").groupBy(*KEY).agg(F.collect_list(part).alias("wanted")), "wanted")
    firsts = slim.join(told(wanted.select(*KEY)), [*KEY], "left_semi").groupBy(*KEY).agg(F.first("text").alias("text"))
    cut = F.transform("wanted", lambda w: F.struct(w["anchor"].alias("anchor"), w["shards"].alias("shards"), w["seg"].alias("seg"), w["n"].alias("n"), F.substring(F.encode("text", "UTF-8"), w["start"] + 1, w["bytes"]).alias("data")))
    solved = written(sharded(firsts.join(wanted, [*KEY]).select(F.explode(cut).alias("w")).select("w.*"), length), "solved")
    deleted(wanted)

    whole = each.where("n > 1").select("anchor", "seg", F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end"))).alias("spans"))
    some = solved.where("windows is null").select("anchor", "seg", "spans").unionByName(across(solved.where("windows is not null").select("anchor", "bucket", "windows"), length)).unionByName(whole)
    placed = live.join(some, ["anchor", "seg"]).select(*KEY, "start", F.explode("spans").alias("s"))
    placed = placed.select(*KEY, (F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"))
    every = placed.unionByName(known.select(*KEY, F.explode("spans").alias("s")).select(*KEY, "s.start", "s.end"))
    spans = written(every.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    for done in (live, known, each, solved):
        deleted(done)
    return spans


RESULT = "kept binary, n_removed bigint, n_spans bigint"


def cut_out(text: Column, spans: Column) -> Column:
    """Struct of the remaining bytes, the number of removed bytes and of maximal removed runs."""

    @F.pandas_udf(RESULT)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for t, s in zip(texts, found, strict=True):
                data, runs, at, kept = t.encode(), [], 0, []
                if s is not None:
                    runs = merged((int(x["start"]), int(x["end"])) for x in s)
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                out.append((b"".join(kept), sum(b - a for a, b in runs), len(runs)))
            yield pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    return of(text, spans)


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Null and empty texts and texts shorter than `length` bytes lose nothing, and aren't shuffled. Repeated rows repeat
    each other. Other columns of `docs` play no part.
    """
    spans = repeated_spans(docs.select("text"), "text", length)
    t = text_or_empty()
    slim = docs.select("doc_id", t.alias("text"))
    long = slim.where(F.octet_length("text") >= length).select("doc_id", "text", *keys(F.col("text")))
    cut = long.join(spans, [*KEY], "left").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), cut_out(F.col("text"), F.col("spans")).alias("c"))
    cut = cut.select("doc_id", "n_bytes", "c.n_removed", "c.n_spans", F.sha2("c.kept", 256).alias("kept_sha256"))
    none = F.lit(0).cast("bigint")
    short = slim.where(F.octet_length("text") < length)
    return cut.unionByName(short.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")))
