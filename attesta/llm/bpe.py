"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its incremental decoder.

A merge list has a sufficient lookahead: a number of bytes such that a token ending that far before the
end of what has been read can no longer change, whatever follows. Suppose two runs of the merges, one on a
text and one on the text with more bytes after it, agree left of a position. The agreement only moves left
when some merge (u, v) takes the token u that ends at that position, and each later move needs a later merge
whose right part starts with what the earlier merge had moved. So the moves form a chain of merges with
rising ranks, and the longest chain, in bytes of the left parts, is the lookahead. It is found in one pass
over the merges. Tokens are emitted once stable and their bytes leave the buffer, so a text of any length,
even one that is a single piece, is encoded in constant memory.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The published pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Characters at a buffer's end in which the pattern's match may still depend on what follows.
UNSETTLED = 3
#: Characters read at once, and the length from which a piece that reaches the buffer's end is streamed.
CHUNK, OPEN = 1 << 16, 1 << 12
#: Pieces remembered in each of two generations, bytes of pieces that are merged side by side, and characters of texts looked at together.
REMEMBERED, SHORT, TOGETHER = 100_000, 64, 1 << 20

RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(r"\p{White_Space}*"), "P": regex.compile(r"[^\p{White_Space}\p{L}\p{N}]*")}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = (b for b in range(256) if b not in set(own))
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(other)}


#: Tokens that stand together: their ids, the ids as decimals joined by commas, and their bytes.
Piece = tuple[tuple[int, ...], bytes, bytes]


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        alphabet = byte_alphabet()
        ids = told["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.token = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in ids.items():
            self.token[i] = s.encode() if s in self.special else bytes(alphabet[c] for c in s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.byte = [0] * 256
        for c, b in alphabet.items():
            self.byte[b] = ids[c]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in told["model"]["merges"]]
        self.left = [ids[a] for a, _ in pairs]
        self.right = [ids[b] for _, b in pairs]
        self.made = [ids[a + b] for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.name = [b"%d" % i for i in range(len(self.token))]
        self._arrays()

    def piece(self, ids: list[int]) -> Piece:
        return tuple(ids), b",".join([self.name[i] for i in ids]), b"".join([self.token[i] for i in ids])

    def _arrays(self) -> None:
        """The same as arrays: pairs in order of (left, right) with their ranks."""
        self.bytes_, self.makes = np.array(self.byte, np.int64), np.array([*self.made, 0], np.int64)
        pair = (np.array(self.left, np.int64) << 32) | np.array(self.right, np.int64)
        order = np.argsort(pair)
        self.pair, self.pair_rank = pair[order], order

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; the number of merges where there is none."""
        none = len(self.pair)
        if not none:
            return np.zeros(len(left), np.int64)
        asked = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair, asked), none - 1)
        return np.where(self.pair[at] == asked, self.pair_rank[at], none)

    def merged_together(self, pieces: list[bytes]) -> list[list[int]]:
        """The tokens of many pieces: in each round every piece makes its next merge. Only pairs beside a merge are looked up again."""
        none = len(self.pair)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        now = self.bytes_[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), size)
        rank = np.full(len(now), none, np.int64)
        inside = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inside] = self.ranks(now[inside], now[inside + 1])
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(now):
            begin = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            size = np.diff(np.append(begin, len(now)))
            least = np.minimum.reduceat(rank, begin)
            if (least == none).any():  # these pieces are ready
                done = np.repeat(least == none, size)
                ready.append((piece[done], now[done]))
                now, piece, rank = now[~done], piece[~done], rank[~done]
                size, least = size[least != none], least[least != none]
            hit = rank == np.repeat(least, size)
            if (hit[1:] & hit[:-1]).any():  # one token in a row: every second pair from the left
                place = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), place, 0))
                hit &= (place - start) % 2 == 0
            at = np.flatnonzero(hit)
            now[at] = self.makes[rank[at]]
            kept = np.ones(len(now), bool)
            kept[at + 1] = False
            at -= np.arange(len(at))
            now, piece, rank = now[kept], piece[kept], rank[kept]
            again = np.concatenate((at, at[at > 0] - 1))
            rank[again] = none
            again = again[again + 1 < len(now)]
            again = again[piece[again] == piece[again + 1]]
            rank[again] = self.ranks(now[again], now[again + 1])
        which = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in ready)])
        tokens = np.concatenate([np.zeros(0, np.int64), *(t for _, t in ready)])[np.argsort(which, kind="stable")].tolist()
        stop = np.cumsum(np.bincount(which, minlength=len(pieces))).tolist()
        return [tokens[a:b] for a, b in zip([0, *stop], stop)]

    def lookahead(self) -> int:
        """Bytes of sufficient lookahead: the longest chain of merges that can carry a change to the left."""
        start = {m: a for m, a in zip(self.made, self.left, strict=True)}
        reach: dict[int, int] = {}
        most = 1
        for a, b in zip(self.left, self.right, strict=True):
            far, t = reach.get(b, 0), b
            while t in start:
                t = start[t]
                far = max(far, reach.get(t, 0))
            far += len(self.token[a])
            reach[a] = max(reach.get(a, 0), far)
            most = max(most, far)
        return most

    def merged(self, text: bytes) -> list[int]:
        """The tokens of one piece, all of it at hand."""
        ids = [self.byte[b] for b in text]
        if len(ids) > 48:
            return self._merged_long(ids)
        rank, made, none = self.rank, self.made, len(self.made)
        while len(ids) > 1:
            found = [rank.get(p, none) for p in zip(ids, ids[1:])]
            best = min(found)
            if best == none:
                break
            if found.count(best) == 1:
                i = found.index(best)
                ids[i : i + 2] = [made[best]]
                continue
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and found[i] == best:
                    out.append(made[best])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        rank, made, n = self.rank, self.made, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = made[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (s := rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]


class Transducer:
    """Bytes of one piece in, tokens out as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int | None = None):
        self.vocabulary = vocabulary
        self.lookahead = lookahead or vocabulary.lookahead()
        self.held = b""

    def feed(self, more: bytes) -> list[int]:
        out: list[int] = []
        at, window = 0, 4 * self.lookahead
        held = self.held + more
        while len(held) - at >= window:
            stable = window - self.lookahead
            size = 0
            for t in self.vocabulary.merged(held[at : at + window]):
                if size + len(self.vocabulary.token[t]) > stable:
                    break
                size += len(self.vocabulary.token[t])
                out.append(t)
            at += size
        self.held = held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.vocabulary.merged(self.held), b""
        return out


class Pieces(dict):
    """Each piece met lately; what a generation forgets comes from the one before or is made anew."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        super().__init__()
        self.vocabulary, self.transducer, self.old = vocabulary, transducer, {}

    def __missing__(self, piece: str) -> Piece:
        found = self.old.get(piece)
        if found is None:
            b = piece.encode()
            if len(b) > OPEN:
                return self.vocabulary.piece(self.transducer.feed(b) + self.transducer.finish())
            found = self.vocabulary.piece(self.vocabulary.merged(b))
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found

    def meet(self, pieces: set[str]) -> None:
        """Makes the short ones that are new all at once; they stay until the next call at least."""
        if len(self) + len(pieces) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        unknown = [(p, b) for p in pieces if p not in self and p not in self.old and len(b := p.encode()) <= SHORT]
        if unknown:
            made = self.vocabulary.merged_together([b for _, b in unknown])
            self.update(zip([p for p, _ in unknown], map(self.vocabulary.piece, made), strict=True))


class Encoder:
    """Text in chunks of any size in, pieces out as they become stable; holds a few characters or one lookahead of bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.transducer = Transducer(vocabulary)
        self.pieces = Pieces(vocabulary, self.transducer)
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.kept = UNSETTLED + max([0, *(len(s) - 1 for s in vocabulary.special)])
        self.held, self.open = "", ""

    def feed(self, text: str, last: bool = False) -> Iterator[list[Piece]]:
        """Pieces, or parts of one, whose tokens are stable now; with `last`, all that remain."""
        text = self.held + text
        self.held, at = "", 0
        if self.cut:
            for m in self.cut.finditer(text):
                yield from self._segment(text[at : m.start()], True)
                yield self._part([self.vocabulary.special[m[0]]])
                at = m.end()
        yield from self._segment(text[at:] if at else text, last)

    def _part(self, ids: list[int]) -> list[Piece]:
        return [self.vocabulary.piece(ids)] if ids else []

    def _segment(self, text: str, whole: bool) -> Iterator[list[Piece]]:
        if self.open:
            n = RUNS[self.open].match(text).end()
            if not whole and n > len(text) - self.kept:
                n = max(0, len(text) - self.kept)
                yield self._part(self.transducer.feed(text[:n].encode()))
                self.held = text[n:]
                return
            if self.open == "S" and n and n < len(text):
                n -= 1  # the last white space belongs to the next piece
            yield self._part(self.transducer.feed(text[:n].encode()))
            text = text[n:]
            yield self._part(self.transducer.finish())
            self.open = ""
        pieces = self.find(text)
        if not whole:
            cut, keep = len(text), len(pieces)
            while keep and cut > len(text) - self.kept:
                keep -= 1
                cut -= len(pieces[keep])
            if keep < len(pieces) and len(p := pieces[keep]) > OPEN + self.kept and cut + len(p) == len(text):
                self.open = next(k for k, run in RUNS.items() if run.match(p[-1]).end())
                safe = len(p) - self.kept
                yield [self.pieces[x] for x in pieces[:keep]]
                yield self._part(self.transducer.feed(p[:safe].encode()))
                self.held = p[safe:]
                return
            self.held, pieces = text[cut:], pieces[:keep]
        yield [self.pieces[x] for x in pieces]

    def encode(self, text: str) -> Iterator[list[Piece]]:
        """The pieces of a whole text, some at a time."""
        for at in range(0, len(text), CHUNK):
            yield from self.feed(text[at : at + CHUNK], at + CHUNK >= len(text))

    def encode_all(self, texts: Iterable[str]) -> Iterator[Iterator[list[Piece]]]:
        """`encode` of each text. New pieces of short texts that stand together are merged together."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[Iterator[list[Piece]]]:
        short = [len(t) <= CHUNK and not (self.cut and self.cut.search(t)) for t in texts]
        found = [self.find(t) if s else [] for t, s in zip(texts, short, strict=True)]
        self.pieces.meet(set(chain.from_iterable(found)))
        for text, s, pieces in zip(texts, short, found, strict=True):
            yield iter([[self.pieces[x] for x in pieces]]) if s else self.encode(text)


class Decoder:
    """Token ids in, text out: token bytes pass through an incremental UTF-8 state machine, which keeps an unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.token = vocabulary.token
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.take(b"".join(map(self.token.__getitem__, ids)), last)

    def take(self, data: bytes, last: bool = False) -> str:
        """The same for tokens of which the bytes are at hand."""
        return self.state.decode(data, last)


def digests(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_decoded (characters) of every row; no shuffle.

    A null or empty text has no tokens and the digests of nothing; repeated rows each get their own result.
    `tokenizer` is a path that every executor can open, as the vocabulary's package is on every machine.
    """

    def run(batches):
        vocabulary = Vocabulary(tokenizer)
        encoder = Encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, parts in zip(batch["doc_id"], encoder.encode_all(batch["text"]), strict=True):
                ids_hash, text_hash, decoder, n, size = sha256(), sha256(), Decoder(vocabulary), 0, 0
                for pieces in parts:
                    if pieces:
                        if n:
                            ids_hash.update(b",")
                        ids_hash.update(b",".join([written for _, written, _ in pieces]))
                        n += sum([len(ids) for ids, _, _ in pieces])
                        part = decoder.take(b"".join([data for _, _, data in pieces]))
                        size += len(part)
                        text_hash.update(part.encode())
                rest = decoder.take(b"", True)
                text_hash.update(rest.encode())
                rows.append((doc_id, n, ids_hash.hexdigest(), text_hash.hexdigest(), size + len(rest)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_decoded"]).astype({"doc_id": batch["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", text_or_empty(text).alias("text"))
    return slim.mapInPandas(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_decoded bigint")


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`docs` with the token ids of its text as array<int>; null texts give an empty array. A column of that name is replaced."""

    @F.pandas_udf("array<int>")
    def to_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(Vocabulary(tokenizer))
        for texts in batches:
            yield pd.Series([[i for pieces in parts for ids, _, _ in pieces for i in ids] for parts in encoder.encode_all(texts)], dtype=object)

    return docs.withColumn(ids, to_ids(text_or_empty(text)))


def checked(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids", same: str = "decodes") -> DataFrame:
    """`encoded` with a column that says whether the ids decode to the text, null taken as empty.

    Both directions run in the same worker, so a task needs one vocabulary and the decoded text never leaves it.
    """

    @F.pandas_udf("ids array<int>, same boolean")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(tokenizer)
        encoder = Encoder(vocabulary)
        for texts in batches:
            each, alike = [], []
            for told, parts in zip(texts, encoder.encode_all(texts), strict=True):
                found = np.fromiter((i for pieces in parts for piece, _, _ in pieces for i in piece), np.int32)
                each.append(found)
                alike.append(Decoder(vocabulary).feed(found.tolist(), True) == told)
            yield pd.DataFrame({"ids": pd.Series(each, dtype=object), "same": np.array(alike, bool)})

    # Nondeterministic, so that it is called once for both columns.
    at = "_both" + "_" * sum(map(len, docs.columns))  # no other column's name
    found = docs.withColumn(at, both.asNondeterministic()(text_or_empty(text)))
    return found.withColumns({ids: F.col(f"{at}.ids"), same: F.col(f"{at}.same")}).drop(at)


def decoded(df: DataFrame, tokenizer: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """`df` with the text of its token ids; null ids give null."""

    @F.pandas_udf("string")
    def to_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(tokenizer)
        for column in batches:
            yield pd.Series([None if x is None else Decoder(vocabulary).feed(map(int, x), True) for x in column], dtype=object)

    return df.withColumn(text, to_text(F.col(ids)))
