"""Vectorised words of many texts at once: positions and 64-bit hashes by prefix sums, without a loop over words."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for n positions; kept for the largest n so far, by power of two."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _powers[size]
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose high bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def joined(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by one byte `gap`, and where each text begins (one more at the end)."""
    sep = bytes([gap])
    data = np.frombuffer(sep.join(texts) + sep, np.uint8)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    return data, starts


def spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last position of each run of word bytes; the last byte must not be one."""
    change = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0)))
    return change[0::2], change[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of `data`, equal for equal bytes wherever they stand."""
    up, down = powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pieces(texts: list[bytes], limit: int):
    """Ranges of texts whose bytes together stay under `limit`, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
