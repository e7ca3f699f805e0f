"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes, a bucket at a time.

Suffixes are classed as smaller or larger than their successor. The leftmost-smaller ones are sorted by their
substrings, recursively over the substrings' names while names repeat. From them all larger suffixes are induced
bucket by bucket in ascending order, and from those all smaller ones in descending order. Over bytes a bucket's
entries are taken as one array, and only a run of one byte takes a round for each of its bytes. Over the names of a
recursion, whose buckets hold an entry or two, the entries are taken one by one. Both are linear.
"""

from __future__ import annotations

import numpy as np

from . import words

#: Symbols up to which a bucket's entries are taken as one array.
BUCKETS = 257


def classes(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last, a least symbol of its own, is. The next change decides for equal neighbours."""
    change = np.flatnonzero(s[1:] != s[:-1])
    length = np.diff(np.concatenate(([-1], change)))
    return np.append(np.repeat(s[change] < s[change + 1], length), True)


def induced(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order (at least by their first symbol)."""
    count = np.bincount(s, minlength=symbols)
    end = np.cumsum(count)
    begin = end - count
    sa = np.zeros(len(s), np.int64)
    present = np.flatnonzero(count).tolist()

    def place(entries: np.ndarray, c: int, want: bool, at: np.ndarray, sign: int) -> np.ndarray:
        """Puts the predecessors of a bucket's entries that are of the wanted class at the open ends of their buckets; returns those of the same bucket."""
        before = entries[entries > 0] - 1
        before = before[smaller[before] == want]
        if not len(before):
            return before
        symbol = s[before]
        order = np.argsort(symbol, kind="stable")
        symbol, before = symbol[order], before[order]
        start = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
        size = np.diff(np.append(start, len(symbol)))
        within = np.arange(len(symbol)) - np.repeat(start, size)
        sa[at[symbol] + sign * within - (sign < 0)] = before
        at[symbol[start]] += sign * size
        return before[symbol == c]

    first = s[leftmost]
    low, high = np.searchsorted(first, present, side="left"), np.searchsorted(first, present, side="right")
    head = begin.copy()
    for i, c in enumerate(present):
        entries = sa[begin[c] : head[c]]
        while len(entries):
            entries = place(entries, c, False, head, 1)
        place(leftmost[low[i] : high[i]], c, False, head, 1)
    tail = end.copy()
    sa[begin[s[-1]]] = len(s) - 1
    tail[s[-1]] = begin[s[-1]]
    for c in reversed(present):
        entries = sa[tail[c] : end[c]][::-1]
        while len(entries):
            entries = place(entries, c, True, tail, -1)
        place(sa[begin[c] : head[c]][::-1], c, True, tail, -1)
    return sa


def induced_singly(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """The same as `induced`, entry by entry."""
    count = np.bincount(s, minlength=symbols)
    end = np.cumsum(count)
    first = s[leftmost]
    placed = np.zeros(len(s), np.int64)
    placed[end[first] - np.searchsorted(first, first, side="right") + np.arange(len(first))] = leftmost
    symbol, small, sa = s.tolist(), smaller.tolist(), placed.tolist()
    head = (end - count).tolist()
    for j in sa:  # grows ahead of the loop
        if j:
            j -= 1
            if not small[j]:
                c = symbol[j]
                sa[head[c]] = j
                head[c] += 1
    tail = end.tolist()
    for j in reversed(sa):
        if j:
            j -= 1
            if small[j]:
                c = symbol[j]
                tail[c] -= 1
                sa[tail[c]] = j
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """The order of all suffixes of a string whose last symbol is 0 and occurs nowhere else."""
    induce = induced if symbols <= BUCKETS else induced_singly
    s = s.astype(np.uint16 if symbols <= 1 << 16 else np.int64)  # 16 bits are sorted by radix
    smaller = classes(s)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(leftmost):
        return np.arange(len(s))[::-1].copy() if len(s) else np.zeros(0, np.int64)
    rough = induce(s, smaller, leftmost[np.argsort(s[leftmost], kind="stable")], symbols)
    is_leftmost = np.zeros(len(s), bool)
    is_leftmost[leftmost] = True
    order = rough[is_leftmost[rough]]
    place = np.searchsorted(leftmost, order)
    stop = np.append(leftmost, leftmost[-1])[place + 1] + 1
    told = words.hashes(s, order, stop)
    fresh = np.concatenate(([False], (told[1:] != told[:-1]) | (np.diff(stop - order) != 0)))
    name = np.cumsum(fresh)
    if name[-1] + 1 < len(order):
        reduced = np.empty(len(order), np.int64)
        reduced[place] = name
        order = leftmost[suffix_array(reduced, int(name[-1]) + 1)]
    return induce(s, smaller, order, symbols)


def runs(data: bytes, valid: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start the number of its string of `length` bytes, and for each number the valid starts' total weight.

    The permuted common prefix of each suffix with its predecessor in the order is compared eight bytes at a time,
    up to `length`; runs of the order with common prefixes that long are one string.
    """
    n = len(data)
    s = np.zeros(n + 1, np.uint16)
    s[:-1] = np.frombuffer(data, np.uint8)
    s[:-1] += 1
    order = suffix_array(s, 257)[1:]
    padded = data + bytes(length + 8)
    word = np.ndarray((n + length,), "<u8", padded, strides=(1,))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(n, bool)
    here = np.flatnonzero((before >= 0) & (np.arange(n) <= n - length) & (before <= n - length))
    for at in [*range(0, length - 7, 8), length - 8]:
        here = here[word[here + at] == word[before[here] + at]]
    common[here] = True
    run = np.empty(n, np.int64)
    run[order] = np.cumsum(~common[order]) - 1
    return run, np.bincount(run[valid], weights=weight[valid], minlength=n)
