"""Suffix arrays by Larsson-Sadakane refinement and Kasai's common prefixes, in NumPy."""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number that sorts like them; zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i:i + len(data)].astype(np.uint64)
    return out


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of ``data``, bytes that are not 0.

    Suffixes start sorted by eight bytes. Each round doubles the length: a suffix's key is the rank
    of the suffix that starts that much later, and only groups that are not yet single are sorted.
    """
    n = len(data)
    first = _words(data)
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    length = 8
    while len(slots):
        at = order[slots]
        later = np.where(at + length < n, rank[np.minimum(at + length, n - 1)] + 1, 0)
        group = rank[at]
        by = np.argsort(group * (n + 1) + later, kind="stable")
        at, later, group = at[by], later[by], group[by]
        order[slots] = at
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (later[1:] != later[:-1])
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        single = fresh & np.append(fresh[1:], True)
        slots = slots[~single]
        length *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Bytes that the suffix at each place of ``order`` shares with the one before it.

    Kasai: where the bytes before two neighbours agree, the length is that of the position before
    less one. So lengths are counted only where they differ, and carried on from there.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    counted = (before < 1) | (at == 0)
    inner = ~counted
    counted[inner] = data[at[inner] - 1] != data[before[inner] - 1]
    start = at[counted]
    other = before[counted]
    length = np.zeros(len(start), np.int64)
    words = _words(data)
    open_ = np.flatnonzero(other >= 0)
    while len(open_):
        a, b = start[open_] + length[open_], other[open_] + length[open_]
        ok = (a < n) & (b < n)
        open_, a, b = open_[ok], a[ok], b[ok]
        same = words[a] == words[b]
        # Zeros past the end may agree with each other only where both texts have ended.
        differ = open_[~same]
        x = words[a[~same]] ^ words[b[~same]]
        lead = np.zeros(len(x), np.int64)
        for i in range(7, 0, -1):
            lead += (x >> np.uint64(8 * i)) == 0
        length[differ] += lead
        length[open_[same]] += 8
        open_ = open_[same]
    source = np.maximum.accumulate(np.where(counted, at, 0))
    full = np.zeros(n, np.int64)
    full[start] = np.minimum(length, n - np.maximum(start, other))
    lengths = np.maximum(full[source] - (at - source), 0)
    return lengths[order]
