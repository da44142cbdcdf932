"""Groups of suffixes (of rotations, in fact: no group looks beyond the end) with a common prefix of a given length, from a Burrows-Wheeler transform.

The common prefixes are derived by increasing length: an interval of suffixes that begin with w is extended backward by every
byte c before them, which gives the interval of cw; where such an interval begins for the first time, the suffixes
before and after differ within len(cw) bytes. The search is breadth-first, one length after the other, expands an interval only
if its beginning is new, and stops at the length asked for.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """The rotations of ``text`` in the order of their first ``length`` bytes at least (by doubling, from eight bytes on)."""
    n = len(text)
    around = np.resize(text, n + 8).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | around[j : n + j]
    order = np.argsort(key, kind="stable")
    wide = 8
    while wide < length:
        k = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], k[1:] != k[:-1]])).astype(np.uint64)
        key = (rank << np.uint64(32)) | np.roll(rank, -wide)
        order = np.argsort(key, kind="stable")
        wide *= 2
    return order


def prefix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place in it whether it begins a new group of suffixes that share ``length`` bytes."""
    n = len(text)
    order = suffix_order(text, length + 1)
    before = text[order - 1]  # the transform; text[-1] stands before the first suffix
    # Rows by the byte before them, stably: place j of the first column came from row back[j], and row i goes to place forward[i].
    back = np.argsort(before, kind="stable")
    forward = np.empty(n, np.int64)
    forward[back] = np.arange(n)
    column = before[back]
    new_byte = np.ones(n + 1, bool)
    new_byte[1:n] = column[1:] != column[:-1]
    begins = np.zeros(n + 1, bool)  # n stands for the end of the last interval
    begins[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    mark = np.full(n + 1, -1, np.int64)
    for _ in range(length):
        if not len(low):
            break
        sizes = high - low
        total = int(sizes.sum())
        which = np.repeat(np.arange(len(low)), sizes)
        rows = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        to = forward[rows]
        if total * 8 > n:  # many rows: sort them by place
            mark[to] = which
            to = np.flatnonzero(mark >= 0)
            which = mark[to]
            mark[to] = -1
        else:
            by = np.argsort(to, kind="stable")
            to, which = to[by], which[by]
        first = np.ones(len(to), bool)
        first[1:] = (to[1:] != to[:-1] + 1) | (which[1:] != which[:-1]) | new_byte[to[1:]]
        lows = to[first]
        highs = to[np.append(np.flatnonzero(first)[1:], len(to)) - 1] + 1
        fresh = ~(begins[lows] & begins[highs])
        begins[lows] = True
        begins[highs] = True
        low, high = lows[fresh], highs[fresh]
    return order, begins[:n]
