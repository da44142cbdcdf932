"""Content-defined anchors of byte windows: every window of a text is assigned to the least hashed k-mer that it contains.

Equal windows have equal anchors at equal places, so windows need only be compared with those of the same anchor. The
consecutive windows of one anchor form a segment.
"""

from __future__ import annotations

import numpy as np

from . import tokens as tk

KMER = 20
_BASE = 0xD1342543DE82EF95


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Of the KMER bytes from each place on."""
    step = lambda low, high, shift: low[: len(high) - shift] * np.uint64(pow(_BASE, shift, 1 << 64)) + high[shift:]
    h1 = tk._BYTE[data]
    h2 = step(h1, h1, 1)
    h4 = step(h2, h2, 2)
    h8 = step(h4, h4, 4)
    h16 = step(h8, h8, 8)
    return tk.mix(h16[: len(data) - KMER + 1] * np.uint64(pow(_BASE, 4, 1 << 64)) + h4[16:])


def segments(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows, anchor place, and anchor hash of the segments of consecutive texts, in order."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none.astype(np.uint64)
    keys = kmer_hashes(data)
    low = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    wide = 1
    left = window - KMER + 1
    while wide * 2 <= left:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < left:
        low = np.minimum(low[: len(low) - (left - wide)], low[left - wide :])
    # Windows that lie in one text.
    edge = np.zeros(len(low) + 1, np.int64)
    first, last = offsets[:-1], offsets[1:] - window + 1
    good = last > first
    np.add.at(edge, first[good], 1)
    np.add.at(edge, last[good], -1)
    inside = np.cumsum(edge[:-1]) > 0
    new = inside.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    starts_of_texts = first[good]
    new[starts_of_texts] = True
    start = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= (low[1:] != low[:-1]) | ~inside[1:]
    ends_of_texts = last[good] - 1
    stop[ends_of_texts] = True
    end = np.flatnonzero(stop) + 1
    place = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return start, end, place, keys[place]
