"""Words of many texts at once: spans and 64-bit hashes over the bytes of an Arrow string column.

All functions work on UTF-8 bytes. ``WHITE`` separates words at bytes 32 and 9-13; ``SYMBOLS`` separates them at
every ASCII byte but digits and lower-case letters (apply ``LOWER`` first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes of text handled at once; one longer document is a block of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[:128] = True
SYMBOLS[48:58] = False
SYMBOLS[97:123] = False

_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes each, or one document."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 offsets of documents into the words. No word spans documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    out = separators.take(data)
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = out[:-1]
    edges = offsets[offsets < len(data)]
    before[edges] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = out[1:]
    after[edges[edges > 0] - 1] = True
    inside = ~out
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; equal bytes have equal hashes everywhere."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def span_hashes_in(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes`` of spans with ascending starts that may overlap, over data of any size."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + BLOCK)))
        last = int(ends[at:to].max())
        out[at:to] = span_hashes(data[base:last], starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def hashed_words(column, separators: np.ndarray = WHITE, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of documents: first and last document, the word hashes, and the documents' offsets into them."""
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        part = data[offsets[a] : offsets[b]]
        part = LOWER.take(part) if lower else part
        starts, ends, at = word_spans(part, offsets[a : b + 1] - offsets[a], separators)
        yield a, b, span_hashes(part, starts, ends), at


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; of the whole text where it has fewer words, but some."""
    n = len(words)
    if not n:
        return words
    wide = min(width, n)
    total = np.zeros(n - wide + 1, np.uint64)
    for j in range(wide):
        total = (total ^ words[j : n - wide + 1 + j]) * np.uint64(_BASE)
        total ^= total >> np.uint64(29)
    return mix(total + np.uint64(wide))
