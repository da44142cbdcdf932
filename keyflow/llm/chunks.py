"""Substring dedup by content-defined chunking: a gear rolling hash cuts texts into chunks, and repeated chunks go.

A cut depends on the last ``WINDOW`` bytes and on the distance from the cut before, so equal passages are cut alike soon after
they begin, wherever they stand: an insertion moves cuts near it only. Chunks are compared by 128-bit BLAKE2 digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import census
from .tokens import mix, text_bytes

WINDOW = 16
LEAST, MOST = 16, 128  # bytes of a chunk, but for a text's last one
MASK = np.uint32(0x7 << 13)  # a cut at one in 8 places, on bits that the whole window reaches
MIN_RUN = 64  # bytes of consecutive repeated chunks that are removed; fewer are left alone as chance, but for a whole text

GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash of the WINDOW bytes up to each byte, by doubling: h[i] = sum of GEAR[data[i - j]] << j."""
    h = GEAR[data]
    wide = 1
    while wide < WINDOW:
        more = h.copy()
        more[wide:] += h[:-wide] << np.uint32(wide)
        h, wide = more, 2 * wide
    return h


def cuts(data: np.ndarray) -> list[int]:
    """The chunks' ends. No cut parts the bytes of a character."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    lead = np.ones(n + 1, bool)
    lead[:-1] = (data & 0xC0) != 0x80
    hit = (gear_hash(data) & MASK) == 0
    hit[: WINDOW - 1] = False
    out, at = [], 0
    for c in (np.flatnonzero(hit & lead[1:]) + 1).tolist():
        while c - at > MOST:
            at += MOST
            while not lead[at]:
                at += 1
            out.append(at)
        if c - at >= LEAST:
            out.append(c)
            at = c
    while n - at > MOST:
        at += MOST
        while not lead[at]:
            at += 1
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunked(table: pa.Table) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """The chunks' ends in each text, and of all chunks in order the text's number and the two halves of the digest."""
    data, offsets = text_bytes(table.column("text"))
    ends, digests = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        mine = cuts(data[a:b])
        raw = data[a:b].tobytes()
        at = 0
        for c in mine:
            digests.append(hashlib.blake2b(raw[at:c], digest_size=16).digest())
            at = c
        ends.append(mine)
    halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    rows = np.repeat(np.arange(len(ends)), [len(e) for e in ends])
    return ends, rows, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def repeated(rows: np.ndarray, who: np.ndarray, k1: np.ndarray, k2: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Which chunks stand earlier: in a document with a smaller id, here or elsewhere, or before in the same one."""
    order = np.lexsort((np.arange(len(k1)), who[rows], k2, k1))
    a, b, d, r = k1[order], k2[order], who[rows][order], rows[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    low = d[new][group] if len(a) else d
    keys, extra, vals = known
    if len(keys) and len(a):
        at = np.minimum(np.searchsorted(keys, a), len(keys) - 1)
        low = np.where((keys[at] == a) & (extra[at] == b), np.minimum(low, vals[at]), low)
    again = np.zeros(len(a), bool)
    again[1:] = ~new[1:] & (r[1:] == r[:-1])  # the same chunk once more in one text
    out = np.zeros(len(a), bool)
    out[order] = (d > low) | again
    return out


def ask(table: pa.Table, buckets: int) -> pa.Table:
    who = census.ids(table)
    k1, k2, low = [], [], []
    for part, at in ((table.slice(a, 500), a) for a in range(0, table.num_rows, 500)):
        _, rows, x, y = chunked(part)
        k1.append(x)
        k2.append(y)
        low.append(who[at:][rows])
    keys, extra, vals = census.distinct(np.concatenate(k1), np.concatenate(k2), np.concatenate(low))
    return census.ask(table.column("batch")[0].as_py(), keys, extra, vals, buckets)


def remove(docs: pa.Table, answers: pa.Table, min_run: int) -> pa.Table:
    keys, extra, vals, _ = census.unpack(answers)
    order = np.lexsort((extra, keys))
    who = census.ids(docs)
    ends, rows, k1, k2 = chunked(docs)
    flags = repeated(rows, who, k1, k2, (keys[order], extra[order], vals[order]))
    texts = docs.column("text").to_pylist()
    at, out = 0, []
    for text, mine in zip(texts, ends, strict=True):
        again = flags[at : at + len(mine)].tolist()
        at += len(mine)
        spans: list[dict[str, int]] = []
        start = 0
        for end, flag, more in zip(mine, again, [*again[1:], False], strict=False):
            if flag and not more and (end - start >= min_run or end - start == mine[-1]):
                spans.append({"start": start, "end": end})
            if not (flag and more):
                start = end
        if spans:
            raw, kept, before = text.encode(), [], 0
            for s in spans:
                kept.append(raw[before : s["start"]])
                before = s["end"]
            text = b"".join([*kept, raw[before:]]).decode()
        out.append({"n_bytes": mine[-1] if mine else 0, "n_chunks": len(mine), "n_repeated": sum(again), "n_removed": sum(s["end"] - s["start"] for s in spans), "spans": spans, "text": text})
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    column = lambda c, t: pa.array([r[c] for r in out], t)
    return pa.table({"doc_id": docs.column("doc_id"), **{c: column(c, pa.int64()) for c in ("n_bytes", "n_chunks", "n_repeated", "n_removed")}, "spans": column("spans", pa.list_(span)), "text": column("text", pa.string())})


SCHEMA = "doc_id long, n_bytes long, n_chunks long, n_repeated long, n_removed long, spans array<struct<start: long, end: long>>, text string"


def dedup_chunks(docs: DataFrame, min_run: int = MIN_RUN, batch_bytes: int = census.BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeated, n_removed, spans (removed byte ranges) and text (what is left), a row for each row
    of ``docs``.

    A chunk is repeated when its digest stands in a document with a smaller doc_id, or before it in its own; runs of
    repeated chunks of ``min_run`` bytes or more are removed, and texts that are repeated chunks alone, whatever their length. Null and empty texts have no chunks (a null text stays null).
    Rows that share a doc_id are one document's: none removes from the other. A null doc_id comes after all others. Other columns
    are not read.
    """
    dealt, n = census.batched(docs, batch_bytes)
    buckets = census.buckets_for(n)
    asked = census.grouped(dealt, "batch", lambda t: ask(t, buckets), census.ASKED)
    answers = census.grouped(asked, "bucket", census.earlier, census.ANSWERED)
    return census.joined(dealt, answers, lambda d, a: remove(d, a, min_run), SCHEMA)
