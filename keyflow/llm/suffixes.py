"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts in a document with a smaller id.

A Burrows-Wheeler transform of a whole corpus fits no machine, so the windows of ``length`` bytes are first dealt by content: each
goes with its anchor (see anchors.py), and windows that are equal share theirs.

1. Batches of documents ask which anchors occur in more than one document.
2. The segments of those anchors are sent once for each distinct text in a batch, with the smallest id that has it.
3. Each task collapses equal segments and derives, from the transform of those whose anchor has several, which windows
   share ``length`` bytes, and for each window the smallest id among them.
4. Batches read the answers, and remove.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import census
from . import tokens as tk
from .anchors import segments
from .bwt import prefix_groups

LENGTH = 50
BLOCK = 1 << 19  # bytes of text in one transform
BATCH_BYTES = 4 << 20
BACK = "batch int, bucket int, kind int, a binary, b binary, c binary"
BITS, FOUND = 0, 1


class Batch:
    """The segments of a batch's texts. ``keys``: the distinct anchors in ascending order; ``at``: each segment's among them."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        self.batch = table.column("batch")[0].as_py()
        self.who = census.ids(table)
        self.data, self.offsets = tk.text_bytes(table.column("text"))
        self.length = length
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for a, b in tk.blocks(self.offsets):
            base = self.offsets[a]
            start, end, place, key = segments(self.data[base : self.offsets[b]], self.offsets[a : b + 1] - base, length)
            doc = a + np.searchsorted(self.offsets[a : b + 1] - base, start, "right") - 1
            for to, x in zip(parts, (start + base, end - start, place - start, key, self.who[doc]), strict=True):
                to.append(x)
        self.start, self.count, self.back, key, self.doc = (np.concatenate([*p, np.zeros(0, np.uint64 if i == 3 else np.int64)]) for i, p in enumerate(parts))
        self.keys, self.at = np.unique(key, return_inverse=True)
        self.edges = np.searchsorted(census.bucket_of(self.keys, buckets), np.arange(buckets + 1))

    def several(self) -> np.ndarray:
        """Which keys this batch alone has in two documents."""
        low = np.full(len(self.keys), np.iinfo(np.int64).max)
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.at, self.doc)
        np.maximum.at(high, self.at, self.doc)
        return low < high

    def shared(self, answers: list[dict]) -> np.ndarray:
        """Which keys any two documents have."""
        out = self.several()
        for row in answers:
            a, b = self.edges[row["bucket"]], self.edges[row["bucket"] + 1]
            out[a:b] |= np.unpackbits(np.frombuffer(row["a"], np.uint8), count=b - a).astype(bool)
        return out

    def entries(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The segments with shared anchors, as a place in ``start``; the entry (distinct anchor and text) of each; of each entry, its first
        segment and the smallest id. Entries are in the order of their keys."""
        mine = np.flatnonzero(self.shared(answers)[self.at])
        text = tk.span_hashes_in(self.data, self.start[mine], self.start[mine] + self.count[mine] + self.length - 1)
        order = np.lexsort((self.doc[mine], text, self.at[mine]))
        k, t = self.at[mine][order], text[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        first = mine[order[new]]
        return mine, entry, first, self.doc[first]


def ask(table: pa.Table, length: int, buckets: int, wide: int) -> pa.Table:
    """A row for each bucket: the first ``wide`` bytes of the keys."""
    b = Batch(table, length, buckets)
    raw = b.keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :wide]
    some = np.flatnonzero(np.diff(b.edges))
    return pa.table({"bucket": pa.array(some, pa.int32()), "batch": pa.array(np.full(len(some), b.batch), pa.int32()), "keys": pa.array([raw[b.edges[i] : b.edges[i + 1]].tobytes() for i in some], pa.binary())})


def back(rows: list[tuple]) -> pa.Table:
    columns = [*zip(*rows, strict=True)] or [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("batch", "bucket", "kind", "a", "b", "c"), columns, kinds, strict=True)})


def common(table: pa.Table, wide: int) -> pa.Table:
    """To each batch of a bucket, a bit for each of its keys: whether another batch has it."""
    blobs = table.column("keys").to_pylist()
    sizes = np.array([len(x) // wide for x in blobs])
    raw = np.zeros((sizes.sum(), 8), np.uint8)
    raw[:, :wide] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, wide)
    keys = raw.view(">u8").ravel().astype(np.uint64)
    batch = np.repeat(np.arange(len(blobs)), sizes)
    order = np.argsort(keys, kind="stable")
    k, who = keys[order], batch[order]
    same = (k[1:] == k[:-1]) & (who[1:] != who[:-1])
    # A short key that a batch has twice, next to another batch's, is shared as a whole.
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    hit = np.zeros(group[-1] + 1 if len(k) else 0, bool)
    hit[group[1:][same]] = True
    flags = np.zeros(len(k), bool)
    flags[order] = hit[group]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    bucket = table.column("bucket")[0].as_py()
    return back([(who, bucket, BITS, np.packbits(flags[edges[i] : edges[i + 1]]).tobytes(), None, None) for i, who in enumerate(table.column("batch").to_pylist()) if flags[edges[i] : edges[i + 1]].any()])


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


SENT = "bucket int, batch int, low binary, count binary, back binary, text binary"


def send(docs: pa.Table, answers: pa.Table, length: int, buckets: int) -> pa.Table:
    """The entries of a batch, a row for each bucket: smallest ids, numbers of windows, the anchors' places, and texts (deflated)."""
    rows = {"bucket": [], "low": [], "count": [], "back": [], "text": []}
    batch = None
    if docs.num_rows:
        b = Batch(docs, length, buckets)
        batch = b.batch
        _, _, first, low = b.entries(answers.to_pylist())
        cut = np.searchsorted(b.at[first], b.edges)
        for i in np.flatnonzero(np.diff(cut)):
            own = first[cut[i] : cut[i + 1]]
            rows["bucket"].append(i)
            rows["low"].append(low[cut[i] : cut[i + 1]].tobytes())
            rows["count"].append(b.count[own].astype(np.uint8).tobytes())
            rows["back"].append(b.back[own].astype(np.uint8).tobytes())
            rows["text"].append(zlib.compress(gather(b.data, b.start[own], b.count[own] + length - 1).tobytes(), 1))
    kinds = {"bucket": pa.int32(), "low": pa.binary(), "count": pa.binary(), "back": pa.binary(), "text": pa.binary()}
    out = {n: pa.array(v, kinds[n]) for n, v in rows.items()}
    return pa.table({"bucket": out["bucket"], "batch": pa.array([batch] * len(rows["bucket"]), pa.int32()), **{n: out[n] for n in ("low", "count", "back", "text")}})


def least_ids(text: np.ndarray, count: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """Of each window of consecutive segment texts, the smallest id that any segment with an equal window has."""
    size = count + length - 1
    # A byte that is in no text but as a NUL of its own parts the segments; windows never contain one.
    parted = np.zeros(int(size.sum()) + len(size), np.uint8)
    at = np.cumsum(size + 1) - (size + 1)
    parted[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())] = text
    order, begins = prefix_groups(parted, length)
    window = np.full(len(parted), -1, np.int64)  # the number of the window that begins at each place
    places = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(count.sum())
    window[places] = np.arange(len(places))
    of = window[order]
    inside = of >= 0
    group = (np.cumsum(begins) - 1)[inside]
    ids = np.repeat(low, count)
    smallest = np.full(int(group.max()) + 1, census.NO_ID)
    np.minimum.at(smallest, group, ids[of[inside]])
    out = np.empty(len(places), np.int64)
    out[of[inside]] = smallest[group]
    return out


def anchor_blocks(group: np.ndarray, size: np.ndarray) -> Iterator[slice]:
    """Ranges of whole anchors with about BLOCK bytes of text each; equal windows share an anchor, so no block needs another."""
    heads = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else group
    upto = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(heads):
        to = max(at + 1, int(np.searchsorted(upto[heads], upto[heads[at]] + BLOCK)))
        yield slice(int(heads[at]), int(heads[to]) if to < len(heads) else len(group))
        at = to


def compare(table: pa.Table, length: int) -> pa.Table:
    """To each batch of a bucket, for its entries: the smallest id where all windows have the same smaller one (else NO_ID), and for
    other entries with smaller ones the entry, first window, end and id of each run of windows."""
    rows = table.to_pylist()
    low = np.concatenate([np.frombuffer(r["low"], np.int64) for r in rows])
    count = np.concatenate([np.frombuffer(r["count"], np.uint8) for r in rows]).astype(np.int64)
    place = np.concatenate([np.frombuffer(r["back"], np.uint8) for r in rows]).astype(np.int64)
    data = np.frombuffer(b"".join(zlib.decompress(r["text"]) for r in rows), np.uint8)
    size = count + length - 1
    start = np.cumsum(size) - size
    text = tk.span_hashes_in(data, start, start + size)
    anchor = tk.span_hashes_in(data, start + place, start + place + 20)
    order = np.lexsort((low, place, text, anchor))
    a, t = anchor[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    unique = order[new]  # one entry of each anchor and text, that with the smallest id
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    best = low[unique]
    # Anchors with several texts, which the transform compares.
    head = np.ones(len(unique), bool)
    head[1:] = anchor[unique][1:] != anchor[unique][:-1]
    group = np.cumsum(head) - 1
    many = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for some in anchor_blocks(group[many], size[unique[many]]):
        mine = many[some]
        own = unique[mine]
        ids = least_ids(gather(data, start[own], size[own]), count[own], low[own], length)
        edges = np.concatenate([[0], np.cumsum(count[own])])
        turn = np.ones(len(ids), bool)
        turn[1:] = ids[1:] != ids[:-1]
        turn[edges[:-1]] = True
        first = np.flatnonzero(turn)
        last = np.append(first[1:], len(ids))
        which = np.searchsorted(edges, first, "right") - 1
        whole = np.bincount(which, minlength=len(mine)) == 1
        best[mine[whole]] = ids[edges[:-1][whole]]
        for w, x, y in zip(which.tolist(), first.tolist(), last.tolist(), strict=True):
            if not whole[w]:
                runs.setdefault(int(mine[w]), []).append((x - int(edges[w]), y - int(edges[w]), int(ids[x])))
    split = np.zeros(len(unique), bool)
    split[[*runs]] = True
    full = np.where(~split[of] & (best[of] < low), best[of], census.NO_ID)
    bucket, at, out = rows[0]["bucket"], 0, []
    for r in rows:
        n = len(r["low"]) // 8
        some = [(i, x, y, g) for i in np.flatnonzero(split[of[at : at + n]]).tolist() for x, y, g in runs[int(of[at + i])] if g < low[at + i]]
        mine = full[at : at + n]
        if some or (mine != census.NO_ID).any():
            out.append((r["batch"], bucket, FOUND, zlib.compress(mine.tobytes(), 1), zlib.compress(np.array(some, np.int64).tobytes(), 1), None))
        at += n
    return back(out)


def remove(docs: pa.Table, answers: pa.Table, length: int, buckets: int) -> pa.Table:
    rows = answers.to_pylist()
    b = Batch(docs, length, buckets)
    mine, entry, first, low = b.entries([r for r in rows if r["kind"] == BITS])
    cut = np.searchsorted(b.at[first], b.edges)
    full = low.copy()  # what the batch knows itself
    parts: list[np.ndarray] = []
    for r in rows:
        if r["kind"] == FOUND:
            base = cut[r["bucket"]]
            got = np.frombuffer(zlib.decompress(r["a"]), np.int64)
            full[base : base + len(got)] = np.minimum(full[base : base + len(got)], got)
            some = np.frombuffer(zlib.decompress(r["b"]), np.int64).reshape(-1, 4).copy()
            some[:, 0] += base
            parts.append(some)
    edge = np.zeros(len(b.data) + 1, np.int32)

    def cover(segment: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Windows first to last - 1 of the segments."""
        at = b.start[segment]
        np.add.at(edge, at + first, 1)
        np.add.at(edge, at + last - 1 + length, -1)

    late = b.doc[mine] > full[entry]
    cover(mine[late], np.zeros(late.sum(), np.int64), b.count[mine[late]])
    runs = np.concatenate([*parts, np.zeros((0, 4), np.int64)])
    if len(runs):
        # Every segment of an entry with runs meets each of them.
        by = np.argsort(entry, kind="stable")
        lo, hi = np.searchsorted(entry[by], runs[:, 0]), np.searchsorted(entry[by], runs[:, 0], "right")
        times = hi - lo
        run = np.repeat(np.arange(len(runs)), times)
        segment = by[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)]
        late = b.doc[mine[segment]] > runs[run, 3]
        cover(mine[segment[late]], runs[run[late], 1], runs[run[late], 2])
    gone = np.cumsum(edge[:-1]) > 0
    out: dict[str, list] = {"n_bytes": [], "n_removed": [], "spans": [], "kept_sha256": []}
    for lo, hi in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
        g = gone[lo:hi]
        n = int(np.count_nonzero(g))
        spans = []
        if n:
            turn = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]])))
            spans = [{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)]
        out["n_bytes"].append(hi - lo)
        out["n_removed"].append(n)
        out["spans"].append(spans)
        out["kept_sha256"].append(hashlib.sha256((b.data[lo:hi][~g] if n else b.data[lo:hi]).tobytes()).hexdigest())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": span, "kept_sha256": pa.string()}
    return pa.table({"doc_id": docs.column("doc_id"), **{n: pa.array(v, kinds[n]) for n, v in out.items()}})


REMOVED = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string"


def repeated_bytes(docs: DataFrame, length: int = LENGTH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed byte ranges) and kept_sha256 (of the other bytes), a row for each row of
    ``docs``.

    A byte is removed when it is covered by ``length`` bytes of its text that also start in a document with a smaller doc_id,
    as the texts are given. Null and empty texts have no bytes. Rows that share a doc_id are one document's: none removes
    from the other. A null doc_id comes after all others. Other columns are not read. ``length`` is 21 to 270.
    """
    dealt, n = census.batched(docs, batch_bytes)
    buckets = census.buckets_for(n)
    # Short keys save space: with some 20 bits more than keys there are, one in a million is shared by chance, and compared for nothing.
    wide = min(8, max(4, -(-(int(np.log2(n * batch_bytes)) + 20 - 4) // 8)))
    asked = census.grouped(dealt, "batch", lambda t: ask(t, length, buckets, wide), "bucket int, batch int, keys binary")
    bits = census.grouped(asked, "bucket", lambda t: common(t, wide), BACK)
    sent = census.joined(dealt, bits, lambda d, a: send(d, a, length, buckets), SENT)
    found = census.grouped(sent, "bucket", lambda t: compare(t, length), BACK)
    return census.joined(dealt, bits.unionByName(found), lambda d, a: remove(d, a, length, buckets) if d.num_rows else EMPTY, REMOVED)


EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "spans": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_sha256": pa.array([], pa.string())})


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if spans:
                raw, at, left = text.encode(), 0, []
                for s in spans:
                    left.append(raw[at : s["start"]])
                    at = s["end"]
                text = b"".join([*left, raw[at:]]).decode("utf-8", "ignore")
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and the text without its repeated bytes; of a character that a span cuts, nothing is left. Rows without an id are left out."""
    spans = repeated_bytes(docs, length).filter("n_removed > 0").select("doc_id", "spans").dropDuplicates(["doc_id"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").join(spans, "doc_id", "left").mapInArrow(_cleaned, "doc_id long, text string")
