"""A corpus-wide look-up of many small keys: packed, pre-aggregated, and sent back to where it was asked.

Documents are dealt into batches by a hash of their id. A batch asks for its distinct keys, packed into one row for each bucket of
the key space, so a key that is in every document costs one entry a batch. A bucket's task sorts all its entries at once and
sends its answers back as one row for each batch, and each batch reads its texts again together with the answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from .scratch import small_batches

BATCH_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: after all ids

ASKED = "bucket int, batch int, keys binary, extra binary, vals binary"
ANSWERED = "batch int, keys binary, extra binary, vals binary"


def batched(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """batch, doc_id, text, and the number of batches for the texts' total size."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, size = slim.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-size // batch_bytes), -(-rows // 50_000))
    # Rows without an id are dealt by their text.
    key = F.coalesce("doc_id", F.xxhash64("text"))
    return slim.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("batch"), "doc_id", "text"), n


def ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)


def buckets_for(batches: int) -> int:
    """As many as give each about as many entries as a batch asks for."""
    return max(1, batches)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ask(batch: int, keys: np.ndarray, extra: np.ndarray, vals: np.ndarray, buckets: int) -> pa.Table:
    """Rows for distinct ``keys`` in ascending order."""
    edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edges))
    cut = lambda a: pa.array([a[edges[i] : edges[i + 1]].tobytes() for i in some], pa.binary())
    return pa.table({"bucket": pa.array(some, pa.int32()), "batch": pa.array(np.full(len(some), batch), pa.int32()), "keys": cut(keys), "extra": cut(extra), "vals": cut(vals)})


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, extras and values of all rows, and the batch of each entry."""
    raw = {c: b"".join(x for x in table.column(c).to_pylist()) for c in ("keys", "extra", "vals")}
    keys, extra, vals = np.frombuffer(raw["keys"], np.uint64), np.frombuffer(raw["extra"], np.uint64), np.frombuffer(raw["vals"], np.int64)
    sizes = [len(x) // 8 for x in table.column("keys").to_pylist()]
    return keys, extra, vals, np.repeat(table.column("batch").to_numpy(), sizes)


def answer(batch: np.ndarray, keys: np.ndarray, extra: np.ndarray, vals: np.ndarray) -> pa.Table:
    """Rows for entries, one for each batch."""
    order = np.argsort(batch, kind="stable")
    which, first = np.unique(batch[order], return_index=True)
    edges = np.append(first, len(order))
    cut = lambda a: pa.array([a[order[edges[i] : edges[i + 1]]].tobytes() for i in range(len(which))], pa.binary())
    return pa.table({"batch": pa.array(which, pa.int32()), "keys": cut(keys), "extra": cut(extra), "vals": cut(vals)})


def earlier(table: pa.Table) -> pa.Table:
    """Of a bucket: to each batch, the keys that another batch has with a smaller value, and the smallest one."""
    keys, extra, vals, batch = unpack(table)
    order = np.lexsort((vals, extra, keys)) if len(extra) else np.lexsort((vals, keys))
    k, v = keys[order], vals[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if len(extra):
        e = extra[order]
        new[1:] |= e[1:] != e[:-1]
    low = v[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else v
    late = v > low
    return answer(batch[order][late], k[late], extra[order][late] if len(extra) else np.zeros(0, np.uint64), low[late])


def grouped(frame: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return frame.groupBy(key).applyInArrow(fn, schema)


def joined(docs: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of each batch's documents and the answers to it."""
    return docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(fn, schema)


def distinct(keys: np.ndarray, extra: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with their smallest value."""
    order = np.lexsort((vals, extra, keys)) if len(extra) else np.lexsort((vals, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if len(extra):
        e = extra[order]
        new[1:] |= e[1:] != e[:-1]
        return k[new], e[new], vals[order][new]
    return k[new], extra, vals[order][new]


def slices(table: pa.Table, rows: int = 1000) -> Iterator[pa.Table]:
    for at in range(0, table.num_rows, rows):
        yield table.slice(at, rows)
