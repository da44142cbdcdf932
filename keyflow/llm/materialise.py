"""Token ids in training order: a keyed permutation gives every sequence a slot, and range partitions hold the slots in order.

Documents become token ids with an end token after each, cut into sequences of a fixed number of ids (the last one padded
with end tokens). The sequences are numbered, a Feistel network keyed by ``key`` permutes the numbers (values beyond the
last number walk on along their cycle), and each sequence is written at its slot. All records have one stride, so that a
reader seeks to any slot and can resume after the last one it has read.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, release, small_batches
from .tokens import mix

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # ranks; the file is public and not part of this repository
END = 50256  # free in this vocabulary
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
LENGTH = 512
ROUNDS = 4
SHARD_BYTES = 8 << 20
PARTITIONS = 20_000  # at most, of the written order; more shards than that are dealt in runs
PASSES = 6  # in which shards are written, so that the shuffle never holds more than a sixth of them
ROWS = "slot long, shard int, position long, doc_id long, piece long, n_tokens long, tokens binary"

#: Of each record, in a table beside its shard.
OWNERS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32())])

_encoders: dict[str, Callable[[str], list[int]]] = {}


def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """One for each worker process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _encoders[vocabulary]


def tokenised(batches: Iterator[pa.RecordBatch], vocabulary: str, length: int) -> Iterator[pa.RecordBatch]:
    encode, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            ids = [array("H", [*encode(t or ""), END]).tobytes() for t in batch.column(1).slice(a, 500).to_pylist()]
            n = np.array([-(-len(x) // (2 * length)) for x in ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part), pa.int32()), pa.array(at + np.cumsum(n) - n, pa.int64()), batch.column(0).slice(a, 500), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "first", "doc_id", "n", "ids"],
            )
            at += int(n.sum())


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of the numbers below ``n``, applied to ``x``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & ((1 << 64) - 1)))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(batches: Iterator[pa.RecordBatch], before: dict[int, int], n: int, key: int, length: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The sequences whose slots are from ``low`` to below ``high``."""
    stride = 2 * length
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            some = batch.slice(a, 200)
            parts, first, count = (some.column(c).to_numpy(zero_copy_only=False) for c in ("part", "first", "n"))
            start = np.array([before[int(p)] for p in parts], np.int64) + first
            rows = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            ids = some.column("ids").to_pylist()
            pad = np.array([END], np.uint16).tobytes()
            raw = b"".join(x + pad * ((k * stride - len(x)) // 2) for x, k in zip(ids, count.tolist(), strict=True))
            sizes = np.array([len(x) // 2 for x in ids])
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), len(rows), [None, pa.py_buffer(raw)])
            slots = feistel(start[rows] + piece, n, key)
            here = np.flatnonzero((slots >= low) & (slots < high))
            rows, piece, slots = rows[here], piece[here], slots[here]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slots),
                    some.column("doc_id").take(pa.array(rows)),
                    pa.array(piece),
                    pa.array(np.minimum(length, sizes[rows] - piece * length)),
                    fixed.take(pa.array(here)).cast(pa.binary()),
                ],
                ["slot", "doc_id", "piece", "n_tokens", "tokens"],
            )


def training_order(docs: DataFrame, length: int = LENGTH, key: int = 7, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """slot, shard, position (the record's byte in its shard), doc_id, piece, n_tokens, tokens: one row for each sequence.

    The slots are 0 to N - 1, each once; partitions hold consecutive shards, sorted by slot. ``tokens`` has 2 * ``length`` bytes:
    16-bit little-endian ids, the document's end token and padding included; n_tokens counts ids up to the end token. A
    null or empty text is one sequence with an end token alone; a null doc_id stays null. Repeated rows are sequences of
    their own. No rows give no sequences. A very long text is as many sequences as it needs. Reruns over the same files with the
    same key agree. Other columns are not read. The numbers of sequences by partition, which the driver sums up, are as many as
    the input's partitions. With a ``folder``, the shards are written there and the rows are those read back (see ``stored``).
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "order")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = scratch.save("ids", slim.mapInArrow(lambda it: tokenised(it, vocabulary, length), "part int, first long, doc_id long, n long, ids binary"), compression="zstd")
    before, n = {}, 0
    for part, count in table.groupBy("part").agg(F.sum("n")).orderBy("part").collect():
        before[part] = n
        n += count
    stride = 2 * length
    each = max(1, SHARD_BYTES // stride)
    shards = max(1, -(-n // each))

    def ordered(first: int, last: int) -> DataFrame:
        """The rows of the shards from ``first`` to below ``last``."""
        low, high = first * each, min(n, last * each)
        rows = table.mapInArrow(lambda it: sequences(it, before, n, key, length, low, high), "slot long, doc_id long, piece long, n_tokens long, tokens binary")
        rows = rows.withColumn("shard", F.floor(F.col("slot") / each).cast("int"))
        together = -(-(last - first) // PARTITIONS)  # consecutive shards of a partition
        rows = rows.repartitionById(-(-(last - first) // together), F.expr(f"(shard - {first}) div {together}").cast("int")).sortWithinPartitions("slot")
        return rows.select("slot", "shard", ((F.col("slot") % each) * stride).alias("position"), "doc_id", "piece", "n_tokens", "tokens")

    if folder is None:
        return ordered(0, shards)
    out = stored(docs.sparkSession, ordered, folder, n, stride, each, key)
    scratch.drop("ids")
    return out


def _file_system(folder: str):
    """The file system of a folder that all executors reach (local, HDFS, object stores), and its path there."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return fs.LocalFileSystem(), folder


def _shard_name(shard: int) -> str:
    return f"shard-{shard:07d}.bin"


def _store(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes each shard's records, and beside them whose they are, when its last row is there; returns the number of records."""
    files, path = _file_system(folder)
    tag = TaskContext.get().taskAttemptId()
    held: list[pa.RecordBatch] = []

    def finish() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        shard = rows.column("shard")[0].as_py()
        name = f"{path}/{_shard_name(shard)}"
        with files.open_output_stream(f"{name}.rows.{tag}", compression=None) as out, pa.ipc.new_file(out, OWNERS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as table:
            table.write_table(rows.select(OWNERS.names).cast(OWNERS).combine_chunks())
        files.move(f"{name}.rows.{tag}", f"{name}.rows")
        with files.open_output_stream(f"{name}.{tag}", compression=None) as out:
            out.write(b"".join(rows.column("tokens").to_pylist()))
        files.move(f"{name}.{tag}", name)
        return pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int64())], ["records"])

    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column("shard")[0].as_py() != shards[a]:
                yield finish()
                held.clear()
            held.append(batch.slice(a, b - a))
    if held:
        yield finish()


def _read_shard(folder: str, shard: int, records: int, stride: int, each: int) -> Iterator[pa.RecordBatch]:
    """The rows of a stored shard, the tokens from its records."""
    files, path = _file_system(folder)
    name = f"{path}/{_shard_name(shard)}"
    with files.open_input_file(name) as back:
        raw = back.read()
    with files.open_input_file(f"{name}.rows") as back:
        owners = pa.ipc.open_file(back).read_all().combine_chunks()
    if len(raw) != stride * records or owners.num_rows != records:
        raise OSError(f"{name} has {len(raw)} bytes for {owners.num_rows} rows instead of {records} records of {stride}")
    tokens = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), records, [None, pa.py_buffer(raw)])
    for a in range(0, records, 1000):
        at = np.arange(a, min(records, a + 1000))
        own = [owners.column(c).chunk(0).slice(a, len(at)).cast(pa.int64()) for c in OWNERS.names]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard * each + at), pa.array(np.full(len(at), shard), pa.int32()), pa.array(at * stride), *own, tokens.slice(a, len(at)).cast(pa.binary())],
            ["slot", "shard", "position", *OWNERS.names, "tokens"],
        )


def stored(spark: SparkSession, ordered: Callable[[int, int], DataFrame], folder: str, n: int, stride: int, each: int, key: int) -> DataFrame:
    """Writes ``ordered`` as shards of bare records to a folder that all executors reach, and returns the rows as read back from there.

    The manifest comes first and states how many shards of what size a whole run has, so a reader sees what is missing or
    left over from a larger run. A shard appears when it is whole, and a repeated task writes the same bytes. Beside each
    shard a table has doc_id, piece and n_tokens of its records. Shards are written in PASSES jobs, so that the disk holds the
    ids, the shards and the shuffle of one pass; each pass reads all ids.
    """
    files, path = _file_system(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"sequences": n, "stride": stride, "per_shard": each, "key": key}).encode())
    shards = -(-n // each)
    step = max(1, -(-shards // PASSES))
    for first in range(0, shards, step):
        last = min(shards, first + step)
        written = ordered(first, last).mapInArrow(lambda it: _store(it, folder), "records long").agg(F.sum("records")).first()[0]
        if written != min(n, last * each) - first * each:
            raise OSError(f"{written} records were written to the shards from {first} to {last}")
        release(spark)  # and with it the pass's shuffle
    together = max(1, -(-shards // PARTITIONS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for shard in range(part * together, min(shards, (part + 1) * together)):
                    yield from _read_shard(folder, shard, min(each, n - shard * each), stride, each)

    parts = max(1, -(-shards // together))
    return spark.range(0, parts, 1, parts).mapInArrow(read, ROWS)


def read_slots(folder: str, slot: int = 0) -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on, in order. A missing or short shard raises; shards beyond the manifest's number are not read."""
    files, path = _file_system(folder)
    with files.open_input_stream(f"{path}/manifest.json") as text:
        manifest = json.loads(text.read())
    n, stride, each = manifest["sequences"], manifest["stride"], manifest["per_shard"]
    while slot < n:
        shard, skip = divmod(slot, each)
        records = min(each, n - shard * each)
        with files.open_input_file(f"{path}/{_shard_name(shard)}") as file:
            if file.size() != records * stride:
                raise ValueError(f"{_shard_name(shard)} has {file.size()} bytes instead of {records * stride}")
            file.seek(skip * stride)
            for _ in range(skip, records):
                yield np.frombuffer(file.read(stride), np.uint16)
        slot = (shard + 1) * each
