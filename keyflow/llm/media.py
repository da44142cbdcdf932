"""Media columns: texts stored as lossless WebP images, pixel arrays read back, and features of them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .tokens import text_bytes
from .scratch import small_batches

ROW = 192  # samples: a payload is whole rows of grey pixels
FILL = 32
ROWS = 4096  # of an image; a longer text makes several
TEXTS, BYTES = 1000, 2 << 20  # that are stored or read at once; a longer text is alone, and its images are taken a few at a time
VALUES = np.arange(256)


def payload(raw: bytes) -> bytes:
    rows = max(1, -(-len(raw) // ROW))
    return raw.ljust(rows * ROW, bytes([FILL]))


def _groups(values: Iterable, size: Callable = len) -> Iterator[list]:
    some: list = []
    total = 0
    for v in values:
        if some and (len(some) == TEXTS or total + size(v) > BYTES):
            yield some
            some, total = [], 0
        some.append(v)
        total += size(v)
    if some:
        yield some


def all_stored(raws: list[bytes]) -> list[bytes]:
    """Payloads as WebP files one after the other, of at most ROWS rows each. Each states its own length."""
    parts = [[p[at : at + ROWS] for at in range(0, len(p), ROWS)] for p in (np.frombuffer(payload(raw), np.uint8).reshape(-1, ROW) for raw in raws)]
    files = chain.from_iterable(webp.together(map(webp.encoding, some)) for some in _groups((p for some in parts for p in some), np.size))
    return [b"".join(islice(files, len(some))) for some in parts]


def stored(raw: bytes) -> bytes:
    return all_stored([raw])[0]


def all_images(medias: list[bytes]) -> list[list[np.ndarray]]:
    files: list[list[bytes]] = []
    for media in medias:
        files.append([])
        at = 0
        while at < len(media):
            size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
            files[-1].append(media[at : at + size])
            at += size
    pixels = chain.from_iterable(webp.together(map(webp.decoding, some)) for some in _groups(f for some in files for f in some))
    return [[*islice(pixels, len(some))] for some in files]


def images(media: bytes) -> list[np.ndarray]:
    return all_images([media])[0]


def samples(media: bytes) -> bytes:
    """The stored payload: the grey values of all pixels."""
    return b"".join(p[..., 0].tobytes() for p in images(media))


def feature(pixels: np.ndarray) -> str:
    """Width x height, mean and deviation in hundredths (rounded down), a histogram of eight ranges, and a 64-bit mean hash of
    an 8 x 8 grid (fewer bits for fewer rows)."""
    light = np.ascontiguousarray(pixels[..., 0])
    counts = np.bincount(light.ravel(), minlength=256)
    n, total, squares = light.size, int(counts @ VALUES), int(counts @ (VALUES * VALUES))
    mean = total * 100 // n
    deviation = int(max(0, squares * 10_000 // n - mean * mean) ** 0.5)
    ranges = counts.reshape(8, 32).sum(1)
    bands = np.add.reduceat(light, np.unique(np.arange(8) * light.shape[0] // 8), axis=0, dtype=np.int64)
    grid = np.add.reduceat(bands, np.arange(8) * light.shape[1] // 8, axis=1)
    bits = (grid * grid.size > grid.sum()).ravel()
    mark = int("".join("01"[int(b)] for b in bits), 2)
    return f"{pixels.shape[1]}x{pixels.shape[0]};mean={mean};dev={deviation};hist={','.join(map(str, ranges.tolist()))};hash={mark:016x}"


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = text_bytes(batch.column(1))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b].tobytes()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for raw in _groups(_texts(batch)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raw)), pa.array([len(x) for x in raw], pa.int64()), pa.array(all_stored(raw), pa.binary())], ["doc_id", "n_bytes", "media"])
            at += len(raw)


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))
    for batch in batches:
        for a in range(0, batch.num_rows, 100):
            some = batch.slice(a, 100)
            found = [[{"width": p.shape[1], "height": p.shape[0], "pixels": p.tobytes()} for p in parts] for parts in all_images(some.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, kind)], ["doc_id", "images"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for raws in _groups(_texts(batch)):
            medias = all_stored(raws)
            for raw, media, parts in zip(raws, medias, all_images(medias), strict=True):
                back = b"".join(p[..., 0].tobytes() for p in parts)
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), "|".join(map(feature, parts)))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def _slim(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as images, one row for each row of ``docs``.

    The text's UTF-8 bytes (null: none) and bytes 32 up to a positive multiple of 192 are the samples of a grey image with 192
    pixels to a row; a text of over 786,432 bytes makes several images. Equal texts have equal media. Other columns are not read.
    """
    return _slim(docs).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame) -> DataFrame:
    """doc_id, images (width, height, pixels: red, green, blue and alpha bytes) of a table with doc_id and media."""
    return media.select("doc_id", "media").mapInArrow(_load, "doc_id long, images array<struct<width: int, height: int, pixels: binary>>")


def digests(docs: DataFrame) -> DataFrame:
    """What is stored and what is read back from it, one row for each row of ``docs``: sizes, SHA-256 of payload and media, the CRC-32 of
    the payload's last 16 bytes, and the images' features.

    A null or empty text is one row of blanks; a null doc_id stays null; repeated rows give equal rows; no rows give none. A very
    long text makes several images. Other columns are not read.
    """
    return _slim(docs).mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
