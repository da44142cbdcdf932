"""The wire protocol: bytes to commands, replies to bytes.

The decoder takes arrays of bulk strings (and of the protocol's other scalars), and inline commands: lines of words parted by
spaces. It stops before an incomplete command, and raises on bytes that break the protocol.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits of a command.
MOST_ITEMS, MOST_DEPTH, MOST_BYTES = 1_048_576, 32, 512 << 20
END = b"\r\n"


class ProtocolError(ValueError):
    pass


class Incomplete(Exception):
    """More bytes are needed."""


def _line(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(END, at)
    if end < 0:
        raise Incomplete
    return data[at:end], end + 2


def _size(text: bytes, most: int) -> int:
    if not text.removeprefix(b"-").removeprefix(b"+").isdigit():
        raise ProtocolError("a length is not a number")
    n = int(text)
    if n < -1 or n > most:
        raise ProtocolError("a length is out of range")
    return n


def value(data: bytes, at: int, depth: int = 0):
    """The value at a place and the place after it: bytes, an integer, None, True or False, a float, or a list."""
    if depth > MOST_DEPTH:
        raise ProtocolError("values are nested too deeply")
    if at >= len(data):
        raise Incomplete
    kind = data[at : at + 1]
    text, at = _line(data, at + 1)
    if kind in b"+-(":
        return text, at
    if kind == b":":
        if not text.lstrip(b"+-").isdigit():
            raise ProtocolError("an integer is not a number")
        return int(text), at
    if kind in b"$=!":
        n = _size(text, MOST_BYTES)
        if n < 0:
            return None, at
        if len(data) < at + n + 2:
            raise Incomplete
        if data[at + n : at + n + 2] != END:
            raise ProtocolError("a string is longer than stated")
        return data[at : at + n], at + n + 2
    if kind in b"*~>%|":
        n = _size(text, MOST_ITEMS)
        if n < 0:
            return None, at
        items = []
        for _ in range(2 * n if kind in b"%|" else n):
            item, at = value(data, at, depth + 1)
            items.append(item)
        return items, at
    if kind == b"_":
        return None, at
    if kind == b"#":
        if text not in (b"t", b"f"):
            raise ProtocolError("not a boolean")
        return text == b"t", at
    if kind == b",":
        try:
            return float(text), at
        except ValueError as error:
            raise ProtocolError("not a number") from error
    raise ProtocolError("an unknown type")


def commands(data: bytes) -> Iterator[list[bytes]]:
    """The complete commands in a buffer: the name and its arguments."""
    at = 0
    while at < len(data):
        try:
            if data[at : at + 1] in (b"*", b"$", b"+", b"-", b":", b"_", b"#", b",", b"(", b"!", b"=", b"%", b"~", b">", b"|"):
                found, at = value(data, at)
                words = [w if isinstance(w, bytes) else str(w).encode() for w in found if w is not None] if isinstance(found, list) else []
            else:
                line, at = _line(data, at)
                words = line.split()
        except Incomplete:
            return
        if words:
            yield words


def decode(raw: DataFrame) -> DataFrame:
    """id, n, name, args, error: the commands of each row (id, bytes) in order; a row that breaks the protocol ends with the error."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                n = 0
                try:
                    for n, (name, *args) in enumerate(commands(bytes(r.bytes) if r.bytes is not None else b""), 1):
                        rows.append((r.id, n - 1, name.decode("latin-1").upper(), args, None))
                except ProtocolError:
                    rows.append((r.id, n, None, None, "ERR protocol error"))
            yield pd.DataFrame(rows, columns=["id", "n", "name", "args", "error"])

    return raw.select(F.col("id").cast("string").alias("id"), "bytes").mapInPandas(batches, "id string, n int, name string, args array<binary>, error string")


def command_bytes(words: list[bytes]) -> bytes:
    return b"*%d\r\n" % len(words) + b"".join(b"$%d\r\n%b\r\n" % (len(w), w) for w in words)


def encoded(kind: Column, ival: Column, bulk: Column, items: Column) -> Column:
    """The bytes of a reply row."""
    raw = lambda text: F.lit(text.encode())
    digits = lambda n: n.cast("string").cast("binary")
    string = lambda b: F.coalesce(F.concat(raw("$"), digits(F.octet_length(b)), raw("\r\n"), b, raw("\r\n")), raw("$-1\r\n"))
    array = F.concat(raw("*"), digits(F.size(items)), raw("\r\n"), F.aggregate(F.transform(items, string), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)))
    return (
        F.when(kind == "status", F.concat(raw("+"), bulk, raw("\r\n")))
        .when(kind == "error", F.concat(raw("-"), bulk, raw("\r\n")))
        .when(kind == "int", F.concat(raw(":"), digits(ival), raw("\r\n")))
        .when(kind == "nil", raw("$-1\r\n"))
        .when(kind == "bulk", string(bulk))
        .when(kind == "array", array)
    )
