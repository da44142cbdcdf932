"""The data model: a keyspace, requests, replies, and the fixed texts of replies.

keyspace : key BINARY, vtype STRING, val BINARY, is_int BOOLEAN, deadline_ns BIGINT (null: never)
request  : ord BIGINT, key BINARY, and an operator's operands as columns
replies  : ord BIGINT, key BINARY, kind STRING, ival BIGINT, bulk BINARY
commands : seq BIGINT, conn_id BIGINT, now_ns BIGINT, name STRING, args ARRAY<BINARY>

A keyspace is immutable: an operator takes one and returns replies and the next one. ``now_ns`` is always given, and every
operator starts from the rows that are alive then, so results never depend on a clock or on when expired rows were swept.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NS = 1_000_000_000
NS_MS = 1_000_000

KEYSPACE = "key binary, vtype string, val binary, is_int boolean, deadline_ns long"
REPLIES = "ord long, key binary, kind string, ival long, bulk binary"
COMMANDS = "seq long, conn_id long, now_ns long, name string, args array<binary>"

# What the protocol says.
OK = "OK"
PONG = "PONG"
WRONG_TYPE = "WRONGTYPE Operation against a key holding the wrong kind of value"
SYNTAX = "ERR syntax error"
NOT_INTEGER = "ERR value is not an integer or out of range"
NOT_FLOAT = "ERR value is not a valid float"
OVERFLOW = "ERR increment or decrement would overflow"
NO_SUCH_KEY = "ERR no such key"
WRONG_ARGS = "ERR wrong number of arguments"
WRONG_ARITY = "ERR wrong number of arguments for command"
UNKNOWN = "ERR unknown command"
NOT_IMPLEMENTED = "ERR command not yet implemented"
PROTOCOL = "ERR protocol error"
DB_INDEX = "ERR DB index is out of range"
MULTI_STUB = "ERR MULTI/EXEC is not yet implemented"
EXEC_STUB = "ERR EXEC without MULTI"
DISCARD_STUB = "ERR DISCARD without MULTI"


class Result(NamedTuple):
    replies: DataFrame
    state: DataFrame


class CommandError(ValueError):
    """An operator's options are not valid; the text is the reply."""


def alive(now_ns: int) -> Column:
    return F.col("deadline_ns").isNull() | (F.col("deadline_ns") > F.lit(now_ns))


def live(ks: DataFrame, now_ns: int) -> DataFrame:
    """The rows that are not expired: a filter on a literal, which reaches the scan."""
    return ks.filter(alive(now_ns))


def binary(value: bytes | str) -> Column:
    return F.lit(value.encode() if isinstance(value, str) else value).cast("binary")


def bulk(value: Column) -> Column:
    return F.when(value.isNull(), "nil").otherwise("bulk")


def replies(frame: DataFrame, kind: Column | str, ival: Column | None = None, text: Column | None = None) -> DataFrame:
    """Reply rows; ``kind`` is int, bulk, status, error or nil."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return frame.select("ord", "key", kind.alias("kind"), (F.lit(None) if ival is None else ival).cast("long").alias("ival"), (F.lit(None) if text is None else text).cast("binary").alias("bulk"))


def one_reply(spark: SparkSession, kind: str, ival: int | None = None, text: str | bytes | None = None) -> DataFrame:
    text = text.encode() if isinstance(text, str) else text
    return spark.createDataFrame([(0, None, kind, ival, text)], REPLIES)


def request(spark: SparkSession, rows: Iterable, operands: str = "") -> DataFrame:
    """A request frame of literal rows: keys, or tuples of a key and its operands (``operands``: their schema)."""
    as_bytes = lambda v: v.encode() if isinstance(v, str) else v
    rows = [(r,) if isinstance(r, (str, bytes)) else tuple(r) for r in rows]
    schema = "ord long, key binary" + (f", {operands}" if operands else "")
    return spark.createDataFrame([(i, *map(as_bytes, r)) for i, r in enumerate(rows)], schema)


def keyspace(spark: SparkSession, entries: dict | Iterable[tuple]) -> DataFrame:
    """A keyspace of literal values (bytes, text or integers), or of (key, value, deadline_ns) tuples."""
    rows = []
    for key, value, *deadline in ((k, v) for k, v in entries.items()) if isinstance(entries, dict) else entries:
        text = str(value).encode() if isinstance(value, int) else value.encode() if isinstance(value, str) else value
        rows.append((key.encode() if isinstance(key, str) else key, "string", text, isinstance(value, int), deadline[0] if deadline else None))
    return spark.createDataFrame(rows, KEYSPACE)
