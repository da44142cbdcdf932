"""Server and connection commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DB_INDEX, DISCARD_STUB, EXEC_STUB, MULTI_STUB, OK, PONG, Result, live, one_reply
from ..plans.commands import command_table, listed

VERSION = "0.1.0"


def ping(spark: SparkSession, message: bytes | str | None = None) -> DataFrame:
    """PING: PONG, or the message."""
    return one_reply(spark, "status", text=PONG) if message is None else one_reply(spark, "bulk", text=message)


def echo(spark: SparkSession, message: bytes | str) -> DataFrame:
    """ECHO: the message."""
    return one_reply(spark, "bulk", text=message)


def quit_(spark: SparkSession) -> DataFrame:
    """QUIT: OK; a replay ignores what follows on the connection."""
    return one_reply(spark, "status", text=OK)


def select(spark: SparkSession, index: bytes | str) -> DataFrame:
    """SELECT: there is database 0 alone."""
    good = index in (b"0", "0")
    return one_reply(spark, "status" if good else "error", text=OK if good else DB_INDEX)


def time(spark: SparkSession) -> DataFrame:
    """TIME: seconds and microseconds of the wall clock."""
    return spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("t")).select(F.expr("t div 1000000").alias("seconds"), F.expr("t % 1000000").alias("micros"))


def multi(spark: SparkSession) -> DataFrame:
    """MULTI, and WATCH: not implemented, as known."""
    return one_reply(spark, "error", text=MULTI_STUB)


watch = multi


def exec_(spark: SparkSession) -> DataFrame:
    """EXEC outside a transaction."""
    return one_reply(spark, "error", text=EXEC_STUB)


def discard(spark: SparkSession) -> DataFrame:
    """DISCARD outside a transaction."""
    return one_reply(spark, "error", text=DISCARD_STUB)


def unwatch(spark: SparkSession) -> DataFrame:
    """UNWATCH: OK."""
    return one_reply(spark, "status", text=OK)


def dbsize(ks: DataFrame, now_ns: int, swept: bool = True) -> DataFrame:
    """DBSIZE: the number of keys; with ``swept=False`` expired rows that are still there count."""
    return (live(ks, now_ns) if swept else ks).agg(F.count("*").alias("dbsize"))


def flushdb(ks: DataFrame) -> Result:
    """FLUSHDB and FLUSHALL: OK, and an empty keyspace."""
    return Result(one_reply(ks.sparkSession, "status", text=OK), ks.limit(0))


flushall = flushdb


def info_keyspace(ks: DataFrame, now_ns: int) -> DataFrame:
    """keys and expires (keys with a deadline), one row."""
    return live(ks, now_ns).agg(F.count("*").alias("keys"), F.count("deadline_ns").alias("expires"))


def info(ks: DataFrame, now_ns: int, section: str = "all") -> DataFrame:
    """INFO: a text of the sections server, clients, memory and keyspace, or one of them."""
    every = section.lower() in ("all", "everything")
    parts = [
        ("server", F.lit(f"# Server\r\nversion:{VERSION}\r\narch_bits:64\r\n\r\n")),
        ("clients", F.lit("# Clients\r\nconnected_clients:0\r\n\r\n")),
        ("memory", F.lit("# Memory\r\nused_memory:0\r\nused_memory_human:0B\r\n\r\n")),
        ("keyspace", F.concat(F.lit("# Keyspace\r\n"), F.when(F.col("keys") > 0, F.concat(F.lit("db0:keys="), F.col("keys"), F.lit(",expires="), F.col("expires"), F.lit(",avg_ttl=0\r\n"))).otherwise(""), F.lit("\r\n"))),
    ]
    chosen = [text for name, text in parts if every or name == section.lower()]
    return info_keyspace(ks, now_ns).select(F.concat(F.lit(""), *chosen).alias("info"))


def command(spark: SparkSession) -> DataFrame:
    """COMMAND: a row for each listed command (one is listed twice)."""
    names = spark.createDataFrame([(n,) for n in listed()], "name string")
    return _shown(names.join(F.broadcast(command_table(spark)), "name"))


def command_count(spark: SparkSession) -> DataFrame:
    """COMMAND COUNT: how many commands are listed."""
    return command(spark).agg(F.count("*").alias("commands"))


def command_info(spark: SparkSession, names: list[str]) -> DataFrame:
    """COMMAND INFO: a row for each name in any case, with nulls for unknown ones."""
    asked = spark.createDataFrame([*enumerate(names)], "ord int, asked string")
    known = F.broadcast(_shown(command_table(spark)))
    return asked.join(known, F.upper("asked") == F.col("name"), "left").drop("asked")


def command_docs(spark: SparkSession) -> DataFrame:
    """COMMAND DOCS, LIST and GETKEYS: nothing."""
    return spark.createDataFrame([], "name string")


command_list = command_getkeys = command_docs


def _shown(table: DataFrame) -> DataFrame:
    flags = F.transform("flags", lambda f: F.when(f == "read", "readonly").otherwise(f))
    return table.select("name", "arity", F.filter(flags, lambda f: f != "-").alias("flags"), "first_key", "last_key", "step")
