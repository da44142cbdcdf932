"""Keyspaces and command logs derived from tables, and keyspaces as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEYSPACE

DAY_NS = 86_400_000_000_000
NOW_NS = 899_251_200_000_000_000  # 1998-07-01, among the orders' dates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    """Microseconds of a timestamp; one without a zone is read in the session's zone, which should be UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def strings(frame: DataFrame, key, val, is_int, deadline=None) -> DataFrame:
    return frame.select(key.cast("binary").alias("key"), F.lit("string").alias("vtype"), val.cast("binary").alias("val"), F.lit(is_int).alias("is_int"), (F.lit(None) if deadline is None else deadline).cast("long").alias("deadline_ns"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order:<key>: the price in cents; two of three with a deadline."""
    until = micros("o_orderdate") * 1000 + (F.col("o_orderkey") % 365) * DAY_NS
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    return strings(table(spark, sf_dir, "orders"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), cents, True, F.when(F.col("o_orderkey") % 3 != 0, until))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer:<nation>:<key>: the name."""
    key = F.concat_ws(":", F.lit("customer"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    return strings(table(spark, sf_dir, "customer"), key, F.col("c_name"), False)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part:<key>: the name; odd sizes have a deadline a day after NOW_NS."""
    return strings(table(spark, sf_dir, "part"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), F.col("p_name"), False, F.when(F.col("p_size") % 2 == 1, NOW_NS + DAY_NS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc:<id>: the text."""
    return strings(table(spark, sf_dir, "documents"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.col("text"), False)


def event_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command log of events: signup sets and view gets user:<id>, click counts clicks:<id>, purchase adds to spend:<id>, error
    deletes all three. ``seq`` is the place in the order of (ts, event_id), made of both."""
    user = F.col("user_id").cast("string")
    key = lambda kind: F.concat(F.lit(f"{kind}:"), user).cast("binary")
    text = lambda c: c.cast("string").cast("binary")
    kind = F.col("event_type")
    name = F.when(kind == "signup", "SET").when(kind == "view", "GET").when(kind == "click", "INCR").when(kind == "purchase", "INCRBYFLOAT").when(kind == "error", "DEL")
    args = (
        F.when(kind == "signup", F.array(key("user"), text(F.col("event_id"))))
        .when(kind == "view", F.array(key("user")))
        .when(kind == "click", F.array(key("clicks")))
        .when(kind == "purchase", F.array(key("spend"), text(F.col("value"))))
        .when(kind == "error", F.array(key("user"), key("clicks"), key("spend")))
    )
    at = micros("ts")
    events = table(spark, sf_dir, "events").filter(name.isNotNull())
    # Events of one microsecond follow their ids; seq is unique where no two of one microsecond have ids that agree in 11 bits.
    seq = (at - 1_600_000_000_000_000) * 2048 + F.pmod("event_id", F.lit(2048))
    return events.select(seq.alias("seq"), F.col("user_id").cast("long").alias("conn_id"), (at * 1000).alias("now_ns"), name.alias("name"), args.alias("args"))


def save(ks: DataFrame, name: str, buckets: int, mode: str = "overwrite") -> None:
    """A table bucketed and sorted by key, so that bulk reads and writes by key move only the request."""
    ks.write.mode(mode).bucketBy(buckets, "key").sortBy("key").saveAsTable(name)


def save_files(ks: DataFrame, path: str) -> None:
    """Parquet files in key ranges, so that prefixes and key lists skip row groups."""
    ks.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def load_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KEYSPACE).parquet(path)
