"""How a request meets a keyspace: as a predicate, as a join, or as a full outer join that writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYSPACE, binary, live

FEW = 1000  # keys that become an IN list, which the scan can use
STATE = [c.split()[0] for c in KEYSPACE.split(", ")]


def narrowed(ks: DataFrame, keys: list[bytes | str] | None) -> DataFrame:
    """The keyspace's rows that a request of these literal keys can meet."""
    if keys is None or len(set(keys)) > FEW:
        return ks
    return ks.filter(F.col("key").isin([binary(k) for k in dict.fromkeys(keys)])) if keys else ks.limit(0)


def lookup(ks: DataFrame, request: DataFrame, now_ns: int, keys: list[bytes | str] | None = None) -> DataFrame:
    """Each request row with its key's live row: vtype, val, is_int, deadline_ns, and found. Repeated keys are repeated. Request columns with these names are
    left out (rename them before).

    Which side is broadcast, if any, is left to the optimizer, which knows their sizes."""
    held = live(narrowed(ks, keys), now_ns).select(*STATE, F.lit(True).alias("found"))
    own = request.select(*[c for c in request.columns if c == "key" or c not in held.columns])
    return own.join(held, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def written(ks: DataFrame, changes: DataFrame, now_ns: int) -> DataFrame:
    """The next keyspace: ``changes`` has one row for each key, with new_val, new_is_int, new_deadline, and keep (the old deadline stays
    where there is one); a null new_val leaves the old row as it is. One full outer join."""
    held = live(ks, now_ns).select(*STATE)
    both = held.withColumn("old", F.lit(True)).join(changes.select("key", "new_val", "new_is_int", "new_deadline", "keep"), "key", "full")
    write = F.col("new_val").isNotNull()
    kept = F.when(F.coalesce("keep", F.lit(False)) & F.col("old"), F.col("deadline_ns")).otherwise(F.col("new_deadline"))
    return both.filter(F.col("old") | write).select(
        "key",
        F.when(write, "string").otherwise(F.col("vtype")).alias("vtype"),
        F.when(write, F.col("new_val")).otherwise(F.col("val")).alias("val"),
        F.when(write, F.col("new_is_int")).otherwise(F.col("is_int")).alias("is_int"),
        F.when(write, kept).otherwise(F.col("deadline_ns")).alias("deadline_ns"),
    )


def changed(frame: DataFrame, val: Column, is_int: Column, deadline: Column | None = None, keep: bool | Column = True) -> DataFrame:
    """A row of ``written``'s changes."""
    return frame.select(
        "key",
        val.alias("new_val"),
        is_int.alias("new_is_int"),
        (F.lit(None) if deadline is None else deadline).cast("long").alias("new_deadline"),
        (F.lit(keep) if isinstance(keep, bool) else keep).alias("keep"),
    )


def without(ks: DataFrame, keys: DataFrame, now_ns: int) -> DataFrame:
    """The live rows whose key isn't among ``keys``."""
    return live(ks, now_ns).join(keys.select("key").distinct(), "key", "left_anti").select(*STATE)


def retimed(ks: DataFrame, changes: DataFrame, now_ns: int) -> DataFrame:
    """The next keyspace where ``changes`` (key, gone, retime, new_deadline), a row for each key, deletes rows or sets deadlines."""
    both = live(ks, now_ns).join(changes.select("key", "gone", "retime", "new_deadline"), "key", "left")
    both = both.filter(~F.coalesce("gone", F.lit(False)))
    return both.withColumn("deadline_ns", F.when(F.coalesce("retime", F.lit(False)), F.col("new_deadline")).otherwise(F.col("deadline_ns"))).select(*STATE)
