"""String commands over whole requests: each takes a keyspace, a request and ``now_ns``.

Reads return replies; writes return replies and the next keyspace. The rows of a request act in the order of ``ord``; several
rows with one key act as if one command came after the other. A key of another type gives the wrong-type error, but to MGET nil.
A plain overwrite keeps the key's deadline, as do GETSET, MSET, SETRANGE, APPEND and the counters.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.values import byte_range, canonical, float_texts, overwrite, to_float, to_int
from ..model import NOT_FLOAT, NOT_INTEGER, NS, NS_MS, OK, OVERFLOW, SYNTAX, WRONG_TYPE, CommandError, Result, bulk, one_reply, replies
from ..plans.requests import changed, lookup, retimed, without, written


def by_key() -> WindowSpec:
    """A key's rows in order."""
    return Window.partitionBy("key").orderBy("ord")


def so_far() -> WindowSpec:
    """A key's rows up to this one."""
    return by_key().rowsBetween(Window.unboundedPreceding, 0)


BLOCKS = 4096
HOT = 100_000  # rows of a key that one task sorts


def running(frame: DataFrame, value: str, name: str) -> DataFrame:
    """``frame`` with the sum of an integer column over a key's rows up to each one, as the column ``name``.

    The ranges of ``ord`` by which the rows of a key are summed are chosen by a count: one range where no key has more than HOT rows,
    so that a plain window does. Else no task sorts more than a range of a key, and the sums of the ranges before, at most
    BLOCKS for a key, are added. Null where it overflows."""
    keys = frame.groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("low"), F.max("ord").alias("high"))
    most, low, high = keys.agg(F.max("n"), F.min("low"), F.max("high")).first()
    if most is None or most <= HOT:
        return frame.withColumn(name, F.try_sum(value).over(so_far()))
    width = (high - low) // BLOCKS + 1
    ranged = frame.withColumn("range", F.expr(f"(ord - {low}L) div {width}L"))
    sums = ranged.groupBy("key", "range").agg(F.try_sum(value).alias("sum"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "range", F.coalesce(F.try_sum("sum").over(earlier), F.lit(0)).alias("earlier"))
    inner = Window.partitionBy("key", "range").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.withColumn("inner", F.try_sum(value).over(inner)).join(sums, ["key", "range"])
    return here.withColumn(name, F.try_add("earlier", "inner")).drop("earlier", "inner", "range")


def is_string() -> Column:
    return ~F.col("found") | (F.col("vtype") == "string")


def _read(frame: DataFrame, kind: Column, ival: Column | None = None, text: Column | None = None) -> DataFrame:
    """Replies of reads, with the wrong-type error where it applies."""
    bad = ~is_string()
    text = F.lit(None).cast("binary") if text is None else text
    return replies(frame, F.when(bad, "error").otherwise(kind), None if ival is None else F.when(~bad, ival), F.when(bad, F.lit(WRONG_TYPE.encode())).otherwise(text))


def get(ks: DataFrame, request: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """GET: the value, or nil."""
    return _read(lookup(ks, request, now_ns, keys), bulk(F.col("val")), text=F.col("val"))


def mget(ks: DataFrame, request: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """MGET: a row for each argument, in any order; nil for missing keys and other types."""
    value = F.when(F.col("vtype") == "string", F.col("val"))
    return replies(lookup(ks, request, now_ns, keys), bulk(value), None, value)


def strlen(ks: DataFrame, request: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """STRLEN: bytes of the value, 0 where it is missing."""
    return _read(lookup(ks, request, now_ns, keys), F.lit("int"), F.coalesce(F.octet_length("val"), F.lit(0)))


def getrange(ks: DataFrame, request: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """GETRANGE: bytes ``start`` to ``end`` (request columns) of the value."""
    value = F.coalesce("val", F.lit(b"").cast("binary"))
    return _read(lookup(ks, request, now_ns, keys), F.lit("bulk"), text=byte_range(value, F.col("start"), F.col("end")))


def _deadline(now_ns: int, ex: int | None, px: int | None, exat: int | None, pxat: int | None) -> int | None:
    """Of the given time options; the last one named counts. Each must be positive, and the deadline a 64-bit number."""
    found = None
    for value, base, unit in ((ex, now_ns, NS), (px, now_ns, NS_MS), (exat, 0, NS), (pxat, 0, NS_MS)):
        if value is not None:
            found = base + value * unit
            if value <= 0 or found >= 1 << 63:
                raise CommandError(NOT_INTEGER)
    return found


def set_(ks: DataFrame, request: DataFrame, now_ns: int, *, ex: int | None = None, px: int | None = None, exat: int | None = None, pxat: int | None = None, keepttl: bool = False, nx: bool = False, xx: bool = False, get: bool = False) -> Result:
    """SET of ``val`` with options that hold for all rows. OK, or nil where NX or XX forbids it; with GET the value before.

    Without a time option the deadline stays; with KEEPTTL that of an existing key stays in any case."""
    if nx and xx:
        raise CommandError(SYNTAX)
    deadline = _deadline(now_ns, ex, px, exat, pxat)
    value, is_int = canonical(F.col("val"))
    source = request.select("ord", "key", value.alias("value"), is_int.alias("number"))
    done = F.lit(OK.encode())
    if not (nx or xx or get):  # nothing depends on what is there
        acting, out = source, replies(source, "status", None, done)
    else:
        held = lookup(ks, source, now_ns)
        if nx:
            held = held.withColumn("acts", ~F.col("found") & (F.row_number().over(by_key()) == 1))
        else:
            held = held.withColumn("acts", F.col("found") if xx else F.lit(True))
        acting = held.filter("acts")
        out = replies(held, F.when(F.col("acts"), "status").otherwise("nil"), None, F.when(F.col("acts"), done))
    if get:
        # What the last row before has written, else what the keyspace holds.
        last = F.last(F.when(F.col("acts"), F.col("value")), ignorenulls=True).over(by_key().rowsBetween(Window.unboundedPreceding, -1))
        wrong = F.col("found") & (F.col("vtype") != "string") & last.isNull()
        old = F.coalesce(last, "val")
        out = replies(held, F.when(wrong, "error").otherwise(bulk(old)), None, F.when(wrong, F.lit(WRONG_TYPE.encode())).otherwise(old))
    final = acting.groupBy("key").agg(F.max_by(F.struct("value", "number"), "ord").alias("w"))
    changes = changed(final, F.col("w.value"), F.col("w.number"), F.lit(deadline), deadline is None or keepttl)
    return Result(out, written(ks, changes, now_ns))


def setnx(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """SETNX: 1 where the key was missing and ``val`` is set, else 0."""
    out, state = set_(ks, request, now_ns, nx=True)
    return Result(replies(out, "int", (F.col("kind") == "status").cast("long")), state)


def _setex(ks: DataFrame, request: DataFrame, now_ns: int, unit: int, time: str) -> Result:
    deadline = F.try_add(F.lit(now_ns), F.try_multiply(time, F.lit(unit)))
    good = (F.col(time) > 0) & deadline.isNotNull()
    value, is_int = canonical(F.col("val"))
    final = request.filter(good).withColumns({"value": value, "number": is_int, "until": deadline}).groupBy("key").agg(F.max_by(F.struct("value", "number", "until"), "ord").alias("w"))
    out = replies(request, F.when(good, "status").otherwise("error"), None, F.when(good, F.lit(OK.encode())).otherwise(F.lit(NOT_INTEGER.encode())))
    return Result(out, written(ks, changed(final, F.col("w.value"), F.col("w.number"), F.col("w.until"), False), now_ns))


def setex(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """SETEX of ``val`` for ``seconds``, which must be positive."""
    return _setex(ks, request, now_ns, NS, "seconds")


def psetex(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """PSETEX of ``val`` for ``millis``, which must be positive."""
    return _setex(ks, request, now_ns, NS_MS, "millis")


def mset(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """MSET of all rows at once: OK; of a repeated key the last ``val`` stays."""
    return Result(one_reply(ks.sparkSession, "status", text=OK), set_(ks, request, now_ns).state)


def msetnx(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """MSETNX: 1 and all rows are set if no key exists, else 0 and none is. One plan: one row, if any key exists, rules out all."""
    held = lookup(ks, request.select("ord", "key", F.col("val").alias("new")), now_ns)
    free = held.agg((F.coalesce(F.sum(F.col("found").cast("int")), F.lit(0)) == 0).alias("free"))
    taken = held.filter("found").select(F.lit(0).alias("one")).limit(1)
    out = free.select(F.lit(0).cast("long").alias("ord"), F.lit(None).cast("binary").alias("key"), F.lit("int").alias("kind"), F.col("free").cast("long").alias("ival"), F.lit(None).cast("binary").alias("bulk"))
    value, is_int = canonical(F.col("new"))
    final = held.groupBy("key").agg(F.max_by("new", "ord").alias("new")).withColumn("one", F.lit(0)).join(taken, "one", "left_anti")
    return Result(out, written(ks, changed(final, value, is_int), now_ns))


def getset(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """GETSET: the value before ``val``."""
    return set_(ks, request, now_ns, get=True)


def getdel(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """GETDEL: the value, and the key goes; of a repeated key, nil from the second row on."""
    held = lookup(ks, request, now_ns).withColumn("turn", F.row_number().over(by_key()))
    wrong = ~is_string() & (F.col("turn") == 1)
    value = F.when(F.col("turn") == 1, F.col("val"))
    out = replies(held, F.when(wrong, "error").otherwise(bulk(value)), None, F.when(wrong, F.lit(WRONG_TYPE.encode())).otherwise(value))
    return Result(out, without(ks, request, now_ns))


def getex(ks: DataFrame, request: DataFrame, now_ns: int, *, ex: int | None = None, px: int | None = None, exat: int | None = None, pxat: int | None = None, persist: bool = False) -> Result:
    """GETEX: the value; its deadline is set or, with ``persist``, taken away. Without an option it stays."""
    deadline = _deadline(now_ns, ex, px, exat, pxat)
    state = ks
    if persist or deadline is not None:
        touched = request.select("key").distinct().select("key", F.lit(False).alias("gone"), F.lit(True).alias("retime"), F.lit(None if persist else deadline).cast("long").alias("new_deadline"))
        state = retimed(ks, touched, now_ns)
    return Result(get(ks, request, now_ns), state)


def setrange(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """SETRANGE of ``val`` at byte ``offset``: the new length. Zero bytes fill a gap, and an empty ``val`` makes a key as well.

    Rows of one key follow each other, so they are folded in order within the key."""
    held = lookup(ks, request.select("ord", "key", "offset", F.col("val").alias("part")), now_ns)
    valid = held.withColumn("bad", F.when(F.col("offset") < 0, NOT_INTEGER).when(~is_string(), WRONG_TYPE))
    steps = F.array_sort(F.collect_list(F.when(F.col("bad").isNull(), F.struct("ord", "offset", "part"))))
    empty = F.lit(b"").cast("binary")
    of_key = valid.groupBy("key").agg(F.first("val").alias("val"), steps.alias("steps"))
    after = F.aggregate("steps", F.coalesce("val", empty), lambda v, s: overwrite(v, s.offset, s.part))
    final = of_key.filter(F.size("steps") > 0).select("key", after.alias("after"))
    grown = F.greatest(F.coalesce(F.octet_length("val"), F.lit(0)), F.max(F.when(F.col("bad").isNull(), F.col("offset") + F.octet_length("part"))).over(so_far()))
    out = replies(valid.withColumn("grown", grown), F.when(F.col("bad").isNotNull(), "error").otherwise("int"), F.when(F.col("bad").isNull(), F.col("grown")), F.col("bad").cast("binary"))
    return Result(out, written(ks, changed(final, F.col("after"), F.lit(False)), now_ns))


def append(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """APPEND of ``val``: the new length. The result is text even where it spells a number. A null ``val`` is an error that changes nothing.

    The parts of a key are joined in one step, so many rows of one key aren't copied over and over."""
    held = lookup(ks, request.select("ord", "key", F.col("val").alias("part")), now_ns)
    bad = F.when(F.col("part").isNull(), SYNTAX).when(~is_string(), WRONG_TYPE)
    grown = running(held.withColumn("more", F.coalesce(F.octet_length("part"), F.lit(0)).cast("long")), "more", "added")
    size = F.coalesce(F.octet_length("val"), F.lit(0)) + F.col("added")
    out = replies(grown, F.when(bad.isNotNull(), "error").otherwise("int"), F.when(bad.isNull(), size), bad.cast("binary"))
    empty = F.lit(b"").cast("binary")
    of_key = held.filter(bad.isNull()).groupBy("key").agg(F.first("val").alias("val"), F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("parts"))
    after = F.concat(F.coalesce("val", empty), F.expr("unhex(array_join(transform(parts, p -> hex(p.part)), ''))"))
    return Result(out, written(ks, changed(of_key.select("key", after.alias("after")), F.col("after"), F.lit(False)), now_ns))


def incrby(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """INCRBY of ``delta``: the new number, from 0 where the key is missing. A row that would overflow changes nothing.

    Without an overflow in sight, the numbers are running sums by ranges of rows; keys where the sums' bounds leave 64
    bits are folded row by row."""
    held = lookup(ks, request, now_ns).withColumn("start", F.when(F.col("found"), F.when(F.col("vtype") == "string", to_int(F.col("val")))).otherwise(F.lit(0)))
    error = F.when(~is_string(), WRONG_TYPE).when(F.col("start").isNull(), NOT_INTEGER)
    held = held.withColumn("error", error)
    wide = F.col("delta").cast("decimal(20,0)")
    bounds = held.filter("error is null").groupBy("key").agg(F.first("start").alias("start"), F.sum(F.when(wide > 0, wide).otherwise(0)).alias("up"), F.sum(F.when(wide < 0, wide).otherwise(0)).alias("down"), F.sum(wide).alias("sum"))
    base = F.col("start").cast("decimal(38,0)")
    safe = (base + F.col("up") <= (1 << 63) - 1) & (base + F.col("down") >= -(1 << 63))
    bounds = bounds.withColumn("safe", safe)
    bounds = bounds.withColumn("now", (F.col("start") + F.col("sum")).cast("long"))
    if bounds.filter("not safe").isEmpty():
        calm, folded = held, None
    else:
        unsafe = bounds.filter("not safe").select("key")
        calm = held.join(unsafe, "key", "left_anti")
        folded = _step_by_step(held.filter("error is null").join(unsafe, "key", "left_semi"))
    calm = running(calm, "delta", "added").withColumn("now", F.when(F.col("error").isNull(), F.col("start") + F.col("added")))
    out = replies(calm, F.when(F.col("error").isNull(), "int").otherwise("error"), F.col("now"), F.col("error").cast("binary"))
    final = bounds.filter("safe").select("key", F.col("now").alias("v"))
    if folded is not None:
        out = out.unionByName(replies(folded, F.when(F.col("failed"), "error").otherwise("int"), F.when(~F.col("failed"), F.col("value")), F.when(F.col("failed"), F.lit(OVERFLOW.encode()))))
        final = final.unionByName(folded.groupBy("key").agg(F.max_by("value", "ord").alias("v")))
    return Result(out, written(ks, changed(final, F.col("v").cast("string").cast("binary"), F.lit(True)), now_ns))


def _step_by_step(rows: DataFrame) -> DataFrame:
    """ord, key, value, failed of rows (key, ord, start, delta): numbers of 64 bits, where a row that would overflow changes nothing.
    A key's rows come sorted, in Arrow batches, and one number is carried on."""

    def fold(batches):
        last, number = None, 0
        for batch in batches:
            keys, deltas, starts = (batch.column(c).to_pylist() for c in ("key", "delta", "start"))
            values, failed = [], []
            for key, delta, start in zip(keys, deltas, starts, strict=True):
                if key != last:
                    last, number = key, start
                after = number + delta if delta is not None else 1 << 63
                bad = not -(1 << 63) <= after < 1 << 63
                number = number if bad else after
                values.append(number)
                failed.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("key"), pa.array(values, pa.int64()), pa.array(failed, pa.bool_())], ["ord", "key", "value", "failed"])

    rows = rows.select("ord", "key", "start", "delta")
    kind = f"ord {rows.schema['ord'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, value long, failed boolean"
    return rows.repartition("key").sortWithinPartitions("key", "ord").mapInArrow(fold, kind)


def incr(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """INCR: by one."""
    return incrby(ks, request.select("ord", "key", F.lit(1).cast("long").alias("delta")), now_ns)


def decr(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """DECR: by minus one."""
    return incrby(ks, request.select("ord", "key", F.lit(-1).cast("long").alias("delta")), now_ns)


def decrby(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """DECRBY of ``delta``. The least 64-bit number has no opposite and is refused."""
    least = F.col("delta") == -(1 << 63)
    out, state = incrby(ks, request.filter(~least).select("ord", "key", (-F.col("delta")).alias("delta")), now_ns)
    return Result(out.unionByName(replies(request.filter(least), "error", None, F.lit(NOT_INTEGER.encode()))), state)


def incrbyfloat(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """INCRBYFLOAT of ``delta`` (a double): the new number's shortest text, which is also stored. The sums of a key are taken in order.

    A value that is no number, and a sum that is not finite, is an error; after such a sum, a key's later rows of the same request
    are errors as well (replay them one by one to go on from the last good value)."""
    held = lookup(ks, request, now_ns).withColumn("start", F.when(F.col("found"), F.when(F.col("vtype") == "string", to_float(F.col("val")))).otherwise(F.lit(0.0)))
    total = F.col("start") + F.sum("delta").over(so_far())
    held = held.withColumn("total", total)
    finite = F.abs("total") < float("inf")
    error = F.when(~is_string(), WRONG_TYPE).when(F.col("start").isNull() | ~finite | F.col("total").isNull(), NOT_FLOAT)
    held = held.withColumn("error", error).withColumn("shown", F.when(F.col("error").isNull(), float_texts(F.col("total"))).cast("binary"))
    out = replies(held, F.when(F.col("error").isNull(), "bulk").otherwise("error"), None, F.coalesce("shown", F.col("error").cast("binary")))
    final = held.filter("error is null").groupBy("key").agg(F.max_by("shown", "ord").alias("v"))
    return Result(out, written(ks, changed(final, F.col("v"), F.lit(False)), now_ns))
