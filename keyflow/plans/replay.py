"""Replaying a command log in order.

Commands on one key commute with those on other keys, so a log is dealt by key and folded in order of ``seq`` within the key, a
batch of rows at a time. Commands on several keys that act key by key are dealt as parts. Commands that read or write the
whole keyspace, or keys together, are barriers: the log before one is folded, then the operator runs, then the log goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DB_INDEX, DISCARD_STUB, EXEC_STUB, KEYSPACE, MULTI_STUB, NOT_IMPLEMENTED, OK, PONG, SYNTAX, UNKNOWN, WRONG_ARITY, Result, live, request
from ..operators import keys as key_ops
from ..operators import server as server_ops
from ..operators import strings as string_ops
from . import fold
from .commands import command_table, listed
from .cut import cut
from .requests import STATE

REPLIED = "seq long, kind string, ival long, bulk binary, items array<binary>"
FOLDED = f"tag string, seq long, sub int, name string, kind string, ival long, bulk binary, {KEYSPACE}"
MANY = ("MGET", "DEL", "UNLINK", "EXISTS", "TOUCH")
BARRIERS = ("MSETNX", "RENAME", "RENAMENX", "COPY", "KEYS", "SCAN", "RANDOMKEY", "DBSIZE", "FLUSHDB", "FLUSHALL", "INFO")
SINGLE = tuple(n for n in fold.COMMANDS if n not in (*MANY, "MSET"))


def reply_rows(frame: DataFrame, kind, ival=None, bulk=None, items=None) -> DataFrame:
    null = F.lit(None)
    return frame.select("seq", kind.alias("kind"), (null if ival is None else ival).cast("long").alias("ival"), (null if bulk is None else bulk).cast("binary").alias("bulk"), (null if items is None else items).cast("array<binary>").alias("items"))


def resolved(commands: DataFrame) -> DataFrame:
    """The log with upper-case names, without what follows a connection's QUIT, and with the error of commands that can't run."""
    named = commands.withColumn("name", F.upper("name"))
    last = named.filter("name = 'QUIT'").groupBy("conn_id").agg(F.min("seq").alias("quit"))
    named = named.join(last, "conn_id", "left").filter("quit is null or seq <= quit").drop("quit")
    table = F.broadcast(command_table(commands.sparkSession).select("name", "arity", "runs"))
    n = F.size("args") + 1
    error = (
        F.when(F.col("arity").isNull(), UNKNOWN)
        .when(F.when(F.col("arity") >= 0, n != F.col("arity")).otherwise(n < -F.col("arity")), WRONG_ARITY)
        .when(~F.col("runs"), NOT_IMPLEMENTED)
        .when((F.col("name") == "MSET") & (F.size("args") % 2 == 1), SYNTAX)
        .when((F.col("name") == "MSETNX") & (F.size("args") % 2 == 1), SYNTAX)
    )
    return named.join(table, "name", "left").withColumn("error", error).drop("arity", "runs")


def parts(commands: DataFrame) -> DataFrame:
    """seq, sub, now_ns, name, key and args of each key that a command touches."""
    single = commands.filter(F.col("name").isin(*SINGLE)).select("seq", F.lit(0).alias("sub"), "now_ns", "name", F.get("args", F.lit(0)).alias("key"), F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0))).alias("args"))
    many = commands.filter(F.col("name").isin(*MANY)).select("seq", "now_ns", "name", F.posexplode("args").alias("sub", "key")).select("seq", "sub", "now_ns", "name", "key", F.array().cast("array<binary>").alias("args"))
    pair = F.transform(F.sequence(F.lit(0), F.expr("size(args) div 2 - 1")), lambda i: F.struct(F.get("args", i * 2).alias("key"), F.get("args", i * 2 + 1).alias("value")))
    mset = commands.filter("name = 'MSET'").select("seq", "now_ns", "name", F.posexplode(pair).alias("sub", "pair")).select("seq", "sub", "now_ns", "name", F.col("pair.key").alias("key"), F.array("pair.value").alias("args"))
    return single.unionByName(many).unionByName(mset)


def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, seq and sub; a key's row with a null name is its entry before."""
    names = [c.split()[0] for c in FOLDED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.bool_(), pa.int64()]
    key: bytes | None = None
    entry: fold.Entry | None = None

    def state() -> list[tuple]:
        return [("state", None, None, None, None, None, None, key, "string", *entry)] if key is not None and entry else []

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if r["key"] != key:
                out += state()
                key, entry = r["key"], None
            if r["name"] is None:
                entry = fold.Entry(r["val"], r["is_int"], r["deadline_ns"])
            else:
                reply, entry = fold.step(entry, r["name"], r["args"], r["now_ns"])
                out.append(("reply", r["seq"], r["sub"], r["name"], *reply, key, None, None, None, None))
        if out:
            yield table(out)
    if rows := state():
        yield table(rows)


def folded(ks: DataFrame, commands: DataFrame, keep: bool) -> Result:
    """Replies to the commands, which are no barriers, and the keyspace after them. Keys without commands are passed by in the JVM.
    With ``keep`` the fold is done now and kept for both."""
    touched = parts(commands)
    asked = touched.select("key").distinct()
    before = ks.join(asked, "key", "left_semi").filter("vtype = 'string'").select(F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("sub"), F.lit(None).cast("long").alias("now_ns"), F.lit(None).cast("string").alias("name"), "key", F.lit(None).cast("array<binary>").alias("args"), "val", "is_int", "deadline_ns")
    rows = touched.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("val", "binary"), ("is_int", "boolean"), ("deadline_ns", "long")))).unionByName(before)
    out = rows.repartition("key").sortWithinPartitions("key", "seq", "sub").mapInArrow(fold_batches, FOLDED)
    out = cut(out) if keep else out
    found = out.filter("tag = 'reply'")
    several = found.filter(F.col("name").isin(*MANY, "MSET")).groupBy("seq", "name").agg(F.sum("ival").alias("ival"), F.array_sort(F.collect_list(F.struct("sub", "bulk"))).alias("items"))
    kind = F.when(F.col("name") == "MGET", "array").when(F.col("name") == "MSET", "status").otherwise("int")
    replied = reply_rows(found.filter(F.col("name").isin(*SINGLE)), F.col("kind"), F.col("ival"), F.col("bulk")).unionByName(
        reply_rows(several, kind, F.when(kind == "int", F.col("ival")), F.when(kind == "status", F.lit(OK.encode())), F.when(kind == "array", F.col("items.bulk")))
    )
    state = ks.join(asked, "key", "left_anti").select(*STATE).unionByName(out.filter("tag = 'state'").select(*STATE))
    return Result(replied, state)


def connection(commands: DataFrame) -> DataFrame:
    """Replies of commands that touch no key."""
    name, args = F.col("name"), F.col("args")
    first = F.get("args", F.lit(0))
    sub = F.upper(F.coalesce(F.decode(first, "ISO-8859-1"), F.lit("")))
    wrong = F.lit(None).cast("string")
    error = F.when(name.isin("MULTI", "WATCH"), MULTI_STUB).when(name == "EXEC", EXEC_STUB).when(name == "DISCARD", DISCARD_STUB).when((name == "SELECT") & (first != F.lit(b"0")), DB_INDEX).otherwise(wrong)
    echo = F.when((name == "ECHO") | ((name == "PING") & (F.size(args) > 0)), first)
    status = F.when(name == "PING", PONG).when(name.isin("QUIT", "SELECT", "UNWATCH"), OK)
    count = F.when((name == "COMMAND") & (sub == "COUNT"), F.lit(len(listed())))
    kind = F.when(error.isNotNull(), "error").when(echo.isNotNull(), "bulk").when(status.isNotNull(), "status").when(count.isNotNull(), "int").otherwise("array")
    clock = F.when(name == "TIME", F.array(F.expr("cast(cast(now_ns div 1000000000 as string) as binary)"), F.expr("cast(cast(now_ns % 1000000000 div 1000 as string) as binary)")))
    items = F.when(kind == "array", F.coalesce(clock, F.when((name == "COMMAND") & (F.size(args) == 0), F.lit([n.encode() for n in listed()])), F.array().cast("array<binary>")))
    return reply_rows(commands, kind, count, F.coalesce(error.cast("binary"), echo, status.cast("binary")), items)


def barrier(ks: DataFrame, seq: int, now_ns: int, name: str, args: list[bytes]) -> tuple[DataFrame, DataFrame]:
    """The reply (without its seq) and the next keyspace of a command on the whole keyspace or on keys together."""
    spark = ks.sparkSession
    options = [a.upper() for a in args]
    if name == "MSETNX":
        out, state = string_ops.msetnx(ks, request(spark, [*zip(args[::2], args[1::2], strict=True)], "val binary"), now_ns)
    elif name in ("RENAME", "RENAMENX"):
        out, state = key_ops.rename(ks, request(spark, [(args[0], args[1])], "target binary"), now_ns, nx=name == "RENAMENX")
    elif name == "COPY":
        out, state = key_ops.copy(ks, request(spark, [(args[0], args[1])], "target binary"), now_ns, replace=b"REPLACE" in options[2:])
    elif name in ("FLUSHDB", "FLUSHALL"):
        out, state = server_ops.flushdb(ks)
    elif name == "DBSIZE":
        out, state = server_ops.dbsize(ks, now_ns).select(F.lit("int").alias("kind"), F.col("dbsize").alias("ival"), F.lit(None).cast("binary").alias("bulk")), ks
    elif name == "INFO":
        out, state = server_ops.info(ks, now_ns, args[0].decode() if args else "all").select(F.lit("bulk").alias("kind"), F.lit(None).cast("long").alias("ival"), F.col("info").cast("binary").alias("bulk")), ks
    elif name == "RANDOMKEY":
        found = key_ops.randomkey(ks, now_ns).agg(F.first("key").alias("bulk"))
        out, state = found.select(F.when(F.col("bulk").isNull(), "nil").otherwise("bulk").alias("kind"), F.lit(None).cast("long").alias("ival"), "bulk"), ks
    else:  # KEYS, and SCAN as one page of all keys, whose cursor is 0
        pattern, type_name = args[0] if name == "KEYS" else b"*", None
        if name == "SCAN":
            for option, value in zip(options[1::2], args[2::2], strict=False):
                pattern = value if option == b"MATCH" else pattern
                type_name = value.decode().lower() if option == b"TYPE" else type_name
        found = key_ops.keys(ks if type_name in (None, "string") else ks.limit(0), pattern, now_ns)
        # A header with the number of keys (and SCAN's cursor), and a row for each key: no row holds all of them.
        head = found.agg(F.count("*").alias("ival")).select(F.lit("array").alias("kind"), "ival", F.lit(b"0" if name == "SCAN" else None).cast("binary").alias("bulk"))
        out, state = head.unionByName(found.select(F.lit("element").alias("kind"), F.lit(None).cast("long").alias("ival"), F.col("key").alias("bulk"))), ks
    return out.select("kind", "ival", "bulk", F.lit(None).cast("array<binary>").alias("items")), state


def replay(ks: DataFrame, commands: DataFrame, strict_wire: bool = True) -> Result:
    """Replies (seq, kind, ival, bulk, items; KEYS and SCAN also have a row of kind element for each key) and the keyspace after a log. ``seq`` is unique and gives the order; ``now_ns`` doesn't
    fall along it. With ``strict_wire`` commands obey the command table's arity, which leaves no room for the flags of EXPIRE and its
    kin; else those flags are heard. Each barrier is a job of its own, so barriers should be few; without any, nothing is computed
    before the results are."""
    log = resolved(commands)
    if not strict_wire:
        flagged = F.col("name").isin("EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT") & (F.size("args") >= 2)
        log = log.withColumn("error", F.when(~flagged, F.col("error")))
    among = F.col("error").isNull() & F.col("name").isin(*BARRIERS)
    barriers = log.filter(among).orderBy("seq").select("seq", "now_ns", "name", "args").collect()
    log = cut(log) if barriers else log
    good = log.filter("error is null")
    touching = F.col("name").isin(*fold.COMMANDS)
    done = [reply_rows(log.filter("error is not null"), F.lit("error"), bulk=F.col("error")), connection(good.filter(~touching & ~F.col("name").isin(*BARRIERS)))]
    touching_log = good.filter(touching)
    state, last = ks, None
    for b in [*barriers, None]:
        epoch = touching_log if last is None else touching_log.filter(F.col("seq") > last)
        if b:
            epoch = epoch.filter(F.col("seq") < b.seq)
        replied, state = folded(state, epoch, keep=bool(barriers))
        done.append(replied)
        if b:
            out, state = barrier(state, b.seq, b.now_ns, b.name, [bytes(a) for a in b.args])
            out, state, last = cut(out.select(F.lit(b.seq).alias("seq"), "kind", "ival", "bulk", "items")), cut(state), b.seq
            done.append(out)
    return Result(reduce(DataFrame.unionByName, done), state)


def counters(commands: DataFrame) -> DataFrame:
    """key, total, n of a log of INCR, DECR, INCRBY and DECRBY alone: these commute, so their sums are combined before the shuffle."""
    sign = F.when(F.col("name").isin("DECR", "DECRBY"), -1).otherwise(1)
    by = F.coalesce(F.get("args", F.lit(1)).cast("string").try_cast("long"), F.lit(1))
    return commands.groupBy(F.get("args", F.lit(0)).alias("key")).agg(F.sum(sign * by).alias("total"), F.count("*").alias("n"))


def final(ks: DataFrame, now_ns: int) -> DataFrame:
    """The rows of a replayed keyspace that are alive at its end."""
    return live(ks, now_ns)


