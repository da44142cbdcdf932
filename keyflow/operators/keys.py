"""Key commands over whole requests: each takes a keyspace, a request and ``now_ns``; see strings.py for the conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.glob import matches
from ..model import NO_SUCH_KEY, NOT_INTEGER, NS, NS_MS, OK, REPLIES, SYNTAX, CommandError, Result, live, replies
from ..plans.requests import STATE, lookup, narrowed, retimed, without

FLAGS = ("nx", "xx", "gt", "lt")


def _total(frame: DataFrame) -> DataFrame:
    """One integer reply: the number of rows."""
    return frame.agg(F.count("*").alias("ival")).select(F.lit(0).cast("long").alias("ord"), F.lit(None).cast("binary").alias("key"), F.lit("int").alias("kind"), "ival", F.lit(None).cast("binary").alias("bulk"))


def delete(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """DEL: how many of the keys existed, each counted once; they go."""
    gone = live(ks, now_ns).join(request.select("key").distinct(), "key", "left_semi")
    return Result(_total(gone), without(ks, request, now_ns))


unlink = delete


def exists(ks: DataFrame, request: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """EXISTS: how many of the arguments name existing keys; a repeated one counts each time."""
    return _total(request.join(live(narrowed(ks, keys), now_ns).select("key"), "key"))


touch = exists


def _expire(ks: DataFrame, request: DataFrame, now_ns: int, unit: int, relative: bool, flags: tuple[str, ...]) -> Result:
    flags = tuple(f.lower() for f in flags)
    if not set(flags) <= set(FLAGS):
        raise CommandError(SYNTAX)
    # The last row of a key that acts decides; rows of one key with flags see each other's deadlines only in a replay.
    span = F.try_multiply("time", F.lit(unit))
    until = F.try_add(F.lit(now_ns), span) if relative else span
    held = lookup(ks, request.select("ord", "key", "time"), now_ns).withColumn("until", until)
    past = (F.col("time") <= 0) if relative else (F.col("until") <= now_ns)
    none = F.col("deadline_ns").isNull()
    blocked = F.lit(False)
    if "nx" in flags:
        blocked |= ~none
    if "xx" in flags:
        blocked |= none
    if "gt" in flags:
        blocked |= ~none & (F.col("until") <= F.col("deadline_ns"))
    if "lt" in flags:
        blocked |= ~none & (F.col("until") >= F.col("deadline_ns"))
    bad = ~past & F.col("until").isNull() | F.col("time").isNull()
    gone = F.col("found") & past
    held = held.withColumns({"bad": F.coalesce(bad, F.lit(True)), "gone": F.coalesce(gone, F.lit(False)), "set": F.coalesce(F.col("found") & ~past & ~blocked & ~bad, F.lit(False))})
    # After a deletion, later rows of the key find nothing.
    dead = F.coalesce(F.max(F.col("gone").cast("int")).over(Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    held = held.withColumns({"gone": F.col("gone") & ~dead, "set": F.col("set") & ~dead})
    out = replies(held, F.when(F.col("bad"), "error").otherwise("int"), F.when(~F.col("bad"), (F.col("gone") | F.col("set")).cast("long")), F.when(F.col("bad"), F.lit(NOT_INTEGER.encode())))
    of_key = held.groupBy("key").agg(F.max("gone").alias("gone"), F.max("set").alias("retime"), F.max_by("until", F.when(F.col("set"), F.col("ord"))).alias("new_deadline"))
    return Result(out, retimed(ks, of_key, now_ns))


def expire(ks: DataFrame, request: DataFrame, now_ns: int, *flags: str) -> Result:
    """EXPIRE in ``time`` seconds: 1 where the deadline is set or, for a time that is not positive, the key deleted; else 0.

    Flags: nx only without a deadline, xx only with one, gt only if later than the one there is, lt only if earlier."""
    return _expire(ks, request, now_ns, NS, True, flags)


def pexpire(ks: DataFrame, request: DataFrame, now_ns: int, *flags: str) -> Result:
    """PEXPIRE in ``time`` milliseconds."""
    return _expire(ks, request, now_ns, NS_MS, True, flags)


def expireat(ks: DataFrame, request: DataFrame, now_ns: int, *flags: str) -> Result:
    """EXPIREAT at ``time`` in seconds; a time that has come deletes the key."""
    return _expire(ks, request, now_ns, NS, False, flags)


def pexpireat(ks: DataFrame, request: DataFrame, now_ns: int, *flags: str) -> Result:
    """PEXPIREAT at ``time`` in milliseconds."""
    return _expire(ks, request, now_ns, NS_MS, False, flags)


def persist(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """PERSIST: 1 where a deadline is taken away, else 0; a repeated key has none the second time."""
    turn = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    held = lookup(ks, request, now_ns).withColumn("acts", F.col("deadline_ns").isNotNull() & (turn == 1))
    of_key = request.select("key").distinct().select("key", F.lit(False).alias("gone"), F.lit(True).alias("retime"), F.lit(None).cast("long").alias("new_deadline"))
    return Result(replies(held, "int", F.col("acts").cast("long")), retimed(ks, of_key, now_ns))


def _time(ks: DataFrame, request: DataFrame, now_ns: int, unit: int, relative: bool, keys: list | None) -> DataFrame:
    until = F.col("deadline_ns") - now_ns if relative else F.col("deadline_ns")
    held = lookup(ks, request, now_ns, keys).withColumn("until", until)
    return replies(held, "int", F.when(~F.col("found"), -2).when(F.col("deadline_ns").isNull(), -1).otherwise(F.expr(f"until div {unit}")))


def ttl(ks: DataFrame, request: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """TTL: whole seconds left; -1 without a deadline, -2 without the key."""
    return _time(ks, request, now_ns, NS, True, keys)


def pttl(ks: DataFrame, request: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """PTTL: whole milliseconds left."""
    return _time(ks, request, now_ns, NS_MS, True, keys)


def expiretime(ks: DataFrame, request: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """EXPIRETIME: the deadline in seconds."""
    return _time(ks, request, now_ns, NS, False, keys)


def pexpiretime(ks: DataFrame, request: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """PEXPIRETIME: the deadline in milliseconds."""
    return _time(ks, request, now_ns, NS_MS, False, keys)


def type_of(ks: DataFrame, request: DataFrame, now_ns: int, keys: list | None = None) -> DataFrame:
    """TYPE: the type's name, or none."""
    return replies(lookup(ks, request, now_ns, keys), "status", None, F.coalesce("vtype", F.lit("none")).cast("binary"))


def _moves(ks: DataFrame, request: DataFrame, now_ns: int) -> DataFrame:
    """Request rows (key, target) with the source's row and whether the target exists."""
    held = lookup(ks, request.select("ord", "key", "target"), now_ns)
    there = live(ks, now_ns).select(F.col("key").alias("target"), F.lit(True).alias("taken"))
    return held.join(there, "target", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def _last(frame: DataFrame) -> DataFrame:
    """Each key's row with the greatest ord (null: before all). Nothing is summed up before the shuffle, and the sort is that of a join on the key."""
    later = F.lead(F.lit(True)).over(Window.partitionBy("key").orderBy("ord"))
    return frame.withColumn("later", later).filter("later is null").drop("later")


def rename(ks: DataFrame, request: DataFrame, now_ns: int, nx: bool = False) -> Result:
    """RENAME ``key`` to ``target``: OK, or an error without the key. The target's row goes, the deadline moves along.

    The rows of a request act at once, on the keyspace as it is: each key should stand once, as source or target. Renaming a
    key to itself changes nothing."""
    held = _moves(ks, request, now_ns)
    same = F.col("key") == F.col("target")
    acts = F.col("found") & ~same & (~F.col("taken") if nx else F.lit(True))
    held = held.withColumn("acts", acts)
    if nx:
        out = replies(held, F.when(F.col("found"), "int").otherwise("error"), F.when(F.col("found"), F.col("acts").cast("long")), F.when(~F.col("found"), F.lit(NO_SUCH_KEY.encode())))
    else:
        out = replies(held, F.when(F.col("found"), "status").otherwise("error"), None, F.when(F.col("found"), F.lit(OK.encode())).otherwise(F.lit(NO_SUCH_KEY.encode())))
    if nx:
        moved = held.filter("acts")
        state = without(ks, moved, now_ns).unionByName(_last(moved.withColumn("key", F.col("target"))).select(*STATE))
    else:
        # A source's row goes on under its target's key, where the last row to come is the one that stays; old rows have no ord.
        named = request.select("ord", "key", "target").filter("key <> target")
        placed = live(ks, now_ns).select(*STATE).join(named, "key", "left")
        state = _last(placed.withColumn("key", F.coalesce("target", "key"))).select(*STATE)
    return Result(out, state)


def renamenx(ks: DataFrame, request: DataFrame, now_ns: int) -> Result:
    """RENAMENX: 1 where the target is missing and the key renamed, 0 where not; an error without the key."""
    return rename(ks, request, now_ns, nx=True)


def copy(ks: DataFrame, request: DataFrame, now_ns: int, replace: bool = False) -> Result:
    """COPY ``key`` to ``target``: 1, or 0 without the key or, but for ``replace``, where the target exists. The deadline is copied;
    over a target with one, a source without leaves it."""
    held = _moves(ks, request, now_ns).withColumn("acts", F.col("found") & (F.lit(replace) | ~F.col("taken")))
    out = replies(held, "int", F.col("acts").cast("long"))
    # Sources meet their own rows, and then, under the targets' keys, the rows that are there: each task sorts two tables once.
    named = request.select("ord", "key", "target").filter("key <> target")
    found = named.join(live(ks, now_ns).select(*STATE), "key").withColumn("key", F.col("target"))
    copied = _last(found).select("key", F.struct(*STATE[1:]).alias("new"))
    old = live(ks, now_ns).select(*STATE, F.lit(True).alias("taken"))
    both = old.join(copied, "key", "full")
    writes = F.col("new").isNotNull() & (F.lit(replace) | F.col("taken").isNull())
    values = {c: F.when(writes, F.col(f"new.{c}")).otherwise(F.col(c)) for c in STATE[1:]}
    values["deadline_ns"] = F.when(writes, F.coalesce("new.deadline_ns", "deadline_ns")).otherwise(F.col("deadline_ns"))
    return Result(out, both.select("key", *[v.alias(c) for c, v in values.items()]))


def keys(ks: DataFrame, pattern: bytes | str, now_ns: int) -> DataFrame:
    """KEYS: the keys that match a glob pattern, in any order."""
    return live(ks, now_ns).filter(matches(F.col("key"), pattern)).select("key")


def place(column: str = "key"):
    """Where SCAN meets a key: its hash, and then the key itself."""
    return F.xxhash64(column)


def scan(ks: DataFrame, cursor: tuple[int, bytes] | None, now_ns: int, *, match: bytes | str | None = None, count: int = 10, type_name: str | None = None) -> tuple[DataFrame, tuple[int, bytes] | None]:
    """SCAN: a page of up to ``count`` keys after a cursor (None: the start), and the next cursor (None: the end).

    Pages follow the order of (hash, key), so each key that stays is met exactly once, whatever comes or goes between pages."""
    found = live(ks, now_ns).select("key", "vtype", place().alias("place"))
    if match is not None:
        found = found.filter(matches(F.col("key"), match))
    if type_name is not None:
        found = found.filter(F.col("vtype") == type_name.lower())
    if cursor:
        at, key = cursor
        found = found.filter((F.col("place") > at) | ((F.col("place") == at) & (F.col("key") > F.lit(key).cast("binary"))))
    size = count if count > 0 else 10
    page = found.orderBy("place", "key").limit(size + 1).collect()  # bounded by COUNT, as a reply is
    end = (page[size - 1].place, bytes(page[size - 1].key)) if len(page) > size else None
    return ks.sparkSession.createDataFrame([(bytes(r.key),) for r in page[:size]], "key binary"), end


def scan_pages(ks: DataFrame, now_ns: int, count: int = 10, *, match: bytes | str | None = None, type_name: str | None = None) -> DataFrame:
    """All pages of a SCAN at once: key and page. The keys are dealt by a million ranges of their hash, and pages counted up from the number
    of keys in the ranges before, so no task and no driver sees all keys."""
    found = live(ks, now_ns).select("key", "vtype", place().alias("place"))
    if match is not None:
        found = found.filter(matches(F.col("key"), match))
    if type_name is not None:
        found = found.filter(F.col("vtype") == type_name.lower())
    found = found.select("key", "place", F.shiftright("place", 44).alias("range"))
    sizes = found.groupBy("range").count()
    before = sizes.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("place", "key"))
    return found.withColumn("rank", rank).join(before, "range").select("key", F.expr(f"(before + rank - 1) div {int(count)}").alias("page"))


def randomkey(ks: DataFrame, now_ns: int) -> DataFrame:
    """RANDOMKEY: one key that ``now_ns`` chooses, or no row."""
    return live(ks, now_ns).select("key", F.xxhash64(F.lit(now_ns), "key").alias("draw")).orderBy("draw", "key").limit(1).select("key")


def sweep(ks: DataFrame, now_ns: int) -> Result:
    """The active expiry: one integer reply, the number of expired rows, and the keyspace without them."""
    return Result(_total(ks.filter(F.col("deadline_ns") <= now_ns)), live(ks, now_ns))


def empty_replies(ks: DataFrame) -> DataFrame:
    return ks.sparkSession.createDataFrame([], REPLIES)
