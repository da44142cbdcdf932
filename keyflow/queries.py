"""The registered queries of the key-value operators over the driver's tables, each beside its SQL."""

from __future__ import annotations

import time as clock
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.values import memory, slot
from .model import keyspace, live, request
from .operators import keys as K
from .operators import server as V
from .operators import strings as S
from .plans.cut import shared_folder
from .plans.replay import counters, replay
from .sources import keyspaces as T
from .sources import resp
from .sources.keyspaces import NOW_NS
from .streaming import replay as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDERS_SQL = f"""ko AS (SELECT 'order:' || o_orderkey AS key, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS val,
    CASE WHEN o_orderkey % 3 <> 0 THEN epoch_us(o_orderdate) * 1000 + (o_orderkey % 365) * 86400000000000 END AS deadline_ns FROM orders),
  lo AS (SELECT * FROM ko WHERE deadline_ns IS NULL OR deadline_ns > {NOW_NS})"""
CUSTOMERS_SQL = "lc AS (SELECT 'customer:' || c_nationkey || ':' || c_custkey AS key, c_name AS val FROM customer)"
# Lookups: the lines' orders, every second one of them shifted beyond all orders.
ASKED_SQL = "r AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'order:' || (l_orderkey + CASE WHEN l_linenumber % 2 = 1 THEN 100000000 ELSE 0 END) AS key FROM lineitem)"
# Writes: half of the keys are new, every fifth is written twice.
WRITES_SQL = """w AS (SELECT c_custkey AS ord, 'order:' || (c_custkey * 20) AS key, '0' || c_nationkey AS val, CAST(c_nationkey AS BIGINT) AS n FROM customer
    UNION ALL SELECT c_custkey + 100000000, 'order:' || (c_custkey * 20), 'again ' || c_custkey, c_nationkey + 1 FROM customer WHERE c_custkey % 5 = 0)"""
CANON_SQL = "CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') AND length({0}) <= 20 THEN coalesce(CAST(TRY_CAST({0} AS BIGINT) AS VARCHAR), {0}) ELSE {0} END"
LAST_SQL = f"l AS (SELECT key, arg_max({CANON_SQL.format('val')}, ord) AS val FROM w GROUP BY key)"


def register(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_orderkey") + F.when(F.col("l_linenumber") % 2 == 1, 100_000_000).otherwise(0)
    return T.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("order:"), n.cast("string")).cast("binary").alias("key"))


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "customer")
    key = F.concat(F.lit("order:"), (F.col("c_custkey") * 20).cast("string")).cast("binary").alias("key")
    one = c.select(F.col("c_custkey").alias("ord"), key, F.concat(F.lit("0"), F.col("c_nationkey").cast("string")).cast("binary").alias("val"), F.col("c_nationkey").cast("long").alias("n"))
    two = c.filter("c_custkey % 5 = 0").select((F.col("c_custkey") + 100_000_000).alias("ord"), key, F.concat(F.lit("again "), F.col("c_custkey").cast("string")).cast("binary").alias("val"), (F.col("c_nationkey") + 1).cast("long").alias("n"))
    return one.unionByName(two)


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes(spark, sf_dir).filter("ord < 100000000")


def text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def answers(replies: DataFrame) -> DataFrame:
    """Replies with text instead of bytes."""
    return replies.select("ord", text("key"), "kind", "ival", F.col("bulk").cast("string").alias("val"))


def values(replies: DataFrame) -> DataFrame:
    return replies.select("ord", text("key"), F.col("bulk").cast("string").alias("val"))


def numbers(replies: DataFrame) -> DataFrame:
    return replies.select("ord", text("key"), F.col("ival").alias("n"))


def state(ks: DataFrame) -> DataFrame:
    return ks.select(text("key"), text("val"), "deadline_ns")


def total(replies: DataFrame) -> DataFrame:
    return replies.select(F.col("ival").alias("n"))


# String commands


@register(f"WITH {ORDERS_SQL} SELECT key, val FROM lo WHERE key IN ('order:3', 'order:6', 'order:7', 'order:10')")
def get_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GET of a few literal keys, which the scan filters by."""
    keys = ["order:3", "order:6", "order:7", "order:10", "order:none"]
    out = S.get(T.orders(spark, sf_dir), request(spark, keys), NOW_NS, keys)
    return out.filter("kind = 'bulk'").select(text("key"), F.col("bulk").cast("string").alias("val"))


@register(f"WITH {ORDERS_SQL} SELECT o_orderkey AS ord, 'order:' || o_orderkey AS key, lo.val FROM orders LEFT JOIN lo ON lo.key = 'order:' || o_orderkey")
def mget_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MGET of every order."""
    asked_ = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).cast("binary").alias("key"))
    return values(S.mget(T.orders(spark, sf_dir), asked_, NOW_NS))


@register(f"WITH {ORDERS_SQL}, {ASKED_SQL} SELECT ord, r.key, lo.val FROM r LEFT JOIN lo USING (key)")
def mget_missing_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MGET of repeated and missing keys."""
    return values(S.mget(T.orders(spark, sf_dir), asked(spark, sf_dir), NOW_NS))


SET_SQL = """SELECT coalesce(l.key, lo.key) AS key, CASE WHEN l.key IS NOT NULL THEN l.val ELSE lo.val END AS val, {0} AS deadline_ns FROM lo FULL JOIN l ON l.key = lo.key"""


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL}, {LAST_SQL} " + SET_SQL.format("lo.deadline_ns"))
def set_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET: the keyspace after plain writes, which keep deadlines."""
    return state(S.set_(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL}, {LAST_SQL} " + SET_SQL.format(f"CASE WHEN l.key IS NOT NULL THEN {NOW_NS + 60_000_000_000} ELSE lo.deadline_ns END"))
def set_ex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET EX: every written key gets the deadline."""
    return state(S.set_(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS, ex=60).state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL}, {LAST_SQL} " + SET_SQL.format(f"CASE WHEN l.key IS NOT NULL AND lo.key IS NULL THEN {NOW_NS + 5_000_000} ELSE lo.deadline_ns END"))
def set_keepttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET PX KEEPTTL: new keys get the deadline, others keep theirs."""
    return state(S.set_(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS, px=5, keepttl=True).state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL}, f AS (SELECT key, arg_min({CANON_SQL.format('val')}, ord) AS val FROM w GROUP BY key) SELECT key, val, deadline_ns FROM lo UNION ALL SELECT key, val, NULL FROM f WHERE key NOT IN (SELECT key FROM lo)")
def set_nx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET NX: new keys alone, by their first row."""
    return state(S.set_(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS, nx=True).state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL}, {LAST_SQL} SELECT lo.key, coalesce(l.val, lo.val) AS val, deadline_ns FROM lo LEFT JOIN l USING (key)")
def set_xx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET XX: existing keys alone."""
    return state(S.set_(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS, xx=True).state)


CHAIN_SQL = f"SELECT ord, w.key, coalesce(lag({CANON_SQL.format('w.val')}) OVER (PARTITION BY w.key ORDER BY ord), lo.val) AS val FROM w LEFT JOIN lo ON lo.key = w.key"


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} {CHAIN_SQL}")
def set_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET GET: the values before."""
    return values(S.set_(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS, get=True).replies)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} {CHAIN_SQL}")
def getset_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GETSET: the values before, along repeated keys."""
    return values(S.getset(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).replies)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} SELECT ord, w.key, CAST(lo.key IS NULL AND row_number() OVER (PARTITION BY w.key ORDER BY ord) = 1 AS BIGINT) AS n FROM w LEFT JOIN lo ON lo.key = w.key")
def setnx_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SETNX: 1 for the first row of each new key."""
    return numbers(S.setnx(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).replies)


TIMED_SQL = """t AS (SELECT key, arg_max(n, ord) AS n, arg_max({0}, ord) AS val FROM w WHERE n > 0 GROUP BY key)
  SELECT coalesce(t.key, lo.key) AS key, CASE WHEN t.key IS NOT NULL THEN t.val ELSE lo.val END AS val, CASE WHEN t.key IS NOT NULL THEN {1} + t.n * {2} ELSE lo.deadline_ns END AS deadline_ns FROM lo FULL JOIN t ON t.key = lo.key"""


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL}, " + TIMED_SQL.format(CANON_SQL.format("val"), NOW_NS, 1_000_000_000))
def setex_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SETEX for seconds that are positive in most rows; other rows are errors."""
    return state(S.setex(T.orders(spark, sf_dir), writes(spark, sf_dir).withColumnRenamed("n", "seconds"), NOW_NS).state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL}, " + TIMED_SQL.format(CANON_SQL.format("val"), NOW_NS, 1_000_000))
def psetex_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSETEX, the same in milliseconds."""
    return state(S.psetex(T.orders(spark, sf_dir), writes(spark, sf_dir).withColumnRenamed("n", "millis"), NOW_NS).state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL}, {LAST_SQL} " + SET_SQL.format("lo.deadline_ns"))
def mset_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSET: of a repeated key the last value stays."""
    return state(S.mset(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).state)


@register(f"WITH {ORDERS_SQL}, w AS (SELECT 'new:' || c_custkey AS key, c_name AS val FROM customer) SELECT key, val, deadline_ns FROM lo UNION ALL SELECT key, val, NULL FROM w")
def msetnx_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSETNX of new keys: all are set."""
    new = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("new:"), F.col("c_custkey").cast("string")).cast("binary").alias("key"), F.col("c_name").cast("binary").alias("val"))
    return state(S.msetnx(T.orders(spark, sf_dir), new, NOW_NS).state)


@register(f"WITH {ORDERS_SQL} SELECT key, val, deadline_ns FROM lo")
def msetnx_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSETNX with existing keys among new ones: none is set."""
    return state(S.msetnx(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} SELECT ord, w.key, CASE WHEN row_number() OVER (PARTITION BY w.key ORDER BY ord) = 1 THEN lo.val END AS val FROM w LEFT JOIN lo ON lo.key = w.key")
def getdel_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GETDEL: values; nil the second time."""
    return values(S.getdel(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).replies)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} SELECT key, val, deadline_ns FROM lo WHERE key NOT IN (SELECT key FROM w)")
def getdel_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GETDEL: what stays."""
    return state(S.getdel(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} SELECT key, val, CASE WHEN key NOT IN (SELECT key FROM w) THEN deadline_ns END AS deadline_ns FROM lo")
def getex_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GETEX PERSIST: deadlines of the keys asked for go."""
    return state(S.getex(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS, persist=True).state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} SELECT key, val, CASE WHEN key IN (SELECT key FROM w) THEN {NOW_NS + 90_000_000_000} ELSE deadline_ns END AS deadline_ns FROM lo")
def getex_ex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GETEX EX: deadlines are set."""
    return state(S.getex(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS, ex=90).state)


@register("SELECT doc_id AS ord, 'doc:' || doc_id AS key, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n FROM documents")
def strlen_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STRLEN of texts, in bytes."""
    ks = T.documents(spark, sf_dir)
    asked_ = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).cast("binary").alias("key"))
    return numbers(S.strlen(ks, asked_, NOW_NS))


def _ranges(spark: SparkSession, sf_dir: str, start: int, end: int) -> DataFrame:
    ks = T.customers(spark, sf_dir)
    asked_ = ks.select(F.xxhash64("key").alias("ord"), "key", F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"))
    return S.getrange(ks, asked_, NOW_NS).select(text("key"), F.col("bulk").cast("string").alias("val"))


@register(f"WITH {CUSTOMERS_SQL} SELECT key, substr(val, 3, 6) AS val FROM lc")
def getrange_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GETRANGE 2 7."""
    return _ranges(spark, sf_dir, 2, 7)


@register(f"WITH {CUSTOMERS_SQL} SELECT key, right(val, 4) AS val FROM lc")
def getrange_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GETRANGE -4 -1."""
    return _ranges(spark, sf_dir, -4, -1)


def _overwrites(spark: SparkSession, sf_dir: str, offset: int) -> DataFrame:
    ks = T.customers(spark, sf_dir)
    asked_ = ks.select(F.xxhash64("key").alias("ord"), "key", F.lit(offset).cast("long").alias("offset"), F.lit(b"Redone").alias("val"))
    return S.setrange(ks, asked_, NOW_NS).state


@register(f"WITH {CUSTOMERS_SQL} SELECT key, substr(val, 1, 3) || 'Redone' || substr(val, 10) AS val FROM lc")
def setrange_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SETRANGE within values."""
    return _overwrites(spark, sf_dir, 3).select(text("key"), text("val"))


@register(f"WITH {CUSTOMERS_SQL} SELECT key, hex(CAST(val AS BLOB)) || repeat('00', 40 - CAST(length(val) AS INTEGER)) || hex(CAST('Redone' AS BLOB)) AS bytes FROM lc")
def setrange_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SETRANGE beyond the end, which zero bytes fill."""
    return _overwrites(spark, sf_dir, 40).select(text("key"), F.hex("val").alias("bytes"))


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL}, a AS (SELECT key, string_agg(val, '' ORDER BY ord) AS more FROM w GROUP BY key) SELECT coalesce(a.key, lo.key) AS key, coalesce(lo.val, '') || coalesce(more, '') AS val, deadline_ns FROM lo FULL JOIN a ON a.key = lo.key")
def append_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APPEND, repeated keys in order."""
    return state(S.append(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).state)


def _counts(sign: str) -> str:
    return f"WITH {ORDERS_SQL}, {WRITES_SQL}, s AS (SELECT key, sum({sign}n) AS n FROM w GROUP BY key) SELECT coalesce(s.key, lo.key) AS key, CAST(coalesce(CAST(lo.val AS BIGINT), 0) + coalesce(CAST(s.n AS BIGINT), 0) AS VARCHAR) AS val, deadline_ns FROM lo FULL JOIN s ON s.key = lo.key"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes(spark, sf_dir).select("ord", "key", F.col("n").alias("delta"))


@register(_counts("+"))
def incrby_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INCRBY: the numbers after."""
    return state(S.incrby(T.orders(spark, sf_dir), _deltas(spark, sf_dir), NOW_NS).state)


@register(_counts("-"))
def decrby_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DECRBY: the numbers after."""
    return state(S.decrby(T.orders(spark, sf_dir), _deltas(spark, sf_dir), NOW_NS).state)


@register("SELECT event_id AS ord, 'clicks:' || user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n FROM events WHERE event_type = 'click'")
def incr_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INCR: every reply along a key."""
    clicks = T.table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("event_id").alias("ord"), F.concat(F.lit("clicks:"), F.col("user_id").cast("string")).cast("binary").alias("key"))
    return numbers(S.incr(keyspace(spark, []), clicks, NOW_NS).replies)


@register("SELECT event_id AS ord, 'errors:' || user_id AS key, -CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n FROM events WHERE event_type = 'error'")
def decr_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DECR: every reply along a key."""
    errors = T.table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("ord"), F.concat(F.lit("errors:"), F.col("user_id").cast("string")).cast("binary").alias("key"))
    return numbers(S.decr(keyspace(spark, []), errors, NOW_NS).replies)


@register("SELECT 'spend:' || user_id AS key, round(sum(value), 4) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1")
def incrbyfloat_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INCRBYFLOAT: the sums after."""
    bought = T.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("ord"), F.concat(F.lit("spend:"), F.col("user_id").cast("string")).cast("binary").alias("key"), F.col("value").alias("delta"))
    after = S.incrbyfloat(keyspace(spark, []), bought, NOW_NS).state
    return after.select(text("key"), F.round(F.col("val").cast("string").cast("double"), 4).alias("total"))


# Key commands


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} SELECT key, val, deadline_ns FROM lo WHERE key NOT IN (SELECT key FROM w)")
def del_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEL: what stays."""
    return state(K.delete(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} SELECT count(*) AS n FROM lo WHERE key IN (SELECT key FROM w)")
def unlink_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNLINK: how many existed."""
    return total(K.unlink(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).replies)


@register(f"WITH {ORDERS_SQL}, {ASKED_SQL} SELECT count(*) AS n FROM r JOIN lo USING (key)")
def exists_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXISTS: a repeated key counts each time."""
    return total(K.exists(T.orders(spark, sf_dir), asked(spark, sf_dir), NOW_NS))


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} SELECT count(*) AS n FROM w JOIN lo USING (key)")
def touch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOUCH: like EXISTS."""
    return total(K.touch(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS))


def _timed(spark: SparkSession, sf_dir: str, time) -> DataFrame:
    return once(spark, sf_dir).select("ord", "key", time.alias("time"))


def _retimed(until: str, gone: str, blocked: str = "false") -> str:
    return f"WITH {ORDERS_SQL}, {WRITES_SQL}, x AS (SELECT lo.*, w.n, {until} AS until FROM lo LEFT JOIN w ON w.key = lo.key AND w.ord < 100000000) SELECT key, val, CASE WHEN n IS NOT NULL AND NOT ({blocked}) THEN until ELSE deadline_ns END AS deadline_ns FROM x WHERE n IS NULL OR NOT ({gone})"


@register(_retimed(f"{NOW_NS} + n * 1000000000", "n <= 0"))
def expire_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPIRE; no seconds delete the key."""
    return state(K.expire(T.orders(spark, sf_dir), _timed(spark, sf_dir, F.col("n")), NOW_NS).state)


@register(_retimed(f"{NOW_NS} + n * 1000000", "n <= 0", "deadline_ns IS NOT NULL"))
def pexpire_nx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PEXPIRE NX: only keys without a deadline."""
    return state(K.pexpire(T.orders(spark, sf_dir), _timed(spark, sf_dir, F.col("n")), NOW_NS, "nx").state)


_AT = "(899251200 + (n - 3) * 8640000)"


@register(_retimed(f"{_AT} * 1000000000", f"{_AT} * 1000000000 <= {NOW_NS}", "deadline_ns IS NOT NULL AND until <= deadline_ns"))
def expireat_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPIREAT GT: only later deadlines; past ones delete."""
    return state(K.expireat(T.orders(spark, sf_dir), _timed(spark, sf_dir, F.lit(899251200) + (F.col("n") - 3) * 8640000), NOW_NS, "gt").state)


@register(_retimed(f"{_AT} * 1000000000", f"{_AT} * 1000000000 <= {NOW_NS}", "deadline_ns IS NOT NULL AND until >= deadline_ns"))
def pexpireat_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PEXPIREAT LT: only earlier deadlines."""
    return state(K.pexpireat(T.orders(spark, sf_dir), _timed(spark, sf_dir, (F.lit(899251200) + (F.col("n") - 3) * 8640000) * 1000), NOW_NS, "lt").state)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} SELECT ord, w.key, CAST(coalesce(lo.deadline_ns IS NOT NULL, false) AND row_number() OVER (PARTITION BY w.key ORDER BY ord) = 1 AS BIGINT) AS n FROM w LEFT JOIN lo ON lo.key = w.key")
def persist_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PERSIST: 1 where a deadline went."""
    return numbers(K.persist(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).replies)


@register(f"WITH {ORDERS_SQL}, {WRITES_SQL} SELECT key, val, CASE WHEN key NOT IN (SELECT key FROM w) THEN deadline_ns END AS deadline_ns FROM lo")
def persist_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PERSIST: the keyspace after."""
    return state(K.persist(T.orders(spark, sf_dir), writes(spark, sf_dir), NOW_NS).state)


def _left(value: str) -> str:
    return f"WITH {ORDERS_SQL}, {ASKED_SQL} SELECT ord, r.key, CAST(CASE WHEN lo.key IS NULL THEN -2 WHEN deadline_ns IS NULL THEN -1 ELSE {value} END AS BIGINT) AS n FROM r LEFT JOIN lo ON lo.key = r.key"


@register(_left(f"(deadline_ns - {NOW_NS}) // 1000000000"))
def ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TTL."""
    return numbers(K.ttl(T.orders(spark, sf_dir), asked(spark, sf_dir), NOW_NS))


@register(_left(f"(deadline_ns - {NOW_NS}) // 1000000"))
def pttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTTL."""
    return numbers(K.pttl(T.orders(spark, sf_dir), asked(spark, sf_dir), NOW_NS))


@register(_left("deadline_ns // 1000000000"))
def expiretime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPIRETIME."""
    return numbers(K.expiretime(T.orders(spark, sf_dir), asked(spark, sf_dir), NOW_NS))


@register(_left("deadline_ns // 1000000"))
def pexpiretime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PEXPIRETIME."""
    return numbers(K.pexpiretime(T.orders(spark, sf_dir), asked(spark, sf_dir), NOW_NS))


@register(f"WITH {ORDERS_SQL}, {ASKED_SQL} SELECT ord, r.key, CASE WHEN lo.key IS NULL THEN 'none' ELSE 'string' END AS val FROM r LEFT JOIN lo ON lo.key = r.key")
def type_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TYPE."""
    return values(K.type_of(T.orders(spark, sf_dir), asked(spark, sf_dir), NOW_NS))


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders: each goes to a new name, or, where its number is divisible by three, to that of a customer."""
    o = T.table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("customer:"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("moved:"), F.col("o_orderkey").cast("string")))
    return o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).cast("binary").alias("key"), name.cast("binary").alias("target"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyspace of orders and, as customer:<key>, the customers: targets of moves that exist, one in two with a deadline."""
    c = T.table(spark, sf_dir, "customer")
    until = F.when(F.col("c_custkey") % 2 == 0, NOW_NS + T.DAY_NS)
    return T.orders(spark, sf_dir).unionByName(T.strings(c, F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), F.col("c_custkey").cast("string"), True, until))


MAPPING_SQL = f"""m AS (SELECT o_orderkey AS ord, 'order:' || o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'customer:' || o_orderkey ELSE 'moved:' || o_orderkey END AS target FROM orders),
  b AS (SELECT key, val, deadline_ns FROM lo UNION ALL SELECT 'customer:' || c_custkey, CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN {NOW_NS + T.DAY_NS} END FROM customer)"""


@register(f"WITH {ORDERS_SQL}, {MAPPING_SQL}, x AS (SELECT m.key, target, val, deadline_ns FROM m JOIN b USING (key)) SELECT key, val, deadline_ns FROM b WHERE key NOT IN (SELECT key FROM x) AND key NOT IN (SELECT target FROM x) UNION ALL SELECT target, val, deadline_ns FROM x")
def rename_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RENAME: the keyspace after."""
    return state(K.rename(_both(spark, sf_dir), _mapping(spark, sf_dir), NOW_NS).state)


@register(f"WITH {ORDERS_SQL}, {MAPPING_SQL} SELECT ord, m.key, CASE WHEN s.key IS NULL THEN 'error' ELSE 'int' END AS kind, CASE WHEN s.key IS NOT NULL THEN CAST(t.key IS NULL AS BIGINT) END AS ival, CASE WHEN s.key IS NULL THEN 'ERR no such key' END AS val FROM m LEFT JOIN b s ON s.key = m.key LEFT JOIN b t ON t.key = m.target")
def renamenx_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RENAMENX: the replies."""
    return answers(K.renamenx(_both(spark, sf_dir), _mapping(spark, sf_dir), NOW_NS).replies)


@register(f"WITH {ORDERS_SQL}, {MAPPING_SQL}, x AS (SELECT target, val, deadline_ns FROM m JOIN b USING (key) WHERE target NOT IN (SELECT key FROM b)) SELECT key, val, deadline_ns FROM b UNION ALL SELECT target, val, deadline_ns FROM x")
def copy_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY: the keyspace after."""
    return state(K.copy(_both(spark, sf_dir), _mapping(spark, sf_dir), NOW_NS).state)


@register(f"WITH {ORDERS_SQL}, {MAPPING_SQL}, x AS (SELECT target, s.val, coalesce(s.deadline_ns, t.deadline_ns) AS deadline_ns FROM m JOIN b s ON s.key = m.key LEFT JOIN b t ON t.key = m.target) SELECT key, val, deadline_ns FROM b WHERE key NOT IN (SELECT target FROM x) UNION ALL SELECT target, val, deadline_ns FROM x")
def copy_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY REPLACE: a source without a deadline leaves the target's."""
    return state(K.copy(_both(spark, sf_dir), _mapping(spark, sf_dir), NOW_NS, replace=True).state)


def _keys(pattern: str):
    return lambda spark, sf_dir: K.keys(T.customers(spark, sf_dir), pattern, NOW_NS).select(text("key"))


for _name, _pattern, _regex in (
    ("keys_star", "*", ".*"),
    ("keys_prefix", "customer:7:*", "customer:7:.*"),
    ("keys_qmark", "customer:?:1?", "customer:.:1."),
    ("keys_class", "customer:[2-4]:*[05]", "customer:[2-4]:.*[05]"),
    ("keys_negclass", "customer:1[^0-5]:*", "customer:1[^0-5]:.*"),
    ("keys_escape", r"customer\:9:*", "customer:9:.*"),
):
    QUERIES[_name] = _keys(_pattern)
    ORACLES[_name] = f"WITH {CUSTOMERS_SQL} SELECT key FROM lc WHERE regexp_full_match(key, '{_regex}')"


@register(f"WITH {ORDERS_SQL} SELECT key, true AS on_one_page FROM lo")
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCAN: each key is on exactly one of the pages of 1000."""
    pages = K.scan_pages(T.orders(spark, sf_dir), NOW_NS, 1000)
    return pages.groupBy("key").agg(F.count("*").alias("n")).select(text("key"), (F.col("n") == 1).alias("on_one_page"))


@register(f"WITH {ORDERS_SQL} SELECT (row_number() OVER () - 1) // 1000 AS page, count(*) OVER (PARTITION BY 1) AS keys FROM lo QUALIFY (row_number() OVER () - 1) % 1000 = 0")
def scan_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCAN: the pages have consecutive numbers, and all keys together."""
    pages = K.scan_pages(T.orders(spark, sf_dir), NOW_NS, 1000).groupBy("page").count()
    return pages.select("page", F.sum("count").over(Window.partitionBy()).alias("keys"))


@register(f"WITH {CUSTOMERS_SQL} SELECT key FROM lc WHERE key LIKE 'customer:%:1%'")
def scan_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCAN MATCH: all pages."""
    return K.scan_pages(T.customers(spark, sf_dir), NOW_NS, 100, match="customer:*:1*").select(text("key"))


@register(f"WITH {CUSTOMERS_SQL} SELECT key FROM lc")
def scan_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCAN TYPE string: all pages."""
    return K.scan_pages(T.customers(spark, sf_dir), NOW_NS, 100, type_name="STRING").select(text("key"))


@register(f"WITH {ORDERS_SQL} SELECT count(*) AS n FROM ko WHERE deadline_ns <= {NOW_NS}")
def sweep_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expiry sweep: how many go."""
    return total(K.sweep(T.orders(spark, sf_dir), NOW_NS).replies)


@register(f"WITH {ORDERS_SQL} SELECT * FROM lo")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expiry sweep: what stays."""
    return state(K.sweep(T.orders(spark, sf_dir), NOW_NS).state)


@register("SELECT CAST(1 AS BIGINT) AS keys, CAST(1 AS BIGINT) AS live_keys")
def randomkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RANDOMKEY: one key, which is live."""
    ks = T.orders(spark, sf_dir)
    drawn = K.randomkey(ks, NOW_NS).join(live(ks, NOW_NS).select("key", F.lit(1).alias("is_live")), "key", "left")
    return drawn.agg(F.count("*").alias("keys"), F.count("is_live").alias("live_keys"))


# Server commands


@register(f"WITH {ORDERS_SQL} SELECT count(*) AS dbsize FROM lo")
def dbsize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DBSIZE."""
    return V.dbsize(T.orders(spark, sf_dir), NOW_NS)


@register(f"WITH {ORDERS_SQL} SELECT '# Keyspace' || chr(13) || chr(10) || 'db0:keys=' || count(*) || ',expires=' || count(deadline_ns) || ',avg_ttl=0' || chr(13) || chr(10) || chr(13) || chr(10) AS info FROM lo")
def info_keyspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INFO keyspace."""
    return V.info(T.orders(spark, sf_dir), NOW_NS, "keyspace")


@register("SELECT CAST(0 AS BIGINT) AS dbsize")
def flushdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLUSHDB, and the size after it."""
    return V.dbsize(V.flushdb(T.orders(spark, sf_dir)).state, NOW_NS)


@register("SELECT CAST(0 AS BIGINT) AS dbsize")
def flushall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLUSHALL, and the size after it."""
    return V.dbsize(V.flushall(T.orders(spark, sf_dir)).state, NOW_NS)


@register("SELECT CAST(208 AS BIGINT) AS commands")
def command_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COMMAND COUNT."""
    return V.command_count(spark)


@register("SELECT * FROM (VALUES (0, 'GET', 2, 'readonly,fast', 1, 1, 1), (1, 'MSETNX', -3, 'write', 1, -1, 2), (2, NULL, NULL, NULL, NULL, NULL, NULL)) t(ord, name, arity, flags, first_key, last_key, step)")
def command_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COMMAND INFO of two known names and an unknown one."""
    return V.command_info(spark, ["get", "MSetNX", "nothing"]).withColumn("flags", F.when(F.col("flags").isNotNull(), F.array_join("flags", ",")))


@register("SELECT CAST(count(*) AS BIGINT) AS names, CAST(207 AS BIGINT) AS several FROM range(208)")
def command_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COMMAND: rows, and different names among them."""
    return V.command(spark).agg(F.count("*").alias("names"), F.countDistinct("name").alias("several"))


@register("SELECT CAST(0 AS BIGINT) AS n")
def command_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COMMAND DOCS, LIST and GETKEYS: no rows."""
    return V.command_docs(spark).unionByName(V.command_list(spark)).unionByName(V.command_getkeys(spark)).agg(F.count("*").alias("n"))


@register(
    f"""WITH {ORDERS_SQL} SELECT '# Server' || e || 'version:0.1.0' || e || 'arch_bits:64' || e || e || '# Clients' || e || 'connected_clients:0' || e || e || '# Memory' || e || 'used_memory:0' || e || 'used_memory_human:0B' || e || e
    || '# Keyspace' || e || 'db0:keys=' || n || ',expires=' || x || ',avg_ttl=0' || e || e AS info FROM (SELECT chr(13) || chr(10) AS e, count(*) AS n, count(deadline_ns) AS x FROM lo)"""
)
def info_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INFO: all sections."""
    return V.info(T.orders(spark, sf_dir), NOW_NS)


def _until(kind: str, n: int):
    """The keyspace after SET or GETEX of all orders with one of OPTIONS."""
    command = S.set_ if kind == "set" else S.getex
    return lambda spark, sf_dir: state(command(T.orders(spark, sf_dir), bumped(spark, sf_dir), NOW_NS, **{OPTIONS[n][0]: OPTIONS[n][1]}).state)


def bumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for all orders, with the order's number as the value."""
    o = T.table(spark, sf_dir, "orders")
    number = F.col("o_orderkey").cast("string")
    return o.select(F.col("o_orderkey").cast("long").alias("ord"), F.concat(F.lit("order:"), number).cast("binary").alias("key"), number.cast("binary").alias("val"))


SECOND = NOW_NS // 10**9
OPTIONS = [("px", 1500, NOW_NS + 1500 * 10**6), ("exat", SECOND + 77, (SECOND + 77) * 10**9), ("pxat", SECOND * 1000 + 5, (SECOND * 1000 + 5) * 10**6)]
for _n, (_option, _, _deadline) in enumerate(OPTIONS):
    QUERIES[f"set_{_option}"] = _until("set", _n)
    ORACLES[f"set_{_option}"] = f"SELECT 'order:' || o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS val, CAST({_deadline} AS BIGINT) AS deadline_ns FROM orders"
    QUERIES[f"getex_{_option}"] = _until("getex", _n)
    ORACLES[f"getex_{_option}"] = f"WITH {ORDERS_SQL} SELECT key, val, CAST({_deadline} AS BIGINT) AS deadline_ns FROM lo"


def _constant(name: str, make: Callable[[SparkSession], DataFrame], kind: str, value: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(spark).select("kind", F.col("bulk").cast("string").alias("val"))
    ORACLES[name] = f"SELECT '{kind}' AS kind, '{value}' AS val"


_constant("ping", V.ping, "status", "PONG")
_constant("ping_message", lambda s: V.ping(s, "hello"), "bulk", "hello")
_constant("echo", lambda s: V.echo(s, "hello"), "bulk", "hello")
_constant("quit", V.quit_, "status", "OK")
_constant("select_db", lambda s: V.select(s, "0"), "status", "OK")
_constant("select_other", lambda s: V.select(s, "1"), "error", "ERR DB index is out of range")
_constant("multi", V.multi, "error", "ERR MULTI/EXEC is not yet implemented")
_constant("watch", V.watch, "error", "ERR MULTI/EXEC is not yet implemented")
_constant("exec", V.exec_, "error", "ERR EXEC without MULTI")
_constant("discard", V.discard, "error", "ERR DISCARD without MULTI")
_constant("unwatch", V.unwatch, "status", "OK")


@register("SELECT true AS near_the_clock, true AS micros_fit")
def time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIME: within an hour of the clock that the plan was made by, and microseconds of a second."""
    now = int(clock.time())
    return V.time(spark).select(F.col("seconds").between(now - 3600, now + 3600).alias("near_the_clock"), F.col("micros").between(0, 999_999).alias("micros_fit"))


# Functions


@register(f"WITH {ORDERS_SQL} SELECT key, val, CAST(8 AS BIGINT) AS bytes FROM lo")
def memory_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated size of values: integers here."""
    return live(T.orders(spark, sf_dir), NOW_NS).select(text("key"), text("val"), memory(F.col("vtype"), F.col("val"), F.col("is_int")).alias("bytes"))


#: CRC-16 (polynomial 0x1021) bit by bit: each byte's eight bits are shifted in from the top.
SLOT_SQL = """WITH k AS (SELECT key, CASE WHEN length(regexp_extract(key, '^[^{]*[{]([^}]+)[}]', 1)) > 0 THEN regexp_extract(key, '^[^{]*[{]([^}]+)[}]', 1) ELSE key END AS tag FROM (
    SELECT 'customer:' || c_nationkey || ':' || c_custkey AS key FROM customer
    UNION ALL SELECT 'cart:{' || c_nationkey || '}:' || c_custkey FROM customer
    UNION ALL SELECT 'empty{}' || c_custkey FROM customer)),
  c AS (SELECT key, list_reduce(list_prepend(0::BIGINT, flatten(list_transform(range(1, length(tag) + 1), lambda i: list_transform(range(8), lambda j: ((ascii(substr(tag, i, 1)) >> (7 - j)) & 1)::BIGINT)))),
    lambda crc, bit: CASE WHEN xor((crc >> 15) & 1, bit) = 1 THEN xor((crc << 1) & 65535, 4129) ELSE (crc << 1) & 65535 END) AS crc FROM k)
  SELECT key, CAST(crc % 16384 AS INT) AS slot FROM c"""


@register(SLOT_SQL)
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of each customer's key, of keys with a tag, and of keys with an empty tag."""
    c, number = T.customers(spark, sf_dir).select(text("key")), F.split("key", ":")
    tagged = c.select(F.concat(F.lit("cart:{"), number[1], F.lit("}:"), number[2]).alias("key"))
    every = c.unionByName(tagged).unionByName(c.select(F.concat(F.lit("empty{}"), number[2]).alias("key")))
    return every.select("key", slot(F.col("key").cast("binary")).alias("slot"))


# The wire protocol


@register(f"WITH {ORDERS_SQL}, {ASKED_SQL} SELECT ord, coalesce('$' || length(lo.val) || chr(13) || chr(10) || lo.val || chr(13) || chr(10), '$-1' || chr(13) || chr(10)) AS bytes FROM r LEFT JOIN lo ON lo.key = r.key")
def wire_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of MGET's replies."""
    out = S.mget(T.orders(spark, sf_dir), asked(spark, sf_dir), NOW_NS)
    none = F.lit(None).cast("array<binary>")
    return out.select("ord", resp.encoded(F.col("kind"), F.col("ival"), F.col("bulk"), none).cast("string").alias("bytes"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS id, n, CASE n WHEN 0 THEN 'SET' ELSE 'GET' END AS name, CASE n WHEN 0 THEN c_custkey || ',' || c_name ELSE CAST(c_custkey AS VARCHAR) END AS args FROM customer, (VALUES (0), (1)) t(n)")
def wire_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commands a row, an array of bulk strings and an inline line, from their bytes."""
    c = T.table(spark, sf_dir, "customer")
    end = F.lit("\r\n")
    bulk_ = lambda v: F.concat(F.lit("$"), F.octet_length(v).cast("string"), end, v, end)
    key = F.col("c_custkey").cast("string")
    raw = F.concat(F.lit("*3"), end, bulk_(F.lit("set")), bulk_(key), bulk_(F.col("c_name")), F.lit("get  "), key, end)
    got = resp.decode(c.select(key.alias("id"), raw.cast("binary").alias("bytes")))
    return got.select("id", "n", "name", F.array_join(F.transform("args", lambda a: a.cast("string")), ",").alias("args"))


# Command logs

SEGMENTS_SQL = """g AS (SELECT *, sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM events),
  z AS (SELECT *, max(part) OVER (PARTITION BY user_id) AS last FROM g)"""


@register(
    f"""WITH {SEGMENTS_SQL}, c AS (SELECT * FROM z WHERE part = last)
    SELECT 'user:' || user_id AS key, CAST(arg_max(event_id, ts) AS DOUBLE) AS n FROM c WHERE event_type = 'signup' GROUP BY user_id
    UNION ALL SELECT 'clicks:' || user_id, CAST(count(*) AS DOUBLE) FROM c WHERE event_type = 'click' GROUP BY user_id
    UNION ALL SELECT 'spend:' || user_id, round(sum(value), 4) FROM c WHERE event_type = 'purchase' GROUP BY user_id"""
)
def replay_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyspace after the log of all events."""
    after = replay(keyspace(spark, []), T.event_commands(spark, sf_dir)).state
    return after.select(text("key"), F.round(F.col("val").cast("string").cast("double"), 4).alias("n"))


def line(at: int, name: str, *args) -> Column:
    """A command of a log at a place in its order."""
    return F.struct(F.lit(at).cast("long").alias("seq"), F.lit(0).cast("long").alias("conn_id"), F.lit(NOW_NS).cast("long").alias("now_ns"), F.lit(name).alias("name"), F.array(*(a.cast("binary") if isinstance(a, Column) else F.lit(a).cast("binary") for a in args)).cast("array<binary>").alias("args"))


BIG = 1 << 40  # after all customers' numbers


def barrier_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers are set; one is renamed, one copied; MSETNX fails on a known name and then succeeds; sizes in between."""
    c = T.table(spark, sf_dir, "customer")
    number = F.col("c_custkey").cast("string")
    sets = c.select(F.col("c_custkey").cast("long").alias("seq"), F.lit(0).cast("long").alias("conn_id"), F.lit(NOW_NS).cast("long").alias("now_ns"), F.lit("SET").alias("name"), F.array(F.concat(F.lit("c:"), number).cast("binary"), F.col("c_name").cast("binary")).alias("args"))
    more = [("DBSIZE",), ("RENAME", "c:1", "moved:1"), ("COPY", "c:2", "copy:2"), ("MSETNX", "c:2", "x", "new:1", "y"), ("MSETNX", "new:2", "x", "new:1", "y"), ("DBSIZE",), ("GET", "moved:1"), ("EXISTS", "c:1"), ("GET", "new:1")]
    lines = spark.range(1).select(F.explode(F.array(*(line(BIG + i, *command) for i, command in enumerate(more)))).alias("l")).select("l.*")
    return sets.unionByName(lines)


@register(
    """SELECT 'c:' || c_custkey AS key, c_name AS val FROM customer WHERE c_custkey <> 1 UNION ALL SELECT 'moved:1', c_name FROM customer WHERE c_custkey = 1
    UNION ALL SELECT 'copy:2', c_name FROM customer WHERE c_custkey = 2 UNION ALL VALUES ('new:1', 'y'), ('new:2', 'x')"""
)
def replay_barriers_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyspace after a log with RENAME, COPY, MSETNX and DBSIZE among writes."""
    return replay(keyspace(spark, []), barrier_log(spark, sf_dir)).state.select(text("key"), text("val"))


@register(
    f"""SELECT seq - {BIG} AS n, kind, ival, val FROM (
    SELECT {BIG} AS seq, 'int' AS kind, count(*) AS ival, NULL AS val FROM customer UNION ALL VALUES ({BIG} + 1, 'status', NULL, 'OK'), ({BIG} + 2, 'int', 1, NULL), ({BIG} + 3, 'int', 0, NULL), ({BIG} + 4, 'int', 1, NULL)
    UNION ALL SELECT {BIG} + 5, 'int', count(*) + 3, NULL FROM customer UNION ALL SELECT {BIG} + 6, 'bulk', NULL, c_name FROM customer WHERE c_custkey = 1 UNION ALL VALUES ({BIG} + 7, 'int', 0, NULL), ({BIG} + 8, 'bulk', NULL, 'y'))"""
)
def replay_barriers_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies to its last commands."""
    out = replay(keyspace(spark, []), barrier_log(spark, sf_dir)).replies.filter(F.col("seq") >= BIG)
    return out.select((F.col("seq") - BIG).alias("n"), "kind", "ival", F.col("bulk").cast("string").alias("val"))


VIEWS_SQL = f"WITH {SEGMENTS_SQL}, x AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS val FROM z) SELECT epoch_us(ts) AS at, user_id, CAST(val AS VARCHAR) AS val FROM x WHERE event_type = 'view'"


@register(VIEWS_SQL)
def replay_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies to the log's GETs."""
    log = T.event_commands(spark, sf_dir)
    out = replay(keyspace(spark, []), log).replies
    views = log.filter("name = 'GET'").select("seq", F.expr("now_ns div 1000").alias("at"), F.col("conn_id").alias("user_id"))
    return views.join(out, "seq").select("at", "user_id", F.col("bulk").cast("string").alias("val"))


@register(VIEWS_SQL)
def stream_replay_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same replies from the log as a stream of files, into files."""
    base, log = shared_folder(spark), T.event_commands(spark, sf_dir)
    log.write.parquet(f"{base}/log")
    out = stream.replies(stream.read_commands(spark, f"{base}/log", 1000))
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    views = log.filter("name = 'GET'").select("seq", F.expr("now_ns div 1000").alias("at"), F.col("conn_id").alias("user_id"))
    return views.join(spark.read.parquet(f"{base}/out"), "seq").select("at", "user_id", F.col("bulk").cast("string").alias("val"))


@register("SELECT 'clicks:' || user_id AS key, CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'click' GROUP BY user_id")
def replay_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of counters alone, summed before the shuffle."""
    return counters(T.event_commands(spark, sf_dir).filter("name = 'INCR'")).select(text("key"), "total", "n")
