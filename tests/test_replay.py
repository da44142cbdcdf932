import random

import pytest

from keyflow.model import COMMANDS, keyspace
from keyflow.plans.replay import final, replay

from .model import Store

SEC = 10**9


def log(spark, rows):
    """Rows of (now, name, *args)."""
    b = lambda v: v if isinstance(v, bytes) else str(v).encode()
    return spark.createDataFrame([(i, 1, now, name, [b(a) for a in args]) for i, (now, name, *args) in enumerate(rows)], COMMANDS)


def shown(replies):
    """Replies by seq, in the test model's form."""
    out, elements = {}, {}
    for r in replies.collect():
        bulk = None if r.bulk is None else bytes(r.bulk)
        if r.kind == "element":
            elements.setdefault(r.seq, []).append(bulk)
        elif r.kind == "array":
            out[r.seq] = None if r["items"] is None else [None if x is None else bytes(x) for x in r["items"]]
        else:
            out[r.seq] = {"int": r.ival, "bulk": bulk, "nil": None}.get(r.kind, bulk.decode() if r.kind in ("status", "error") else None)
    for seq in [s for s, v in out.items() if v is None and s in elements]:
        out[seq] = sorted(elements[seq])
    return out


def held(state):
    return {bytes(r.key): (bytes(r.val), r.deadline_ns) for r in state.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_equal_a_dictionary(spark, seed):
    rng = random.Random(seed)
    keys = [b"a", b"b", b"c", b"user:1", b"user:2", b"\xff\x00"]
    vals = [b"x", b"007", b"+5", b"-0", b"12", b"", b"\x00\xff", b"9223372036854775807"]
    rows, now = [], 1000 * SEC
    for _ in range(120):
        now += rng.choice([0, SEC // 2, 2 * SEC])
        k, v = rng.choice(keys), rng.choice(vals)
        name = rng.choices(["GET", "SET", "SETNX", "SETEX", "GETDEL", "APPEND", "INCRBY", "EXPIRE", "PERSIST", "TTL", "DEL", "EXISTS", "MGET", "MSET", "RENAME", "COPY", "DBSIZE", "KEYS", "FLUSHDB"], [8, 8, 3, 4, 2, 4, 6, 4, 2, 4, 3, 2, 3, 3, 0.4, 0.4, 0.4, 0, 0.2])[0]
        k2 = rng.choice(keys)
        args = {"GET": [k], "SET": [k, v], "SETNX": [k, v], "SETEX": [k, rng.randint(1, 9), v], "GETDEL": [k], "APPEND": [k, v], "INCRBY": [k, rng.choice([1, -3, 2**62])], "EXPIRE": [k, rng.choice([-1, 0, 3, 50])], "PERSIST": [k], "TTL": [k], "DEL": [k, k2], "EXISTS": [k, k, k2], "MGET": [k, k2, b"none"], "MSET": [k, v, k2, b"2", k, b"last"], "RENAME": [k, k2], "COPY": [k, k2], "DBSIZE": [], "KEYS": ["user:*"], "FLUSHDB": []}[name]
        rows.append((now, name, *args))
    store, expected = Store(), {}
    for i, (at, name, *args) in enumerate(rows):
        expected[i] = store.run(at, name, [a if isinstance(a, bytes) else str(a).encode() for a in args])
    out = replay(keyspace(spark, []), log(spark, rows))
    got = shown(out.replies)
    assert {i: got.get(i) for i in expected} == expected
    store.sweep(now)
    assert held(final(out.state, now)) == {k: tuple(v) for k, v in store.rows.items()}


def test_errors_and_connections(spark):
    rows = [(1, "get"), (1, "NOSUCH", "x"), (1, "LPUSH", "k", "v"), (1, "GeT", "k"), (1, "PING"), (1, "PING", "hi"), (1, "ECHO", "x"), (1, "SELECT", "0"), (1, "SELECT", "1"), (1, "MULTI"), (1, "EXEC"), (1, "DISCARD"), (1, "WATCH", "k"), (1, "UNWATCH"), (1, "COMMAND", "COUNT"), (1, "EXPIRE", "k", "5", "NX"), (1, "MSET", "a"), (1, "MSET", "a", "1", "b"), (1, "QUIT"), (1, "GET", "k")]
    got = shown(replay(keyspace(spark, []), log(spark, rows)).replies)
    assert got[0] == "ERR wrong number of arguments for command" == got[15] == got[16]
    assert got[1] == "ERR unknown command" and got[2] == "ERR command not yet implemented"
    assert [got[i] for i in range(3, 15)] == [None, "PONG", b"hi", b"x", "OK", "ERR DB index is out of range", "ERR MULTI/EXEC is not yet implemented", "ERR EXEC without MULTI", "ERR DISCARD without MULTI", "ERR MULTI/EXEC is not yet implemented", "OK", 208]
    assert got[17] == "ERR syntax error" and got[18] == "OK" and 19 not in got


def test_flags_of_expire_without_the_wire(spark):
    rows = [(SEC, "SET", "k", "v"), (SEC, "EXPIRE", "k", "5", "XX"), (SEC, "EXPIRE", "k", "5", "GT"), (SEC, "EXPIRE", "k", "3", "GT"), (SEC, "EXPIRE", "k", "3", "LT"), (SEC, "EXPIRE", "k", "9", "NX"), (SEC, "TTL", "k"), (SEC, "EXPIRE", "k", "9", "WHAT")]
    got = shown(replay(keyspace(spark, []), log(spark, rows), strict_wire=False).replies)
    assert [got[i] for i in range(8)] == ["OK", 0, 1, 0, 1, 0, 3, "ERR syntax error"]
    assert shown(replay(keyspace(spark, []), log(spark, [(1, "KEYS", "*"), (1, "SCAN", "0"), (1, "RANDOMKEY"), (1, "INFO", "keyspace")])).replies)[2] is None


def test_an_empty_log_and_an_empty_keyspace(spark):
    out = replay(keyspace(spark, {"a": 1}), spark.createDataFrame([], COMMANDS))
    assert out.replies.count() == 0 and held(out.state) == {b"a": (b"1", None)}
