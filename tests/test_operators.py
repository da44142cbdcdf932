"""The operators one by one on small keyspaces."""

import pytest

from keyflow.model import NS, CommandError, keyspace, request
from keyflow.operators import keys as K
from keyflow.operators import server as V
from keyflow.operators import strings as S

NOW = 1000 * NS


def rows(replies):
    out = []
    for r in sorted(replies.collect(), key=lambda r: r.ord):
        bulk = None if r.bulk is None else bytes(r.bulk)
        out.append(r.ival if r.kind == "int" else bulk if r.kind in ("bulk", "nil") else bulk.decode())
    return out


def held(state, now=NOW):
    return {bytes(r.key).decode(): bytes(r.val) for r in state.collect() if r.deadline_ns is None or r.deadline_ns > now}


@pytest.fixture(scope="module")
def ks(spark):
    return keyspace(spark, [("foo", "old", None), ("num", 42, None), ("text", "Hello, World!", None), ("soon", "s", NOW + 5 * NS), ("gone", "g", NOW), ("max", 2**63 - 1, None)]).cache()


def test_reads(spark, ks):
    ask = request(spark, ["foo", "missing", "num", "gone", "foo"])
    assert rows(S.get(ks, ask, NOW)) == [b"old", None, b"42", None, b"old"] == rows(S.mget(ks, ask, NOW, ["foo", "missing", "num", "gone"]))
    assert rows(S.strlen(ks, ask, NOW)) == [3, 0, 2, 0, 3]
    assert rows(K.type_of(ks, ask, NOW)) == ["string", "none", "string", "none", "string"]
    assert rows(K.exists(ks, ask, NOW)) == [3] == rows(K.touch(ks, ask, NOW))
    assert rows(K.ttl(ks, request(spark, ["soon", "foo", "gone"]), NOW)) == [5, -1, -2]
    assert rows(K.pttl(ks, request(spark, ["soon"]), NOW)) == [5000]
    assert rows(K.expiretime(ks, request(spark, ["soon"]), NOW)) == [1005] and rows(K.pexpiretime(ks, request(spark, ["soon"]), NOW)) == [1_005_000]
    ranges = request(spark, [("text", 0, 4), ("text", -6, -1), ("text", -5, -100), ("text", 20, 30), ("text", 5, 2), ("missing", 0, 1)], "start long, end long")
    assert rows(S.getrange(ks, ranges, NOW)) == [b"Hello", b"World!", b"", b"", b"", b""]
    assert rows(S.getrange(keyspace(spark, {"k": "abc"}), request(spark, [("k", -5, -10)], "start long, end long"), NOW)) == [b"a"]


def test_a_list_of_keys_reaches_the_scan(spark, ks, tmp_path):
    ks.write.parquet(str(tmp_path / "ks"))
    stored = spark.read.parquet(str(tmp_path / "ks"))
    plan = S.get(stored, request(spark, ["foo"]), NOW, ["foo"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "key" in plan.split("PushedFilters")[1].split("]")[0]
    plan = K.keys(stored, "fo*", NOW)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqu" in plan


def test_set_and_its_options(spark, ks):
    new = lambda *pairs: request(spark, pairs, "val binary")
    out, state = S.set_(ks, new(("foo", "007"), ("x", "+5"), ("foo", "12345678901234567890123")), NOW)
    assert rows(out) == ["OK"] * 3 and held(state) == {"foo": b"12345678901234567890123", "x": b"5", "num": b"42", "text": b"Hello, World!", "soon": b"s", "max": str(2**63 - 1).encode()}
    out, state = S.set_(ks, new(("foo", "a"), ("x", "b"), ("x", "c")), NOW, nx=True)
    assert rows(out) == [None, "OK", None] and held(state)["x"] == b"b"
    out, state = S.set_(ks, new(("foo", "a"), ("x", "b")), NOW, xx=True)
    assert rows(out) == ["OK", None] and "x" not in held(state)
    out, state = S.set_(ks, new(("foo", "a"), ("foo", "b"), ("x", "c")), NOW, get=True, ex=10)
    assert rows(out) == [b"old", b"a", None] and held(state, NOW + 10 * NS).keys() == {"num", "text", "max"}
    _, state = S.set_(ks, new(("soon", "kept")), NOW)
    assert held(state)["soon"] == b"kept" and "soon" not in held(state, NOW + 5 * NS)
    for bad in ({"nx": True, "xx": True}, {"ex": 0}, {"pxat": -1}, {"ex": 2**60}):
        with pytest.raises(CommandError):
            S.set_(ks, new(("a", "b")), NOW, **bad)
    assert rows(S.setnx(ks, new(("foo", "a"), ("x", "b")), NOW).replies) == [0, 1]
    out, state = S.setex(ks, request(spark, [("foo", 10, "a"), ("x", 0, "b")], "seconds long, val binary"), NOW)
    assert rows(out) == ["OK", "ERR value is not an integer or out of range"] and "x" not in held(state) and "foo" not in held(state, NOW + 10 * NS)
    assert "foo" in held(S.psetex(ks, request(spark, [("foo", 5000, "a")], "millis long, val binary"), NOW).state, NOW + 4 * NS)
    out, state = S.msetnx(ks, new(("a", "1"), ("b", "2"), ("a", "3")), NOW)
    assert rows(out) == [1] and held(state)["a"] == b"3"
    out, state = S.msetnx(ks, new(("a", "1"), ("foo", "2")), NOW)
    assert rows(out) == [0] and "a" not in held(state)
    assert rows(S.mset(ks, new(("a", "1")), NOW).replies) == ["OK"]
    assert rows(S.getset(ks, new(("foo", "1"), ("foo", "2"), ("none", "3")), NOW).replies) == [b"old", b"1", None]
    out, state = S.getdel(ks, request(spark, ["foo", "foo", "none"]), NOW)
    assert rows(out) == [b"old", None, None] and "foo" not in held(state)
    assert "soon" in held(S.getex(ks, request(spark, ["soon"]), NOW, persist=True).state, NOW + 99 * NS)
    assert "foo" not in held(S.getex(ks, request(spark, ["foo"]), NOW, px=1).state, NOW + NS)


def test_counters_and_edits(spark, ks):
    by = lambda *pairs: request(spark, pairs, "delta long")
    out, state = S.incrby(ks, by(("num", 10), ("new", -3), ("num", -60), ("foo", 1), ("max", 1), ("max", -5), ("max", 6)), NOW)
    no = "ERR value is not an integer or out of range"
    assert rows(out) == [52, -3, -8, no, "ERR increment or decrement would overflow", 2**63 - 6, "ERR increment or decrement would overflow"]
    assert held(state)["num"] == b"-8" and held(state)["max"] == str(2**63 - 6).encode() and held(state)["foo"] == b"old"
    assert rows(S.incrby(ks, by(("foo", 2**63 - 1), ("foo", 2**63 - 1)), NOW).replies) == [no, no]
    assert rows(S.incr(ks, request(spark, ["num", "c", "c"]), NOW).replies) == [43, 1, 2] and rows(S.decr(ks, request(spark, ["c"]), NOW).replies) == [-1]
    assert rows(S.decrby(ks, by(("num", 2), ("num", -(2**63))), NOW).replies) == [40, no]
    out, state = S.incrbyfloat(ks, request(spark, [("num", 0.5), ("f", 3.0), ("foo", 1.0), ("num", 1e300)], "delta double"), NOW)
    assert rows(out) == [b"42.5", b"3.0", "ERR value is not a valid float", b"1e300"]
    out, state = S.append(ks, request(spark, [("foo", "er"), ("new", "1"), ("foo", "!")], "val binary"), NOW)
    assert rows(out) == [5, 1, 6] and held(state)["foo"] == b"older!" and held(state)["new"] == b"1"
    out, state = S.setrange(ks, request(spark, [("text", 7, "Earth"), ("new", 5, "x"), ("empty", 2, ""), ("foo", -1, "x"), ("text", 0, "J")], "offset long, val binary"), NOW)
    assert rows(out) == [13, 6, 2, no, 13]
    assert held(state)["text"] == b"Jello, Earth!" and held(state)["new"] == b"\0" * 5 + b"x" and held(state)["empty"] == b"\0\0" and held(state)["foo"] == b"old"


def test_deadlines(spark, ks):
    at = lambda *pairs: request(spark, pairs, "time long")
    out, state = K.expire(ks, at(("foo", 100), ("num", 0), ("missing", 5), ("num", 5)), NOW)
    assert rows(out) == [1, 1, 0, 0] and "num" not in held(state) and "foo" not in held(state, NOW + 100 * NS)
    assert rows(K.expire(ks, at(("foo", 9), ("soon", 9)), NOW, "nx").replies) == [1, 0]
    assert rows(K.pexpire(ks, at(("foo", 9), ("soon", 9)), NOW, "XX").replies) == [0, 1]
    assert rows(K.expireat(ks, at(("foo", 2000), ("soon", 1004), ("num", 999)), NOW, "gt").replies) == [1, 0, 1]
    assert rows(K.pexpireat(ks, at(("foo", 2_000_000), ("soon", 1_004_000), ("text", 2**62)), NOW, "lt").replies) == [1, 1, "ERR value is not an integer or out of range"]
    with pytest.raises(CommandError):
        K.expire(ks, at(("foo", 9)), NOW, "no")
    out, state = K.persist(ks, request(spark, ["soon", "soon", "foo"]), NOW)
    assert rows(out) == [1, 0, 0] and "soon" in held(state, NOW + 99 * NS)
    out, state = K.sweep(ks, NOW + 5 * NS)
    assert rows(out) == [2] and state.count() == 4


def test_names(spark, ks):
    to = lambda *pairs: request(spark, pairs, "target binary")
    out, state = K.rename(ks, to(("foo", "num"), ("missing", "x"), ("text", "text")), NOW)
    assert rows(out) == ["OK", "ERR no such key", "OK"] and held(state)["num"] == b"old" and "foo" not in held(state)
    out, state = K.rename(ks, to(("soon", "foo")), NOW)
    assert "foo" not in held(state, NOW + 5 * NS)
    assert rows(K.renamenx(ks, to(("foo", "num"), ("text", "y"), ("max", "max"), ("none", "z")), NOW).replies) == [0, 1, 0, "ERR no such key"]
    assert rows(K.copy(ks, to(("foo", "num"), ("foo", "y"), ("none", "z")), NOW).replies) == [0, 1, 0]
    out, state = K.copy(ks, to(("foo", "soon")), NOW, replace=True)
    assert rows(out) == [1] and held(state)["soon"] == b"old" and "soon" not in held(state, NOW + 5 * NS)
    out, state = K.delete(ks, request(spark, ["foo", "foo", "none", "gone"]), NOW)
    assert rows(out) == [1] and "foo" not in held(state)


def plan_of(spark, frame):
    """A plan without broadcasts, as for large tables, before it runs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return frame.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_meet_their_targets_in_one_join(spark, ks):
    to = lambda *pairs: request(spark, pairs, "target binary")
    state = K.copy(ks, to(("foo", "y"), ("none", "y"), ("num", "y"), ("text", "text"), ("gone", "z"), ("y", "q"), ("soon", "num")), NOW).state
    assert held(state) == held(ks) | {"y": b"42"} and state.count() == 6
    state = K.copy(ks, to(("foo", "num"), ("num", "soon"), ("text", "text"), ("soon", "gone"), ("text", "num")), NOW, replace=True).state
    assert held(state) == held(ks) | {"num": b"Hello, World!", "soon": b"42", "gone": b"s"} and not {"soon", "gone"} & set(held(state, NOW + 5 * NS))
    for replace in (False, True):
        plan = plan_of(spark, K.copy(ks, to(("foo", "y")), NOW, replace).state)
        assert plan.count("SortMergeJoin") == 2 and plan.count("Sort [") <= 4 and "Aggregate" not in plan and "Union" not in plan


def test_renames_move_rows_to_their_targets_in_one_shuffle(spark, ks):
    to = lambda *pairs: request(spark, pairs, "target binary")
    state = K.rename(ks, to(("foo", "num"), ("num", "foo"), ("none", "text"), ("gone", "text"), ("soon", "x"), ("max", "x"), ("text", "text")), NOW).state
    assert held(state) == {"num": b"old", "foo": b"42", "x": str(2**63 - 1).encode(), "text": b"Hello, World!"} and state.count() == 4
    state = K.rename(ks, to(("foo", "foo"), ("foo", "a"), ("foo", "b"), ("soon", "c")), NOW).state
    assert held(state) == {"a": b"old", "b": b"old", "num": b"42", "text": b"Hello, World!", "c": b"s", "max": str(2**63 - 1).encode()} and "c" not in held(state, NOW + 5 * NS)
    state = K.renamenx(ks, to(("foo", "num"), ("text", "y"), ("soon", "y"), ("max", "max"), ("num", "gone")), NOW).state
    assert held(state) == {"foo": b"old", "y": b"s", "max": str(2**63 - 1).encode(), "gone": b"42"}
    plan = plan_of(spark, K.rename(ks, to(("foo", "y")), NOW).state)
    assert plan.count("SortMergeJoin") == 1 and plan.count("Sort [") <= 3 and "Aggregate" not in plan and "Union" not in plan


def test_search(spark):
    ks = keyspace(spark, {f"k{i}": i for i in range(57)} | {"hello": 1, "hallo": 2, "hxllo": 3})
    names = lambda p: sorted(bytes(r.key).decode() for r in K.keys(ks, p, NOW).collect())
    assert len(names("*")) == 60 and names("h?llo") == ["hallo", "hello", "hxllo"] and names("h[ae]llo") == ["hallo", "hello"] and names("h[^ae]llo") == ["hxllo"] and names("k1") == ["k1"]
    seen, cursor = [], None
    for _ in range(100):
        page, cursor = K.scan(ks, cursor, NOW, count=10, match="k*")
        seen += [bytes(r.key) for r in page.collect()]
        if cursor is None:
            break
    assert sorted(seen) == sorted(f"k{i}".encode() for i in range(57))
    pages = K.scan_pages(ks, NOW, 7).groupBy("page").count().collect()
    assert sorted(r.page for r in pages) == list(range(9)) and {r["count"] for r in pages if r.page < 8} == {7}
    assert K.randomkey(ks, NOW).count() == 1 and K.randomkey(ks.limit(0), NOW).count() == 0


def test_server(spark, ks):
    assert V.dbsize(ks, NOW).first()[0] == 5 and V.dbsize(ks, NOW, swept=False).first()[0] == 6
    assert "db0:keys=5,expires=1,avg_ttl=0\r\n" in V.info(ks, NOW).first()[0]
    assert V.info(ks, NOW, "CLIENTS").first()[0] == "# Clients\r\nconnected_clients:0\r\n\r\n" and V.info(ks, NOW, "none").first()[0] == ""
    assert V.command_count(spark).first()[0] == 208
    assert V.dbsize(V.flushall(ks).state, NOW).first()[0] == 0
    assert V.command_docs(spark).count() == 0 and V.time(spark).first().seconds > 1_600_000_000


def test_append_of_nothing_changes_nothing(spark):
    from keyflow.operators import strings

    now = 1_000 * 10**9
    ks = keyspace(spark, {"a": "hello"})
    asked = request(spark, [("a", None), ("a", "x"), ("new", None)], "val binary")
    replies, after = strings.append(ks, asked, now)
    assert [(r.kind, r.ival) for r in replies.orderBy("ord").collect()] == [("error", None), ("int", 6), ("error", None)]
    assert [(bytes(r.key), bytes(r.val)) for r in after.collect()] == [(b"a", b"hellox")]


def test_running_sums_of_hot_keys_and_overflows(spark, monkeypatch):
    from keyflow.operators import strings

    now = 1_000 * 10**9
    rows = [("hot" if i % 3 else "cold", i % 7 - 2) for i in range(300)]
    ks = keyspace(spark, {"hot": 5})
    found = []
    for most in (100_000, 50):
        monkeypatch.setattr(strings, "HOT", most)
        replies, after = strings.incrby(ks, request(spark, rows, "delta long"), now)
        found.append(([r.ival for r in replies.orderBy("ord").collect()], sorted((bytes(r.key), bytes(r.val)) for r in after.collect())))
    sums, expected = {"hot": 5, "cold": 0}, []
    for key, delta in rows:
        sums[key] += delta
        expected.append(sums[key])
    assert found[0] == found[1] == (expected, sorted((k.encode(), str(v).encode()) for k, v in sums.items()))
    top = (1 << 63) - 1
    replies, after = strings.incrby(keyspace(spark, {"a": top - 1, "b": 0}), request(spark, [("a", 1), ("a", 1), ("a", -3), ("b", 2)], "delta long"), now)
    assert [(r.kind, r.ival) for r in replies.orderBy("ord").collect()] == [("int", top), ("error", None), ("int", top - 3), ("int", 2)]
    assert {bytes(r.key): bytes(r.val) for r in after.collect()} == {b"a": str(top - 3).encode(), b"b": b"2"}
