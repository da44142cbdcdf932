import pytest
from pyspark.sql import functions as F

from keyflow.model import COMMANDS, keyspace
from keyflow.plans.replay import replay
from keyflow.sources import resp
from keyflow.sources.keyspaces import load_files, save, save_files
from keyflow.streaming.replay import read_commands, replies


def test_commands_of_bytes():
    both = resp.command_bytes([b"SET", b"k", b"a\r\nb"]) + b"PING\r\n  get   k \r\n" + resp.command_bytes([b"GET", b""])
    assert [*resp.commands(both)] == [[b"SET", b"k", b"a\r\nb"], [b"PING"], [b"get", b"k"], [b"GET", b""]]
    for n in range(len(both)):
        assert len([*resp.commands(both[:n])]) <= 4
    assert [*resp.commands(b"*2\r\n$3\r\nGET\r\n:5\r\n*0\r\n*-1\r\n\r\n")] == [[b"GET", b"5"]]
    for bad in (b"*x\r\n", b"*2\r\n$-5\r\n", b"$3\r\nabcd\r\n", b"*1\r\n$99999999999\r\n", b"*1\r\n" * 40, b":a\r\n", b"#x\r\n"):
        with pytest.raises(resp.ProtocolError):
            [*resp.commands(bad)]


def test_decode_and_encode(spark):
    raw = spark.createDataFrame([("a", bytearray(resp.command_bytes([b"get", b"k"]) + b"PING\r\n")), ("b", bytearray(b"*x\r\n")), ("c", None)], "id string, bytes binary")
    got = [(r.id, r.n, r.name, None if r.args is None else [bytes(a) for a in r.args], r.error) for r in resp.decode(raw).collect()]
    assert sorted(got, key=str) == [("a", 0, "GET", [b"k"], None), ("a", 1, "PING", [], None), ("b", 0, None, None, "ERR protocol error")]
    rows = spark.createDataFrame([("status", None, b"OK", None), ("int", -2, None, None), ("nil", None, None, None), ("bulk", None, b"a\xff", None), ("error", None, b"ERR x", None), ("array", None, None, [b"a", None])], "kind string, ival long, bulk binary, items array<binary>")
    out = [bytes(r[0]) for r in rows.select(resp.encoded(F.col("kind"), F.col("ival"), F.col("bulk"), F.col("items"))).collect()]
    assert out == [b"+OK\r\n", b":-2\r\n", b"$-1\r\n", b"$2\r\na\xff\r\n", b"-ERR x\r\n", b"*2\r\n$1\r\na\r\n$-1\r\n"]


def test_stream_equals_batch(spark, tmp_path):
    sec = 10**9
    log = [("SET", "a", "1"), ("INCR", "a"), ("EXPIRE", "a", "5"), ("SET", "b", "x"), ("MGET", "a", "b"), ("GET", "a"), ("INCR", "a"), ("DEL", "a", "b"), ("APPEND", "b", "y")]
    rows = [(i, 1, i * 2 * sec, name, [a.encode() for a in args]) for i, (name, *args) in enumerate(log)]
    folder = tmp_path / "log"
    for n, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(str(folder))
        if n == 0:
            import time

            time.sleep(1.1)  # files are taken in the order of their times
    query = replies(read_commands(spark, str(folder))).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    streamed = {(r.seq, r.sub): (r.kind, r.ival, None if r.bulk is None else bytes(r.bulk)) for r in spark.sql("select * from out").collect()}
    batch = {r.seq: (r.kind, r.ival, None if r.bulk is None else bytes(r.bulk)) for r in replay(keyspace(spark, []), spark.createDataFrame(rows, COMMANDS)).replies.collect()}
    assert {s: v for (s, _), v in streamed.items() if log[s][0] not in ("MGET", "DEL")} == {s: v for s, v in batch.items() if log[s][0] not in ("MGET", "DEL")}
    assert [streamed[4, i] for i in range(2)] == [("nil", None, None) if 8 * sec >= 9 * sec else ("bulk", None, b"2"), ("bulk", None, b"x")]


def test_keyspaces_as_tables(spark, tmp_path):
    ks = keyspace(spark, {f"k{i}": i for i in range(50)})
    save_files(ks, str(tmp_path / "ks"))
    assert sorted(map(tuple, load_files(spark, str(tmp_path / "ks")).collect())) == sorted(map(tuple, ks.collect()))
    save(ks, "saved_keyspace", 4)
    try:
        asked = spark.createDataFrame([(b"k1",), (b"k2",)], "key binary")
        plan = spark.table("saved_keyspace").hint("merge").join(asked, "key")._jdf.queryExecution().executedPlan().toString()
        assert spark.table("saved_keyspace").count() == 50 and "SortMergeJoin" in plan
    finally:
        spark.sql("drop table saved_keyspace")
