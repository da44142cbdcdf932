import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyflow.functions import glob, values


def simple_match(p: bytes, s: bytes) -> bool:
    """Globs, recursively."""
    if not p:
        return not s
    c, rest = p[:1], p[1:]
    if c == b"*":
        return any(simple_match(rest, s[i:]) for i in range(len(s) + 1))
    if not s:
        return False
    if c == b"?":
        return simple_match(rest, s[1:])
    if c == b"\\":
        return bool(rest) and rest[:1] == s[:1] and simple_match(rest[1:], s[1:])
    if c == b"[":
        negate = rest[:1] in (b"^", b"!")
        i, found = int(negate), False
        while i < len(rest) and rest[i : i + 1] != b"]":
            if i + 2 < len(rest) and rest[i + 1 : i + 2] == b"-" and rest[i + 2 : i + 3] != b"]":
                found |= rest[i] <= s[0] <= rest[i + 2]
                i += 3
            else:
                found |= rest[i] == s[0]
                i += 1
        return found != negate and simple_match(rest[i + 1 :], s[1:])
    return c == s[:1] and simple_match(rest, s[1:])


texts = st.lists(st.sampled_from([b"a", b"b", b"z", b"-", b"]", b"[", b"^", b"!", b"*", b"?", b"\\", b"\n", b"\xff", b"\x00"]), max_size=7).map(b"".join)


@settings(max_examples=600, deadline=None)
@given(texts, texts)
def test_globs_equal_a_simple_matcher(pattern, key):
    expected = simple_match(pattern, key)
    assert bool(glob.python_regex(pattern).match(key)) == expected
    if expected:
        start, _ = glob.prefix(pattern)
        end = glob.above(start)
        assert key >= start and (end is None or not start or key < end)


def test_globs_in_spark(spark):
    keys = [b"hello", b"ho", b"hex", b"h*llo", b"h\xffo", b"h\no", b"M", b"m"]
    df = spark.createDataFrame([(k,) for k in keys], "key binary")
    for pattern in (b"h*o", b"h?o", b"[a-z]", rb"h\*llo", b"h[^a]o", b"*", b"", b"h[", b"\\", b"\xff*", b"h[]o"):
        got = {bytes(r.key) for r in df.filter(glob.matches(F.col("key"), pattern)).collect()}
        assert got == {k for k in keys if simple_match(pattern, k)}, pattern


def test_numbers(spark):
    cases = {b"5": (b"5", True), b"+5": (b"5", True), b"007": (b"7", True), b"-0": (b"0", True), b" 1": (b" 1", False), b"1.0": (b"1.0", False), b"": (b"", False), b"9223372036854775807": (b"9223372036854775807", True), b"9223372036854775808": (b"9223372036854775808", False), b"000000000000000000001": (b"000000000000000000001", False), b"1\n": (b"1\n", False), b"\xff": (b"\xff", False)}
    df = spark.createDataFrame([(k,) for k in cases], "v binary")
    val, is_int = values.canonical(F.col("v"))
    assert {bytes(r.v): (bytes(r.a), r.b) for r in df.select("v", val.alias("a"), is_int.alias("b")).collect()} == cases
    floats = {b"1.5": 1.5, b"1e3": 1000.0, b".5": 0.5, b"5.": 5.0, b"1.5f": None, b" 1": None, b"inf": None, b"nan": None, b"1e999": None, b"-2": -2.0}
    df = spark.createDataFrame([(k,) for k in floats], "v binary")
    assert {bytes(r.v): r.f for r in df.select("v", values.to_float(F.col("v")).alias("f")).collect()} == floats


def test_float_texts():
    for x, t in {3.0: "3.0", 10.5: "10.5", 1e15: "1000000000000000.0", 1e16: "1e16", 1.5e300: "1.5e300", 0.1: "0.1", -0.0: "-0.0", 1e-5: "1e-5", 1.25e-7: "1.25e-7", 0.001: "0.001"}.items():
        assert values.float_text(x) == t


@settings(max_examples=300, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_texts_come_back(x):
    assert float(values.float_text(x)) == x and re.search(r"[.e]", values.float_text(x))


def test_slots(spark):
    assert values.crc16(b"123456789") == 0x31C3
    assert values.slot_of(b"user:{123}.name") == values.slot_of(b"user:{123}.email") == values.crc16(b"123") % 16384
    assert values.slot_of(b"a{}b") == values.crc16(b"a{}b") % 16384
    df = spark.createDataFrame([(b"a{x}",), (None,)], "key binary")
    assert [r[0] for r in df.select(values.slot(F.col("key"))).collect()] == [values.crc16(b"x") % 16384, None]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=8), st.integers(-10, 10), st.integers(-10, 10))
def test_ranges_of_the_fold(value, start, end):
    from keyflow.plans.fold import getrange

    n = len(value)
    a, b = (max(0, n + i) if i < 0 else i for i in (start, end))
    assert getrange(value, start, end) == bytes(value[i] for i in range(n) if a <= i <= b)
