"""One key's commands in order: what a command answers, and what it leaves.

This is the row-at-a-time meaning of the commands that touch one key, for replays and streams. An entry is (value, is_int,
deadline_ns) or None; a reply is (kind, ival, bulk). Entries of other types than strings don't occur in a command log.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from ..functions.values import float_text
from ..model import NOT_FLOAT, NOT_INTEGER, NS, NS_MS, OK, OVERFLOW, SYNTAX, WRONG_ARGS

MOST, LEAST = (1 << 63) - 1, -(1 << 63)


class Entry(NamedTuple):
    value: bytes
    is_int: bool = False
    deadline_ns: int | None = None


Reply = tuple[str, int | None, bytes | None]
NIL: Reply = ("nil", None, None)
DONE: Reply = ("status", None, OK.encode())


class Failed(Exception):
    """A command that answers an error and changes nothing."""


def number(n: int) -> Reply:
    return "int", n, None


def bulk(value: bytes | None) -> Reply:
    return NIL if value is None else ("bulk", None, value)


def whole(text: bytes | None) -> int:
    if text is None or not re.fullmatch(rb"[+-]?[0-9]+", text) or not LEAST <= (n := int(text)) <= MOST:
        raise Failed(NOT_INTEGER)
    return n


def real(text: bytes) -> float:
    if not re.fullmatch(rb"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", text) or math.isinf(x := float(text)):
        raise Failed(NOT_FLOAT)
    return x


def canonical(value: bytes) -> tuple[bytes, bool]:
    try:
        return (str(whole(value)).encode(), True) if len(value) <= 20 else (value, False)
    except Failed:
        return value, False


def put(value: bytes, deadline: int | None) -> Entry:
    return Entry(*canonical(value), deadline)


def until(n: int, base: int, unit: int) -> int:
    if n <= 0 or base + n * unit > MOST:
        raise Failed(NOT_INTEGER)
    return base + n * unit


TIMES = {b"EX": (True, NS), b"PX": (True, NS_MS), b"EXAT": (False, NS), b"PXAT": (False, NS_MS)}


def after(option: bytes, args: list[bytes], at: int, now: int) -> int:
    """The deadline of a time option whose number stands at ``at``."""
    relative, unit = TIMES[option]
    return until(whole(args[at] if at < len(args) else None), now if relative else 0, unit)


def set_(old: Entry | None, args: list[bytes], now: int) -> tuple[Reply, Entry | None]:
    deadline, flags, at = None, set(), 1
    while at < len(args):
        option = args[at].upper()
        if option in TIMES:
            at += 1
            deadline = after(option, args, at, now)
        elif option in (b"NX", b"XX", b"GET", b"KEEPTTL"):
            flags.add(option)
        else:
            raise Failed(SYNTAX)
        at += 1
    if {b"NX", b"XX"} <= flags:
        raise Failed(SYNTAX)
    acts = not (b"NX" in flags and old or b"XX" in flags and not old)
    keep = old and (deadline is None or b"KEEPTTL" in flags)
    new = put(args[0], old.deadline_ns if keep else deadline) if acts else old
    return (bulk(old and old.value) if b"GET" in flags else DONE if acts else NIL), new


def getex(old: Entry | None, args: list[bytes], now: int) -> tuple[Reply, Entry | None]:
    if old is None:
        return NIL, None
    new = old
    if args:
        option = args[0].upper()
        if option in TIMES:
            new = old._replace(deadline_ns=after(option, args, 1, now))
        elif option == b"PERSIST":
            new = old._replace(deadline_ns=None)
        elif option != b"KEEPTTL":
            raise Failed(SYNTAX)
    return bulk(old.value), new


def getrange(value: bytes, start: int, end: int) -> bytes:
    start, end = (max(0, len(value) + i) if i < 0 else i for i in (start, end))
    return value[start : end + 1] if start <= end else b""


def add(old: Entry | None, n: int) -> tuple[Reply, Entry]:
    total = (whole(old.value) if old else 0) + n
    if not LEAST <= total <= MOST:
        raise Failed(OVERFLOW)
    return number(total), Entry(str(total).encode(), True, old and old.deadline_ns)


def add_float(old: Entry | None, text: bytes) -> tuple[Reply, Entry]:
    step = real(text)
    total = (real(old.value) if old else 0.0) + step
    if math.isinf(total):
        raise Failed(NOT_FLOAT)
    shown = float_text(total).encode()
    return bulk(shown), Entry(shown, False, old and old.deadline_ns)


def expire(old: Entry | None, args: list[bytes], now: int, relative: bool, unit: int) -> tuple[Reply, Entry | None]:
    if not args:
        raise Failed(WRONG_ARGS)
    n, flags = whole(args[0]), {a.upper() for a in args[1:]}
    if not flags <= {b"NX", b"XX", b"GT", b"LT"}:
        raise Failed(SYNTAX)
    deadline = n * unit + (now if relative else 0)
    if n <= 0 if relative else deadline <= now:
        return number(int(old is not None)), None
    if deadline > MOST:
        raise Failed(NOT_INTEGER)
    if old is None:
        return number(0), None
    held = old.deadline_ns
    blocked = b"NX" in flags and held is not None or b"XX" in flags and held is None or held is not None and (b"GT" in flags and deadline <= held or b"LT" in flags and deadline >= held)
    return (number(0), old) if blocked else (number(1), old._replace(deadline_ns=deadline))


def left(old: Entry | None, base: int, unit: int) -> Reply:
    return number(-2 if old is None else -1 if old.deadline_ns is None else (old.deadline_ns - base) // unit)


def overwrite(old: Entry | None, args: list[bytes]) -> tuple[Reply, Entry]:
    offset, part = whole(args[0]), args[1]
    if offset < 0:
        raise Failed(NOT_INTEGER)
    held = (old.value if old else b"").ljust(offset, b"\0")
    new = held[:offset] + part + held[offset + len(part) :]
    return number(len(new)), Entry(new, False, old and old.deadline_ns)


COMMANDS = {
    "GET": lambda e, a, now: (bulk(e and e.value), e),
    "SET": set_,
    "SETNX": lambda e, a, now: (number(0), e) if e else (number(1), put(a[0], None)),
    "SETEX": lambda e, a, now: (DONE, put(a[1], until(whole(a[0]), now, NS))),
    "PSETEX": lambda e, a, now: (DONE, put(a[1], until(whole(a[0]), now, NS_MS))),
    "GETSET": lambda e, a, now: (bulk(e and e.value), put(a[0], e and e.deadline_ns)),
    "GETDEL": lambda e, a, now: (bulk(e and e.value), None),
    "GETEX": getex,
    "GETRANGE": lambda e, a, now: (("bulk", None, getrange(e.value if e else b"", whole(a[0]), whole(a[1]))), e),
    "SETRANGE": lambda e, a, now: overwrite(e, a),
    "INCR": lambda e, a, now: add(e, 1),
    "DECR": lambda e, a, now: add(e, -1),
    "INCRBY": lambda e, a, now: add(e, whole(a[0])),
    "DECRBY": lambda e, a, now: add(e, whole(str(-whole(a[0])).encode())),
    "INCRBYFLOAT": lambda e, a, now: add_float(e, a[0]),
    "APPEND": lambda e, a, now: (number(len(e.value if e else b"") + len(a[0])), Entry((e.value if e else b"") + a[0], False, e and e.deadline_ns)),
    "STRLEN": lambda e, a, now: (number(len(e.value) if e else 0), e),
    "TYPE": lambda e, a, now: (("status", None, b"string" if e else b"none"), e),
    "EXPIRE": lambda e, a, now: expire(e, a, now, True, NS),
    "PEXPIRE": lambda e, a, now: expire(e, a, now, True, NS_MS),
    "EXPIREAT": lambda e, a, now: expire(e, a, now, False, NS),
    "PEXPIREAT": lambda e, a, now: expire(e, a, now, False, NS_MS),
    "PERSIST": lambda e, a, now: (number(int(bool(e and e.deadline_ns is not None))), e and e._replace(deadline_ns=None)),
    "TTL": lambda e, a, now: (left(e, now, NS), e),
    "PTTL": lambda e, a, now: (left(e, now, NS_MS), e),
    "EXPIRETIME": lambda e, a, now: (left(e, 0, NS), e),
    "PEXPIRETIME": lambda e, a, now: (left(e, 0, NS_MS), e),
    # Parts of commands on several keys.
    "MGET": lambda e, a, now: (bulk(e and e.value), e),
    "MSET": lambda e, a, now: (DONE, put(a[0], e and e.deadline_ns)),
    "DEL": lambda e, a, now: (number(int(e is not None)), None),
    "UNLINK": lambda e, a, now: (number(int(e is not None)), None),
    "EXISTS": lambda e, a, now: (number(int(e is not None)), e),
    "TOUCH": lambda e, a, now: (number(int(e is not None)), e),
}


def step(entry: Entry | None, name: str, args: list[bytes], now: int) -> tuple[Reply, Entry | None]:
    """A command on its key's entry at a time; an entry that has expired by then is gone."""
    if entry and entry.deadline_ns is not None and entry.deadline_ns <= now:
        entry = None
    try:
        return COMMANDS[name](entry, args, now)
    except Failed as failed:
        return ("error", None, str(failed).encode()), entry
