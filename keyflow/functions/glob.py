"""Glob patterns over keys as byte strings, as a regular expression and a range that scans can use.

``*`` any bytes, ``?`` one byte, ``[abc]``, ``[a-c]``, ``[^a]`` or ``[!a]`` one byte of a class or outside it, and a backslash
before a byte that means itself. Within a class a backslash is a byte like others, an unclosed class runs to the end, a range whose
ends are swapped is empty, and a class may be empty. A backslash at the end matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import text

NOTHING = "(?!)"


def tokens(pattern: bytes) -> list[tuple[str, bytes | list[tuple[int, int]]]]:
    """('byte', b), ('any', …), ('one', …), ('in' or 'out', ranges), or ('never', …)."""
    out: list = []
    at = 0
    while at < len(pattern):
        c = pattern[at : at + 1]
        at += 1
        if c == b"*":
            out.append(("any", b""))
        elif c == b"?":
            out.append(("one", b""))
        elif c == b"\\":
            out.append(("byte", pattern[at : at + 1]) if at < len(pattern) else ("never", b""))
            at += 1
        elif c == b"[":
            kind = "in"
            if pattern[at : at + 1] in (b"^", b"!"):
                kind = "out"
                at += 1
            close = pattern.find(b"]", at)
            body = pattern[at:] if close < 0 else pattern[at:close]
            at = len(pattern) if close < 0 else close + 1
            ranges, i = [], 0
            while i < len(body):
                wide = i + 2 < len(body) and body[i + 1 : i + 2] == b"-"
                ranges.append((body[i], body[i + 2] if wide else body[i]))
                i += 3 if wide else 1
            out.append((kind, ranges))
        else:
            out.append(("byte", c))
    return out


def to_regex(pattern: bytes) -> str:
    """An expression for text of one character a byte."""
    parts = []
    for kind, what in tokens(pattern):
        if kind == "any":
            parts.append(".*")
        elif kind == "one":
            parts.append(".")
        elif kind == "never":
            parts.append(NOTHING)
        elif kind == "byte":
            parts.append(f"\\x{what[0]:02x}")
        else:
            inside = "".join(f"\\x{a:02x}-\\x{b:02x}" for a, b in what if a <= b)
            parts.append(f"[{'^' if kind == 'out' else ''}{inside}]" if inside else NOTHING if kind == "in" else ".")
    return "(?s)^" + "".join(parts) + r"\z"


def prefix(pattern: bytes) -> tuple[bytes, bool]:
    """The bytes that every match begins with, and whether any bytes may follow them."""
    found, rest = b"", tokens(pattern)
    while rest and rest[0][0] == "byte":
        found += rest.pop(0)[1]
    return found, rest == [("any", b"")]


def above(start: bytes) -> bytes | None:
    """The least byte string above all that begin with ``start``; None where there is none."""
    start = start.rstrip(b"\xff")
    return start[:-1] + bytes([start[-1] + 1]) if start else None


def matches(key: Column, pattern: bytes | str) -> Column:
    """A predicate on BINARY keys: a range for the prefix, which is pushed to the scan, and the expression for the rest."""
    pattern = pattern.encode() if isinstance(pattern, str) else pattern
    start, simple = prefix(pattern)
    found = F.lit(True)
    if start:
        found = key >= F.lit(start)
        if (end := above(start)) is not None:
            found &= key < F.lit(end)
    if not simple:
        found &= text(key).rlike(to_regex(pattern))
    return found


def python_regex(pattern: bytes) -> re.Pattern[bytes]:
    """The same for one key at a time."""
    return re.compile(to_regex(pattern).replace(r"\z", r"\Z").encode("latin-1"))
