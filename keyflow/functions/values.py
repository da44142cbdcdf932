"""Column functions over values: integers, floats, byte ranges, slots and sizes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^[+-]?[0-9]+\z"
FLOAT = r"(?i)^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?\z"
INLINE = 23  # bytes that a value or key holds in place
HANDLE = 32  # bytes of a reference to a longer one


def text(value: Column) -> Column:
    """One character for each byte, so that patterns see bytes and nothing is lost."""
    return F.decode(value, "ISO-8859-1")


def to_int(value: Column) -> Column:
    """The 64-bit integer that the whole value spells, or null: an optional sign and digits."""
    return F.when(text(value).rlike(INTEGER), text(value).try_cast("long"))


def to_float(value: Column) -> Column:
    """The double that the value spells, or null where it doesn't or is not finite."""
    number = F.when(text(value).rlike(FLOAT), text(value).try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def canonical(value: Column) -> tuple[Column, Column]:
    """A written value and whether it is an integer: up to 20 bytes that spell one are stored as its digits."""
    number = F.when(F.octet_length(value) <= 20, to_int(value))
    return F.coalesce(number.cast("string").cast("binary"), value), number.isNotNull()


def byte_range(value: Column, start: Column, end: Column) -> Column:
    """Bytes ``start`` to ``end``, both included; negative ones count from the end and stop at 0."""
    size = F.octet_length(value).cast("long")
    place = lambda i: F.when(i < 0, F.greatest(size + i, F.lit(0))).otherwise(i)
    first, last = place(start), F.least(place(end), size - 1)
    return F.when((first > last) | (first >= size), F.lit(b"").cast("binary")).otherwise(F.substring(value, (first + 1).cast("int"), (last - first + 1).cast("int")))


def overwrite(value: Column, offset: Column, part: Column) -> Column:
    """``part`` written at a byte offset, after zero bytes where the value is shorter."""
    held = F.coalesce(value, F.lit(b"").cast("binary"))
    padded = F.when(F.octet_length(held) < offset, F.rpad(held, offset.cast("int"), F.lit(b"\0").cast("binary"))).otherwise(held)
    rest = F.substring(padded, (offset + F.octet_length(part) + 1).cast("int"), F.octet_length(padded))
    return F.concat(F.substring(padded, F.lit(1), offset.cast("int")), part, rest)


def float_text(value: float) -> str:
    """The shortest text of a double: a point always, an exponent from 1e16 on and below 1e-5."""
    if value == int(value) and abs(value) < 1e16:
        return f"{'-' if str(value)[0] == '-' else ''}{abs(int(value))}.0"
    digits, _, exponent = repr(value).partition("e")
    if exponent:
        return f"{digits.removesuffix('.0')}e{int(exponent)}"
    if abs(value) >= 1e16 or abs(value) < 1e-5:
        mantissa, _, exponent = f"{value:.17e}".partition("e")
        short = re.sub(r"\.?0+$", "", repr(float(mantissa)))
        return f"{short}e{int(exponent)}"
    return digits


def float_texts(value: Column) -> Column:
    def convert(values: pd.Series) -> pd.Series:
        return values.map(float_text, na_action="ignore").astype(object).where(values.notna(), None)

    return F.pandas_udf(convert, "string")(value)


def _crc_steps() -> list[int]:
    """CRC-16 of each byte: polynomial 0x1021, no reflection."""
    steps = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x1021 if crc & 0x8000 else 0)) & 0xFFFF
        steps.append(crc)
    return steps


CRC_STEPS = _crc_steps()


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x1021 and no reflection."""
    crc = 0
    for byte in data:
        crc = crc << 8 & 0xFFFF ^ CRC_STEPS[crc >> 8 ^ byte]
    return crc


def slot_of(key: bytes, slots: int = 16384) -> int:
    """The slot of a key, by its tag where it has one: what stands between the first brace and the next closing one."""
    tag = re.search(rb"^[^{]*\{([^}]+)\}", key)
    return crc16(tag[1] if tag else key) % slots


def slot(key: Column, slots: int = 16384) -> Column:
    """``slot_of`` as an expression: the tag's hex digits are cut out and read byte by byte through a table of 256 numbers."""
    digits = F.hex(key)
    # Pairs of digits up to the first brace (7B) and from there to the next closing one (7D).
    tag = F.regexp_extract(digits, "^(?:(?!7B)..)*7B((?:(?!7D)..)+)7D", 1)
    read = F.when(tag == "", digits).otherwise(tag)
    steps = F.array(*map(F.lit, CRC_STEPS))
    bytes_ = F.transform(F.sequence(F.lit(1), F.floor(F.length(read) / 2).cast("int")), lambda i: F.conv(F.substr(read, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))
    crc = F.aggregate(bytes_, F.lit(0), lambda c, b: F.shiftleft(c, 8).bitwiseAND(0xFFFF).bitwiseXOR(F.element_at(steps, F.shiftright(c, 8).bitwiseXOR(b) + 1)))
    return F.when(key.isNotNull(), F.when(F.length(digits) == 0, 0).otherwise(crc) % slots).cast("int")


def memory(vtype: Column, val: Column, is_int: Column) -> Column:
    """Estimated bytes of a string value: eight for an integer, else its bytes and those of what holds them."""
    size = F.octet_length(val)
    return F.when(vtype == "string", F.when(is_int, 8).otherwise(F.when(size <= INLINE, INLINE + 1).otherwise(HANDLE) + size)).cast("long")
