"""Byte codecs and unsigned 64-bit order, as column expressions.

Sequences are unsigned 64-bit numbers kept in ``bigint`` columns. ``unsigned_key`` gives a
signed number with the same order, so windows, comparisons and partition pruning stay native.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(1 << 63)
MAX_UNSIGNED = (1 << 64) - 1


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def long_to_bytes(value: Column | str, order: str = "big") -> Column:
    """A long as 8 bytes; null for null."""
    digits = F.lpad(F.hex(column(value).cast("bigint")), 16, "0")
    return F.unhex(digits if order == "big" else _swapped(digits, 8))


def bytes_to_long(data: Column | str) -> Column:
    """The long in 8 big-endian bytes; null for null or any other length."""
    data = column(data)
    return F.when(F.length(data) == 8, F.conv(F.hex(data), 16, -10).cast("bigint"))


def checked(data: Column, end: int, on_bad: str) -> Column:
    """``data``, if it reaches to byte ``end``. A shorter or null payload raises (``fail``) or
    gives null (``null``), for a dead-letter output."""
    if on_bad not in ("fail", "null"):
        raise ValueError(f"on_bad is 'fail' or 'null', not {on_bad!r}")
    short = F.raise_error(F.concat(F.lit(f"payload ends before byte {end}: "), F.coalesce(F.length(data).cast("string"), F.lit("null")))) if on_bad == "fail" else F.lit(None)
    return F.when(F.length(data) >= end, data).otherwise(short.cast("binary"))


def _swapped(digits: Column, width: int) -> Column:
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))])


def _number(data: Column, offset: int, width: int, order: str) -> Column:
    digits = F.hex(F.substring(data, offset + 1, width))
    if order == "little":
        digits = _swapped(digits, width)
    elif order != "big":
        raise ValueError(f"order is 'little' or 'big', not {order!r}")
    return digits


def long_at(data: Column | str, offset: int, order: str = "little", on_bad: str = "fail") -> Column:
    """The 64-bit number at a byte offset of a payload."""
    digits = _number(checked(column(data), offset + 8, on_bad), offset, 8, order)
    return F.conv(digits, 16, -10).cast("bigint")


def int_at(data: Column | str, offset: int, order: str = "little", on_bad: str = "fail") -> Column:
    """The signed 32-bit number at a byte offset of a payload."""
    wide = F.conv(_number(checked(column(data), offset + 4, on_bad), offset, 4, order), 16, 10).cast("bigint")
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide).cast("int")


def unsigned_key(seq: Column | str) -> Column:
    """A signed number in the order of the unsigned ones; it is its own inverse."""
    return column(seq).bitwiseXOR(F.lit(SIGN).cast("bigint"))


def unsigned_text(seq: Column | str) -> Column:
    """Decimal digits of the unsigned number."""
    return F.conv(F.hex(column(seq)), 16, 10)


def unsigned_less(a: Column | str, b: Column | str) -> Column:
    return unsigned_key(a) < unsigned_key(b)


def slice_payload(data: Column | str, offset: int, length: int | None = None) -> Column:
    """Bytes from an offset on; all that follow, if no length is given."""
    data = column(data)
    return F.substring(data, offset + 1, (1 << 31) - 1 if length is None else length)


def encode_text(text: Column | str, charset: str = "UTF-8") -> Column:
    return F.encode(column(text), charset)
