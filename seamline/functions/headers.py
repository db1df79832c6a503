"""Record headers: an ordered list of names and values in which a name may repeat; the last
entry of a name counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HEADERS, OFFSET_PREFIX, SEQUENCE, SEQUENCE_COUNT
from .codec import bytes_to_long, column, long_to_bytes


def header(key: str | Column, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))


def long_header(key: str | Column, value: Column) -> Column:
    return header(key, long_to_bytes(value))


def header_list(*entries: Column) -> Column:
    return (F.array(*entries) if entries else F.array()).cast(HEADERS)


def append_headers(headers: Column | str, *entries: Column) -> Column:
    """The headers with more at the end; null headers are none."""
    return F.concat(F.coalesce(column(headers), header_list()), header_list(*entries))


def last_header(headers: Column | str, key: str | Column) -> Column:
    """The last value of a name; null if there is none."""
    wanted = F.lit(key) if isinstance(key, str) else key
    return F.try_element_at(F.filter(column(headers), lambda h: h["key"] == wanted), F.lit(-1))["value"]


def header_long(headers: Column | str, key: str | Column) -> Column:
    return bytes_to_long(last_header(headers, key))


def sequence_headers(seq: Column, count: Column, prefix: str | Column = "") -> list[Column]:
    """The two headers from which a restart finds the next sequence."""
    name = (lambda x: F.concat(prefix, F.lit(x))) if isinstance(prefix, Column) else (lambda x: F.lit(prefix + x))
    return [long_header(name(SEQUENCE), seq), long_header(name(SEQUENCE_COUNT), count)]


def offset_headers(offsets: Column | str) -> Column:
    """One header for each topic of a map from topic index to offset, by index."""
    entries = F.array_sort(F.map_entries(column(offsets)))
    return F.transform(entries, lambda e: long_header(F.concat(F.lit(OFFSET_PREFIX), e["key"].cast("string")), e["value"])).cast(HEADERS)


def recovered_offsets(headers: Column | str) -> Column:
    """The map from topic index to offset that offset headers hold; of a name that repeats the
    last entry counts, names with anything but digits after the prefix are left out."""
    own = F.filter(column(headers), lambda h: h["key"].rlike(f"^{OFFSET_PREFIX}[0-9]{{1,9}}$"))
    pairs = F.transform(own, lambda h: F.struct(F.substring(h["key"], len(OFFSET_PREFIX) + 1, 9).cast("int").alias("key"), bytes_to_long(h["value"]).alias("value")))
    # later entries replace earlier ones
    return F.aggregate(pairs, F.create_map().cast("map<int,bigint>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))
