"""Byte codecs, unsigned order and headers."""

import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seamline.functions import codec, headers

LONGS = [0, 1, 1234567890123, -1, -(1 << 63), (1 << 63) - 1, None]


@pytest.fixture(scope="module")
def longs(spark):
    return spark.createDataFrame([(x,) for x in LONGS], "x long")


def test_long_round_trip(longs):
    for order, sign in (("big", ">q"), ("little", "<q")):
        for r in longs.select("x", codec.long_to_bytes("x", order).alias("b")).collect():
            assert r["b"] == (None if r["x"] is None else struct.pack(sign, r["x"]))
    assert all(r[0] == r[1] for r in longs.select("x", codec.bytes_to_long(codec.long_to_bytes("x"))).collect())
    assert longs.select(codec.bytes_to_long(F.lit(b"short"))).first()[0] is None


def test_numbers_at_offsets(spark):
    df = spark.createDataFrame([(b"abc" + struct.pack("<q", 1234567890123) + struct.pack(">q", -5) + struct.pack("<i", -7),)], "b binary")
    assert df.select(codec.long_at("b", 3), codec.long_at("b", 11, "big"), codec.int_at("b", 19)).first()[:] == (1234567890123, -5, -7)
    with pytest.raises(ValueError):
        codec.long_at("b", 0, "middle")
    with pytest.raises(ValueError):
        codec.long_at("b", 0, on_bad="ignore")


def test_short_payloads_fail_or_are_null(spark):
    df = spark.createDataFrame([(b"seven b",), (None,)], "b binary")
    assert [r[0] for r in df.select(codec.long_at("b", 0, on_bad="null")).collect()] == [None, None]
    with pytest.raises(PySparkException, match="payload ends before byte 8"):
        df.select(codec.long_at("b", 0)).collect()


def test_unsigned_order(longs):
    ordered = [r["x"] for r in longs.filter("x is not null").orderBy(codec.unsigned_key("x")).collect()]
    assert ordered == sorted((x for x in LONGS if x is not None), key=lambda x: x & codec.MAX_UNSIGNED)
    assert {r[0]: r[1] for r in longs.select("x", codec.unsigned_text("x")).collect()}[-1] == str(codec.MAX_UNSIGNED)
    assert all(r[0] == r[1] for r in longs.select("x", codec.unsigned_key(codec.unsigned_key("x"))).collect())
    assert longs.limit(1).select(codec.unsigned_less(F.lit(1), F.lit(-1))).first()[0]


def test_slices_and_text(spark):
    df = spark.createDataFrame([(b"0123456789", "aä")], "b binary, s string")
    row = df.select(codec.slice_payload("b", 2, 3), codec.slice_payload("b", 8), codec.slice_payload("b", 20), codec.encode_text("s", "UTF-16BE")).first()
    assert row[:] == (b"234", b"89", b"", "aä".encode("utf-16-be"))


def test_last_header_wins(spark):
    entries = headers.header_list(headers.long_header("K", F.lit(1)), headers.long_header("K", F.lit(2)), headers.header("E", F.lit(b"")))
    df = spark.range(1).select(entries.alias("h"), headers.header_list().alias("none"), F.lit(None).cast("array<struct<key:string,value:binary>>").alias("null"))
    row = df.select(headers.header_long("h", "K"), headers.last_header("h", "E"), headers.last_header("none", "K"), headers.last_header("null", "K"), F.size(headers.append_headers("null", headers.long_header("A", F.lit(1))))).first()
    assert row[:] == (2, b"", None, None, 1)


def test_offset_headers(spark):
    df = spark.range(1).select(headers.offset_headers(F.create_map(F.lit(2), F.lit(311), F.lit(0), F.lit(100))).alias("h"))
    row = df.select(F.transform("h", lambda x: x["key"]), headers.recovered_offsets("h")).first()
    assert row[:] == (["DDOFF_0", "DDOFF_2"], {0: 100, 2: 311})
    repeated = df.select(headers.recovered_offsets(headers.append_headers("h", headers.long_header("DDOFF_0", F.lit(101)), headers.long_header("DDOFF_x", F.lit(1)), headers.long_header("DDOFF_9999999999", F.lit(1)))))
    assert repeated.first()[0] == {0: 101, 2: 311}
    assert df.select(headers.recovered_offsets(headers.header_list())).first()[0] == {}
