"""Shaping captured payloads into outbound records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import slice_payload
from ..functions.headers import append_headers, header_list, long_header, offset_headers, sequence_headers
from ..schema import CAPTURE_QUEUE_TIME, CAPTURE_SEND_TIME, DEDUP_SEND_TIME, HEADERS


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def populate(spooled: DataFrame, partition: int | Column, *, key: Column | None = None, value: Column | None = None, send_time: Column | None = None, headers: Column | None = None) -> DataFrame:
    """Outbound records from spooled payloads (``payload, enqueue_time``). By default the key is
    null, the value the payload, and the headers the times of queueing and sending."""
    times = header_list(long_header(CAPTURE_QUEUE_TIME, F.col("enqueue_time")), long_header(CAPTURE_SEND_TIME, now_ms() if send_time is None else send_time))
    return spooled.select(
        (F.lit(None).cast("binary") if key is None else key).alias("key"),
        (F.col("payload") if value is None else value).alias("value"),
        (F.lit(partition) if isinstance(partition, int) else partition).cast("int").alias("partition"),
        (times if headers is None else headers).cast(HEADERS).alias("headers"),
    )


def split_header(spooled: DataFrame, partition: int | Column, width: int = 32, **given: Column) -> DataFrame:
    """Outbound records whose key is the payload's first ``width`` bytes and whose value the rest;
    a shorter payload gives a short key and an empty value."""
    return populate(spooled, partition, key=slice_payload("payload", 0, width), value=slice_payload("payload", width), **given)


def outbound_records(sent: DataFrame, *, send_time: Column | None = None, count: Column | None = None, offsets: Column | None = None, prefix: str | Column = "", extra: list[Column] | None = None) -> DataFrame:
    """Sent records as a sink takes them: their own headers, then the send time, the offsets
    handled so far (a map from topic index to offset), and the sequence headers."""
    first = append_headers("headers", long_header(DEDUP_SEND_TIME, now_ms() if send_time is None else send_time))
    handled = offset_headers(offsets) if offsets is not None else header_list()
    last = header_list(*sequence_headers(F.col("seq"), F.lit(1) if count is None else count, prefix), *(extra or []))
    return sent.withColumn("headers", F.concat(first, handled, last))
