"""Schemas and header names that all operators share."""

from __future__ import annotations

HEADERS = "array<struct<key: string, value: binary>>"
#: A captured record, as a Kafka source with headers gives it.
CAPTURE_SCHEMA = f"key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int, headers {HEADERS}"
#: What a Kafka sink takes.
OUTBOUND_SCHEMA = f"key binary, value binary, partition int, headers {HEADERS}"
GAP_SCHEMA = "partition int, producer_key string, from_seq bigint, to_seq bigint"
SPOOL_SCHEMA = "payload binary, enqueue_time bigint"

# Names of headers.
CAPTURE_QUEUE_TIME = "CAPQT"
CAPTURE_SEND_TIME = "CAPST"
DEDUP_SEND_TIME = "DDST"
OFFSET_PREFIX = "DDOFF_"
SEQUENCE = "DDSEQ"
SEQUENCE_COUNT = "DDNUM"
