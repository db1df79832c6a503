"""Restart from what was sent: last records, offsets, and the sequences to go on from."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import unsigned_key
from ..functions.headers import header_long, recovered_offsets
from ..schema import SEQUENCE, SEQUENCE_COUNT
from .dedup import ARRIVAL, KEYS, gaps, sequenced_dedup


def last_records(outbound: DataFrame) -> DataFrame:
    """The outbound record with the highest offset of each partition; empty partitions have none."""
    names = [c for c in outbound.columns if c != "partition"]
    last = F.max_by(F.struct(*names), "offset").alias("last")
    return outbound.groupBy("partition").agg(last).select("partition", *[F.col(f"last.`{c}`").alias(c) for c in names])


def last_offsets(outbound: DataFrame) -> DataFrame:
    """partition, topic_idx and the offset from which each topic was handled, from the headers
    of the last records. A partition without such headers gives no rows."""
    offsets = last_records(outbound.select("partition", "offset", "headers")).select("partition", F.explode(recovered_offsets("headers")).alias("topic_idx", "offset"))
    return offsets.filter("offset is not null")


def handled_offsets(records: DataFrame) -> DataFrame:
    """The last offset of each partition and topic among the records themselves."""
    return records.groupBy("partition", "topic_idx").agg(F.max("offset").alias("offset"))


def low_water_offsets(records: DataFrame, *, keys: Sequence[str] = KEYS, arrival: Sequence[str] = ARRIVAL, start: str | DataFrame = "first_arrival") -> DataFrame:
    """partition, topic_idx and ``offset``, the highest below which nothing is only held when all
    ``records`` have been handled and no gap given up, and ``handled``, the last offset of all. A
    cold start after ``offset`` reads again whatever was held; one after ``handled`` loses it.

    ``keys``: the partition, and producers within it if there are any; what any of them holds
    counts for the partition. Arguments as in ``sequenced_dedup``; an empty table gives no rows.
    """
    sent = sequenced_dedup(records, keys=keys, arrival=arrival, start=start)
    stuck = gaps(sent, keys=keys).groupBy(*keys).agg(F.min(unsigned_key("from_seq")).alias("__stuck"))
    stuck = stuck.select(*[F.col(k).alias(f"__{k}") for k in keys], "__stuck")
    same = F.lit(True)
    for k in keys:
        same = same & sent[k].eqNullSafe(stuck[f"__{k}"])
    held = sent.join(stuck, same).filter(unsigned_key("seq") > F.col("__stuck"))
    low = held.groupBy("partition", "topic_idx").agg(F.min("offset").alias("__low"))
    rows = records.groupBy("partition", "topic_idx").agg(F.max("offset").alias("handled")).join(low, ["partition", "topic_idx"], "left")
    return rows.select("partition", "topic_idx", F.least(F.col("__low") - 1, F.col("handled")).alias("offset"), "handled")


def tracked_count(offsets: DataFrame) -> DataFrame:
    """The number of topics with a tracked offset in each partition."""
    return offsets.groupBy("partition").agg(F.count("*").alias("tracked"))


def resume_sequences(outbound: DataFrame, prefix: str = "") -> DataFrame:
    """partition and ``start_seq``, the sequence after the last sent record, from its headers. A
    last record without both headers gives a null start: that partition opens anew."""
    last = last_records(outbound.select("partition", "offset", "headers"))
    seq, count = header_long("headers", prefix + SEQUENCE), header_long("headers", prefix + SEQUENCE_COUNT)
    return last.select("partition", unsigned_key(F.try_add(unsigned_key(seq), count)).alias("start_seq"))


def resume_producers(outbound: DataFrame) -> DataFrame:
    """partition, producer_key and ``start_seq`` from the headers ``<producer>-DDSEQ`` and
    ``<producer>-DDNUM`` of all outbound records: for each producer those of its last record."""
    named = outbound.select("partition", "offset", F.col("headers").alias("all"), F.explode("headers").alias("h")).filter(F.col("h.key").endswith(f"-{SEQUENCE}"))
    producer = F.expr(f"substring(h.key, 1, length(h.key) - {len(SEQUENCE) + 1})")
    rows = named.select("partition", "offset", producer.alias("producer_key"), header_long("all", F.col("h.key")).alias("seq"), header_long("all", F.concat(producer, F.lit(f"-{SEQUENCE_COUNT}"))).alias("count"))
    last = rows.groupBy("partition", "producer_key").agg(F.max_by(F.struct("seq", "count"), "offset").alias("last"))
    return last.select("partition", "producer_key", unsigned_key(F.try_add(unsigned_key("last.seq"), F.coalesce("last.count", F.lit(1)))).alias("start_seq"))


def replay(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """The records after the recovered offsets; all of those without one."""
    done = offsets.select(F.col("partition").alias("__partition"), F.col("topic_idx").alias("__topic_idx"), F.col("offset").alias("__offset"))
    joined = records.join(done, (records["partition"] == done["__partition"]) & (records["topic_idx"] == done["__topic_idx"]), "left")
    return joined.filter(F.coalesce(F.col("offset") > F.col("__offset"), F.lit(True))).drop("__partition", "__topic_idx", "__offset")


def starting_offsets(offsets: DataFrame, topics: list[str], partitions: list[int]) -> str:
    """The ``startingOffsets`` of a Kafka source: for each topic and partition the offset after
    the recovered one, or the earliest. There is one number for each Kafka partition."""
    known = {(r["topic_idx"], r["partition"]): r["offset"] for r in offsets.collect()}
    return json.dumps({t: {str(p): known.get((k, p), -3) + 1 for p in partitions} for k, t in enumerate(topics)})
