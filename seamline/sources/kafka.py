"""Kafka-shaped sources and sinks. The connector is a separate jar: without it only the options
and the shaping of rows can be used, on any table with the same columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source_options(servers: str, topics: Sequence[str], *, starting_offsets: str = "earliest", max_per_trigger: int | None = None, group_prefix: str | None = None) -> dict[str, str]:
    """Options of a Kafka source over all capture topics at once; there is no leading topic."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "includeHeaders": "true", "startingOffsets": starting_offsets, "failOnDataLoss": "true"}
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if group_prefix is not None:
        options["groupIdPrefix"] = group_prefix
    return options


def sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.enable.idempotence": "true"}


def read_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load()


def read_batch(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("kafka").options(**{k: v for k, v in options.items() if k != "maxOffsetsPerTrigger"}).load()


def normalise(captured: DataFrame, topics: Sequence[str], *, sequence: Column, producer_key: Column | None = None, num_sequences: Column | None = None) -> DataFrame:
    """Kafka-shaped rows with topic_idx (the topic's place in the list), seq, num_seq, arrival
    (epoch milliseconds) and, if given, producer_key. Rows of other topics are left out."""
    index = F.create_map(*[x for k, t in enumerate(topics) for x in (F.lit(t), F.lit(k))])
    rows = captured.filter(F.col("topic").isin(list(topics))).withColumns({
        "topic_idx": index[F.col("topic")], "seq": sequence.cast("bigint"), "num_seq": (F.lit(1) if num_sequences is None else num_sequences).cast("bigint"),
        "arrival": F.unix_millis("timestamp"),
    })
    return rows if producer_key is None else rows.withColumn("producer_key", producer_key.cast("string"))


def outbound(rows: DataFrame) -> DataFrame:
    """The columns a Kafka sink takes; the outbound partition is the inbound one."""
    return rows.select("key", "value", "partition", "headers")
