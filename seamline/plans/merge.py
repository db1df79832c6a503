"""The whole merge from settings: capture topics in, one ordered stream and a gap report out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.codec import unsigned_key
from ..operators.populate import outbound_records
from ..operators.recovery import last_offsets, resume_producers, resume_sequences, starting_offsets
from ..sources import kafka, log
from ..streaming.dedup import handled_offsets, stream_dedup, use_rocksdb
from ..streaming.listener import ProgressListener, observed
from .config import DedupSettings, strategy

KEPT = ("key", "value", "headers")


def _normalised(captured: DataFrame, settings: DedupSettings) -> DataFrame:
    own = strategy(settings.strategy)
    return kafka.normalise(captured, settings.inbound_topics, sequence=own.sequence, producer_key=own.producer_key, num_sequences=own.num_sequences)


def merge(captured: DataFrame, settings: DedupSettings, *, start: DataFrame | None = None) -> DataFrame:
    """Kafka-shaped rows of all capture topics, merged: rows of kind record or gap. ``start``: where
    each partition (and producer) goes on, from recovery."""
    own = strategy(settings.strategy)
    return stream_dedup(
        _normalised(captured, settings), topics=len(settings.inbound_topics), ordered=settings.ordered, timeout_ms=own.timeout_ms, expire_ms=own.expire_ms, carry=KEPT, start=start,
        processor=own.processor, producer=None if own.producer_key is None else "producer_key", counts=True,
    )


def dead_letters(captured: DataFrame, settings: DedupSettings) -> DataFrame:
    """Records whose sequence can't be read; strategies that raise on these stop the query instead."""
    return _normalised(captured, settings).filter("seq is null")


def start_dead_letters(captured: DataFrame, settings: DedupSettings, checkpoint: str, sink: Callable[[DataFrame], None], **trigger) -> StreamingQuery:
    """Send the dead letters of a stream to ``sink``, by a query beside the merge. Its commit
    interval is the merge's, if no other ``trigger`` is given."""
    given = trigger or {"processingTime": f"{settings.commit_ms} milliseconds"}
    letters = dead_letters(captured, settings)
    return letters.writeStream.foreachBatch(lambda rows, _: sink(rows)).option("checkpointLocation", checkpoint).trigger(**given).start()


def outbound_rows(merged: DataFrame, settings: DedupSettings) -> DataFrame:
    """Sent records as a sink takes them, with the headers that a restart needs. Several producers
    of a partition get headers of their own name."""
    own = strategy(settings.strategy)
    prefix = own.header_prefix if own.producer_key is None else F.concat(F.col("producer_key"), F.lit("-"))
    records = merged.filter("kind = 'record'")
    return kafka.outbound(outbound_records(records, count=F.col("num_seq"), offsets=handled_offsets("handled"), prefix=prefix))


def outbound_gaps(merged: DataFrame) -> DataFrame:
    """Sequences that were given up: the keys, from_seq and to_seq."""
    keys = [c for c in ("partition", "producer_key") if c in merged.columns]
    return merged.filter("kind = 'gap'").select(*keys, "from_seq", "to_seq")


def recovered(outbound: DataFrame, settings: DedupSettings) -> tuple[DataFrame, DataFrame]:
    """Where a restart goes on, from what is sent: the sequences (keys, start_seq), and the offset
    from which each partition and topic was handled."""
    own = strategy(settings.strategy)
    start = resume_sequences(outbound, own.header_prefix) if own.producer_key is None else resume_producers(outbound)
    return start.filter("start_seq is not null"), last_offsets(outbound)


def sender(
    settings: DedupSettings, sink: Callable[[DataFrame], None] | None = None, *, committed: Callable[[DataFrame, int], None] | None = None, sent: Callable[[], DataFrame] | None = None, on_gaps: Callable[[DataFrame], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: ``sink`` gets the outbound rows, ``on_gaps`` the gaps if there are
    any. ``committed``: a sink that takes the number of the micro-batch too and writes each once (see
    :func:`~seamline.sources.log.log_sink`). ``sent`` reads what is sent: with a sink that can't tell
    repeated batches, the first micro-batch of a run may be one that an earlier run has sent in
    part, so it leaves out what is there already."""
    first = [sent is not None]

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        rows = batch
        if first[0]:
            done = recovered(sent(), settings)[0]
            keys = [c for c in done.columns if c != "start_seq"]
            done = done.select(*[F.col(k).alias(f"__{k}") for k in keys], "start_seq")
            known = batch.join(done, [batch[k] == done[f"__{k}"] for k in keys], "left")
            rows = known.filter((F.col("kind") != "record") | F.col("start_seq").isNull() | (unsigned_key("seq") >= unsigned_key("start_seq"))).select(batch.columns)
            first[0] = False
        if committed is not None:
            committed(outbound_rows(rows, settings), number)  # the merge has a partition's rows in one task, in order
        else:
            sink(outbound_rows(rows, settings))
        found = outbound_gaps(batch)
        if on_gaps is not None and not found.isEmpty():
            on_gaps(found)
        batch.unpersist()

    return send


@dataclass
class Merge:
    """A running merge, and the query that takes its dead letters, if there is one."""

    query: StreamingQuery
    dead_letters: StreamingQuery | None = None
    listener: ProgressListener | None = None

    def stop(self) -> None:
        for q in (self.query, self.dead_letters):
            if q is not None:
                q.stop()
        if self.listener is not None:
            SparkSession.active().streams.removeListener(self.listener)

    def processAllAvailable(self) -> None:  # noqa: N802
        for q in (self.query, self.dead_letters):
            if q is not None:
                q.processAllAvailable()


@dataclass(frozen=True)
class Ends:
    """What a merge reads and writes. ``source``: the captures, Kafka-shaped, from offsets by topic and
    partition (``earliest`` if there are none). ``sent``: all that is sent, with offsets; ``tail``: at
    least the last record of each partition. ``committed``: writes a micro-batch once, by its number; or ``sink``,
    which writes it as often as it comes."""

    source: Callable[[str | dict[str, dict[str, int]]], DataFrame]
    sent: Callable[[], DataFrame]
    tail: Callable[[], DataFrame]
    committed: Callable[[DataFrame, int], None] | None = None
    sink: Callable[[DataFrame], None] | None = None


def kafka_ends(spark: SparkSession, settings: DedupSettings) -> Ends:
    """From Kafka to Kafka; needs the connector."""
    servers = settings.consumer["bootstrap.servers"]
    out = kafka.sink_options(settings.producer.get("bootstrap.servers", servers), settings.outbound_topic)

    def source(start: str | dict[str, dict[str, int]]) -> DataFrame:
        at = start if isinstance(start, str) else json.dumps(start)
        return kafka.read_stream(spark, kafka.source_options(servers, settings.inbound_topics, starting_offsets=at, group_prefix=settings.group_prefix))

    sent = lambda: kafka.read_batch(spark, kafka.source_options(servers, [settings.outbound_topic]))
    return Ends(source, sent, sent, sink=lambda rows: rows.write.format("kafka").options(**out).save())


def log_ends(spark: SparkSession, settings: DedupSettings, paths: dict[str, str], outbound: str, *, limit: int = 100_000) -> Ends:
    """From logs to a log: ``paths`` of the inbound topics by name. A restart reads one record of each
    outbound partition, and no batch is written twice."""
    topics = {t: paths[t] for t in settings.inbound_topics}
    return Ends(lambda start: log.read_topics(spark, topics, start, limit), lambda: log.read_log(spark, outbound), lambda: log.tail_of(spark, outbound), committed=log.log_sink(outbound, settings.group_prefix))


def start_merge(
    spark: SparkSession, settings: DedupSettings, checkpoint: str, *, ends: Ends | None = None, partitions: list[int] | None = None, on_gaps: Callable[[DataFrame], None] | None = None, on_dead_letters: Callable[[DataFrame], None] | None = None,
    report: Callable[[dict], None] | None = None,
) -> Merge:
    """Run the merge. ``ends``: what it reads and writes, by default Kafka. What has been sent decides where
    it goes on: sequences and, for a new checkpoint and the given ``partitions``, offsets.
    ``on_dead_letters`` gets the records whose sequence can't be read, from a query of its own, which is
    stopped with the merge. ``report`` gets the counts of each micro-batch.

    Offsets come from the last record of each partition, and so do sequences; those of several
    producers of a partition come from the last record of each, for which all that is sent is read."""
    use_rocksdb(spark)
    ends = ends or kafka_ends(spark, settings)
    start, offsets = recovered(ends.tail(), settings)
    if strategy(settings.strategy).producer_key is not None:
        start = recovered(ends.sent(), settings)[0]
    at: str | dict = json.loads(starting_offsets(offsets, settings.inbound_topics, partitions)) if partitions else "earliest"
    captured = ends.source(at)
    send = sender(settings, ends.sink, committed=ends.committed, sent=None if ends.committed else ends.sent, on_gaps=on_gaps)
    letters = None
    if on_dead_letters is not None:
        letters = start_dead_letters(captured, settings, f"{checkpoint.rstrip('/')}-dead-letters", on_dead_letters)
    merged, listener = merge(captured, settings, start=start), None
    if report is not None:
        merged, listener = observed(merged), ProgressListener(report)
        spark.streams.addListener(listener)
    interval = f"{settings.commit_ms} milliseconds"
    return Merge(merged.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start(), letters, listener)
