"""A running capture: a receiver's queue, and the query that publishes it to a capture topic."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.populate import populate
from ..sources import kafka, log
from ..sources.receivers import Agent, agent_of
from ..sources.spool import read_spool
from .config import UdpCapture, WebsocketCapture

Sink = Callable[[DataFrame], DataStreamWriter]


@dataclass
class Capture:
    """``close`` stops the receiver first and publishes what is queued, then stops the query."""

    agent: Agent
    query: StreamingQuery

    def close(self) -> None:
        self.agent.close()
        self.query.processAllAvailable()
        self.query.stop()


def kafka_sink(settings: UdpCapture | WebsocketCapture) -> Sink:
    """To the capture's topic; needs the connector."""
    options = kafka.sink_options(settings.kafka.producer["bootstrap.servers"], settings.kafka.topic)
    return lambda rows: rows.writeStream.format("kafka").options(**options)


def log_sink(path: str, run: str) -> Sink:
    """To a log on a shared file system."""
    return lambda rows: rows.writeStream.format(log.NAME).option("path", path).option("run", run)


def start_capture(
    spark: SparkSession, settings: UdpCapture | WebsocketCapture, checkpoint: str, *, sink: Sink | None = None, shape: Callable[..., DataFrame] = populate, start: str = "earliest", interval: str = "1 second", **given: Any
) -> Capture:
    """Receive, queue and publish. ``sink``: by default Kafka. ``shape``: how a payload becomes a record
    (``populate``, ``split_header`` or a user's own). ``start``: of a new checkpoint, ``earliest`` for all
    that the queue holds or ``latest``. ``interval`` is how often offsets are committed. ``given``: see
    :func:`~seamline.sources.receivers.agent_of`."""
    log.register(spark)
    agent = agent_of(settings, **given)
    if settings.spool.durable:
        queued = spark.readStream.format(log.NAME).option("start", start).load(settings.spool.path).select(F.col("value").alias("payload"), F.col("timestamp").alias("enqueue_time"))
    else:
        queued = read_spool(spark, settings.spool.path)
    records = shape(queued, settings.kafka.partition)
    agent.start()
    try:
        query = (sink or kafka_sink(settings))(records).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    except Exception:
        agent.close()
        raise
    return Capture(agent, query)
