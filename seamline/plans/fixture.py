"""Redundant captures derived from the ``events`` table, and the tables that follow from them.

The bus is the events, dealt to four partitions by user; its sequences count a partition's
events (``seq``) and a user's (``pseq``). Three captures each miss other sequences of the bus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import long_to_bytes
from ..operators.dedup import sequenced_dedup
from ..operators.ordered import numbered
from ..operators.populate import outbound_records

#: Which sequences each capture misses: those with this remainder.
MISSES = ((7, 3), (5, 2), (3, 1))


def bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("arrival"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "user_id", (F.col("user_id") % 4).cast("int").alias("partition"), "event_type", "props"
    )
    rows = numbered(events, ["partition"], "arrival", "seq")
    rows = numbered(rows, ["user_id"], "arrival", "pseq")
    return rows.withColumn("producer_key", F.col("user_id").cast("string"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures, with topic_idx; a record's offset in its topic grows with its sequence. One
    pass over the bus gives each record's copies."""
    heard = F.array(*[F.when(F.col("seq") % m != r, F.lit(k)) for k, (m, r) in enumerate(MISSES)])
    return bus(spark, sf_dir).withColumn("offset", F.col("seq")).withColumn("topic_idx", F.explode(F.array_compact(heard)))


def delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures with ``clock``, an arrival time of their own in milliseconds: most copies come
    soon, single sequences and whole stretches of them late."""
    seq = F.col("seq")
    delay = (seq * 37 + F.col("topic_idx") * 61) % 50 + F.when(seq % 11 == 4, 400).otherwise(0) + F.when(F.floor(seq / 20) % 9 == 3, 700).otherwise(0)
    return captures(spark, sf_dir).withColumn("clock", (F.col("arrival") * 10 + delay).cast("bigint"))


PIECE = 12


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a message on a bus, in pieces of a few bytes; a session's messages follow each other
    with room between, and some pieces are lost."""
    text = F.concat_ws("|", "arrival", "event_type", "props")
    pieces = F.greatest(F.lit(1), F.ceil(F.length(text) / PIECE)).cast("int")
    rows = bus(spark, sf_dir).select(F.col("partition").alias("session"), "arrival", "seq", text.alias("text"), pieces.alias("pieces"))
    rows = rows.select("session", "arrival", "seq", "text", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("k"))
    rows = rows.filter((F.col("arrival") * 5 + F.col("k") * 3) % 17 != 4)
    return rows.select(
        "session", (F.col("seq") * 100 + F.col("k")).alias("position"), F.lit(1).cast("bigint").alias("length"), (F.col("k") == 0).alias("begin"), (F.col("k") == F.col("pieces") - 1).alias("end"),
        F.encode(F.substr("text", F.col("k") * PIECE + 1, F.lit(PIECE)), "UTF-8").alias("payload"),
    )


def topics(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The same captures as one table for each topic."""
    heard = bus(spark, sf_dir).withColumn("offset", F.col("seq"))
    return [heard.filter(F.col("seq") % m != r) for m, r in MISSES]


def outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged stream as it was sent: partition, offset, seq, and headers as at a restart."""
    sent = numbered(sequenced_dedup(captures(spark, sf_dir)), ["partition"], "seq", "sent_offset")
    handled = F.create_map(F.lit(0), F.col("seq"), F.lit(1), F.col("seq") - F.col("seq") % 5, F.lit(2), F.col("seq") - F.col("seq") % 3)
    rows = sent.withColumns({"offset": F.col("sent_offset"), "headers": F.lit(None).cast("array<struct<key:string,value:binary>>"), "key": long_to_bytes("seq"), "value": F.encode("event_type", "UTF-8")})
    return outbound_records(rows, send_time=F.col("ts_ms") + 5, offsets=handled).select("partition", "offset", "key", "value", "headers", "seq", "ts_ms")


#: The same tables as SQL, to be put before a query.
BUS_SQL = """bus AS (
  SELECT event_id AS arrival, epoch_us(ts) // 1000 AS ts_ms, user_id, user_id % 4 AS part, event_type, props,
    row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS seq,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pseq
  FROM events),
cap AS (
  SELECT *, 0 AS topic_idx FROM bus WHERE seq % 7 <> 3
  UNION ALL SELECT *, 1 FROM bus WHERE seq % 5 <> 2
  UNION ALL SELECT *, 2 FROM bus WHERE seq % 3 <> 1),
sent AS (
  SELECT * FROM cap QUALIFY row_number() OVER (PARTITION BY part, seq ORDER BY arrival, topic_idx) = 1),
texts AS (SELECT part, arrival, seq, concat_ws('|', arrival, event_type, props) AS text FROM bus),
frag AS (
  SELECT part, arrival, seq, k, greatest(1, ceil(length(text) / 12))::BIGINT AS pieces, substr(text, k * 12 + 1, 12) AS payload
  FROM (SELECT *, unnest(range(greatest(1, ceil(length(text) / 12))::BIGINT)) AS k FROM texts) WHERE (arrival * 5 + k * 3) % 17 <> 4),
late AS (
  SELECT *, arrival * 10 + (seq * 37 + topic_idx * 61) % 50 + CASE WHEN seq % 11 = 4 THEN 400 ELSE 0 END + CASE WHEN (seq // 20) % 9 = 3 THEN 700 ELSE 0 END AS clock FROM cap),
outb AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq) - 1 AS sent_offset FROM sent)"""
