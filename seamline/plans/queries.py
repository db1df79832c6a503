"""The registered queries of the merge, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import bytes_to_long, encode_text, int_at, long_at, long_to_bytes, slice_payload, unsigned_key, unsigned_text
from ..functions.headers import header_long
from ..operators import dedup, fragments, histogram, recovery, stats, timeout
from ..operators.ordered import numbered
from ..operators.populate import populate, split_header
from ..sources import log
from ..sources.kafka import normalise
from ..staging import discard, new_folder, staged
from ..streaming.dedup import stream_dedup, use_rocksdb
from . import fixture
from .fixture import BUS_SQL, bus, captures, delayed, outbound, topics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EXPIRE_MS = 86_400_000
TOPICS = ["cap_a", "cap_b", "cap_c"]


def query(sql: str, recursive: bool = False) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        head = f"WITH {'RECURSIVE ' if recursive else ''}{BUS_SQL}"
        ORACLE_SQL[f.__name__] = f"{head}{sql}" if sql.lstrip().startswith(",") else f"{head} {sql}"
        return f

    return put


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n).cast("bigint").alias(n) for n in names])


@query("SELECT part::BIGINT AS partition, topic_idx::BIGINT AS topic_idx, seq, arrival FROM cap")
def topic_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(dedup.union_topics(topics(spark, sf_dir)), "partition", "topic_idx", "seq", "arrival")


@query("SELECT part::BIGINT AS partition, seq, topic_idx::BIGINT AS topic_idx, arrival, event_type FROM sent")
def sequenced_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.sequenced_dedup(captures(spark, sf_dir))
    return found.select(F.col("partition").cast("bigint").alias("partition"), "seq", F.col("topic_idx").cast("bigint").alias("topic_idx"), "arrival", "event_type")


@query("SELECT part::BIGINT AS partition, seq, (row_number() OVER (PARTITION BY part ORDER BY seq) - 1)::BIGINT AS position FROM sent")
def outbound_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = dedup.sequenced_dedup(captures(spark, sf_dir)).withColumn("order", unsigned_key("seq"))
    return dedup.outbound_order(longs(numbered(sent, ["partition"], "order", "position"), "partition", "seq", "position"))


@query("""SELECT part::BIGINT AS partition, count(DISTINCT seq)::BIGINT AS sent, (count(*) - count(DISTINCT seq))::BIGINT AS dropped FROM cap GROUP BY part""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(dedup.verdict_counts(dedup.verdicts(captures(spark, sf_dir))), "partition", "sent", "dropped")


_GAPS = """, holes AS (SELECT part, lag(seq) OVER (PARTITION BY part ORDER BY seq) + 1 AS from_seq, seq - 1 AS to_seq FROM sent)"""


@query(_GAPS + " SELECT part::BIGINT AS partition, from_seq, to_seq FROM holes WHERE to_seq >= from_seq")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(dedup.gaps(dedup.sequenced_dedup(captures(spark, sf_dir))), "partition", "from_seq", "to_seq")


@query(_GAPS + """, marks AS (SELECT part, topic_idx, max(seq) AS mark FROM cap GROUP BY ALL)
SELECT h.part::BIGINT AS partition, from_seq, to_seq,
  (SELECT count(DISTINCT topic_idx) FROM cap c WHERE c.part = h.part AND c.seq = h.to_seq + 1)::BIGINT AS topics_at_next,
  (SELECT count(*) FROM marks m WHERE m.part = h.part AND m.mark > h.to_seq)::BIGINT AS topics_past,
  (SELECT count(*) FROM marks m WHERE m.part = h.part AND m.mark > h.to_seq) = 3 AS agreed
FROM holes h WHERE to_seq >= from_seq""")
def gap_all_topics_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = captures(spark, sf_dir)
    found = dedup.gap_agreement(dedup.gaps(dedup.sequenced_dedup(records)), records, 3)
    return found.withColumn("partition", F.col("partition").cast("bigint"))


def _by_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).withColumn("seq", F.col("pseq"))


TIMEOUT_MS = 300

#: One step for each arrival and each gap that is given up, from lists of the first copies' times.
_TIMEOUTS = f""", opened AS (SELECT part, arg_min(seq, (clock, topic_idx)) AS start FROM late GROUP BY part),
firsts AS (SELECT part, seq, min(clock) AS t FROM late JOIN opened USING (part) WHERE seq >= start GROUP BY ALL),
lists AS (SELECT part, list(seq ORDER BY t, seq) AS s, list(t ORDER BY t, seq) AS t FROM firsts GROUP BY part),
walk AS (
  SELECT part, 0 AS i, start AS next, NULL::BIGINT AS since, []::BIGINT[] AS held, NULL::BIGINT AS from_seq, NULL::BIGINT AS to_seq, NULL::BIGINT AS given_up FROM opened
  UNION ALL
  SELECT part, CASE WHEN due THEN i ELSE i + 1 END,
    CASE WHEN due THEN held[1] + ahead WHEN x = next THEN next + 1 + ahead ELSE next END,
    CASE WHEN due THEN CASE WHEN len(held) > ahead THEN since + {TIMEOUT_MS} + 1 END
      WHEN x = next THEN CASE WHEN len(held) > ahead THEN now END
      WHEN x > next AND (len(held) = 0 OR x < held[1]) THEN now ELSE since END,
    CASE WHEN due OR x = next THEN held[ahead + 1:] WHEN x > next THEN list_sort(list_append(held, x)) ELSE held END,
    CASE WHEN due THEN next END, CASE WHEN due THEN held[1] - 1 END, CASE WHEN due THEN since + {TIMEOUT_MS} + 1 END
  FROM (SELECT *, len(list_filter(held, lambda h, k: h = CASE WHEN due THEN held[1] - 1 ELSE next END + k)) AS ahead
    FROM (SELECT w.*, l.s[i + 1] AS x, l.t[i + 1] AS now, len(held) > 0 AND (i >= len(l.s) OR since + {TIMEOUT_MS} + 1 <= l.t[i + 1]) AS due, len(l.s) AS n
      FROM walk w JOIN lists l USING (part)) WHERE due OR i < n)),
given AS (SELECT part, from_seq, to_seq, given_up FROM walk WHERE given_up IS NOT NULL)"""


@query(_TIMEOUTS + """ SELECT part::BIGINT AS partition, from_seq, to_seq, given_up,
  (SELECT count(*) FROM late c WHERE c.part = g.part AND c.seq BETWEEN from_seq AND to_seq)::BIGINT AS late FROM given g""", recursive=True)
def gap_timeout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeout.gap_timeouts(delayed(spark, sf_dir), TIMEOUT_MS, arrival=("clock", "topic_idx", "offset"), time="clock")
    return longs(found, "partition", "from_seq", "to_seq", "given_up", "late")


@query(_TIMEOUTS + """ SELECT part::BIGINT AS partition, seq, t AS clock FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.part = f.part AND f.seq BETWEEN g.from_seq AND g.to_seq)""", recursive=True)
def gap_timeout_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(timeout.timeout_dedup(delayed(spark, sf_dir), TIMEOUT_MS, arrival=("clock", "topic_idx", "offset"), time="clock"), "partition", "seq", "clock")


@query(_GAPS + """, stuck AS (SELECT part, min(from_seq) AS stuck FROM holes WHERE to_seq >= from_seq GROUP BY part),
low AS (SELECT part, topic_idx, min(seq) - 1 AS low FROM sent JOIN stuck USING (part) WHERE seq > stuck GROUP BY ALL),
marks AS (SELECT part, topic_idx, max(seq) AS handled FROM cap GROUP BY ALL)
SELECT part::BIGINT AS partition, topic_idx::BIGINT AS topic_idx, least(low, handled)::BIGINT AS "offset", handled::BIGINT AS handled FROM marks LEFT JOIN low USING (part, topic_idx)""")
def low_water_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(recovery.low_water_offsets(captures(spark, sf_dir)), "partition", "topic_idx", "offset", "handled")


PRODUCER = ("partition", "producer_key")


@query("""SELECT part::BIGINT AS partition, user_id::VARCHAR AS producer_key, pseq AS seq, arrival, topic_idx::BIGINT AS topic_idx
FROM cap QUALIFY row_number() OVER (PARTITION BY part, user_id, pseq ORDER BY arrival, topic_idx) = 1""")
def multi_producer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.sequenced_dedup(_by_producer(spark, sf_dir), keys=PRODUCER)
    return found.select(F.col("partition").cast("bigint").alias("partition"), "producer_key", "seq", "arrival", F.col("topic_idx").cast("bigint").alias("topic_idx"))


@query(""", each AS (SELECT DISTINCT part, user_id, pseq FROM cap),
holes AS (SELECT part, user_id, lag(pseq) OVER (PARTITION BY part, user_id ORDER BY pseq) + 1 AS from_seq, pseq - 1 AS to_seq FROM each)
SELECT part::BIGINT AS partition, user_id::VARCHAR AS producer_key, from_seq, to_seq FROM holes WHERE to_seq >= from_seq""")
def multi_producer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.gaps(dedup.sequenced_dedup(_by_producer(spark, sf_dir), keys=PRODUCER), keys=PRODUCER)
    return found.withColumn("partition", F.col("partition").cast("bigint"))


@query(f""", marked AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY part, user_id ORDER BY ts_ms) > {EXPIRE_MS} AS late FROM cap),
numbered AS (SELECT *, sum(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY part, user_id ORDER BY ts_ms) AS k FROM marked)
SELECT part::BIGINT AS partition, user_id::VARCHAR AS producer_key, min(ts_ms)::BIGINT AS session, count(*)::BIGINT AS records, count(DISTINCT pseq)::BIGINT AS sent
FROM numbered GROUP BY part, user_id, k""")
def producer_expiry_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.producer_sessions(_by_producer(spark, sf_dir), EXPIRE_MS, time="ts_ms")
    judged = dedup.verdicts(rows, keys=(*PRODUCER, "session"), arrival=("ts_ms", "topic_idx", "offset"), start="lowest")
    found = judged.groupBy(*PRODUCER, "session").agg(F.count("*").alias("records"), F.count_if(F.col("verdict") == "SEND").alias("sent"))
    return found.withColumn("partition", F.col("partition").cast("bigint"))


@query(""", packets AS (SELECT part, seq, seq + 1 + arrival % 3 AS past FROM sent),
folded AS (SELECT part, list_reduce(list({'seq': seq, 'past': past} ORDER BY seq),
  lambda a, x: CASE WHEN x.seq >= a.past THEN {'past': x.past, 'kept': list_append(a.kept, x.seq)} ELSE a END, {'past': -1::BIGINT, 'kept': []::BIGINT[]}) AS f FROM packets GROUP BY part),
kept AS (SELECT part, unnest(f.kept) AS seq FROM folded)
SELECT part::BIGINT AS partition, seq, (past - seq)::BIGINT AS num_seq FROM kept JOIN packets USING (part, seq)""")
def multi_sequence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = captures(spark, sf_dir).withColumn("num_seq", 1 + F.col("arrival") % 3)
    return longs(dedup.packet_dedup(records), "partition", "seq", "num_seq")


def _decoded(spark: SparkSession, sf_dir: str, column: str, order: str, offset: int) -> DataFrame:
    padding = F.lit(bytes(offset))
    packed = bus(spark, sf_dir).withColumn(column, F.concat(padding, long_to_bytes(F.col("seq") * 1_000_003 - 5, order)))
    return packed.select("arrival", long_at(column, offset, order).alias("decoded"))


@query("SELECT arrival, (seq * 1000003 - 5)::BIGINT AS decoded FROM bus")
def binary_sequence_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "value", "little", 8)


@query("SELECT arrival, (seq * 1000003 - 5)::BIGINT AS decoded FROM bus")
def binary_sequence_be(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "key", "big", 4)


@query("SELECT arrival, (pseq - 3)::BIGINT AS decoded FROM bus")
def long_key_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus(spark, sf_dir).select("arrival", bytes_to_long(long_to_bytes(F.col("pseq") - 3)).alias("decoded"))


@query("SELECT arrival, user_id::VARCHAR AS producer_key, event_type AS body FROM bus")
def session_key_from_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.concat(F.lit(bytes(12)), slice_payload(long_to_bytes("user_id", "little"), 0, 4), F.lit(bytes(16)), F.encode("event_type", "UTF-8"))
    spooled = bus(spark, sf_dir).select(frame.alias("payload"), F.col("arrival").alias("enqueue_time"))
    rows = split_header(spooled, 0)
    return rows.select(header_long("headers", "CAPQT").alias("arrival"), int_at("key", 12).cast("string").alias("producer_key"), F.decode("value", "UTF-8").alias("body"))


@query(""", v AS (SELECT arrival, part, CASE WHEN seq % 3 = 0 THEN seq WHEN seq % 3 = 1 THEN -seq - 1 ELSE 9223372036854775807 - seq END AS x FROM bus),
u AS (SELECT *, CASE WHEN x < 0 THEN x::HUGEINT + 18446744073709551616 ELSE x::HUGEINT END AS n FROM v)
SELECT part::BIGINT AS partition, arrival, n::VARCHAR AS digits, (row_number() OVER (PARTITION BY part ORDER BY n) - 1)::BIGINT AS position FROM u""")
def unsigned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    x = F.when(seq % 3 == 0, seq).when(seq % 3 == 1, -seq - 1).otherwise(F.lit((1 << 63) - 1) - seq)
    rows = bus(spark, sf_dir).withColumn("seq", x).withColumn("order", unsigned_key("seq"))
    return numbered(rows, ["partition"], "order", "position", bits=44).select(F.col("partition").cast("bigint").alias("partition"), "arrival", unsigned_text("seq").alias("digits"), "position")


@query("SELECT arrival, ts_ms AS capqt, ts_ms + 2 AS capst, event_type AS body FROM bus")
def capture_populate_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spooled = bus(spark, sf_dir).select(F.encode(F.concat_ws("|", "arrival", "event_type"), "UTF-8").alias("payload"), F.col("ts_ms").alias("enqueue_time"))
    rows = populate(spooled, 0, send_time=F.col("enqueue_time") + 2)
    text = F.decode("value", "UTF-8")
    return rows.select(F.substring_index(text, "|", 1).cast("bigint").alias("arrival"), header_long("headers", "CAPQT").alias("capqt"), header_long("headers", "CAPST").alias("capst"), F.substring_index(text, "|", -1).alias("body"))


@query("SELECT part::BIGINT AS partition, seq, ts_ms + 5 AS ddst, seq AS ddseq, 1::BIGINT AS ddnum, (seq - seq % 5)::BIGINT AS ddoff_1 FROM sent")
def outbound_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"ddst": "DDST", "ddseq": "DDSEQ", "ddnum": "DDNUM", "ddoff_1": "DDOFF_1"}
    return outbound(spark, sf_dir).select(F.col("partition").cast("bigint").alias("partition"), "seq", *[header_long("headers", v).alias(k) for k, v in names.items()])


@query("SELECT arrival, substr(event_type, 3, 4) AS piece FROM bus")
def payload_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus(spark, sf_dir).select("arrival", F.decode(slice_payload(F.encode("event_type", "UTF-8"), 2, 4), "UTF-8").alias("piece"))


@query("SELECT arrival, hex(encode(event_type)) AS digits FROM bus")
def text_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus(spark, sf_dir).select("arrival", F.hex(encode_text("event_type")).alias("digits"))


_LAST = ", final AS (SELECT part, max(seq) AS seq FROM sent GROUP BY part), offs AS (SELECT part, 0 AS topic_idx, seq AS off FROM final UNION ALL SELECT part, 1, seq - seq % 5 FROM final UNION ALL SELECT part, 2, seq - seq % 3 FROM final)"


@query(_LAST + " SELECT part::BIGINT AS partition, topic_idx::BIGINT AS topic_idx, off::BIGINT AS \"offset\" FROM offs")
def recovery_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(recovery.last_offsets(outbound(spark, sf_dir)), "partition", "topic_idx", "offset")


@query("SELECT part::BIGINT AS partition, topic_idx::BIGINT AS topic_idx, max(seq)::BIGINT AS \"offset\" FROM cap GROUP BY ALL")
def handled_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(recovery.handled_offsets(captures(spark, sf_dir)), "partition", "topic_idx", "offset")


@query(_LAST + " SELECT part::BIGINT AS partition, count(*)::BIGINT AS tracked FROM offs GROUP BY part")
def tracked_offset_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(recovery.tracked_count(recovery.last_offsets(outbound(spark, sf_dir))), "partition", "tracked")


@query("SELECT part::BIGINT AS partition, max(sent_offset)::BIGINT AS \"offset\", arg_max(event_type, sent_offset) AS body FROM outb GROUP BY part")
def last_outbound_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.last_records(outbound(spark, sf_dir)).select(F.col("partition").cast("bigint").alias("partition"), "offset", F.decode("value", "UTF-8").alias("body"))


#: Records that one task writes to a log.
SEGMENT_ROWS = 100_000


def _logged(spark: SparkSession, sf_dir: str) -> str:
    """The merged stream written to a log, in two batches of which the second comes twice."""
    path = new_folder(spark, "log")
    rows = staged(outbound(spark, sf_dir).select("partition", "key", "value", "headers", "seq"), "sent")  # read by all batches
    half = rows.agg(F.max("seq")).first()[0] or 0
    for number, part in ((0, rows.filter(F.col("seq") <= half // 2)), (1, rows.filter(F.col("seq") > half // 2)), (1, rows.filter(F.col("seq") > half // 2))):
        tasks = max(1, -(-part.count() // SEGMENT_ROWS))
        log.log_sink(path, "outbound")(dedup.outbound_order(part, partitions=tasks, ranged=True).drop("seq"), number)
    discard(rows)
    return path


@query("SELECT part::BIGINT AS partition, sent_offset::BIGINT AS \"offset\", seq, event_type AS body FROM outb")
def committed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log.read_log(spark, _logged(spark, sf_dir))
    return rows.select(F.col("partition").cast("bigint").alias("partition"), "offset", bytes_to_long("key").alias("seq"), F.decode("value", "UTF-8").alias("body"))


@query("SELECT part::BIGINT AS partition, max(sent_offset)::BIGINT AS \"offset\", arg_max(seq, sent_offset) AS ddseq, (max(seq) + 1)::BIGINT AS start_seq FROM outb GROUP BY part")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = log.tail_of(spark, _logged(spark, sf_dir))
    rows = tail.join(recovery.resume_sequences(tail), "partition")
    return rows.select(F.col("partition").cast("bigint").alias("partition"), "offset", header_long("headers", "DDSEQ").alias("ddseq"), "start_seq")


@query(_LAST + """ SELECT c.part::BIGINT AS partition, c.topic_idx::BIGINT AS topic_idx, c.seq FROM cap c LEFT JOIN (SELECT part, topic_idx, off - 20 AS off FROM offs WHERE topic_idx < 2) o USING (part, topic_idx)
WHERE o.off IS NULL OR c.seq > o.off""")
def replay_after_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = recovery.last_offsets(outbound(spark, sf_dir)).filter("topic_idx < 2").withColumn("offset", F.col("offset") - 20)
    return longs(recovery.replay(captures(spark, sf_dir), offsets), "partition", "topic_idx", "seq")


@query("SELECT part::BIGINT AS partition, (max(seq) + 1)::BIGINT AS start_seq FROM sent GROUP BY part")
def resume_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(recovery.resume_sequences(outbound(spark, sf_dir)), "partition", "start_seq")


@query("SELECT part::BIGINT AS partition, seq, topic_idx::BIGINT AS topic_idx FROM sent WHERE seq >= 100")
def dedup_from_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = outbound(spark, sf_dir).filter("seq < 100")
    return longs(dedup.sequenced_dedup(captures(spark, sf_dir), start=recovery.resume_sequences(done)), "partition", "seq", "topic_idx")


@query("SELECT part::BIGINT AS partition, topic_idx::BIGINT AS topic_idx, seq, 1::BIGINT AS num_seq, ts_ms AS arrival FROM cap")
def normalise_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, TOPICS))
    kafka = captures(spark, sf_dir).select(long_to_bytes("seq").alias("key"), names[F.col("topic_idx")].alias("topic"), "partition", F.timestamp_millis("ts_ms").alias("timestamp"))
    return longs(normalise(kafka, TOPICS, sequence=bytes_to_long("key")), "partition", "topic_idx", "seq", "num_seq", "arrival")


@query(""", l AS (SELECT part, ts_ms // 86400000 AS day, greatest((seq % 97) - 10, 0) AS ms FROM sent)
SELECT part::BIGINT AS partition, day::BIGINT AS day, count(*)::BIGINT AS n, min(ms)::BIGINT AS min_ms, round(avg(ms), 3) AS mean_ms, round(quantile_cont(ms, 0.5), 3) AS p50_ms,
  round(quantile_cont(ms, 0.9), 3) AS p90_ms, round(quantile_cont(ms, 0.99), 3) AS p99_ms, round(quantile_cont(ms, 0.999), 3) AS p999_ms, max(ms)::BIGINT AS max_ms FROM l GROUP BY part, day""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = populate(
        dedup.sequenced_dedup(captures(spark, sf_dir)).withColumns({"payload": F.lit(b""), "enqueue_time": F.col("ts_ms")}), F.col("partition"),
        key=long_to_bytes("seq"), value=long_to_bytes(F.floor(F.col("ts_ms") / 86_400_000)), send_time=F.col("ts_ms"),
    )
    now = header_long("headers", "CAPQT") + bytes_to_long("key") % 97 - 10
    found = stats.latency_histogram(rows, stats.end_to_end_latency("headers", now), by=[F.col("partition").cast("bigint").alias("partition"), bytes_to_long("value").alias("day")])
    return found.select("partition", "day", "n", "min_ms", *[F.round(f"{k}_ms", 3).alias(f"{k}_ms") for k in ("mean", *stats.QUANTILES)], "max_ms")


@query(""" SELECT part::BIGINT AS session, seq * 100 AS position, count(*)::BIGINT AS fragments, string_agg(payload, '' ORDER BY k) AS body
FROM frag GROUP BY part, seq HAVING count(*) = any_value(pieces)""")
def fragment_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fragments.assembled(fixture.fragments(spark, sf_dir))
    return found.select(F.col("session").cast("bigint").alias("session"), "position", "fragments", F.decode("payload", "UTF-8").alias("body"))


@query(""", runs AS (SELECT *, seq * 100 + k AS position, lag(k) OVER (PARTITION BY part, seq ORDER BY k) IS DISTINCT FROM k - 1 AS head FROM frag),
chains AS (SELECT *, max(CASE WHEN head THEN position END) OVER (PARTITION BY part, seq ORDER BY k) AS chain FROM runs),
found AS (SELECT part, chain, max(position) + 1 AS past, count(*) AS fragments, bool_or(k = 0) AS begun, bool_or(k = pieces - 1) AS ended FROM chains GROUP BY part, chain)
SELECT part::BIGINT AS session, chain::BIGINT AS position, past::BIGINT AS past, fragments::BIGINT AS fragments, CASE WHEN NOT begun AND NOT ended THEN 'both' WHEN begun THEN 'end' ELSE 'begin' END AS lost
FROM found WHERE NOT (begun AND ended)""")
def fragment_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.lost_fragments(fixture.fragments(spark, sf_dir)).withColumn("session", F.col("session").cast("bigint"))


_BUCKETS = """, lat AS (SELECT part, ts_ms // 21600000 * 21600000 AS start_ms, (seq * 7919) % 5000 + CASE WHEN seq % 50 = 0 THEN 1000000 + seq ELSE 0 END AS ms FROM sent),
binned AS (SELECT part, start_ms, (greatest(0, length(bin(ms)) - 6) * 32 + (ms >> greatest(0, length(bin(ms)) - 6)))::BIGINT AS bucket FROM lat)"""


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.col("seq") * 7919) % 5000 + F.when(F.col("seq") % 50 == 0, 1_000_000 + F.col("seq")).otherwise(0)
    rows = dedup.sequenced_dedup(captures(spark, sf_dir)).withColumns({"queued": long_to_bytes(F.col("ts_ms")), "ms": ms, "time": F.timestamp_millis("ts_ms")})
    sent = populate(rows.withColumns({"payload": F.lit(b""), "enqueue_time": F.col("ts_ms")}), F.col("partition"), key=long_to_bytes("ms"), send_time=F.col("ts_ms"))
    late = stats.end_to_end_latency("headers", header_long("headers", "CAPQT") + bytes_to_long("key"))
    return histogram.bucket_counts(sent, late, F.timestamp_millis(header_long("headers", "CAPQT")), interval="6 hours", by=["partition"])


@query(_BUCKETS + """, each AS (SELECT part, start_ms, bucket, count(*) AS n FROM binned GROUP BY ALL),
summed AS (SELECT *, sum(n) OVER (PARTITION BY part, start_ms ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY part, start_ms) AS total FROM each),
picked AS (SELECT part, start_ms, total, min(bucket) FILTER (seen >= greatest(1, ceil(total * 0.5))) AS b50, min(bucket) FILTER (seen >= greatest(1, ceil(total * 0.99))) AS b99 FROM summed GROUP BY ALL)
SELECT part::BIGINT AS partition, start_ms::BIGINT AS start_ms, total::BIGINT AS n,
  (((b50 - greatest(0, (b50 >> 5) - 1) * 32) << greatest(0, (b50 >> 5) - 1)) + ((b50 + 1 - greatest(0, ((b50 + 1) >> 5) - 1) * 32) << greatest(0, ((b50 + 1) >> 5) - 1)) - 1) / 2 AS p50_ms,
  (((b99 - greatest(0, (b99 >> 5) - 1) * 32) << greatest(0, (b99 >> 5) - 1)) + ((b99 + 1 - greatest(0, ((b99 + 1) >> 5) - 1) * 32) << greatest(0, ((b99 + 1) >> 5) - 1)) - 1) / 2 AS p99_ms
FROM picked""")
def latency_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histogram.quantiles(histogram.histograms(_latencies(spark, sf_dir), ["partition", "start"]), {"p50_ms": 0.5, "p99_ms": 0.99})
    return found.select(F.col("partition").cast("bigint").alias("partition"), F.unix_millis("start").alias("start_ms"), "n", "p50_ms", "p99_ms")


@query(_BUCKETS + " SELECT part::BIGINT AS partition, bucket, count(*)::BIGINT AS n FROM binned GROUP BY ALL")
def latency_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    intervals = histogram.histograms(_latencies(spark, sf_dir), ["partition", "start"])
    return longs(histogram.merged(intervals, ["partition"]).select("partition", F.explode("buckets").alias("b")).select("partition", "b.bucket", "b.n"), "partition", "bucket", "n")


#: Records of a micro-batch: a partition's are in one worker's memory.
BATCH_ROWS = 2_000_000
#: Each micro-batch starts a worker for each partition of the state, also for those without a key; the
#: four keys are in four of eleven.
STATE_PARTITIONS = 11


def _streamed(spark: SparkSession, sf_dir: str, counts: bool = False) -> DataFrame:
    """The captures as a stream, merged by the stateful processor in three runs or as many as it takes
    for none to have much more than ``BATCH_ROWS`` records; at the end each topic says that it is done."""
    use_rocksdb(spark)
    top = new_folder(spark, "stream")
    rows = captures(spark, sf_dir).select("partition", "seq", "topic_idx", "offset", "arrival", F.encode("event_type", "UTF-8").alias("payload"), F.lit(False).alias("done"))
    rows = staged(rows.sortWithinPartitions("arrival"), "captures")
    ends = rows.select("partition").distinct().join(spark.range(3).select(F.col("id").cast("int").alias("topic_idx")))
    done = ends.select("partition", F.lit(None).cast("bigint").alias("seq"), "topic_idx", *[F.lit(None).cast("bigint").alias(x) for x in ("offset", "arrival")], F.lit(None).cast("binary").alias("payload"), F.lit(True).alias("done"))
    runs = max(3, -(-rows.count() // BATCH_ROWS))
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    bounds = [None, *rows.approxQuantile("arrival", [k / runs for k in range(1, runs)], 0.1 / runs), None]
    spark.createDataFrame([], rows.schema).write.parquet(f"{top}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{top}/in")
    merged = stream_dedup(source, topics=3, ordered=True, timeout_ms=None, counts=counts)
    for after, upto in zip(bounds, bounds[1:], strict=False):  # each part is written, then read by a query that goes on from the last one's checkpoint
        part = rows if after is None else rows.filter(F.col("arrival") > int(after))
        part = part.unionByName(done) if upto is None else part.filter(F.col("arrival") <= int(upto))
        part.write.mode("append").parquet(f"{top}/in")
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(shuffled), STATE_PARTITIONS)))
        try:
            merged.writeStream.format("parquet").option("checkpointLocation", f"{top}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{top}/out").awaitTermination()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    discard(rows)
    return spark.read.schema(merged.schema).parquet(f"{top}/out")


@query("SELECT part::BIGINT AS partition, seq, event_type AS body FROM sent")
def stream_sequenced_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).filter("kind = 'record'").select(F.col("partition").cast("bigint").alias("partition"), "seq", F.decode("payload", "UTF-8").alias("body"))


@query(_GAPS + " SELECT part::BIGINT AS partition, from_seq, to_seq FROM holes WHERE to_seq >= from_seq")
def stream_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_streamed(spark, sf_dir).filter("kind = 'gap'"), "partition", "from_seq", "to_seq")


@query("""SELECT part::BIGINT AS partition, count(DISTINCT seq)::BIGINT AS sent, (count(*) - count(DISTINCT seq))::BIGINT AS dropped FROM cap GROUP BY part""")
def stream_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streamed(spark, sf_dir, counts=True)
    return longs(rows.groupBy("partition").agg(F.count_if(F.col("kind") == "record").alias("sent"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")), "partition", "sent", "dropped")
