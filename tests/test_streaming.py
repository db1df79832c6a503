"""The streaming merge: equal to the batch form, across restarts, and with timers."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from seamline.operators import dedup
from seamline.streaming.core import Sequencer
from seamline.streaming.dedup import DedupProcessor, stream_dedup, use_rocksdb
from seamline.streaming.listener import ProgressListener, observed

SCHEMA = "partition int, producer_key string, seq long, topic_idx int, offset long, arrival long, payload binary, done boolean"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def step(spark, tmp_path, **given):
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    merged = observed(stream_dedup(source, **given))
    merged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    chance = random.Random(11)
    rows = []
    for p, producer in ((0, "a"), (0, "b"), (1, "a")):
        for t in range(3):
            rows += [(p, producer, s + (1 << 63) - 20 - ((1 << 64) if s >= 20 else 0), t, s, s * 10 + t, f"{s}".encode(), False) for s in range(40) if chance.random() < 0.6 or s == 0]
    rows.sort(key=lambda r: r[5])
    third = len(rows) // 3
    seen = []
    listener = ProgressListener(seen.append)
    spark.streams.addListener(listener)
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        put(spark, tmp_path / "in", part)
        step(spark, tmp_path, topics=3, keys=("partition", "producer_key"), ordered=True, timeout_ms=None)
    put(spark, tmp_path / "in", [(p, producer, None, t, None, None, None, True) for p, producer in ((0, "a"), (0, "b"), (1, "a")) for t in range(3)])
    out = step(spark, tmp_path, topics=3, keys=("partition", "producer_key"), ordered=True, timeout_ms=None)
    spark.streams.removeListener(listener)
    keys = ("partition", "producer_key")
    batch = dedup.sequenced_dedup(spark.createDataFrame(rows, SCHEMA), keys=keys)
    assert sorted(r[:] for r in out.filter("kind = 'record'").select(*keys, "seq", "payload").collect()) == sorted(r[:] for r in batch.select(*keys, "seq", "payload").collect())
    assert sorted(r[:] for r in out.filter("kind = 'gap'").select(*keys, "from_seq", "to_seq").collect()) == sorted(r[:] for r in dedup.gaps(batch, keys=keys).collect())
    assert sum(x["rows_in"] for x in seen) >= len(rows)


def test_gap_times_out(spark, tmp_path):
    put(spark, tmp_path / "in", [(0, "a", s, 0, s, s, b"x", False) for s in (0, 1, 5)])
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    merged = stream_dedup(source, topics=2, timeout_ms=500)
    query = merged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="300 milliseconds").start(str(tmp_path / "out"))
    found = []
    try:
        for _ in range(120):
            time.sleep(0.5)
            assert query.exception() is None
            if (tmp_path / "out").exists() and any((tmp_path / "out").glob("*.parquet")):
                found = spark.read.schema(merged.schema).parquet(str(tmp_path / "out")).select("kind", "seq", "from_seq", "to_seq").collect()
                if len(found) >= 4:
                    break
    finally:
        query.stop()
    assert sorted((r["kind"], r["seq"], r["from_seq"], r["to_seq"]) for r in found if r["kind"] == "gap") == [("gap", None, 2, 4)]
    assert sorted(r["seq"] for r in found if r["kind"] == "record") == [0, 1, 5]


def test_packets_in_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", s, 0, s, s, b"", None) for s in (0, 2, 3, 5)], SCHEMA).withColumn("num_seq", F.element_at(F.create_map(F.lit(0), F.lit(3), F.lit(2), F.lit(4), F.lit(3), F.lit(1), F.lit(5), F.lit(1)), F.col("seq").cast("int")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    merged = stream_dedup(source, topics=1, ordered=True, timeout_ms=None)
    merged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).filter("kind = 'record'").collect()) == [0, 3, 5]


def test_settings_build_the_whole_merge(spark, tmp_path):
    """Kafka-shaped rows to outbound rows with recovery headers, dead letters apart, resumed from
    a recovered start."""
    from seamline.functions.codec import long_to_bytes
    from seamline.functions.headers import header_long
    from seamline.operators.recovery import last_offsets, resume_sequences
    from seamline.plans.config import DedupSettings, from_dict
    from seamline.plans.merge import dead_letters, merge, outbound_gaps, outbound_rows, start_dead_letters

    settings = from_dict(DedupSettings, {
        "group_prefix": "g", "consumer": {}, "producer": {}, "inbound_topics": ["a", "b"], "outbound_topic": "o", "ordered": True,
        "strategy": {"impl": "long_key", "props": {"gap_timeout_ms": None}},
    })
    rows = [("a", 5, 0, 0), ("b", 7, 0, 0), ("a", 7, 1, 1), ("a", None, 2, 1), ("a", 4, 3, 2), ("b", 8, 1, 3)]
    df = spark.createDataFrame(rows, "topic string, n long, offset long, ms long").select(
        F.when(F.col("n").isNull(), F.lit(b"bad")).otherwise(long_to_bytes("n")).alias("key"), F.lit(b"v").alias("value"), "topic", F.lit(0).alias("partition"), "offset",
        F.timestamp_millis("ms").alias("timestamp"), F.lit(0).alias("timestampType"), F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    start = spark.createDataFrame([(0, 5)], "partition int, start_seq long")
    merged = merge(source, settings, start=start)
    merged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    out = spark.read.schema(merged.schema).parquet(str(tmp_path / "out"))
    sent = outbound_rows(out, settings)
    assert sorted(r[:] for r in sent.select("partition", bytes_of("key"), header_long("headers", "DDSEQ"), header_long("headers", "DDNUM")).collect()) == [(0, 5, 5, 1), (0, 7, 7, 1), (0, 8, 8, 1)]
    assert [r[:] for r in outbound_gaps(out).select("partition", "from_seq", "to_seq").collect()] == [(0, 6, 6)]
    assert [r["offset"] for r in dead_letters(df, settings).collect()] == [2]
    letters = []
    start_dead_letters(source, settings, str(tmp_path / "d"), lambda rows: letters.extend(r["offset"] for r in rows.collect()), availableNow=True).awaitTermination()
    assert letters == [2]
    kept = sent.withColumn("offset", header_long("headers", "DDSEQ"))
    assert [r[:] for r in resume_sequences(kept).collect()] == [(0, 9)]
    assert sorted(r[:] for r in last_offsets(kept).collect()) == [(0, 0, 3), (0, 1, 1)]


class EvenOnly(Sequencer):
    """A user's own rule: odd sequences are never sent."""

    def offer(self, topic, seq, record, now, count=1):
        if seq % 2:
            return "DROP", []
        return super().offer(topic, seq, record, now, 2)


class EvenProcessor(DedupProcessor):
    sequencer = EvenOnly


def test_a_strategy_brings_its_own_processor(spark, tmp_path, monkeypatch):
    from seamline.functions.codec import bytes_to_long, long_to_bytes
    from seamline.plans import config
    from seamline.plans.merge import merge

    monkeypatch.setitem(config.STRATEGIES, "even", lambda props: config.Strategy(bytes_to_long("key"), timeout_ms=None, processor=EvenProcessor))
    settings = config.from_dict(config.DedupSettings, {"group_prefix": "g", "consumer": {}, "producer": {}, "inbound_topics": ["a"], "outbound_topic": "o", "ordered": True, "strategy": {"impl": "even"}})
    df = spark.createDataFrame([(k,) for k in (4, 5, 6, 6, 7, 10)], "n long").select(
        long_to_bytes("n").alias("key"), F.lit(b"v").alias("value"), F.lit("a").alias("topic"), F.lit(0).alias("partition"), F.col("n").alias("offset"),
        F.timestamp_millis("n").alias("timestamp"), F.lit(0).alias("timestampType"), F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    merged = merge(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), settings)
    merged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    out = spark.read.schema(merged.schema).parquet(str(tmp_path / "out"))
    assert sorted(r["seq"] for r in out.filter("kind = 'record'").collect()) == [4, 6, 10]
    assert [r[:] for r in out.filter("kind = 'gap'").select("from_seq", "to_seq").collect()] == [(8, 9)]


def test_a_silent_producer_expires(spark, tmp_path):
    """After its expiry a producer's next record opens a new stream, even one that starts lower."""
    put(spark, tmp_path / "in", [(0, "a", s, 0, s, s, b"x", False) for s in (7, 8)])
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    merged = stream_dedup(source, topics=1, keys=("partition", "producer_key"), timeout_ms=None, expire_ms=3000)
    query = merged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="300 milliseconds").start(str(tmp_path / "out"))

    def sent(n):
        found = []
        for _ in range(120):
            time.sleep(0.5)
            assert query.exception() is None
            if (tmp_path / "out").exists() and any((tmp_path / "out").glob("*.parquet")):
                found = [r["seq"] for r in spark.read.schema(merged.schema).parquet(str(tmp_path / "out")).collect()]
                if len(found) >= n:
                    break
        return sorted(found)

    try:
        assert sent(2) == [7, 8]
        time.sleep(6)  # silent for longer than the expiry
        put(spark, tmp_path / "in", [(0, "a", 2, 0, 9, 9, b"x", False)])
        assert sent(3) == [2, 7, 8]
    finally:
        query.stop()


def test_a_restart_goes_on_from_what_is_sent(spark, tmp_path):
    """The first micro-batch of a run leaves out what an earlier run has sent; gaps are told."""
    from seamline.functions.codec import long_to_bytes
    from seamline.operators.recovery import starting_offsets
    from seamline.plans.config import DedupSettings, from_dict
    from seamline.plans.merge import recovered, sender

    for impl, keys in (("long_key", ["partition"]), ("session", ["partition", "producer_key"])):
        settings = from_dict(DedupSettings, {"group_prefix": "g", "consumer": {}, "producer": {}, "inbound_topics": ["a", "b"], "outbound_topic": "o", "strategy": {"impl": impl}})
        merged = spark.createDataFrame([(0, "P", "record", k, 1, None, None, f"0:{k},1:7") for k in (5, 6, 7, -1)] + [(1, "Q", "record", 1, 1, None, None, "0:3"), (0, "P", "gap", None, None, 2, 4, "")],
                                       "partition int, producer_key string, kind string, seq long, num_seq long, from_seq long, to_seq long, handled string")
        merged = merged.withColumns({"key": long_to_bytes("seq"), "value": F.lit(b"v"), "headers": F.lit(None).cast("array<struct<key:string,value:binary>>")})
        merged = merged.drop(*({"producer_key"} - set(keys)))
        out, gaps = str(tmp_path / impl), []

        def sent(out=out):
            return spark.read.parquet(out).withColumn("offset", bytes_of("key"))

        def sink(rows, out=out):
            rows.coalesce(1).write.mode("append").parquet(out)

        sender(settings, sink)(merged.filter("seq in (5, 6) or partition = 1"), 0)  # fails before it is committed
        again = sender(settings, sink, sent=lambda sent=sent: sent(), on_gaps=lambda g, gaps=gaps: gaps.extend(r[-2:] for r in g.collect()))
        again(merged, 0)
        assert sorted(r["offset"] for r in sent().collect()) == [-1, 1, 5, 6, 7]
        assert [tuple(g) for g in gaps] == [(2, 4)]
        start, offsets = recovered(sent().filter("offset > 0"), settings)
        assert sorted(r["start_seq"] for r in start.collect()) == [2, 8]
        assert json.loads(starting_offsets(offsets, ["a", "b"], [0, 1])) == {"a": {"0": 8, "1": 4}, "b": {"0": 8, "1": -2}}


def bytes_of(name):
    from seamline.functions.codec import bytes_to_long

    return bytes_to_long(name)


def collected(spark, tmp_path, merged, wanted, during=None, seconds=40):
    """Rows that a query on a clock has written, as soon as there are enough."""
    query = merged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="300 milliseconds").start(str(tmp_path / "out"))
    found = []
    try:
        for _ in range(2 * seconds):
            time.sleep(0.5)
            assert query.exception() is None
            if (tmp_path / "out").exists() and any((tmp_path / "out").glob("*.parquet")):
                found = spark.read.schema(merged.schema).parquet(str(tmp_path / "out")).collect()
                if during is not None and during(found):
                    during = None
                if len(found) >= wanted and during is None:
                    break
    finally:
        query.stop()
    return found


def test_an_expired_producer_sends_what_it_holds(spark, tmp_path):
    """Without a gap timeout, held records wait for the expiry; then they are sent, with the gap, and
    no timer rings again and again."""
    put(spark, tmp_path / "in", [(0, p, s, 0, o, s, b"x", False) for o, (p, s) in enumerate([("a", 1), ("b", 50), ("a", 4), ("a", 7)])])
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    merged = stream_dedup(source, topics=1, producer="producer_key", timeout_ms=None, expire_ms=2000)
    found = collected(spark, tmp_path, merged, 6)
    assert sorted((r["producer_key"], r["seq"]) for r in found if r["kind"] == "record") == [("a", 1), ("a", 4), ("a", 7), ("b", 50)]
    assert sorted((r["producer_key"], r["from_seq"], r["to_seq"]) for r in found if r["kind"] == "gap") == [("a", 2, 3), ("a", 5, 6)]


def test_marks_stay_below_what_is_held(spark, tmp_path):
    """Of each sent record: the highest offsets below which nothing is only held at that moment, over
    all producers, and equal to the batch form's at the end."""
    from seamline.operators.recovery import low_water_offsets

    rows = [(0, "a", 1, 0, 0), (0, "b", 7, 0, 1), (0, "a", 3, 0, 2), (0, "b", 9, 1, 0), (0, "b", 8, 0, 3), (0, "a", 2, 1, 1), (0, "a", 6, 1, 2), (0, "b", 10, 0, 4), (0, "b", 12, 0, 5)]
    put(spark, tmp_path / "in", [(p, who, s, t, o, k, b"x", False) for k, (p, who, s, t, o) in enumerate(rows)])
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    merged = stream_dedup(source, topics=2, producer="producer_key", timeout_ms=None)
    merged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r["producer_key"], r["seq"]): r["handled"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): "0:0", ("b", 7): "0:1", ("b", 8): "0:1,1:-1", ("b", 9): "0:1,1:0", ("a", 2): "0:1,1:1", ("a", 3): "0:3,1:1", ("b", 10): "0:4,1:1"}
    df = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")).withColumn("topic_idx", F.col("topic_idx"))
    batch = low_water_offsets(df, keys=("partition", "producer_key"))
    assert sorted(r[:] for r in batch.collect()) == [(0, 0, 4, 5), (0, 1, 1, 2)]


def test_counters_say_what_verdicts_say(spark, tmp_path):
    from seamline.streaming.listener import observed_partitions

    chance = random.Random(4)
    rows = [(p, "", s, t, s, s * 10 + t, b"x", False) for p in range(2) for t in range(3) for s in range(60) if s == 0 or chance.random() < 0.8]
    want = {r["partition"]: (r["sent"], r["dropped"]) for r in dedup.verdict_counts(dedup.verdicts(spark.createDataFrame(rows, SCHEMA))).collect()}
    seen = []
    listener = ProgressListener(seen.append)
    spark.streams.addListener(listener)
    rows.sort(key=lambda r: r[5])
    ends = [(p, "", None, t, None, None, None, True) for p in range(2) for t in range(3)]
    for part in (rows[:100], rows[100:], ends):
        put(spark, tmp_path / "in", part)
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        merged = observed_partitions(observed(stream_dedup(source, topics=3, ordered=True, timeout_ms=None, counts=True)), 2)
        merged.filter("kind <> 'count'").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    for _ in range(50):
        if sum(x.get("sent", 0) for x in seen) >= sum(s for s, _ in want.values()):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    for p in range(2):
        parts = [x["partitions"][p] for x in seen if "partitions" in x]
        assert (sum(x["sent"] for x in parts), sum(x["dropped"] for x in parts)) == want[p]
    assert sum(x.get("dropped", 0) for x in seen) == sum(d for _, d in want.values())
    assert [x for x in seen if "held" in x][-1]["held"] == 0
