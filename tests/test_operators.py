"""Batch operators on small tables: ties, nulls, repeated rows, empty tables, unsigned ends."""

import random

import pytest
from pyspark.sql import functions as F

from seamline.functions.codec import long_to_bytes
from seamline.functions.headers import header_long
from seamline.operators import dedup, ordered, populate, recovery, stats
from seamline.streaming.core import Gap, Sent, Sequencer

SCHEMA = "partition int, seq long, arrival long, topic_idx int, offset long"


def records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_first_copy_wins_and_start_bounds(spark):
    df = records(spark, [(0, 5, 1, 1, 0), (0, 5, 1, 0, 7), (0, 4, 2, 0, 8), (0, 6, 3, 0, 9), (0, 6, 3, 0, 9), (0, None, 4, 0, 10), (1, -1, 1, 0, 0), (1, 3, 2, 0, 1), (None, 1, 1, 0, 0)])
    found = dedup.sequenced_dedup(df)
    assert sorted(((r["partition"], r["seq"], r["topic_idx"]) for r in found.collect()), key=str) == sorted([(0, 5, 0), (0, 6, 0), (1, -1, 0), (None, 1, 0)], key=str)
    judged = {(r["partition"], r["sent"], r["dropped"]) for r in dedup.verdict_counts(dedup.verdicts(df)).collect()}
    assert judged == {(0, 2, 4), (1, 1, 1), (None, 1, 0)}
    assert dedup.sequenced_dedup(df, start="lowest").count() == 6
    start = spark.createDataFrame([(0, 6)], "partition int, start_seq long")
    assert sorted((r["partition"], r["seq"]) for r in dedup.sequenced_dedup(df, start=start).filter("partition is not null").collect()) == [(0, 6), (1, -1), (1, 3)]
    with pytest.raises(ValueError):
        dedup.sequenced_dedup(df, start="whenever")
    for f in (dedup.sequenced_dedup, dedup.verdicts, dedup.packet_dedup):
        assert f(df.limit(0).withColumn("num_seq", F.lit(1))).count() == 0


def test_gaps_reach_over_the_unsigned_middle(spark):
    top = (1 << 63) - 1
    df = records(spark, [(0, s, k, 0, k) for k, s in enumerate([top - 2, top, -(1 << 63) + 3, -1])])
    found = [(r["from_seq"], r["to_seq"]) for r in dedup.gaps(df).collect()]
    assert sorted(found) == sorted([(top - 1, top - 1), (-(1 << 63), -(1 << 63) + 2), (-(1 << 63) + 4, -2)])
    assert dedup.gaps(df.limit(0)).count() == 0


def test_ranges_give_what_one_window_gives(spark):
    chance = random.Random(4)
    rows = [(k % 3, x, chance.randrange(100)) for k, x in enumerate(chance.sample(range(-5000, 5000), 300))]
    df = spark.createDataFrame(rows, "k int, x long, v long")
    for bits in (4, 9, 16):
        out = ordered.previous(df, ["k"], "x", F.col("v"), "before", bits)
        for kind in ("max", "min", "sum"):
            out = ordered.running(out, ["k"], "x", F.col("v"), kind, kind=kind, bits=bits)
        out = ordered.numbered(out, ["k"], "x", "number", bits)
        got = {(r["k"], r["x"]): r for r in out.collect()}
        assert len(got) == len(rows)
        for k in range(3):
            own = sorted((x, v) for kk, x, v in rows if kk == k)
            for i, (x, _) in enumerate(own):
                seen = [v for _, v in own[: i + 1]]
                r = got[k, x]
                assert (r["before"], r["max"], r["min"], r["sum"], r["number"]) == (own[i - 1][1] if i else None, max(seen), min(seen), sum(seen), i)


@pytest.mark.parametrize("seed", range(4))
def test_packets_follow_the_core(spark, seed):
    chance = random.Random(seed)
    packets = {s: chance.randint(1, 6) for s in range(150) if chance.random() < 0.5}
    rows = [(0, s, k, 0, k, n) for k, (s, n) in enumerate(packets.items())]
    df = spark.createDataFrame(rows, SCHEMA + ", num_seq long")
    core, events = Sequencer(1, True, None), []
    for _, s, k, _, _, n in rows:
        events += core.offer(0, s, None, k, n)[1]
    got = sorted(dedup.packet_dedup(df).collect(), key=lambda r: r["seq"])
    assert [r["seq"] for r in got] == [e.seq for e in events if isinstance(e, Sent)]
    holes = dedup.gaps(dedup.packet_dedup(df), count=F.col("num_seq")).collect()
    assert sorted((r["from_seq"], r["to_seq"]) for r in holes) == [(e.from_seq, e.to_seq) for e in events if isinstance(e, Gap)]


def test_agreement_of_topics(spark):
    df = records(spark, [(0, s, k, t, k) for k, (s, t) in enumerate([(0, 0), (0, 1), (4, 0), (5, 1), (9, 0)])])
    found = {(r["from_seq"], r["to_seq"]): (r["topics_at_next"], r["topics_past"], r["agreed"]) for r in dedup.gap_agreement(dedup.gaps(dedup.sequenced_dedup(df)), df, 2).collect()}
    assert found == {(1, 3): (1, 2, True), (6, 8): (1, 1, False)}


def test_sessions(spark):
    rows = [(0, "p", t) for t in (0, 10, 1000, 2001, 2001, 3002)] + [(0, "q", 5), (0, None, 7)]
    df = spark.createDataFrame(rows, "partition int, producer_key string, arrival long")
    got = sorted(((r["producer_key"] or "", r["arrival"], r["session"]) for r in dedup.producer_sessions(df, 1000).collect()))
    assert got == [("", 7, 7), ("p", 0, 0), ("p", 10, 0), ("p", 1000, 0), ("p", 2001, 2001), ("p", 2001, 2001), ("p", 3002, 3002), ("q", 5, 5)]


def test_union_and_order(spark):
    one, two = (records(spark, [(0, 3, 0, 9, 0), (1, 1, 0, 9, 0)]), records(spark, [(0, -1, 0, 9, 0), (0, 2, 0, 9, 0)]))
    both = dedup.union_topics([one, two])
    assert sorted((r["seq"], r["topic_idx"]) for r in both.collect()) == [(-1, 1), (1, 0), (2, 1), (3, 0)]
    parts = dedup.outbound_order(both, partitions=3).select("partition", "seq", F.spark_partition_id().alias("p")).collect()
    assert [r["seq"] for r in parts if r["partition"] == 0] == [2, 3, -1] and len({r["p"] for r in parts if r["partition"] == 0}) == 1
    with pytest.raises(ValueError):
        dedup.union_topics([])


def test_recovery(spark):
    rows = [(0, k, 100 + k) for k in range(3)] + [(1, 0, 1000)]
    df = spark.createDataFrame(rows, "partition int, offset long, seq long").withColumn("headers", F.lit(None).cast("array<struct<key:string,value:binary>>"))
    out = populate.outbound_records(df, send_time=F.lit(5), count=F.lit(2), offsets=F.create_map(F.lit(0), F.col("offset"), F.lit(1), F.col("offset") + 10))
    bare = df.filter("partition = 1").withColumns({"partition": F.lit(2)}).select(*df.columns)
    everything = out.unionByName(bare)
    assert sorted((r["partition"], r["start_seq"]) for r in recovery.resume_sequences(everything).collect()) == [(0, 104), (1, 1002), (2, None)]
    offsets = recovery.last_offsets(everything)
    assert sorted(r[:] for r in offsets.collect()) == [(0, 0, 2), (0, 1, 12), (1, 0, 0), (1, 1, 10)]
    assert recovery.starting_offsets(offsets, ["a", "b"], [0, 2]) == '{"a": {"0": 3, "2": -2}, "b": {"0": 13, "2": -2}}'
    kept = recovery.replay(spark.createDataFrame([(0, 0, 2), (0, 0, 3), (5, 0, 0)], "partition int, topic_idx int, offset long"), offsets)
    assert sorted(r[:] for r in kept.collect()) == [(0, 0, 3), (5, 0, 0)]
    assert sorted(r[:] for r in recovery.tracked_count(offsets).collect()) == [(0, 2), (1, 2)]
    assert recovery.last_records(everything.limit(0)).count() == 0


def test_recovery_of_producers(spark):
    df = spark.createDataFrame([(0, 0, 10001, "P1"), (0, 1, 102, "P2"), (0, 2, 10002, "P1")], "partition int, offset long, seq long, producer string").withColumn("headers", F.lit(None).cast("array<struct<key:string,value:binary>>"))
    out = populate.outbound_records(df, prefix=F.concat("producer", F.lit("-")))
    assert sorted(r[:] for r in recovery.resume_producers(out).collect()) == [(0, "P1", 10003), (0, "P2", 103)]


def test_populate(spark):
    df = spark.createDataFrame([(b"k" * 32 + b"body", 7), (b"short", 8)], "payload binary, enqueue_time long")
    plain = populate.populate(df, 3, send_time=F.lit(9)).select("key", "value", "partition", header_long("headers", "CAPQT"), header_long("headers", "CAPST")).collect()
    assert [r[:] for r in plain] == [(None, b"k" * 32 + b"body", 3, 7, 9), (None, b"short", 3, 8, 9)]
    split = populate.split_header(df, 0, send_time=F.lit(9)).select("key", "value").collect()
    assert [r[:] for r in split] == [(b"k" * 32, b"body"), (b"short", b"")]


def test_latency(spark):
    df = spark.createDataFrame([(100, 90), (100, 120), (100, None)], "now long, queued long").withColumn("headers", F.when(F.col("queued").isNotNull(), F.array(F.struct(F.lit("CAPQT").alias("key"), long_to_bytes("queued").alias("value")))))
    for exact in (True, False):
        r = stats.latency_histogram(df, stats.end_to_end_latency("headers", F.col("now")), exact=exact).first()
        assert (r["n"], r["min_ms"], r["max_ms"], r["mean_ms"]) == (2, 0, 10, 5.0)
    assert stats.latency_histogram(df, stats.capture_latency("queued", "now")).first()["min_ms"] == -20


def test_long_stretches_of_packets(spark):
    """Stretches in which each packet overlaps the next, equal to the sequencer's decisions."""
    import random

    from seamline.streaming.core import Sent, Sequencer

    chance = random.Random(6)
    rows = []
    for key, n, widest in ((0, 3000, 2), (1, 500, 9), (2, 400, 1), (3, 1, 5)):
        rows += [(key, s, chance.randint(1, widest), 0, s, s) for s in range(n) if key != 1 or chance.random() < 0.7]
    rows += [(4, s, 2, 0, s, s) for s in range(0, 5000)]
    df = spark.createDataFrame(rows, "partition int, seq long, num_seq long, topic_idx int, offset long, arrival long")
    want = set()
    for key in range(5):
        core = Sequencer(1, False, 0, next=min(r[1] for r in rows if r[0] == key))
        for r in sorted(r for r in rows if r[0] == key):
            for now in (r[1] * 10, r[1] * 10 + 5):
                found = core.offer(0, r[1], None, now, r[2])[1] if now % 10 == 0 else core.tick(now)
                want |= {(key, x.seq) for x in found if isinstance(x, Sent)}
    for most in (64, 1):
        assert {(r["partition"], r["seq"]) for r in dedup.packet_dedup(df, most_folded=most).select("partition", "seq").collect()} == want
