"""The log: what survives a kill, tail reads, streams, commits of repeated batches, and a merge and a
capture that run on logs from end to end."""

import json
import os
import signal
import socket
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seamline.functions.codec import long_to_bytes
from seamline.functions.headers import header_long
from seamline.plans import capture, config, merge
from seamline.sources import log

RECORDS = [log.Record(5, None, b"v", None), log.Record(6, b"", b"", []), log.Record(-1, b"k", None, [("a", b"1"), ("ä", None), ("a", b"")])]


def values(path, partition=0, start=0, end=1 << 60):
    return [r.value for _, r in log.read_range(str(path), partition, start, end)]


@pytest.mark.parametrize("record", RECORDS)
def test_records_round_trip(record):
    assert log.decode(log.encode(record)) == record


def test_segments_roll_and_any_offset_is_found(tmp_path):
    with_index = log.LogWriter(str(tmp_path), segment_bytes=2000, index_every=7, sync=False)
    for k in range(300):
        assert with_index.add(f"M{k}".encode(), k) == k
    with_index.close()
    assert len(log.own_segments(str(tmp_path / "0"))) > 3 and log.ends(str(tmp_path)) == {0: 300}
    for start in (0, 1, 6, 7, 8, 63, 64, 65, 150, 299):
        assert values(tmp_path, 0, start, start + 3) == [f"M{k}".encode() for k in range(start, min(300, start + 3))]
    again = log.LogWriter(str(tmp_path), sync=False)
    assert again.add(b"more") == 300
    with pytest.raises(BlockingIOError):
        log.LogWriter(str(tmp_path))
    again.close()


@pytest.mark.parametrize("torn", [1, 5, 8, 11, 13])
def test_a_torn_last_frame_is_left_out(tmp_path, torn):
    writer = log.LogWriter(str(tmp_path), index_every=2)
    for k in range(5):
        writer.add(b"x%d" % k, k)
    writer.close()
    file = Path(log.own_segments(str(tmp_path / "0"))[-1].file)
    whole = file.read_bytes()
    file.write_bytes(whole + log.frame(log.encode(RECORDS[0]))[:torn])
    assert log.ends(str(tmp_path)) == {0: 5} and len(values(tmp_path)) == 5
    log.LogWriter(str(tmp_path)).close()
    assert file.read_bytes() == whole
    file.write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))  # a damaged one too
    assert log.ends(str(tmp_path)) == {0: 4}


def test_a_killed_writer_loses_nothing_it_had_added(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from seamline.sources.log import LogWriter
w = LogWriter({str(tmp_path)!r}, index_every=16)
k = 0
while True:
    w.add(b"%d" % k)
    print(k, flush=True)
    k += 1
"""
    run = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, text=True)
    told = [run.stdout.readline() for _ in range(200)]
    run.send_signal(signal.SIGKILL)
    told += run.stdout.readlines()
    run.wait()
    added = [int(x) for x in told if x.endswith("\n")]
    found = [int(v) for v in values(tmp_path)]
    assert found == list(range(len(found))) and len(found) > added[-1] >= 199
    assert log.LogWriter(str(tmp_path)).add(b"next") == len(found)


def rows(spark, given):
    df = spark.createDataFrame([(p, v) for p, v in given], "partition int, n long")
    return df.select("partition", long_to_bytes("n").alias("key"), F.lit(b"v").alias("value"), F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"))


def test_a_repeated_batch_appears_once(spark, tmp_path):
    put = log.log_sink(str(tmp_path), "r")
    put(rows(spark, [(0, 1), (0, 2), (1, 7)]).coalesce(1), 0)
    put(rows(spark, [(0, 3)]).coalesce(1), 1)
    put(rows(spark, [(0, 3)]).coalesce(1), 1)  # came back after it had been committed
    log.write_segments(str(tmp_path), iter(rows(spark, [(0, 99)]).collect()))  # a task whose batch was never committed
    log.log_sink(str(tmp_path), "other")(rows(spark, [(0, 4)]).coalesce(1), 0)
    found = log.read_log(spark, str(tmp_path)).collect()
    assert sorted((r["partition"], r["offset"], int.from_bytes(r["key"])) for r in found) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (1, 0, 7)]
    assert len(list(tmp_path.glob("0/*.log"))) == 4  # the repeated one is gone, the uncommitted one is never read


def test_commits_name_all_segments_now_and_then(tmp_path, monkeypatch):
    monkeypatch.setattr(log, "ALL_EVERY", 4)
    from pyspark.sql import Row

    for k in range(11):
        done = log.write_segments(str(tmp_path), iter([Row(partition=0, key=None, value=b"%d" % k, headers=None)]))
        assert log.commit_segments(str(tmp_path), "r", k, [(done.order, *x) for x in done.files])
    assert sorted(x for x in os.listdir(tmp_path / "_commits") if "all" in x) == ["00000000000000000003.all.json", "00000000000000000007.all.json"]
    assert values(tmp_path) == [b"%d" % k for k in range(11)] and log.ends(str(tmp_path)) == {0: 11}


def test_a_failed_and_repeated_streaming_batch_appears_once(spark, tmp_path):
    """The checkpoint forgets its last commit, as if the driver had died before writing it."""
    log.register(spark)
    writer = log.LogWriter(str(tmp_path / "in"))
    for round in range(4):
        for k in range(4 if round < 3 else 0):  # a run takes one batch, the last but one of them the repeated
            writer.add(b"%d" % (4 * round + k))
        source = spark.readStream.format(log.NAME).load(str(tmp_path / "in")).select("partition", "key", "value", "headers")
        query = source.writeStream.format(log.NAME).option("path", str(tmp_path / "out")).option("run", "q").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        last = max((x for x in (tmp_path / "c" / "commits").iterdir() if x.name.isdigit()), key=lambda x: int(x.name))
        if round == 1:
            last.unlink()
            (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    writer.close()
    assert [int(v) for v in values(tmp_path / "out")] == list(range(12))


def test_where_a_stream_starts(spark, tmp_path):
    log.register(spark)
    writer = log.LogWriter(str(tmp_path / "in"))
    for k in range(3):
        writer.add(b"%d" % k)
    starts = {"earliest": [0, 1, 2, 3], "latest": [3], "tail:2": [1, 2, 3], '{"0": 2}': [2, 3]}
    queries = {s: spark.readStream.format(log.NAME).option("start", s).load(str(tmp_path / "in")).writeStream.format("memory").queryName(f"starts{k}").trigger(processingTime="100 milliseconds").start() for k, s in enumerate(starts)}
    for q in queries.values():
        q.processAllAvailable()
    writer.add(b"3")
    for s, q in queries.items():
        q.processAllAvailable()
        q.stop()
        assert sorted(int(r["value"]) for r in spark.table(q.name).collect()) == starts[s], s
    writer.close()


def test_tail_reads_one_record_of_each_partition(spark, tmp_path):
    for p in range(3):
        writer = log.LogWriter(str(tmp_path), p, sync=False)
        for k in range(1000 + p):
            writer.add(b"%d" % k, k)
        writer.close()
    found = log.tail_of(spark, str(tmp_path))
    assert sorted((r["partition"], r["offset"], r["value"]) for r in found.collect()) == [(p, 999 + p, b"%d" % (999 + p)) for p in range(3)]
    reader = log._Reader({"path": str(tmp_path), "start": "tail:1"})
    assert [(x.partition, x.end - x.start) for x in reader.partitions()] == [(0, 1), (1, 1), (2, 1)]
    assert sum(b.num_rows for x in reader.partitions() for b in reader.read(x)) == 3


SETTINGS = {"group_prefix": "g", "consumer": {}, "producer": {}, "inbound_topics": ["a", "b"], "outbound_topic": "o", "commit_ms": 200, "strategy": {"impl": "long_key", "props": {"gap_timeout_ms": None}}}


def sequences(path):
    return [int.from_bytes(r.key) for _, r in log.read_range(str(path), 0, 0, 1 << 60)]


def test_a_cold_start_loses_no_held_record(spark, tmp_path):
    """Topic a has a hole, so what follows it is held; the merge stops and goes on with a new
    checkpoint, from the last record it has sent, and the hole is filled."""
    settings = config.from_dict(config.DedupSettings, SETTINGS)
    logs = {t: log.LogWriter(str(tmp_path / t)) for t in "ab"}
    for n in (1, 2, 5, 6):
        logs["a"].add(b"", n, key=n.to_bytes(8))
    logs["b"].add(b"", 2, key=(2).to_bytes(8))
    ends = merge.log_ends(spark, settings, {t: str(tmp_path / t) for t in "ab"}, str(tmp_path / "out"))
    seen = []
    for checkpoint in ("c1", "c2"):
        running = merge.start_merge(spark, settings, str(tmp_path / checkpoint), ends=ends, partitions=[0], report=seen.append)
        try:
            running.processAllAvailable()
            if checkpoint == "c1":
                assert sequences(tmp_path / "out") == [1, 2]
                last = log.tail_of(spark, str(tmp_path / "out"))
                assert last.select(header_long("headers", "DDOFF_0")).first()[0] == 1  # offset 2 is only held
            else:
                for n in (3, 4, 7):
                    logs["b"].add(b"", n, key=n.to_bytes(8))
                running.processAllAvailable()
            for _ in range(50):  # reports come a little later
                if sum(x.get("sent", 0) for x in seen) >= (2 if checkpoint == "c1" else 7):
                    break
                time.sleep(0.2)
        finally:
            running.stop()
    assert sequences(tmp_path / "out") == [1, 2, 3, 4, 5, 6, 7]
    assert sum(x.get("sent", 0) for x in seen) == 7, seen


def test_two_producers_of_a_partition_lose_nothing(spark, tmp_path):
    """What one producer holds keeps the other's records from moving the partition's offsets past it."""
    given = {**SETTINGS, "inbound_topics": ["a"], "strategy": {"impl": "session", "props": {"gap_timeout_ms": None}}}
    settings = config.from_dict(config.DedupSettings, given)
    writer = log.LogWriter(str(tmp_path / "a"))

    def put(producer, n):
        writer.add(n.to_bytes(8, "little"), n, key=bytes(12) + producer.to_bytes(4, "little"))

    for producer, n in ((1, 10), (2, 500), (1, 12), (2, 501), (2, 502)):  # 11 of the first is missing
        put(producer, n)
    ends = merge.log_ends(spark, settings, {"a": str(tmp_path / "a")}, str(tmp_path / "out"))
    for checkpoint in ("c1", "c2"):
        running = merge.start_merge(spark, settings, str(tmp_path / checkpoint), ends=ends, partitions=[0])
        try:
            running.processAllAvailable()
            if checkpoint == "c2":
                put(1, 11)
                put(2, 503)
                running.processAllAvailable()
        finally:
            running.stop()
    found = [(int.from_bytes(r.key[12:16], "little"), int.from_bytes(r.value, "little")) for _, r in log.read_range(str(tmp_path / "out"), 0, 0, 1 << 60)]
    assert [n for p, n in found if p == 1] == [10, 11, 12] and [n for p, n in found if p == 2] == [500, 501, 502, 503]


def test_a_merge_stops_with_its_dead_letters(spark, tmp_path):
    settings = config.from_dict(config.DedupSettings, {**SETTINGS, "inbound_topics": ["a"]})
    writer = log.LogWriter(str(tmp_path / "a"))
    writer.add(b"", 1, key=b"bad")
    writer.add(b"", 1, key=(1).to_bytes(8))
    letters = []
    ends = merge.log_ends(spark, settings, {"a": str(tmp_path / "a")}, str(tmp_path / "out"))
    running = merge.start_merge(spark, settings, str(tmp_path / "c"), ends=ends, on_dead_letters=lambda rows: letters.extend(r["key"] for r in rows.collect()))
    running.processAllAvailable()
    running.stop()
    assert [bytes(x) for x in letters] == [b"bad"] and not running.dead_letters.isActive and sequences(tmp_path / "out") == [1]


def test_a_capture_from_end_to_end(spark, tmp_path):
    given = {"receiver": {"iface": "127.0.0.1", "group": None, "port": 0}, "spool": {"path": str(tmp_path / "queue"), "durable": True}, "kafka": {"producer": {}, "topic": "t", "partition": 3}}
    settings = config.from_dict(config.UdpCapture, given)
    for run in range(2):
        running = capture.start_capture(spark, settings, str(tmp_path / "c"), sink=capture.log_sink(str(tmp_path / "topic"), "t"), interval="200 milliseconds")
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for k in range(5):
                out.sendto(b"M%d%d" % (run, k), ("127.0.0.1", running.agent.receiver.port))
        time.sleep(0.5)
        running.close()
    found = log.read_log(spark, str(tmp_path / "topic")).select("partition", "value", header_long("headers", "CAPQT").alias("queued"), header_long("headers", "CAPST").alias("sent")).collect()
    assert sorted(bytes(r["value"]) for r in found) == [b"M%d%d" % (run, k) for run in range(2) for k in range(5)]
    assert all(r["partition"] == 3 and 0 < r["queued"] <= r["sent"] for r in found)
    assert json.loads((tmp_path / "topic" / "_commits" / "00000000000000000000.json").read_text())["run"] == "t"


def test_batches_are_framed_as_their_rows():
    import pyarrow as pa

    rows = [
        {"partition": 0, "timestamp": 5, "key": b"k", "value": None, "headers": None}, {"partition": 1, "timestamp": 6, "key": None, "value": b"", "headers": []},
        {"partition": 0, "timestamp": 7, "key": b"", "value": b"v", "headers": [{"key": "a", "value": b"x"}, {"key": "b", "value": None}]},
    ]
    batch = pa.RecordBatch.from_pylist(rows, schema=log._FIELDS)
    for part, want in ((batch, rows), (batch.slice(1), rows[1:])):
        pairs = [(r["partition"], log.frame(log.encode(log.Record(r["timestamp"], r["key"], r["value"], None if r["headers"] is None else [(h["key"], h["value"]) for h in r["headers"]])))) for r in want]
        assert list(log.frames_of(part)) == pairs


def test_the_sent_rows_are_computed_once(spark, sf_dir, monkeypatch):
    from seamline.plans import queries

    given = []
    staged = queries.staged
    monkeypatch.setattr(queries, "staged", lambda df, name: given.append(name) or staged(df, name))
    written = []
    sink = log.log_sink
    monkeypatch.setattr(queries.log, "log_sink", lambda path, run: lambda rows, n: written.append(any("events" in f for f in rows.inputFiles())) or sink(path, run)(rows, n))
    queries._logged(spark, sf_dir)
    assert given == ["sent"] and written == [False] * 3
