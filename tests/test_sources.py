"""Spool, receivers, settings, and the shaping of Kafka rows."""

import json
import socket
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seamline.functions.codec import bytes_to_long, long_to_bytes
from seamline.plans import config
from seamline.sources import kafka, receivers, spool


def test_spool_rolls_and_streams(spark, tmp_path):
    now = [1000]
    writer = spool.SpoolWriter(str(tmp_path / "spool"), max_rows=3, max_ms=50, clock=lambda: now[0])
    for k in range(4):
        writer.add(f"M{k}".encode())
    assert len(list((tmp_path / "spool").glob("*.parquet"))) == 1
    now[0] += 60
    writer.roll_if_due()
    writer.close()
    assert not list((tmp_path / "spool").glob(".*.tmp"))
    stream = spool.read_spool(spark, str(tmp_path / "spool"), max_files=1)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted((r["payload"], r["enqueue_time"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(f"M{k}".encode(), 1000) for k in range(4)]


def test_udp_agent(spark, tmp_path):
    receiver = receivers.UdpReceiver(0, iface="127.0.0.1", timeout=0.05)
    agent = receivers.Agent(receiver, spool.SpoolWriter(str(tmp_path), max_ms=10))
    agent.start()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
        for k in range(20):
            out.sendto(f"M{k}".encode(), ("127.0.0.1", receiver.port))
    time.sleep(0.5)
    agent.close()
    assert sorted(r["payload"] for r in spark.read.parquet(str(tmp_path)).collect()) == sorted(f"M{k}".encode() for k in range(20))


def test_websocket_receiver_reconnects(tmp_path):
    class Connection:
        def __init__(self, frames):
            self.frames = frames

        def recv(self):
            if not self.frames:
                raise ConnectionResetError
            return self.frames.pop(0)

        def close(self):
            pass

    rounds = [[b"\x01", "ä"], ["again"]]
    receiver = receivers.WebsocketReceiver("ws://x", charset="ISO-8859-1", pause=0, connect=lambda url: Connection(rounds.pop(0)))
    receiver.open()
    assert [receiver.receive() for _ in range(4)] == [b"\x01", b"\xe4", None, b"again"]
    receiver.close()


def test_websocket_receiver_reconnects_on_the_errors_of_its_library(tmp_path):
    class Closed(Exception):
        pass

    class Connection:
        closed = 0

        def __init__(self, frames):
            self.frames = frames

        def recv(self):
            if not self.frames:
                raise Closed
            return self.frames.pop(0)

        def close(self):
            Connection.closed += 1
            raise Closed

    rounds = [[b"1"], [b"2", b"3"]]
    given = config.from_dict(config.WebsocketCapture, {"receiver": {"url": "ws://x"}, "spool": {"path": str(tmp_path), "roll_ms": 20}, "kafka": {"producer": {}, "topic": "t", "partition": 0}})
    agent = receivers.agent_of(given, pause=0.05, connect=lambda url: Connection(rounds.pop(0)) if rounds else Connection([]), lost=(Closed,))
    agent.start()
    time.sleep(0.6)
    agent.close()
    assert sorted(x for f in tmp_path.glob("*.parquet") for x in pq.read_table(f)["payload"].to_pylist()) == [b"1", b"2", b"3"]
    assert Connection.closed >= 2


def test_capture_restarts_from_its_settings(spark, tmp_path):
    """Each message is spooled once over two runs of a capture built from settings."""
    given = {"receiver": {"iface": "127.0.0.1", "group": None, "port": 0}, "spool": {"path": str(tmp_path)}, "kafka": {"producer": {}, "topic": "t", "partition": 0}}
    for run in range(2):
        agent = receivers.agent_of(config.from_dict(config.UdpCapture, given))
        agent.start()
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for k in range(5):
                out.sendto(f"M{run}{k}".encode(), ("127.0.0.1", agent.receiver.port))
        time.sleep(0.3)
        agent.close()
    assert sorted(r["payload"] for r in spark.read.parquet(str(tmp_path)).collect()) == sorted(f"M{run}{k}".encode() for run in range(2) for k in range(5))
    with pytest.raises(TypeError):
        receivers.agent_of(config.BusCapture(config.BusSettings("d", "c", 1), config.Spool("p"), config.KafkaTarget({}, "t", 0)))


def test_udp_source_replays_until_commit():
    reader = receivers.UdpDataSource({"port": "0", "iface": "127.0.0.1"}).simpleStreamReader(None)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
        for k in range(3):
            out.sendto(bytes([k]), ("127.0.0.1", reader.receiver.port))
    time.sleep(0.2)
    rows, end = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == [b"\0", b"\1", b"\2"] and end == {"n": 3}
    assert [r[0] for r in reader.readBetweenOffsets({"n": 1}, end)] == [b"\1", b"\2"]
    reader.commit(end)
    assert not reader.held and reader.first == 3
    reader.receiver.close()


def test_kafka_rows(spark):
    assert kafka.source_options("h:1", ["a", "b"], max_per_trigger=5, group_prefix="g") == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "a,b", "includeHeaders": "true", "startingOffsets": "earliest", "failOnDataLoss": "true", "maxOffsetsPerTrigger": "5", "groupIdPrefix": "g"
    }
    df = spark.createDataFrame([("b", 7, 0), ("a", 8, 1), ("other", 9, 2)], "topic string, n long, partition int").withColumns({"key": long_to_bytes("n"), "timestamp": F.timestamp_millis(F.lit(1234))})
    rows = kafka.normalise(df, ["a", "b"], sequence=bytes_to_long("key"), producer_key=F.col("n")).select("topic_idx", "seq", "num_seq", "arrival", "producer_key").collect()
    assert sorted(r[:] for r in rows) == [(0, 8, 1, 1234, "8"), (1, 7, 1, 1234, "7")]


def test_settings(spark, tmp_path):
    given = {
        "group_prefix": "g", "consumer": {}, "producer": {}, "inbound_topics": ["a", "b"], "outbound_topic": "o",
        "strategy": {"impl": "binary_value", "props": {"offset": 8, "byte_order": "BIG_ENDIAN", "gap_timeout_ms": 500}},
    }
    (tmp_path / "x.json").write_text(json.dumps(given))
    settings = config.load(config.DedupSettings, str(tmp_path / "x.json"))
    assert settings.inbound_topics == ["a", "b"] and settings.ordered is False
    found = config.strategy(settings.strategy)
    df = spark.createDataFrame([(b"01234567" + (77).to_bytes(8, "big"), (9).to_bytes(32, "little"))], "value binary, key binary")
    assert df.select(found.sequence).first()[0] == 77 and found.timeout_ms == 500
    session = config.strategy(config.StrategySettings("session", {"expire_seconds": 2}))
    assert df.select(session.producer_key).first()[0] == "0" and session.expire_ms == 2000
    capture = config.from_dict(config.UdpCapture, {"receiver": {"iface": "0.0.0.0", "group": "239.0.0.1", "port": 1}, "spool": {"path": "p"}, "kafka": {"producer": {}, "topic": "t", "partition": 0}})
    assert capture.receiver.mtu == 1500
    for wrong in ({**given, "more": 1}, {k: v for k, v in given.items() if k != "strategy"}, {**given, "inbound_topics": []}):
        with pytest.raises(ValueError):
            config.from_dict(config.DedupSettings, wrong)
    with pytest.raises(ValueError):
        config.strategy(config.StrategySettings("none"))
