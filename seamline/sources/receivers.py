"""Bus receivers: agents that spool what they hear, and a streaming source for UDP.

A receiver is one process on one machine by nature; everything after the spool is distributed.
"""

from __future__ import annotations

import socket
import struct
import threading
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import suppress
from typing import Any, Protocol

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..plans.config import UdpCapture, WebsocketCapture
from ..schema import SPOOL_SCHEMA
from .log import LogWriter
from .spool import SpoolWriter


class Receiver(Protocol):
    """What an agent runs: ``open``, ``receive`` again and again (None: nothing came), ``close``."""

    def open(self) -> None: ...
    def receive(self) -> bytes | None: ...
    def close(self) -> None: ...


class UdpReceiver:
    """One datagram is one message of ``mtu`` bytes at most. With a ``group`` the receiver joins
    it on the interface with address ``iface``."""

    def __init__(self, port: int, *, group: str | None = None, iface: str = "0.0.0.0", mtu: int = 1500, timeout: float = 0.1):
        self.port, self.group, self.iface, self.mtu, self.timeout = port, group, iface, mtu, timeout

    def open(self) -> None:
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM, socket.IPPROTO_UDP)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind(("" if self.group else self.iface, self.port))
        self.port = self.socket.getsockname()[1]
        if self.group:
            joined = struct.pack("4s4s", socket.inet_aton(self.group), socket.inet_aton(self.iface))
            self.socket.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, joined)
        self.socket.settimeout(self.timeout)

    def receive(self) -> bytes | None:
        try:
            return self.socket.recv(self.mtu)
        except TimeoutError:
            return None

    def close(self) -> None:
        self.socket.close()


class WebsocketReceiver:
    """Binary frames as they are, text frames encoded with ``charset``; reconnects after a pause.
    ``connect``: opens a connection with ``recv()`` and ``close()``; by default that of the
    optional websocket-client library. ``lost``: the errors besides OSError by which a
    connection tells that it is lost."""

    def __init__(self, url: str, *, charset: str = "UTF-8", pause: float = 1.0, connect: Callable[[str], object] | None = None, lost: tuple[type[Exception], ...] = ()):
        self.url, self.charset, self.pause, self.connect, self.lost = url, charset, pause, connect, (OSError, *lost)
        self.connection = None
        self.stopped = threading.Event()

    def open(self) -> None:
        if self.connect is None:
            from websocket import WebSocketException, create_connection

            self.connect, self.lost = create_connection, (*self.lost, WebSocketException)

    def receive(self) -> bytes | None:
        try:
            if self.connection is None:
                self.connection = self.connect(self.url)
            frame = self.connection.recv()
        except self.lost:
            self._drop()
            self.stopped.wait(self.pause)
            return None
        return frame.encode(self.charset) if isinstance(frame, str) else bytes(frame)

    def _drop(self) -> None:
        connection, self.connection = self.connection, None
        if connection is not None:
            with suppress(*self.lost):
                connection.close()

    def close(self) -> None:
        self.stopped.set()
        self._drop()


class Agent:
    """Runs a receiver in a thread and spools its messages. What was received is written before
    :meth:`close` returns."""

    def __init__(self, receiver: Receiver, spool: SpoolWriter | LogWriter):
        self.receiver, self.spool = receiver, spool
        self.stopped = threading.Event()
        self.failure: Exception | None = None
        self.thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> None:
        self.receiver.open()
        self.thread.start()

    def _run(self) -> None:
        try:
            while not self.stopped.is_set():
                payload = self.receiver.receive()
                if payload is not None:
                    self.spool.add(payload)
                else:
                    self.spool.roll_if_due()
        except Exception as e:
            self.failure = e
        finally:
            self.spool.close()

    def close(self) -> None:
        self.stopped.set()
        self.thread.join()
        self.receiver.close()
        if self.failure is not None:
            raise self.failure


def agent_of(settings: UdpCapture | WebsocketCapture, **given: Any) -> Agent:
    """The agent of a capture's settings, not yet started. ``given``: what settings can't hold,
    such as a websocket's ``connect``."""
    own = settings.receiver
    if isinstance(settings, WebsocketCapture):
        receiver = WebsocketReceiver(own.url, charset=own.charset, **given)
    elif isinstance(settings, UdpCapture):
        receiver = UdpReceiver(own.port, group=own.group, iface=own.iface, mtu=own.mtu, **given)
    else:
        raise TypeError(f"there is no receiver for {type(settings).__name__}")
    spool = LogWriter(settings.spool.path) if settings.spool.durable else SpoolWriter(settings.spool.path, max_ms=settings.spool.roll_ms)
    return Agent(receiver, spool)


class _UdpReader(SimpleDataSourceStreamReader):
    """Datagrams numbered from 0; those of uncommitted batches can be read again."""

    def __init__(self, options: dict):
        self.receiver = UdpReceiver(int(options["port"]), group=options.get("group"), iface=options.get("iface", "0.0.0.0"), mtu=int(options.get("mtu", 1500)))
        self.limit = int(options.get("limit", 1024))
        self.receiver.open()
        self.first, self.held = 0, deque()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        import time

        while len(self.held) < self.limit:
            payload = self.receiver.receive()
            if payload is None:
                break
            self.held.append((payload, time.time_ns() // 1_000_000))
        end = self.first + len(self.held)
        return self.readBetweenOffsets(start, {"n": end}), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([self.held[k - self.first] for k in range(max(start["n"], self.first), end["n"])])

    def commit(self, end: dict) -> None:
        while self.held and self.first < end["n"]:
            self.held.popleft()
            self.first += 1


class UdpDataSource(DataSource):
    """``spark.readStream.format("udp")`` with options port, group, iface, mtu, limit. Datagrams of
    a batch that was not committed are lost with the driver; an :class:`Agent` is durable."""

    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return SPOOL_SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _UdpReader(self.options)
