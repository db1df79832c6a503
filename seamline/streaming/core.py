"""Decisions about one ordered stream: which record is sent, dropped or held back, and which
sequences are given up as lost.

The core knows neither Spark nor a clock; whoever calls it passes the time. Sequences are
unsigned 64-bit numbers as Python integers.

A record that continues the stream is sent, a lower one dropped, a higher one held. The lowest
held record is the next available one. The hole before it is skipped, and reported as a gap,
when all topics have got as far (only if captures are ordered), or when nothing has moved for
longer than the timeout.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from ..functions.codec import MAX_UNSIGNED

SEND, DROP, CACHE = "SEND", "DROP", "CACHE"


class Sent(NamedTuple):
    seq: int
    record: Any


class Gap(NamedTuple):
    from_seq: int
    to_seq: int


class Held:
    """Held records in memory: what a sequencer asks of a store."""

    def __init__(self) -> None:
        self.records: dict[int, tuple[int, Any]] = {}
        self.heap: list[int] = []

    def __contains__(self, seq: int) -> bool:
        return seq in self.records

    def lowest(self) -> int | None:
        return self.heap[0] if self.heap else None

    def add(self, seq: int, count: int, record: Any) -> None:
        self.records[seq] = count, record
        heapq.heappush(self.heap, seq)

    def pop_lowest(self) -> tuple[int, Any]:
        return self.records.pop(heapq.heappop(self.heap))


@dataclass
class Sequencer:
    """``topics``: how many captures there are. ``ordered``: each capture's sequences ascend.
    ``timeout_ms``: the longest wait for a missing sequence; None waits for ever. ``held``: the
    store of held records. ``stamp``: what a record becomes at the moment it is sent."""

    topics: int
    ordered: bool = False
    timeout_ms: int | None = 10_000
    next: int | None = None
    waiting_since: int | None = None
    marks: dict[int, int] = field(default_factory=dict)
    held: Held = field(default_factory=Held)
    stamp: Callable[[Any], Any] = lambda record: record

    def offer(self, topic: int, seq: int, record: Any, now: int, count: int = 1) -> tuple[str, list[Sent | Gap]]:
        """The verdict on a record as it arrives, and all that is sent or given up thereby."""
        self.marks[topic] = max(seq, self.marks.get(topic, -1))
        if self.next is None:
            self.next = seq
        if seq < self.next:
            return DROP, self._settle(now, False)
        if seq == self.next:
            self.next = seq + count
            sent = Sent(seq, self.stamp(record))
            return SEND, [sent, *self._settle(now, True)]
        lowest = self.held.lowest()
        earlier = lowest is None or seq < lowest
        if earlier or seq not in self.held:
            self.held.add(seq, count, record)
        out = self._settle(now, earlier)
        return (SEND if any(isinstance(x, Sent) and x.seq == seq for x in out) else CACHE), out

    def finished(self, topic: int, now: int) -> list[Sent | Gap]:
        """A topic will send no more: it holds up nothing from here on."""
        self.marks[topic] = MAX_UNSIGNED
        return self._settle(now, False)

    def tick(self, now: int) -> list[Sent | Gap]:
        """Time has passed."""
        return self._settle(now, False)

    def give_up(self, now: int) -> list[Sent | Gap]:
        """Nothing is waited for any more: all that is held is sent, with the gaps between."""
        return self._settle(now, False, True)

    def deadline(self) -> int | None:
        """When to call :meth:`tick`, if nothing arrives before."""
        return None if self.timeout_ms is None or self.waiting_since is None else self.waiting_since + self.timeout_ms + 1

    def _past(self, seq: int) -> bool:
        return self.ordered and len(self.marks) >= self.topics and min(self.marks.values()) >= seq

    def _settle(self, now: int, moved: bool, over: bool = False) -> list[Sent | Gap]:
        out: list[Sent | Gap] = []
        while (first := self.held.lowest()) is not None:
            if first > self.next:
                late = self.timeout_ms is not None and not moved and self.waiting_since is not None and now > self.waiting_since + self.timeout_ms
                if not over and not late and not self._past(first):
                    break
                out.append(Gap(self.next, first - 1))
                self.next = first
            count, record = self.held.pop_lowest()
            if first == self.next:
                out.append(Sent(first, self.stamp(record)))
                self.next = first + count
            moved = True
        if self.held.lowest() is None:
            self.waiting_since = None
        elif moved or self.waiting_since is None:
            self.waiting_since = now
        return out


@dataclass
class Producers:
    """A sequencer for each logical producer of a partition; one that is silent for longer than
    ``expire_ms`` is forgotten, so its next record opens a new stream."""

    make: Callable[[], Sequencer]
    expire_ms: int | None = None
    known: dict[str, tuple[Sequencer, int]] = field(default_factory=dict)

    def offer(self, producer: str, topic: int, seq: int, record: Any, now: int, count: int = 1) -> tuple[str, list[Sent | Gap]]:
        if self.expire_ms is not None:
            self.known = {k: v for k, v in self.known.items() if now - v[1] <= self.expire_ms}
        own = self.known[producer][0] if producer in self.known else self.make()
        self.known[producer] = own, now
        return own.offer(topic, seq, record, now, count)
