"""Held records in a streaming query's state, found without a scan.

The sequences that are held are bits in a tree of bitmaps: a node is 256 bits, eight levels cover
unsigned 64-bit numbers, and a bit in a node above says that the node below isn't empty. The
lowest is found by going down along the lowest bits. What a micro-batch reads and writes are the
nodes and records that it touches, however many records are held. Records are in typed columns.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Row

LEVELS, BITS = 8, 8
NODE_KEY, NODE = "space string, level int, prefix bigint", "bits binary"
RECORD_KEY = "producer string, seq bigint"


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def plain(value: Any) -> Any:
    """A value as the state takes it: arrays as lists, structs as dictionaries."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | np.ndarray):
        return [plain(v) for v in value]
    return bytes(value) if isinstance(value, bytearray) else value


class LowestSet:
    """Sets of unsigned 64-bit numbers, one for each ``space``, over a map state."""

    def __init__(self, state: Any):
        self.state = state
        self.nodes: dict[tuple[str, int, int], int] = {}
        self.changed: set[tuple[str, int, int]] = set()

    def _node(self, key: tuple[str, int, int]) -> int:
        if key not in self.nodes:
            found = self.state.getValue(key)
            self.nodes[key] = int.from_bytes(found[0], "little") if found else 0
        return self.nodes[key]

    def _put(self, key: tuple[str, int, int], bits: int) -> None:
        self.nodes[key] = bits
        self.changed.add(key)

    def has(self, space: str, n: int) -> bool:
        return bool(self._node((space, 0, n >> BITS)) >> (n & 255) & 1)

    def add(self, space: str, n: int) -> None:
        for level in range(LEVELS):
            key, bit = (space, level, n >> BITS * (level + 1)), 1 << (n >> BITS * level & 255)
            bits = self._node(key)
            self._put(key, bits | bit)
            if bits:  # the nodes above know of this one
                break

    def remove(self, space: str, n: int) -> None:
        for level in range(LEVELS):
            key, bit = (space, level, n >> BITS * (level + 1)), 1 << (n >> BITS * level & 255)
            bits = self._node(key) & ~bit
            self._put(key, bits)
            if bits:
                break

    def lowest(self, space: str) -> int | None:
        prefix = 0
        for level in reversed(range(LEVELS)):
            bits = self._node((space, level, prefix))
            if not bits:
                return None
            prefix = prefix << BITS | (bits & -bits).bit_length() - 1
        return prefix

    def flush(self) -> None:
        for key in self.changed:
            bits = self.nodes[key]
            if bits:
                self.state.updateValue(key, (bits.to_bytes(32, "little"),))
            elif self.state.containsKey(key):
                self.state.removeKey(key)
        self.changed.clear()


class HeldStore:
    """The held records of all producers of a partition, and the offsets from which topics have
    something held. A record is ``topic, offset, count, values``; a null or negative offset isn't tracked."""

    def __init__(self, nodes: Any, records: Any):
        self.index, self.records = LowestSet(nodes), records
        self.fresh: dict[tuple[str, int], tuple] = {}  # held since the micro-batch began
        self.low: dict[int, int | None] = {}
        self.count = 0  # how many more are held than when the micro-batch began

    def add(self, producer: str, seq: int, count: int, record: tuple) -> None:
        topic, offset, _, values = record
        self.index.add(f"s{producer}", seq)
        if offset is not None and offset >= 0:
            self.index.add(f"o{topic}", offset)
            if topic in self.low:
                self.low[topic] = offset if self.low[topic] is None else min(self.low[topic], offset)
        self.fresh[producer, signed(seq)] = (count, topic, offset, *values)
        self.count += 1

    def pop(self, producer: str, seq: int) -> tuple[int, tuple]:
        key = producer, signed(seq)
        found = self.fresh.pop(key, None)
        if found is None:
            found = tuple(map(plain, self.records.getValue(key)))
            self.records.removeKey(key)
        count, topic, offset, *values = found
        self.index.remove(f"s{producer}", seq)
        if offset is not None and offset >= 0:
            self.index.remove(f"o{topic}", offset)
            if self.low.get(topic) == offset:
                self.low.pop(topic)
        self.count -= 1
        return count, (topic, offset, count, tuple(values))

    def lowest_offset(self, topic: int) -> int | None:
        """The lowest offset of a topic whose record is only held."""
        if topic not in self.low:
            self.low[topic] = self.index.lowest(f"o{topic}")
        return self.low[topic]

    def flush(self) -> None:
        for key, value in self.fresh.items():
            self.records.updateValue(key, tuple(map(plain, value)))
        self.fresh.clear()
        self.index.flush()

    def of(self, producer: str) -> ProducersHeld:
        return ProducersHeld(self, producer)


class ProducersHeld:
    """One producer's part of a :class:`HeldStore`, as a sequencer's store."""

    def __init__(self, store: HeldStore, producer: str):
        self.store, self.producer = store, producer
        self.first: int | None = None
        self.known = False

    def __contains__(self, seq: int) -> bool:
        return self.store.index.has(f"s{self.producer}", seq)

    def lowest(self) -> int | None:
        if not self.known:
            self.first, self.known = self.store.index.lowest(f"s{self.producer}"), True
        return self.first

    def add(self, seq: int, count: int, record: tuple) -> None:
        lowest = self.lowest()
        self.first = seq if lowest is None else min(seq, lowest)
        self.store.add(self.producer, seq, count, record)

    def pop_lowest(self) -> tuple[int, tuple]:
        self.known = False
        return self.store.pop(self.producer, self.first)
