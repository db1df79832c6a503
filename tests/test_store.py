"""Held records in the state: the lowest is found, and what a micro-batch touches doesn't grow."""

import random

import pytest
from pyspark.sql import Row

from seamline.streaming.store import HeldStore, LowestSet, plain


class Map:
    """A map state that counts what is read and written."""

    def __init__(self):
        self.rows, self.touched = {}, 0

    def getValue(self, key):  # noqa: N802
        self.touched += 1
        return self.rows.get(key)

    def containsKey(self, key):  # noqa: N802
        self.touched += 1
        return key in self.rows

    def updateValue(self, key, value):  # noqa: N802
        self.touched += 1
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        self.touched += 1
        del self.rows[key]


@pytest.mark.parametrize("seed", range(5))
def test_lowest_of_any_set(seed):
    chance, state, own = random.Random(seed), Map(), {"a": set(), "b": set()}
    top = chance.choice([10, 1000, (1 << 64) - 1])
    for _ in range(30):
        index = LowestSet(state)  # a new micro-batch
        for _ in range(20):
            space = chance.choice("ab")
            if own[space] and chance.random() < 0.5:
                n = chance.choice([min(own[space]), *own[space]])
                index.remove(space, n)
                own[space].discard(n)
            else:
                n = chance.randint(0, top)
                index.add(space, n)
                own[space].add(n)
            assert index.lowest(space) == min(own[space], default=None)
            assert index.has(space, n) == (n in own[space])
        index.flush()
    for space in "ab":
        for n in list(own[space]):
            index.remove(space, n)
    index.flush()
    assert not state.rows  # nothing is left behind


def batch_of(nodes, records, first):
    """A micro-batch that holds ten more, sends the lowest three, and asks for the marks."""
    nodes.touched = records.touched = 0
    store = HeldStore(nodes, records)
    held = store.of("")
    for k in range(10):
        held.add(first + 3 * k, 1, (k % 2, first + k, 1, (b"x",)))
    sent = []
    for _ in range(3):
        sent.append(held.lowest())
        held.pop_lowest()
        store.lowest_offset(0), store.lowest_offset(1)
    store.flush()
    return sent, nodes.touched + records.touched


def test_a_micro_batch_touches_as_much_with_a_million_held():
    touched = {}
    for n in (1_000, 1_000_000):
        nodes, records = Map(), Map()
        store = HeldStore(nodes, records)
        held = store.of("")
        for seq in range(5, 5 + 2 * n, 2):
            held.add(seq, 1, (seq % 2, seq, 1, (b"x",)))
        store.flush()
        assert len(records.rows) == n
        sent, touched[n] = batch_of(nodes, records, 10 * n)
        assert sent == [5, 7, 9]
    assert touched[1_000_000] <= touched[1_000] + 20 and touched[1_000_000] < 200


def test_records_come_back_as_they_were():
    nodes, records = Map(), Map()
    store = HeldStore(nodes, records)
    value = (b"k", None, [{"key": "h", "value": b"1"}])
    store.of("p").add((1 << 64) - 2, 3, (1, None, 3, value))
    store.flush()
    assert list(records.rows) == [("p", -2)] and store.count == 1
    held = HeldStore(nodes, records).of("p")
    assert held.lowest() == (1 << 64) - 2 and HeldStore(nodes, records).of("q").lowest() is None
    assert held.pop_lowest() == (3, (1, None, 3, value))
    assert plain([Row(key="a", value=bytearray(b"1"))]) == [{"key": "a", "value": b"1"}]
