"""A micro-batch of the stateful processor without Spark: decided together, it is what the sequencer
decides record by record, and its results are handed on in bounded frames."""

import random

import pandas as pd
import pytest

from seamline.streaming import dedup
from seamline.streaming.core import Sequencer
from seamline.streaming.dedup import NONE, DedupProcessor


class Map(dict):
    def getValue(self, key):  # noqa: N802
        return self.get(key)

    def containsKey(self, key):  # noqa: N802
        return key in self

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        del self[key]


class Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value


class Handle:
    def getMapState(self, *given):  # noqa: N802
        return Map()

    def getValueState(self, *given):  # noqa: N802
        return Value()


class Clock:
    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1000


class OneByOne(Sequencer):
    """The same rules; a class of its own is asked about every record."""


class Slow(DedupProcessor):
    sequencer = OneByOne


def results(kind, batches, ordered):
    own = kind(["partition"], 3, ordered, None, None, {"payload": "binary"}, None, True)
    own.init(Handle())
    frames = [f for rows in batches for f in own.handleInputRows((0,), iter([rows]), Clock())]
    return frames, own


def batches_of(seed, size=300, base=0):
    chance = random.Random(seed)
    rows = []
    for t in range(3):
        for s in range(size):
            if (s + seed) % 105 and chance.random() < 0.8:
                seq = base + s
                rows.append((False, seq - (1 << 64) if seq >= 1 << 63 else seq, 2 if seed == 4 and s % 50 == 7 else 1, t, NONE if seed == 3 and s % 9 == 0 else s, s * 10 + chance.randint(0, 25), bytes([s % 256])))
    rows.sort(key=lambda r: r[5])
    cut = [len(rows) * k // 3 for k in range(4)]
    names = ["done", "seq", "num_seq", "topic_idx", "offset", "arrival", "payload"]
    parts = [rows[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    parts[2] = parts[2] + [(True, 0, 1, t, NONE, (1 << 63) - 1, None) for t in range(3)]
    return [pd.DataFrame(p, columns=names) for p in parts]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("ordered", [True, False])
def test_decided_together_as_one_by_one(seed, ordered, monkeypatch):
    monkeypatch.setattr(dedup, "MOST_ROWS", 40)
    batches = batches_of(seed, base=(1 << 63) - 150 if seed == 5 else 0)
    fast, a = results(DedupProcessor, batches, ordered)
    slow, b = results(Slow, batches, ordered)
    assert pd.concat(fast).astype(object).where(lambda x: x.notna(), None).values.tolist() == pd.concat(slow).astype(object).where(lambda x: x.notna(), None).values.tolist()
    for x, y in ((a.idle, b.idle), (a.waiting, b.waiting), (a.records, b.records), (a.nodes, b.nodes)):
        assert dict(x) == dict(y)
    assert a.partition.value == b.partition.value


def test_results_come_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(dedup, "MOST_ROWS", 50)
    frames, _ = results(DedupProcessor, batches_of(0), True)
    assert sum(len(f) for f in frames) > 250
    assert max(len(f) for f in frames) <= 100


def test_most_records_need_no_call_of_their_own(monkeypatch):
    calls = []
    offer = Sequencer.offer
    monkeypatch.setattr(Sequencer, "offer", lambda self, *given: calls.append(1) or offer(self, *given))
    n = 5000
    rows = pd.DataFrame({"done": False, "seq": range(n), "num_seq": 1, "topic_idx": 0, "offset": range(n), "arrival": range(n), "payload": [b"x"] * n})
    frames, _ = results(DedupProcessor, [rows], True)
    assert sum((f["kind"] == "record").sum() for f in frames) == n
    assert len(calls) < 10
