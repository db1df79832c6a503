"""Gaps given up after a timeout, in batch, against the sequencer on any interleaving."""

import random

import pytest

from seamline.operators.timeout import gap_timeouts, timeout_dedup
from seamline.streaming.core import Gap, Sent, Sequencer

SCHEMA = "partition int, seq long, topic_idx int, offset long, arrival long"


def simulated(rows, timeout):
    """The sequencer with a clock that rings at each deadline, before what comes at that moment."""
    gaps, sent = set(), set()
    for key in {r[0] for r in rows}:
        core, found = Sequencer(1, False, timeout), []
        own = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[4], r[2], r[3]))
        for _, seq, topic, _, now in own:
            while (due := core.deadline()) is not None and due <= now:
                found += [(due, x) for x in core.tick(due)]
            found += [(now, x) for x in core.offer(topic, seq & ((1 << 64) - 1), None, now)[1]]
        while (due := core.deadline()) is not None:
            found += [(due, x) for x in core.tick(due)]
        for now, x in found:
            if isinstance(x, Gap):
                late = sum(r[0] == key and r[1] is not None and x.from_seq <= r[1] & ((1 << 64) - 1) <= x.to_seq for r in rows)
                gaps.add((key, x.from_seq, x.to_seq, now, late))
            elif isinstance(x, Sent):
                sent.add((key, x.seq))
    return gaps, sent


def unsigned(n):
    return n & ((1 << 64) - 1)


def check(spark, rows, timeout, **given):
    df = spark.createDataFrame(rows, SCHEMA)
    gaps, sent = simulated(rows, timeout)
    assert {(r["partition"], unsigned(r["from_seq"]), unsigned(r["to_seq"]), r["given_up"], r["late"]) for r in gap_timeouts(df, timeout, **given).collect()} == gaps
    assert {(r["partition"], unsigned(r["seq"])) for r in timeout_dedup(df, timeout, **given).collect()} == sent


@pytest.mark.parametrize(("seed", "bits"), [(0, 12), (1, 2)])
def test_any_interleaving(spark, seed, bits):
    """Many keys at once, each with its own manner: bursts, stretches that come late, lost records."""
    chance = random.Random(seed)
    rows = []
    for key in range(60):
        n, base = chance.randint(1, 60), chance.choice([0, 100, (1 << 63) - 15, (1 << 16) - 20])
        step, jitter, lost, late = chance.choice([1, 3, 10]), chance.choice([0, 5, 30]), chance.choice([0.0, 0.1, 0.4]), chance.choice([0.0, 0.2, 0.5])
        slow = chance.randint(0, n)
        for s in range(n):
            for topic in range(2):
                if chance.random() >= lost:
                    delay = chance.randint(0, jitter) + (chance.randint(10, 80) if chance.random() < late else 0) + (60 if slow <= s < slow + 8 else 0)
                    seq = base + s
                    rows.append((key, seq - (1 << 64) if seq >= 1 << 63 else seq, topic, s, s * step + delay))
    rows.append((0, None, 0, 999, 5))
    check(spark, rows, 20, range_bits=bits)


def test_worked_examples(spark):
    rows = [
        *[(0, s, 0, s, t) for s, t in ((0, 0), (1, 1), (5, 2))],  # never filled
        *[(1, s, 0, s, t) for s, t in ((0, 0), (2, 10), (1, 30), (3, 31))],  # comes at the last moment
        *[(2, s, 0, s, t) for s, t in ((0, 0), (2, 10), (1, 31), (3, 40))],  # comes when it has been given up
        *[(3, s, 0, s, t) for s, t in ((0, 0), (9, 1), (7, 15), (5, 30), (4, 49), (1, 70))],  # lower and lower ones begin the wait anew
        *[(4, s, 0, s, t) for s, t in ((0, 0), (2, 1), (4, 1), (6, 1), (5, 40), (3, 70))],  # one hole after the other
        (5, 3, 0, 0, 0), (5, 3, 1, 0, 0),
    ]
    check(spark, rows, 20)


def test_no_rows(spark):
    assert gap_timeouts(spark.createDataFrame([], SCHEMA), 20).count() == 0
