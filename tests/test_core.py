"""The decisions about one ordered stream: worked examples, and the closed form."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seamline.streaming.core import MAX_UNSIGNED, Gap, Producers, Sent, Sequencer


def run(core, text, start=0):
    """Records such as ``A5`` (topic and sequence) with the expected verdict; returns all events."""
    out = []
    for item in text.split(", "):
        name, verdict = item.split()
        got, events = core.offer("ABC".index(name[0]), int(name[1:]), name, start)
        assert got == {"S": "SEND", "D": "DROP", "C": "CACHE"}[verdict], item
        out += events
    return out


def sent(events):
    return [x.seq for x in events if isinstance(x, Sent)]


def gaps(events):
    return [(x.from_seq, x.to_seq) for x in events if isinstance(x, Gap)]


ORDERED = dict(topics=3, ordered=True, timeout_ms=1000)


@pytest.mark.parametrize("text", ["A0 S, A1 S, A2 S", "A0 S, A1 S, A1 D, A2 S", "A100 S, A101 S, A102 S"])
def test_in_order_and_duplicates(text):
    assert not gaps(run(Sequencer(**ORDERED), text))


def test_three_topics():
    events = run(Sequencer(**ORDERED), "A0 S, A1 S, A2 S, B0 D, B1 D, B2 D, B3 S, A3 D, A4 S, C0 D, C1 D, C2 D, C3 D, C4 D, C5 S, A5 D, B5 D")
    assert sent(events) == [0, 1, 2, 3, 4, 5] and not gaps(events)


def test_gap_on_one_topic():
    events = run(Sequencer(**ORDERED), "A0 S, A1 S, B0 D, B1 D, B4 C, A2 S, A3 S, A4 D, C0 D, C5 S")
    assert sent(events) == [0, 1, 2, 3, 4, 5] and not gaps(events)


def test_gap_on_all_topics():
    core = Sequencer(**ORDERED)
    events = run(core, "A0 S, A1 S, A5 C, B0 D, B1 D, B5 C, C0 D, C1 D, C5 S, B5 D, C5 D, B6 S, A6 D, C6 D")
    assert sent(events) == [0, 1, 5, 6] and gaps(events) == [(2, 4)]


def test_timeout():
    core = Sequencer(**ORDERED)
    run(core, "A0 S, A1 S, A5 C, B0 D, B1 D, B5 C, B5 C")
    assert core.deadline() == 1001
    assert core.tick(1000) == []
    assert core.tick(1001) == [Gap(2, 4), Sent(5, "A5")]
    assert core.deadline() is None
    run(core, "A5 D, A6 S", 1200)


def test_second_gap_after_a_filled_one_times_out():
    core = Sequencer(2, False, 1000)
    run(core, "A0 S, A2 C, B1 S, A2 D, A3 S, A9 C, B9 C")
    assert core.tick(1001) == [Gap(4, 8), Sent(9, "A9")]


def test_partly_filled_gap_times_out():
    core = Sequencer(2, False, 1000)
    run(core, "A0 S, A5 C, B1 S")
    assert core.tick(1001) == [Gap(2, 4), Sent(5, "A5")]


@pytest.mark.parametrize("text", ["A0 S, A10 C, B8 C, C8 S", "A0 S, B8 C, A10 C, C8 S"])
def test_release_does_not_depend_on_the_order_of_topics(text):
    events = run(Sequencer(**ORDERED), text)
    assert sent(events) == [0, 8] and gaps(events) == [(1, 7)]


def test_records_of_several_sequences():
    core = Sequencer(2, True, None)
    events = [e for topic, seq in ((0, 0), (0, 8), (1, 8), (0, 12)) for e in core.offer(topic, seq, None, 0, 4)[1]]
    assert sent(events) == [0, 8, 12] and gaps(events) == [(4, 7)]
    core = Sequencer(1, False, 10)
    events = [e for seq, n in ((0, 3), (2, 4), (3, 1), (5, 1)) for e in core.offer(0, seq, None, 0, n)[1]] + core.tick(11)
    assert sent(events) == [0, 3, 5] and gaps(events) == [(4, 4)]


def test_unsigned_sequences():
    core = Sequencer(1)
    for seq in ((1 << 63) - 1, 1 << 63, (1 << 63) + 1):
        assert core.offer(0, seq, None, 0)[0] == "SEND"
    core = Sequencer(1, timeout_ms=1)
    core.offer(0, MAX_UNSIGNED - 1, None, 0)
    assert core.offer(0, MAX_UNSIGNED, None, 0)[0] == "SEND"
    assert core.offer(0, 0, None, 0)[0] == "DROP"


def test_reverse_order_is_emitted_in_order():
    core = Sequencer(3, False, None)
    events = []
    for seq in (100, 101, *range(109, 101, -1)):
        for topic in range(3):
            events += core.offer(topic, seq, None, 0)[1]
    assert sent(events) == list(range(100, 110)) and not gaps(events)


def test_two_of_three_topics_wait_for_the_timeout():
    core = Sequencer(3, True, 5000)
    events = [e for seq in (100, 101, 105) for topic in (0, 1) for e in core.offer(topic, seq, None, 0)[1]]
    assert sent(events) == [100, 101]
    assert core.finished(2, 1) == [Gap(102, 104), Sent(105, None)]


def test_restart_continues():
    core = Sequencer(1, next=10003)
    assert run(core, "A10001 D, A10002 D, A10003 S, A10004 S, A10005 S")


def test_producers():
    own = Producers(lambda: Sequencer(2))
    out = []
    for producer, seq, verdict in [("P1", 10000, "SEND"), ("P2", 100, "SEND"), ("P1", 10001, "SEND"), ("P2", 101, "SEND"), ("P2", 101, "DROP"), ("P2", 102, "SEND"), ("P1", 10002, "SEND"), ("P1", 10003, "SEND"), ("P1", 10005, "CACHE"), ("P2", 103, "SEND"), ("P1", 10004, "SEND")]:
        got, events = own.offer(producer, 0, seq, producer, 0)
        assert got == verdict
        out += events
    assert sent(out)[-2:] == [10004, 10005]


def test_silent_producers_expire():
    own = Producers(lambda: Sequencer(2), expire_ms=1000)
    assert [own.offer("P1", 0, s, None, 0)[0] for s in (100, 101)] == ["SEND", "SEND"]
    assert own.offer("P2", 0, 10000, None, 1001)[0] == "SEND"
    assert [own.offer("P1", 0, s, None, 1001)[0] for s in (100, 101)] == ["SEND", "SEND"]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3), st.booleans(), st.integers(0, 10_000))
def test_any_interleaving_gives_the_closed_form(topics, ordered, seed):
    chance = random.Random(seed)
    n = chance.randint(1, 30)
    heard = [[s for s in range(n) if chance.random() < 0.7] for _ in range(topics)]
    for own in heard:
        if not ordered:
            own += [s for s in own if chance.random() < 0.2]
            chance.shuffle(own)
    core, events, first = Sequencer(topics, ordered, None), [], None
    streams = [list(x) for x in heard]
    while any(streams):
        topic = chance.choice([k for k, s in enumerate(streams) if s])
        seq = streams[topic].pop(0)
        first = seq if first is None else first
        events += core.offer(topic, seq, seq, 0)[1]
    core.ordered = True
    for topic in range(topics):
        events += core.finished(topic, 0)
    want = sorted({s for own in heard for s in own if first is not None and s >= first})
    assert sent(events) == want
    assert gaps(events) == [(a + 1, b - 1) for a, b in zip(want, want[1:], strict=False) if b > a + 1]
