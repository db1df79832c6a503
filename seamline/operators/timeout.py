"""Gaps that are given up after a timeout: batch form of the streaming decisions, from arrival times.

A sequence can be skipped only if one above it came more than the timeout before it; all others
are safe. Between two safe neighbours lies at most one hole. When the stream has reached a hole at
time E, and the safe record above it came at h, the hole is given up at max(E, h) + timeout + 1,
unless late records of its own come before that. Without such records the times of all holes
follow from a running maximum, and from it the time at which each range of holes is entered. Ranges
are then worked out apart from each other, with their late records; a range whose entry turns
out to be another is worked out again, until none is. No fold runs over a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import unsigned_key
from ..staging import staged
from ..streaming.core import Gap, Sequencer
from .dedup import ARRIVAL, KEYS, start_sequences
from .ordered import numbered, previous, running

RANGE_BITS = 12
HOLE = "from_at bigint, to_at bigint, given_up bigint"


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in names:
        condition = condition & left[k].eqNullSafe(right[f"__{k}"])
    return condition


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """An equality join in which null keys are equal; the right side's other columns are new."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in names], *[c for c in right.columns if c not in names])
    return left.join(renamed, _same(left, renamed, names), how).drop(*[f"__{k}" for k in names])


def _fold(first: int, last: int, reached: int, above: int, late: list[tuple[int, int]], timeout: int) -> tuple[list[tuple[int, int, int]], int]:
    """What becomes of one hole, ``first`` to ``last``, that is reached at ``reached``, with ``late``
    records (sequence, time): the parts given up, and when; and when the stream is past it."""
    core = Sequencer(1, False, timeout, next=0)
    events = [(max(reached, t), at - first) for at, t in late]
    events.append((max(reached, above), last + 1 - first))
    out: list[tuple[int, int, int]] = []
    passed = reached

    def take(found: list, now: int) -> None:
        nonlocal passed
        for x in found:
            if isinstance(x, Gap):
                out.append((x.from_seq + first, x.to_seq + first, now))
        if core.next > last - first:
            passed = now

    for time, seq in sorted(events):
        while core.next <= last - first and (due := core.deadline()) is not None and due <= time:
            take(core.tick(due), due)
        if core.next > last - first:
            break
        take(core.offer(0, seq, None, time)[1], time)
    while core.next <= last - first:
        due = core.deadline()
        take(core.tick(due), due)
    return out, passed


def _fold_range(holes: pd.DataFrame, late: pd.DataFrame, timeout: int) -> tuple[list[tuple[int, int, int]], int]:
    """The parts of a range of holes that are given up, and when the stream is past the last of them."""
    own: dict[int, list[tuple[int, int]]] = {}
    for above, at, time in zip(late["above"].tolist(), late["at"].tolist(), late["time"].tolist(), strict=True):
        own.setdefault(above, []).append((at, time))
    holes = holes.sort_values("number")
    entry, out = holes["entry"].tolist()[0], []
    for first, last, above, time, passed in zip(*(holes[c].tolist() for c in ("from_at", "to_at", "above", "above_time", "__passed")), strict=True):
        reached = max(entry, passed)
        given_up, records = max(reached, time) + timeout + 1, own.get(above, [])
        if any(t < given_up for _, t in records):
            parts, entry = _fold(first, last, reached, time, records, timeout)
            out += parts
        else:
            out.append((first, last, given_up))
            entry = given_up
    return out, entry


def timeout_holes(records: DataFrame, timeout_ms: int, *, keys: Sequence[str] = KEYS, arrival: Sequence[str] = ARRIVAL, time: str = "arrival", range_bits: int = RANGE_BITS, stage: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The parts of holes that are given up, and the first copies of all sequences.

    ``time``: a column of epoch milliseconds, the first of ``arrival``. A record that comes at the very
    moment at which a hole is given up comes after that. ``range_bits``: a range is 2 to the power of
    so many holes; it changes the number of tasks and rounds, never the result. ``stage`` writes a table and gives it
    back, so that rounds don't repeat each other's work (by default to the shared folder).
    Returns ``keys, from_at, to_at, given_up`` (sequences in signed order) and ``keys, at, time``.
    """
    keys = list(keys)
    stage = stage or staged
    start = start_sequences(records.filter("seq is not null"), keys, arrival)
    rows = _joined(records.filter("seq is not null").select(*keys, "seq", F.col(time).alias("__time")), start, keys)
    rows = rows.withColumn("at", unsigned_key("seq")).filter(F.col("at") >= unsigned_key("start_seq"))
    firsts = rows.groupBy(*keys, "at").agg(F.min("__time").alias("time"))
    # the earliest of all above, by a running minimum from the top
    judged = running(firsts.withColumn("__down", F.bitwise_not("at")), keys, "__down", F.col("time"), "__above", kind="min", inclusive=False)
    judged = judged.withColumn("late", F.coalesce(F.col("time") > F.col("__above") + timeout_ms, F.lit(False)))
    judged = running(judged, keys, "__down", F.when(~F.col("late"), F.col("at")), "above", kind="min", inclusive=False)
    judged = stage(judged.select(*keys, "at", "time", "late", "above"))
    safe = judged.filter("not late").select(*keys, "at", "time")
    safe = previous(safe, keys, "at", F.col("at"), "__before")
    safe = running(safe, keys, "at", F.col("time"), "__passed", inclusive=False)
    holes = safe.filter(F.col("at") > F.col("__before") + 1).select(*keys, (F.col("__before") + 1).alias("from_at"), (F.col("at") - 1).alias("to_at"), F.col("at").alias("above"), F.col("time").alias("above_time"), "__passed")
    holes = numbered(holes, keys, "from_at", "number").withColumn("range", F.shiftright("number", range_bits))
    # the time at which each hole is passed, if none has late records that count
    wait = timeout_ms + 1
    holes = running(holes, keys, "number", F.greatest("__passed", "above_time") + wait - F.col("number") * wait, "__line")
    holes = previous(holes, keys, "number", F.col("__line") + F.col("number") * wait, "__earlier")
    holes = stage(holes.withColumn("__earlier", F.coalesce("__earlier", "__passed")).drop("__line"))
    late = _joined(judged.filter("late").select(*keys, "above", "at", "time"), holes.select(*keys, "above", "range"), [*keys, "above"])
    late, ranged = stage(late), [*keys, "range"]
    entries = holes.groupBy(*ranged).agg(F.min_by("__earlier", "number").alias("entry"))
    types = dict(holes.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in ranged) + f", entry bigint, {HOLE}"

    def fold(holes: pd.DataFrame, late: pd.DataFrame) -> pd.DataFrame:
        if not len(holes):
            return pd.DataFrame(columns=[*ranged, "entry", "from_at", "to_at", "given_up"])
        parts, exit = _fold_range(holes, late, timeout_ms)
        found = pd.DataFrame([*parts, (0, -1, exit)], columns=["from_at", "to_at", "given_up"])  # the last row: when the range is passed
        return pd.DataFrame({k: [holes[k].iloc[0]] * len(found) for k in [*ranged, "entry"]}).join(found)

    done = None
    while True:
        due = _joined(holes, entries, ranged)
        some = late if done is None else _joined(late, entries.select(*ranged), ranged, "left_semi")
        parts = due.groupBy(*ranged).cogroup(some.groupBy(*ranged)).applyInPandas(fold, schema)
        done = stage(parts if done is None else _joined(done, entries.select(*ranged), ranged, "left_anti").unionByName(parts))
        marks = done.filter("to_at < from_at")
        after = marks.select(*keys, (F.col("range") + 1).alias("range"), F.col("given_up").alias("now"))
        entries = stage(_joined(marks.select(*ranged, "entry"), after, ranged).filter("entry <> now").select(*ranged, F.col("now").alias("entry")))
        if entries.isEmpty():
            break
    return done.filter("to_at >= from_at").select(*keys, "from_at", "to_at", "given_up"), judged.select(*keys, "at", "time")


def gap_timeouts(records: DataFrame, timeout_ms: int, **given) -> DataFrame:
    """Sequences that are given up when nothing has moved for longer than the timeout: keys, from_seq,
    to_seq, ``given_up`` (the time), and ``late``: how many copies of these came too late. Null
    sequences are left out; an empty table has none. Arguments as in :func:`timeout_holes`."""
    keys, time = list(given.get("keys", KEYS)), given.get("time", "arrival")
    holes, _ = timeout_holes(records, timeout_ms, **given)
    copies = skipped_copies(records, holes, keys, time)
    counts = copies.groupBy(*keys, "from_at").agg(F.count("*").alias("late"))
    found = _joined(holes, counts, [*keys, "from_at"], "left")
    return found.select(*keys, unsigned_key("from_at").alias("from_seq"), unsigned_key("to_at").alias("to_seq"), "given_up", F.coalesce("late", F.lit(0)).cast("bigint").alias("late"))


def skipped_copies(records: DataFrame, holes: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """The records whose sequence lies in a hole, with ``from_at`` of it: holes are marked in the order
    of sequences, and the running last one reaches over a record or doesn't."""
    keys = list(keys)
    present = records.filter("seq is not null").withColumn("at", unsigned_key("seq"))
    places = present.select(*keys, "at").distinct().withColumn("hole", F.lit(None).cast("struct<from_at:bigint,to_at:bigint>"))
    marks = holes.select(*keys, F.col("from_at").alias("at"), F.struct("from_at", "to_at").alias("hole"))
    both = places.unionByName(marks).groupBy(*keys, "at").agg(F.max("hole").alias("hole"))
    both = running(both, keys, "at", F.col("hole"), "last").filter(F.col("last.to_at") >= F.col("at")).select(*keys, "at", F.col("last.from_at").alias("from_at"))
    return _joined(present, both, [*keys, "at"]).drop("at")


def timeout_dedup(records: DataFrame, timeout_ms: int, **given) -> DataFrame:
    """As :func:`~seamline.operators.dedup.sequenced_dedup`, without the records of sequences that had
    been given up before they came."""
    from .dedup import sequenced_dedup

    keys = list(given.get("keys", KEYS))
    sent = (given.get("stage") or staged)(sequenced_dedup(records, keys=keys, arrival=given.get("arrival", ARRIVAL)))  # read three times
    holes, _ = timeout_holes(records, timeout_ms, **given)
    gone = skipped_copies(sent, holes, keys, given.get("time", "arrival")).select(*keys, "seq").distinct()
    return _joined(sent, gone, [*keys, "seq"], "left_anti")
