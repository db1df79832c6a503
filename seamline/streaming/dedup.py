"""The merge as a streaming query: one stateful processor by partition, with its producers inside.
State is kept by the RocksDB provider, so held records may exceed memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .core import MAX_UNSIGNED, Gap, Sent, Sequencer
from .store import NODE, NODE_KEY, RECORD_KEY, HeldStore, signed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = {"kind": "object", "seq": "Int64", "num_seq": "Int64", "from_seq": "Int64", "to_seq": "Int64", "topic_idx": "Int32", "offset": "Int64", "handled": "object", "dropped": "Int64", "held": "Int64"}
COUNTS = ("dropped", "held")
ROW_SCHEMA = "kind string, seq bigint, num_seq bigint, from_seq bigint, to_seq bigint, topic_idx int, offset bigint, handled string"
COUNT_SCHEMA = ", dropped bigint, held bigint"
NONE = -(1 << 63)  # of an offset; pandas would turn a column with nulls into floats
MOST_ROWS = 20_000  # of a frame that is handed on, and of the records that are looked at in one go


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _handled(offsets: dict[int, int]) -> str:
    return ",".join(f"{k}:{v}" for k, v in sorted(offsets.items()))


def handled_offsets(handled: Column | str) -> Column:
    """The map from topic index to offset in the column ``handled`` of the merge's rows."""
    entries = F.map_entries(F.str_to_map(F.col(handled) if isinstance(handled, str) else handled, F.lit(","), F.lit(":")))
    return F.map_from_entries(F.transform(F.filter(entries, lambda e: e["key"] != ""), lambda e: F.struct(e["key"].cast("int"), e["value"].cast("bigint"))))


def _packed(numbers: dict[int, int]) -> str:
    return _handled(numbers)


def _unpacked(text: str | None) -> dict[int, int]:
    return {int(k): int(v) for k, _, v in (x.partition(":") for x in (text or "").split(",") if x)}


#: Where a producer's stream is: unsigned numbers as text, times in epoch milliseconds.
POSITION = "next string, waiting bigint, last bigint, marks string"


class _Ahead:
    """Which records from ``begin`` on continue a stream of single sequences, and which lie beyond its
    next one, if whatever comes before a record has been sent or dropped."""

    def __init__(self, seq: np.ndarray, begin: int, next: int):
        own = seq[begin:].view(np.uint64)
        self.begin, self.before = begin, np.maximum.accumulate(np.concatenate([np.array([next - 1], np.uint64), own[:-1]]))
        step = np.where(own > self.before, own - self.before, np.uint64(0))
        self.sends, self.beyond, self.stop = step == 1, np.flatnonzero(step > 1) + begin, begin + len(own)

    def next(self, at: int) -> int:
        return int(self.before[at - self.begin]) + 1

    def end(self, at: int) -> int:
        """The first record from here on that lies beyond; no more than so many are taken at once."""
        k = int(np.searchsorted(self.beyond, at))
        return min(self.stop if k == len(self.beyond) else int(self.beyond[k]), at + MOST_ROWS)


class DedupProcessor(StatefulProcessor):
    """Sends each key's records in order, and reports gaps. ``carry``: the columns that a record
    takes along, as DDL of their types. ``producer``: the column of producers within a key, or
    None. ``sequencer`` makes the decisions: a subclass may name another.

    A micro-batch reads the positions of its producers and the head of what they hold; the rest of
    the held records stays in the state untouched. Without producers or packets, records that come while
    nothing is held are decided together, from running maxima; the sequencer decides on all others.
    Results are handed on as they come, so that not all are in memory.
    """

    sequencer: type[Sequencer] = Sequencer

    def __init__(self, keys: Sequence[str], topics: int, ordered: bool, timeout_ms: int | None, expire_ms: int | None, carry: dict[str, str], producer: str | None = None, counts: bool = False):
        self.keys, self.topics, self.ordered, self.timeout_ms, self.expire_ms, self.carry, self.producer, self.counts = list(keys), topics, ordered, timeout_ms, expire_ms, dict(carry), producer, counts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = "".join(f", c{k} {t}" for k, t in enumerate(self.carry.values()))
        # of producers that hold nothing, forgotten after their expiry; of those that hold something
        self.idle = handle.getMapState("idle", "producer string", POSITION, *([self.expire_ms] if self.expire_ms is not None else []))
        self.waiting = handle.getMapState("waiting", "producer string", POSITION)
        self.records = handle.getMapState("records", RECORD_KEY, f"num bigint, topic int, offset bigint{columns}")
        self.nodes = handle.getMapState("nodes", NODE_KEY, NODE)
        self.partition = handle.getValueState("partition", "offsets string, held bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        names = initialState[self.producer].tolist() if self.producer else [""] * len(initialState)
        for name, start in zip(names, initialState["start_seq"].tolist(), strict=True):
            if start is not None and start == start:
                self.idle.updateValue((name or "",), (str(int(start) & MAX_UNSIGNED), None, timerValues.getCurrentProcessingTimeInMs(), ""))

    def _begin(self) -> None:
        """What one call works on: positions by producer, the held records, offsets, results."""
        found = self.partition.get() if self.partition.exists() else None
        self.offsets, self.held_before = _unpacked(found[0] if found else None), found[1] if found else 0
        self.store = HeldStore(self.nodes, self.records)
        self.known: dict[str, tuple[Sequencer, int | None]] = {}
        self.out: list[tuple] = []  # a producer, the columns of OUTPUT, those of ``carry``
        self.sent, self.told = 0, False

    def _tell(self, producer: str, found: Sequence[Sent | Gap]) -> None:
        for x in found:
            if isinstance(x, Gap):
                self.out.append((producer, "gap", None, None, signed(x.from_seq), signed(x.to_seq), None, None, None, None, None, *repeat(None, len(self.carry))))
            else:
                (topic, offset, num, record), handled = x.record
                self.out.append((producer, "record", signed(x.seq), num, None, None, topic, offset, handled, None, None, *record))
                self.sent += 1

    def _stamp(self, record: tuple) -> tuple:
        """A record with the offsets up to which each topic has nothing that is only held, as they
        are when it is sent."""
        marks = {}
        for topic, offset in self.offsets.items():
            low = self.store.lowest_offset(topic)
            marks[topic] = offset if low is None else min(offset, low - 1)
        return record, _handled(marks)

    def _core(self, producer: str, now: int) -> Sequencer:
        """The sequencer of a producer; one that was silent for longer than the expiry is sent what it
        holds, and begins anew."""
        if producer not in self.known:
            at = self.waiting.getValue((producer,)) or self.idle.getValue((producer,)) or (None, None, None, "")
            core = self.sequencer(self.topics, self.ordered, self.timeout_ms, None if at[0] is None else int(at[0]), at[1], _unpacked(at[3]), self.store.of(producer), self._stamp)
            if self.expire_ms is not None and at[2] is not None and now - at[2] > self.expire_ms:
                self._tell(producer, core.give_up(now))
                core = self.sequencer(self.topics, self.ordered, self.timeout_ms, held=self.store.of(producer), stamp=self._stamp)
            self.known[producer] = core, at[2]
        return self.known[producer][0]

    def _end(self) -> None:
        self.store.flush()
        for producer, (core, last) in self.known.items():
            value = None if core.next is None else str(core.next), core.waiting_since, last, _packed(core.marks)
            here, there = (self.idle, self.waiting) if core.held.lowest() is None else (self.waiting, self.idle)
            if core.next is None and not core.marks:  # forgotten
                here.removeKey((producer,)) if here.containsKey((producer,)) else None
            else:
                here.updateValue((producer,), value)
            if there.containsKey((producer,)):
                there.removeKey((producer,))
        held = self.held_before + self.store.count
        self.partition.update((_packed(self.offsets), held))
        self.held_now = held
        if self.timeout_ms is None and self.expire_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        times = [at + limit + 1 for _, (_, since, last, _) in self.waiting.iterator() for at, limit in ((since, self.timeout_ms), (last, self.expire_ms)) if at is not None and limit is not None]
        if times:
            self.handle.registerTimer(min(times))

    def _frame(self, key: tuple) -> pd.DataFrame:
        """The results so far, which are forgotten."""
        names, *values = zip(*self.out, strict=True)
        columns = {k: [v] * len(names) for k, v in zip(self.keys, key, strict=True)}
        if self.producer:
            columns[self.producer] = pd.array(names, dtype="object")
        for (name, kind), column in zip(OUTPUT.items(), values, strict=False):
            if self.counts or name not in COUNTS:
                columns[name] = pd.array(column, dtype=kind)  # nullable types: long integers stay exact
        for name, column in zip(self.carry, values[len(OUTPUT) :], strict=True):
            columns[name] = pd.Series(column, dtype=object)
        self.out, self.told = [], True
        return pd.DataFrame(columns)

    def _result(self, key: tuple, offered: int) -> Iterator[pd.DataFrame]:
        dropped = offered - self.sent - self.store.count
        if self.counts and (self.out or self.told or dropped):
            self.out.append(("", "count", *repeat(None, 7), dropped, self.held_now, *repeat(None, len(self.carry))))
        if self.out:
            yield self._frame(key)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        self._begin()
        batch = pd.concat(list(rows), ignore_index=True)
        done, topic, offset, arrival = (batch[k].to_numpy() for k in ("done", "topic_idx", "offset", "arrival"))
        # a topic's records count in the order of its offsets, whatever their times say
        order = np.lexsort((offset, topic, done))
        arrival = arrival[order]
        new = (topic[order][1:] != topic[order][:-1]) | (done[order][1:] != done[order][:-1])
        for part in np.split(arrival, np.flatnonzero(new) + 1):
            np.maximum.accumulate(part, out=part)
        order = order[np.lexsort((offset[order], topic[order], arrival, done[order]))]
        topic, offset, seq, num = topic[order], offset[order], batch["seq"].to_numpy()[order], np.maximum(batch["num_seq"].to_numpy(), 1)[order]
        carried = [batch[c].to_numpy(dtype=object) for c in self.carry]
        producers = batch[self.producer].to_numpy(dtype=object) if self.producer else None
        offered = len(batch) - int(np.count_nonzero(done))
        del batch, arrival
        plain = offered > 0 and self.sequencer is Sequencer and not self.producer and bool((num[:offered] == 1).all())
        at, ahead = 0, None
        while at < offered:
            if len(self.out) >= MOST_ROWS:
                yield self._frame(key)
            if plain and (core := self._core("", now)).next and core.held.lowest() is None:
                if ahead is None or core.next != ahead.next(at):
                    ahead = _Ahead(seq[:offered], at, core.next)
                if (end := ahead.end(at)) > at:
                    self._run(core, now, ahead, at, end, seq, topic, offset, carried, order)
                    at = end
                    continue
            producer = producers[order[at]] or "" if self.producer else ""
            own = None if offset[at] == NONE else int(offset[at])
            t, n = int(topic[at]), int(num[at])
            if own is not None:
                self.offsets[t] = max(own, self.offsets.get(t, own))
            core = self._core(producer, now)
            self.known[producer] = core, now
            self._tell(producer, core.offer(t, int(seq[at]) & MAX_UNSIGNED, (t, own, n, tuple(c[order[at]] for c in carried)), now, n)[1])
            at += 1
        for k in range(offered, len(order)):
            # a topic that ends holds up none of the producers that still wait
            producer = producers[order[k]] or "" if self.producer else ""
            for name in [producer] if producer or not self.producer else [k[0] for k in list(self.waiting.keys())] + list(self.known):
                self._tell(name, self._core(name, now).finished(int(topic[k]), now))
        self._end()
        yield from self._result(key, offered)

    def _run(self, core: Sequencer, now: int, ahead: _Ahead, at: int, end: int, seq: np.ndarray, topic: np.ndarray, offset: np.ndarray, carried: list[np.ndarray], order: np.ndarray) -> None:
        """What :meth:`Sequencer.offer` does with each of these records, while nothing is held and none
        lies beyond the next sequence: it is sent or dropped."""
        topics, offsets = topic[at:end], offset[at:end]
        sent = np.flatnonzero(ahead.sends[at - ahead.begin : end - ahead.begin])
        known, handled = offsets != NONE, {}
        for t in sorted({*self.offsets, *np.unique(topics).tolist()}):
            own = topics == t
            if own.any():
                core.marks[t] = max(int(seq[at:end][own].view(np.uint64).max()), core.marks.get(t, -1))
            before = self.offsets.get(t, NONE)
            reached = np.maximum(np.maximum.accumulate(np.where(own & known, offsets, NONE)), before)
            if reached[-1] != NONE:
                self.offsets[t] = int(reached[-1])
                low, reached = self.store.lowest_offset(t), reached[sent]
                handled[t] = reached if low is None else np.where(reached == NONE, NONE, np.minimum(reached, low - 1))
        core.next += len(sent)
        core.waiting_since = None
        self.known[""] = core, now
        if not len(sent):
            return
        if all((reached != NONE).all() for reached in handled.values()):
            form = ",".join(f"{t}:%d" for t in handled)
            marks = [form % x for x in zip(*(reached.tolist() for reached in handled.values()), strict=True)] if handled else [""] * len(sent)
        else:
            marks = [_handled({t: v for t, v in zip(handled, x, strict=True) if v != NONE}) for x in zip(*(reached.tolist() for reached in handled.values()), strict=True)]
        where = order[at:end][sent]
        own = [None if x == NONE else x for x in offsets[sent].tolist()]
        none = repeat(None)
        self.out += zip(repeat(""), repeat("record"), seq[at:end][sent].tolist(), repeat(1), none, none, topics[sent].tolist(), own, marks, none, none, *(c[where].tolist() for c in carried))
        self.sent += len(sent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        self._begin()
        for (producer,) in list(self.waiting.keys()):
            core = self._core(producer, now)  # sends what an expired one holds
            self._tell(producer, core.tick(now))
        self._end()
        yield from self._result(key, 0)

    def close(self) -> None:
        pass


def stream_dedup(
    records: DataFrame, *, topics: int, keys: Sequence[str] = ("partition",), ordered: bool = False, timeout_ms: int | None = 10_000, expire_ms: int | None = None,
    carry: Sequence[str] = ("payload",), start: DataFrame | None = None, processor: type[DedupProcessor] = DedupProcessor, producer: str | None = None, counts: bool = False,
) -> DataFrame:
    """Merge a stream of captured records (``keys``, seq, topic_idx, offset, arrival, those in
    ``carry``, and num_seq if records cover several sequences) into rows of ``kind`` record or gap.

    A gap is skipped when all topics are past it (``ordered``) or after ``timeout_ms``. Within a
    micro-batch records count in the order of arrival, topic and offset, and those of a topic in the
    order of its offsets. A row whose boolean ``done`` is true, where there is such a column, says
    that its topic sends no more for its key (and its producer; without one, for all that wait);
    other rows with a null seq are left out (dead letters, see the sources). ``carry`` are columns
    of binary, string or array type. ``start``: keys (and producer) and ``start_seq`` from which a
    new query goes on. ``processor``: the class that decides, a user's own or the merge's.

    ``producer``: a column of logical producers within a key, each of which has sequences of its
    own; one that is silent for longer than ``expire_ms`` begins anew, and what it holds is sent
    first. ``handled`` has for each topic the highest offset below which nothing of the key is only
    held, at the moment the record is sent: a cold start from any sent record reads all the
    rest again. ``counts``: also a row of kind ``count`` for each key and micro-batch, with the
    records dropped in it and those held now.

    Needs the RocksDB provider (:func:`use_rocksdb`). With a timeout or expiry there are timers,
    and the query has to run on a processing-time trigger: with ``availableNow`` it would go on
    with empty batches. Keys run apart, so the parallelism is the number of keys; the rows of a key
    in one micro-batch are in memory at once, so limit the source.
    """
    num = F.col("num_seq") if "num_seq" in records.columns else F.lit(1)
    done = F.coalesce(F.col("done"), F.lit(False)) if "done" in records.columns else F.lit(False)

    def whole(c: Column, otherwise: int, kind: str = "bigint") -> Column:
        return F.coalesce(c.cast(kind), F.lit(otherwise).cast(kind))

    named = [producer] if producer else []
    rows = records.filter(F.col("seq").isNotNull() | done).select(
        *keys, *[F.col(c).cast("string").alias(c) for c in named], done.alias("done"), whole(F.col("seq"), 0).alias("seq"), whole(num, 1).alias("num_seq"), whole(F.col("topic_idx"), -1, "int").alias("topic_idx"),
        whole(F.col("offset"), NONE).alias("offset"), whole(F.col("arrival"), (1 << 63) - 1).alias("arrival"), *carry,
    )
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, *named]) + f", {ROW_SCHEMA}{COUNT_SCHEMA if counts else ''}, " + ", ".join(f"{k} {types[k]}" for k in carry)
    timers = timeout_ms is not None or expire_ms is not None
    own = processor(keys, topics, ordered, timeout_ms, expire_ms, {c: types[c] for c in carry}, producer, counts)
    initial = None if start is None else start.select(*keys, *named, F.col("start_seq").cast("string").alias("start_seq")).groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(own, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if timers else "None", initialState=initial)
