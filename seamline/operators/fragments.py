"""Messages that a bus sends in fragments, put together again.

A fragment has its session, a position, the length it takes there, and marks of the first and the
last fragment of a message. The next fragment of a message stands where the last one ends; if
it doesn't, one was lost, and with it the message. Rows are worked on in ranges of positions, so
a session's rows aren't put into one task; only the fragments of a whole message meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .ordered import previous, running

SESSION = ("session",)


def chained(fragments: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Fragments (keys, position, length, begin, end, payload) with ``chain``, the position at which their
    message begins, or at which what is left of a broken one begins. A fragment that comes
    twice counts once; null marks are false. Rows without a position are left out."""
    keys = list(keys)
    rows = fragments.filter("position is not null").withColumns({m: F.coalesce(m, F.lit(False)) for m in ("begin", "end")}).dropDuplicates([*keys, "position"])
    rows = previous(rows, keys, "position", F.struct((F.col("position") + F.col("length")).alias("past"), "end"), "__before")
    goes_on = ~F.col("begin") & (F.col("__before.past") == F.col("position")) & ~F.col("__before.end")
    head = F.when(~F.coalesce(goes_on, F.lit(False)), F.col("position"))
    return running(rows, keys, "position", head, "chain").drop("__before")


def _chains(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "chain").agg(F.bool_or("begin").alias("begun"), F.bool_or("end").alias("ended"), F.count("*").alias("fragments"), F.max(F.col("position") + F.col("length")).alias("past"))


def _whole(rows: DataFrame, keys: list[str], chains: DataFrame) -> DataFrame:
    renamed = chains.select(*[F.col(k).alias(f"__{k}") for k in [*keys, "chain"]])
    same = F.lit(True)
    for k in [*keys, "chain"]:
        same = same & rows[k].eqNullSafe(renamed[f"__{k}"])
    return rows.join(renamed, same, "left_semi")


def assembled(fragments: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Whole messages: keys, position, fragments (how many) and payload. Only fragments of messages
    that are whole are gathered, so a group is never larger than a message."""
    keys = list(keys)
    rows = chained(fragments, keys)
    whole = _chains(rows, keys).filter("begun and ended")
    parts = _whole(rows, keys, whole).groupBy(*keys, "chain").agg(F.sort_array(F.collect_list(F.struct("position", F.coalesce("payload", F.lit(b"")).alias("payload")))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), ""))
    return parts.select(*keys, F.col("chain").alias("position"), F.size("parts").cast("bigint").alias("fragments"), joined.alias("payload"))


def lost_fragments(fragments: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """What is left of messages that aren't whole: keys, position, past, fragments, and ``lost``, which
    is ``begin`` (the first part is missing), ``end`` or ``both``."""
    keys = list(keys)
    broken = _chains(chained(fragments, keys), keys).filter("not (begun and ended)")
    lost = F.when(~F.col("begun") & ~F.col("ended"), "both").when(F.col("begun"), "end").otherwise("begin")
    return broken.select(*keys, F.col("chain").alias("position"), "past", "fragments", lost.alias("lost"))


class FragmentProcessor(StatefulProcessor):
    """The same for a stream, by session: the message that is being put together is in the state, a
    fragment a row. Within a micro-batch fragments count by position."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "chain bigint, begun boolean, past bigint, fragments bigint")
        self.parts = handle.getMapState("parts", "position bigint", "payload binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values("position", kind="stable")
        at, done = self.open.get() if self.open.exists() else None, None
        if at is not None:
            at, done = (None, at[2]) if at[0] is None else (at, None)
        fresh: dict[int, bytes] = {}
        out: list[tuple] = []

        def close(ended: bool) -> None:
            nonlocal at, done
            chain, begun, past, n = at
            held = {} if not self.parts.exists() else {k[0]: v[0] for k, v in self.parts.iterator()}
            if begun and ended:
                payloads = held | fresh
                out.append(("message", chain, past, n, b"".join(bytes(payloads[k]) for k in sorted(payloads)), None))
            else:
                out.append(("lost", chain, past, n, None, "both" if not begun and not ended else "end" if begun else "begin"))
            if held:
                self.parts.clear()
            fresh.clear()
            at, done = None, past

        for position, length, begin, end, payload in zip(*(batch[c].tolist() for c in ("position", "length", "begin", "end", "payload")), strict=True):
            behind = done if at is None else at[2]
            if behind is not None and position < behind:
                continue  # a copy
            if at is not None and (begin or position != at[2]):
                close(False)
            at = (position, bool(begin), position + length, 1) if at is None else (at[0], at[1], position + length, at[3] + 1)
            if at[1]:  # of a message without its beginning nothing has to be kept
                fresh[position] = payload or b""
            if end:
                close(True)
        for position, payload in fresh.items():
            self.parts.updateValue((position,), (payload,))
        if at is not None or done is not None:
            self.open.update(at if at is not None else (None, None, done, None))
        if out:
            columns = dict(zip(("kind", "position", "past", "fragments", "payload", "lost"), map(list, zip(*out, strict=True)), strict=True))
            yield pd.DataFrame({k: [v] * len(out) for k, v in zip(self.keys, key, strict=True)} | columns)

    def close(self) -> None:
        pass


def stream_assembled(fragments: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """A stream of fragments as rows of kind ``message`` or ``lost``: keys, kind, position, past, fragments,
    payload, lost. Each session's positions ascend from one micro-batch to the next; a copy of what has
    been read is left out. Needs the RocksDB provider."""
    keys = list(keys)
    marks = {m: F.coalesce(m, F.lit(False)) for m in ("begin", "end")}
    rows = fragments.filter("position is not null").withColumns(marks).select(*keys, "position", "length", "begin", "end", "payload")
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", kind string, position bigint, past bigint, fragments bigint, payload binary, lost string"
    return rows.groupBy(*keys).transformWithStateInPandas(FragmentProcessor(keys), outputStructType=schema, outputMode="Append", timeMode="None")
