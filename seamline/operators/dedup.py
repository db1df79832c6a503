"""Merging redundant captures of a stream into one ordered, duplicate-free stream: batch forms.

Input rows carry a partition, an unsigned ``seq``, an arrival order and a topic index; a
producer key is one more grouping column. All forms are DataFrame expressions, and none puts
the rows of a partition into one task: copies of a sequence meet by (partition, seq), and what
needs the order of sequences works in ranges of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import unsigned_key
from ..staging import discard, staged
from .ordered import previous, running

KEYS = ("partition",)
ARRIVAL = ("arrival", "topic_idx", "offset")


def union_topics(topics: Sequence[DataFrame]) -> DataFrame:
    """All captures in one table, each row tagged with its topic's place in the list."""
    if not topics:
        raise ValueError("no topics")
    out = topics[0].withColumn("topic_idx", F.lit(0))
    for k, topic in enumerate(topics[1:], 1):
        out = out.unionByName(topic.withColumn("topic_idx", F.lit(k)))
    return out


def start_sequences(records: DataFrame, keys: Sequence[str] = KEYS, arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """The first sequence to arrive for each key: the columns of the keys, and ``start_seq``."""
    return records.groupBy(*keys).agg(F.min_by("seq", F.struct(*arrival)).alias("start_seq"))


def _with_start(records: DataFrame, keys: Sequence[str], arrival: Sequence[str], start: str | DataFrame) -> DataFrame:
    if isinstance(start, str):
        if start == "lowest":
            return records.withColumn("start_seq", F.lit(None).cast("bigint"))
        if start != "first_arrival":
            raise ValueError(f"start is 'first_arrival', 'lowest' or a table, not {start!r}")
        start = start_sequences(records, keys, arrival)
    named = start.select(*[F.col(k).alias(f"__{k}") for k in keys], "start_seq")
    condition = F.lit(True)
    for k in keys:
        condition = condition & records[k].eqNullSafe(named[f"__{k}"])
    return records.join(named, condition, "left").drop(*[f"__{k}" for k in keys])


def verdicts(records: DataFrame, *, keys: Sequence[str] = KEYS, arrival: Sequence[str] = ARRIVAL, start: str | DataFrame = "first_arrival") -> DataFrame:
    """Every record with its ``verdict``: SEND for the first copy of a sequence, DROP for later
    copies and for sequences below the key's start.

    ``start``: ``first_arrival`` (the sequence that arrives first opens a key), ``lowest`` (no
    lower bound) or a table of the keys and ``start_seq`` (from recovery; keys that it lacks
    have no bound). A null seq is dropped; an empty table gives no rows.
    """
    rows = _with_start(records, keys, arrival, start)
    copies = Window.partitionBy(*keys, "seq").orderBy(*arrival)
    below = unsigned_key("seq") < unsigned_key("start_seq")
    sent = (F.row_number().over(copies) == 1) & F.col("seq").isNotNull() & ~F.coalesce(below, F.lit(False))
    return rows.withColumn("verdict", F.when(sent, "SEND").otherwise("DROP")).drop("start_seq")


def sequenced_dedup(records: DataFrame, *, keys: Sequence[str] = KEYS, arrival: Sequence[str] = ARRIVAL, start: str | DataFrame = "first_arrival") -> DataFrame:
    """The records to send: the first copy of each sequence, from the start on. Arguments as in
    :func:`verdicts`."""
    rows = _with_start(records.filter("seq is not null"), keys, arrival, start)
    rows = rows.filter(F.coalesce(unsigned_key("seq") >= unsigned_key("start_seq"), F.lit(True))).drop("start_seq")
    copies = Window.partitionBy(*keys, "seq").orderBy(*arrival)
    return rows.withColumn("__copy", F.row_number().over(copies)).filter("__copy = 1").drop("__copy")


def outbound_order(sent: DataFrame, *, keys: Sequence[str] = KEYS, partitions: int | None = None, ranged: bool = False) -> DataFrame:
    """Sent records by ascending unsigned sequence within each key. As a sink that keeps order within
    partitions needs them, each key's rows are in one partition; with ``ranged`` they are in as many
    consecutive ones as their number takes, for a sink that puts the work of tasks in the tasks'
    order, as the log does when it commits."""
    columns = [*[F.col(k) for k in keys], unsigned_key("seq")]
    if ranged:
        dealt = sent.repartitionByRange(partitions, *columns) if partitions else sent.repartitionByRange(*columns)
    else:
        dealt = sent.repartition(partitions, *columns[:-1]) if partitions else sent.repartition(*columns[:-1])
    return dealt.sortWithinPartitions(*columns)


def gaps(sent: DataFrame, *, keys: Sequence[str] = KEYS, count: Column | None = None) -> DataFrame:
    """Sequences that no capture has: for each hole between consecutive sent records the keys,
    ``from_seq`` and ``to_seq``, both inclusive. ``count``: sequences in a record, 1 if absent.

    ``sent`` has each sequence once. Holes before a key's first or after its last record can't
    be seen; an empty table has none.
    """
    end = F.try_add(unsigned_key("seq"), count if count is not None else F.lit(1))
    rows = sent.select(*keys, unsigned_key("seq").alias("__at"), end.alias("__end"))
    rows = previous(rows, list(keys), "__at", F.col("__end"), "__from")
    return rows.filter("__at > __from").select(*keys, unsigned_key("__from").alias("from_seq"), unsigned_key(F.col("__at") - 1).alias("to_seq"))


def gap_agreement(found: DataFrame, records: DataFrame, topics: int, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gaps with the number of topics that hold the next sequence after it (``topics_at_next``),
    of topics that have got as far (``topics_past``), and whether all have (``agreed``): then,
    if captures are ordered, the gap can be skipped without waiting."""
    marks = records.groupBy(*keys, "topic_idx").agg(F.max(unsigned_key("seq")).alias("__mark")).groupBy(*keys).agg(F.collect_list("__mark").alias("__marks"))
    holders = records.groupBy(*keys, "seq").agg(F.count_distinct("topic_idx").alias("topics_at_next"))
    rows = found.withColumn("seq", unsigned_key(unsigned_key("to_seq") + 1)).join(holders, [*keys, "seq"], "left").join(marks, list(keys), "left")
    past = F.size(F.filter("__marks", lambda m: m > unsigned_key("to_seq"))).cast("bigint")
    return rows.select(*keys, "from_seq", "to_seq", F.coalesce("topics_at_next", F.lit(0)).cast("bigint").alias("topics_at_next"), past.alias("topics_past"), (past == topics).alias("agreed"))


def packet_dedup(records: DataFrame, *, keys: Sequence[str] = KEYS, arrival: Sequence[str] = ARRIVAL, count: str = "num_seq", start: str | DataFrame = "first_arrival", most_folded: int = 64) -> DataFrame:
    """As :func:`sequenced_dedup` for records that cover ``count`` sequences each: a record that
    starts before the end of the last sent one is dropped, and does not extend what is covered.

    A record that no earlier one reaches over is sent whatever came before. A stretch of at most
    ``most_folded`` records between two such ones is folded in order; in a longer one each has a pointer to the record that would be sent next after
    it, the first that starts at or after its end; those sent are what the pointers reach from the
    stretch's first record. Pointers are doubled, so that a stretch of n records takes log n rounds
    of joins, and none is gathered in one row or task. A null or non-positive count is 1.
    """
    keys = list(keys)
    own = F.when(F.col(count) > 0, F.col(count)).otherwise(1)
    first = staged(sequenced_dedup(records, keys=keys, arrival=arrival, start=start), "firsts")  # every running value reads it twice
    rows = first.withColumn("__at", unsigned_key("seq")).withColumn("__end", F.coalesce(F.try_add(F.col("__at"), own), F.lit((1 << 63) - 1)))
    rows = running(rows, keys, "__at", F.col("__end"), "__reach", inclusive=False)
    safe = F.col("__reach").isNull() | (F.col("__reach") <= F.col("__at"))
    rows = running(rows, keys, "__at", F.when(safe, F.col("__at")), "__stretch")
    packets = staged(rows.select(*keys, "__at", "__end", "__stretch"), "packets")
    sizes = packets.groupBy(*keys, "__stretch").agg(F.count("*").alias("__size")).filter("__size > 1")
    kept = packets.filter("__at = __stretch").select(*keys, "__at")
    tangled = _null_safe(packets, sizes, [*keys, "__stretch"], "inner")
    kept = kept.unionByName(_folded(tangled.filter(F.col("__size") <= most_folded), keys))
    tangled = tangled.filter(F.col("__size") > most_folded).drop("__size")
    found = [] if tangled.isEmpty() else _pointed(tangled, keys)
    for new in found:
        kept = kept.unionByName(new)
    return _null_safe(rows, kept, [*keys, "__at"], "left_semi").drop("__at", "__end", "__reach", "__stretch")


def _folded(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Those of short stretches that are sent, but for the first of each: an array for each stretch."""
    begun = F.struct(F.lit(-(1 << 63)).cast("bigint").alias("end"), F.array().cast("array<bigint>").alias("kept"))

    def step(state: Column, p: Column) -> Column:
        return F.when(p["__at"] >= state["end"], F.struct(p["__end"].alias("end"), F.concat(state["kept"], F.array(p["__at"])).alias("kept"))).otherwise(state)

    lone = packets.groupBy(*keys, "__stretch").agg(F.sort_array(F.collect_list(F.struct("__at", "__end"))).alias("__packets"))
    return lone.select(*keys, "__stretch", F.explode(F.aggregate("__packets", begun, step, lambda s: s["kept"])).alias("__at")).filter("__at <> __stretch").select(*keys, "__at")


def _pointed(tangled: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Those of long stretches that are sent, but for the first of each, by rounds of doubled pointers."""
    # the first start at or after each end, looked up among starts and ends in one order
    starts = tangled.select(*keys, F.col("__at").alias("place"), F.col("__at").alias("start"))
    places = starts.unionByName(tangled.select(*keys, F.col("__end").alias("place"), F.lit(None).cast("bigint").alias("start")))
    places = places.groupBy(*keys, "place").agg(F.max("start").alias("start")).withColumn("__down", F.bitwise_not("place"))
    places = running(places, keys, "__down", F.col("start"), "__next", kind="min").select(*keys, F.col("place").alias("__end"), "__next")
    pointers = _null_safe(tangled, places, [*keys, "__end"], "inner")
    ends = tangled.groupBy(*keys, "__stretch").agg(F.max("__at").alias("__last"))
    pointers = _null_safe(pointers, ends, [*keys, "__stretch"], "inner").filter("__next <= __last").select(*keys, "__at", F.col("__next").alias("to"))
    pointers = staged(pointers, "pointers")
    reached = staged(tangled.filter("__at = __stretch").select(*keys, "__at"), "reached")
    found = []
    while not pointers.isEmpty():
        # those that a step of the present length leads to; with them the reached part of a chain doubles
        new = staged(_null_safe(reached, pointers, [*keys, "__at"], "inner").select(*keys, F.col("to").alias("__at")), "reached")
        found.append(new)
        reached = reached.unionByName(new)
        further = pointers.select(*keys, F.col("__at").alias("to"), F.col("to").alias("beyond"))
        double = staged(_null_safe(pointers, further, [*keys, "to"], "inner").select(*keys, "__at", F.col("beyond").alias("to")), "pointers")
        discard(pointers)
        pointers = double
    return found


def _null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """An equality join in which null keys are equal."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in names], *[c for c in right.columns if c not in names])
    condition = F.lit(True)
    for k in names:
        condition = condition & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in names])


def producer_sessions(records: DataFrame, expire_ms: int, *, keys: Sequence[str] = ("partition", "producer_key"), time: str = "arrival", order: str = "offset") -> DataFrame:
    """Records with ``session``: the time at which the producer's current session began. A
    producer that is silent for more than ``expire_ms`` starts a new one, in which its sequences
    may start again; dedup then takes the session as one more key.

    ``time``: a column of epoch milliseconds. Records at one time are in one session.
    """
    keys = list(keys)
    times = records.select(*keys, F.col(time).alias("__time")).distinct()
    times = previous(times, keys, "__time", F.col("__time"), "__before")
    new = F.col("__before").isNull() | (F.col("__time") - F.col("__before") > expire_ms)
    times = running(times, keys, "__time", F.when(new, F.col("__time")), "session")
    named = times.select(*[F.col(k).alias(f"__{k}") for k in keys], "__time", "session")
    condition = records[time] == named["__time"]
    for k in keys:
        condition = condition & records[k].eqNullSafe(named[f"__{k}"])
    return records.join(named, condition, "left").drop("__time", *[f"__{k}" for k in keys])


def verdict_counts(judged: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sent and dropped records of each key."""
    return judged.groupBy(*keys).agg(F.count_if(F.col("verdict") == "SEND").alias("sent"), F.count_if(F.col("verdict") == "DROP").alias("dropped"))
