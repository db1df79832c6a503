"""Repair of the structure of conversations by weighted finite-state composition.

Three machines are composed: the acceptor of a conversation's rows, the transducer of edits
(keep, change the role, delete, insert) and the acceptor of the role grammar, an optional system
turn, then pairs of user and assistant. A state of the composition is a position and a state of
the grammar; only those that paths reach are made, and what a row does to the weights of all
grammar states is remembered by its symbol. Weights are pairs of cost and label string, compared
in that order; positions, and the number of insertions ahead within one, are the topological
order of the shortest path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import needed, small_batches

#: (state, initial of a role) -> state. 0 is the start, 1 after system, 2 after user, 3 after assistant.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
STATES = range(4)
ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua?"
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Bits of a row's symbol: two for its role's initial, then blank, cut off, and duplicate.
BLANK, TRUNCATED, DUPLICATE = 4, 8, 16

BLANK_RE, ENDED_RE = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
PLAN_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURN_SCHEMA = "conv_id long, position long, edit string, role string, text string"


def _consuming(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """The arcs of the composition that read a row: label, cost, next state of the grammar."""
    yield "D", DELETE, state
    if symbol & (BLANK | DUPLICATE):
        return
    late = CUT_OFF if symbol & TRUNCATED else 0
    if (state, INITIALS[symbol & 3]) in GRAMMAR:
        yield "K", late, GRAMMAR[state, INITIALS[symbol & 3]]
    for role in ROLES:
        if (state, role) in GRAMMAR:
            yield "R", REROLE + late, GRAMMAR[state, role]


def _settled(base: list[tuple]) -> tuple[int, tuple, tuple]:
    """Best weights at one position from those of paths that don't insert first: the least cost,
    each state's cost above it with the rank of its label string, and each state's labels up to
    and including the next row, with the state after it. More than two insertions in a row come
    back to a state for a cost, so no best path has them."""
    best = base
    for _ in range(2):
        ahead = best
        best = [min([base[q], *((INSERT + ahead[t][0], ("I", ahead[t][1]), "I" + ahead[t][2], ahead[t][3]) for r in ROLES if (t := GRAMMAR.get((q, r))) is not None)]) for q in STATES]
    least = min(x[0] for x in best)
    rank = {key: k for k, key in enumerate(sorted({x[1] for x in best}))}
    return least, tuple((x[0] - least, rank[x[1]]) for x in best), tuple((x[2], x[3]) for x in best)


END = _settled([(0, (), "", q) if q in FINAL else (1 << 40, ("~",), "", q) for q in STATES])


@lru_cache(maxsize=100_000)
def _before(symbol: int, after: tuple) -> tuple[int, tuple, tuple]:
    """As :func:`_settled`, for the position before a row, from the weights after it."""
    return _settled([min((cost + after[t][0], (label, after[t][1]), label, t) for label, cost, t in _consuming(symbol, q)) for q in STATES])


def shortest_repair(symbols: bytes) -> tuple[int, str]:
    """The least cost of edits after which the roles fit the grammar, and of all edits of that
    cost the labels (D, I, K, R, in order) that come first in ASCII order."""
    total, weights, last = END
    steps = []
    for symbol in reversed(symbols):
        least, weights, moves = _before(symbol, weights)
        total += least
        steps.append(moves)
    state, audit = 0, []
    for moves in reversed(steps):
        labels, state = moves[state]
        audit.append(labels)
    audit.append(last[state][0])
    return total + weights[0][0], "".join(audit)


def tie_of(role: Column | str, text: Column | str) -> Column:
    """A digest of role and text: equal for equal rows only."""
    role, text = (F.col(c) if isinstance(c, str) else c for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn (long), role, text and ``tie``, by which rows of one turn are put in order.
    Null roles and texts become one space."""
    rows = needed(conversations, "conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumn("tie", tie_of("role", "text"))


def _symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, tie and ``symbol``, without the texts. A row is a duplicate if an equal one
    stands before it; those that equal the row right before them in order are left to the pass
    over the ordered rows."""
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = F.col("text").rlike(BLANK_RE)
    symbol = symbol + F.when(~blank, BLANK).when(~F.col("text").rlike(ENDED_RE), TRUNCATED).otherwise(0)
    slim = rows.select("conv_id", "turn", "tie", tie_of("role", "text").alias("same"), symbol.cast("int").alias("symbol"))
    at = F.struct("turn", "tie")
    firsts = slim.groupBy("conv_id", "same").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last")
    firsts = firsts.select(F.col("conv_id").alias("__conv"), F.col("same").alias("__same"), "first")
    joined = slim.join(firsts, slim["conv_id"].eqNullSafe(firsts["__conv"]) & (slim["same"] == firsts["__same"]), "left")
    again = F.coalesce(at > F.col("first"), F.lit(False))
    return joined.select("conv_id", "turn", "tie", (F.col("symbol") + F.when(again, DUPLICATE).otherwise(0)).alias("symbol"))


class _Seen:
    """What the pass over a conversation's ordered rows gathers: a byte a row, and counts."""

    def __init__(self, conv: int | None):
        self.conv, self.symbols = conv, bytearray()
        self.last = self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, tie: bytes, symbol: int) -> None:
        if self.last == (turn, tie):
            symbol |= DUPLICATE
        if turn is not None and (self.high is None or turn != self.high):
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last = turn, tie
        if symbol & BLANK:
            self.blank += 1
        elif symbol & DUPLICATE:
            self.duplicate += 1
        elif symbol & TRUNCATED:
            self.truncated += 1
        if self.symbols and INITIALS[self.symbols[-1] & 3] + INITIALS[symbol & 3] not in ("su", "ua", "au"):
            self.illegal += 1
        self.symbols.append(symbol)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *shortest_repair(bytes(self.symbols))


PLAN_FIELDS = pa.schema([("conv_id", pa.int64()), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
TURN_FIELDS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation's rows in one partition and in order, to be read as a stream."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "tie")


def plan_repairs(rows: DataFrame) -> DataFrame:
    """For each conversation of ``rows`` (as :func:`rows_of` gives them) its faults and the
    cheapest repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows count by turn, nulls first, and within a turn by ``tie``. Of a row's faults the first
    counts: blank, duplicate of an earlier row, cut off. ``gaps``: turns that are missing between
    the least and the greatest, nulls left out. ``illegal``: neighbours whose roles' initials
    aren't su, ua or au. A role of any other initial, an empty one too, can't be kept.

    The texts aren't shuffled here, and a conversation of any length is read as a stream that
    keeps some ten bytes a row, of the order of its audit. A null conv_id is one conversation.
    Repeated rows are duplicates. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, out = None, []
        for batch in batches:
            for conv, turn, tie, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen is None or seen.conv != conv:
                    if seen is not None:
                        out.append(seen.result())
                    seen = _Seen(conv)
                seen.add(turn, tie, symbol)
            if out:
                yield _batch(out, PLAN_FIELDS)
                out = []
        if seen is not None:
            yield _batch([seen.result()], PLAN_FIELDS)

    return _ordered(_symbols(rows)).mapInArrow(run, PLAN_SCHEMA)


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role and text, each
    conversation in order in one partition. ``plans``: the audits, from :func:`plan_repairs`."""
    small_batches(rows.sparkSession)
    planned = plans.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("tie"), F.lit(None).cast("string").alias("role"), "audit", F.lit(0).alias("kind"))
    texts = rows.select("conv_id", "turn", "tie", "role", F.col("text").alias("audit"), F.lit(1).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = audit = None
        at = state = position = 0
        for batch in batches:
            out = []

            def put(edit: str, role: str, text: str) -> None:
                nonlocal state, position
                state = GRAMMAR[state, role[0]]
                out.append((conv, position, edit, role, text))
                position += 1

            def inserted() -> None:
                nonlocal at
                while audit[at : at + 1] == "I":
                    put("I", ROLES["a" if state == 2 else "u"], "")
                    at += 1

            for own, _, _, role, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    conv, audit, at, state, position = own, text, 0, 0, 0
                    inserted()
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(edit, role, text)
                elif edit == "R":
                    put(edit, ROLES["a" if state == 2 else "u"], text)
                inserted()
            if out:
                yield _batch(out, TURN_FIELDS)

    return _ordered(planned.unionByName(texts), "kind").mapInArrow(run, TURN_SCHEMA)


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of ``role:text`` of all its turns, a line feed between, from
    :func:`repaired_turns` as it is, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        digest, conv = None, None
        for batch in batches:
            out = []
            for own, position, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if position == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    digest, conv = hashlib.sha256(), own
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if out:
                yield _batch(out, fields)
        if digest is not None:
            yield _batch([(conv, digest.hexdigest())], fields)

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as :func:`rows_of` gives them, some of them damaged by a hash of conv_id and turn (nulls:
    one space): of 20 remainders 0 drops a row, 1 empties its text, 2 takes its full stops and
    other ends, 3 repeats it, 4 makes its role user."""
    rows = rows_of(conversations)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.crc32(name) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter(hit != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), "tie", copies.alias("__copy")).drop("__copy")
