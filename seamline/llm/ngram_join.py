"""N-gram Jaccard self-join of documents: rare-first prefix filtering, and components.

1. *Profile.* Each text becomes the set of its distinct word shingles (64-bit hashes). Texts
   with the same set form a class; from here on only one text of each class is joined.
2. *Order.* A block of texts sends its distinct tokens (the leading bits of the hashes, some 8
   more than it takes to number all) to the tokens' shards, packed, with their counts in the block.
   A shard adds up exact document frequencies and sends those above one back to the blocks.
   What a token has in one block is one entry in its shard, so that no token makes a shard large.
3. *Prefixes.* A block sorts each text's tokens rare-first (frequency, then token). Only tokens
   that two texts have can make pairs: of the first ``n - ceil(t n) + 1``, those are the postings.
   Most texts have none.
4. *Candidates.* Of a pair the smaller text needs the token early enough for its size, and the
   larger one early enough for the smaller's size, so both are dealt by token and by the ranges of
   sizes that length and positional filter leave. In each such group some members lead, four
   times as many in each turn until all have; a turn pairs leaders with members of another
   component, and of two components at least one is not the group's largest. So a group of
   near copies is linked through its leaders, and any two texts that are not connected do meet.
   A group with a large share of all members is dealt to pieces, and its leaders go to each.
   The first turns link near copies, with some pairs a member at most. In groups that are open
   after that, of texts that share little but a token, members carry a bitmap of their set (about
   a bit a shingle): two sets differ in as many shingles at least as their bitmaps in bits, so
   the join leaves out nearly all pairs that can't be similar before any of them is written.
5. *Verification*, once for a pair: a suffix filter bounds the overlap by the counts of both
   sets in equal ranges of hashes; only what passes has its sets fetched and intersected.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import needed, scratch, staged
from ._words import U64, shingle_sets, slices

#: Tokens of a block, and of a shard on average; what one task holds at once.
BLOCK, SHARD = 1_000_000, 1_000_000
#: Ranges of hashes of the suffix filter, and pairs that are intersected at a time.
RANGES, PAIRS = 64, 256
#: Leaders of a group in the first turn, and how many times as many all turns so far have in the next.
LEADERS, MORE = 2, 4
#: Turns that have had so many leaders are over; pairs of later ones are tested by bitmaps first.
BARE = 8
#: A group with more than one in so many of all members is dealt to pieces, none above that share.
PIECES = 256
#: Nodes that a broadcast bit table of 8 bits each can hold; more are looked up by a join.
MOST_NODES = 1 << 25
#: What a Python worker does with its batches (doc_id, text).
Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
PROFILE_SCHEMA = "doc_id long, n long, key long, check long"
PACKED_SCHEMA = "shard long, block long, payload binary"
POSTING_SCHEMA = "token long, node long, n long, pos long"
SET_SCHEMA = "node long, n long, ranges array<int>, bitmap array<long>, shingles binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)
    return int(both[0]), int(both[1])


def _pack(*columns: np.ndarray) -> bytes:
    """Equally long columns of whole numbers as planes of bytes of one significance, compressed."""
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T) for c in columns]
    return np.array([len(columns), len(columns[0])], "<u4").tobytes() + zlib.compress(b"".join(x.tobytes() for x in planes), 1)


def _unpack(payload: bytes) -> list[np.ndarray]:
    columns, n = np.frombuffer(payload, "<u4", 2).tolist()
    planes = np.frombuffer(zlib.decompress(payload[8:]), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").reshape(-1) for p in planes]


def _gaps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=U64(0))


def _starts(of: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    return np.flatnonzero(new)


def profile(docs: DataFrame, size: int) -> DataFrame:
    """For each row the size of its set and a 128-bit digest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(own), *_digest(own)) for part in slices(batch.column(1), lower=True) for own in shingle_sets(part, size)]
            columns = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[:, k]) for k in range(3))], names=_names(PROFILE_SCHEMA))

    return docs.mapInArrow(run, PROFILE_SCHEMA)


def only(docs: DataFrame, nodes: DataFrame, n: int, work: Work, schema: str) -> DataFrame:
    """``work`` on the rows (doc_id, text) of some nodes, in the Python worker that looks them up.
    Up to ``MOST_NODES`` nodes are looked up in a bit table, which lets a few others pass; more
    are joined."""
    if n > MOST_NODES:
        held = docs.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return held.select("doc_id", "text").mapInArrow(work, schema)
    bits = max(16, (8 * n).bit_length())
    spot = lambda c: F.xxhash64(c).bitwiseAND((1 << bits) - 1)
    words = nodes.groupBy(F.shiftrightunsigned(spot("node"), 5).cast("int").alias("at")).agg(F.bit_or(F.pow(F.lit(2.0), spot("node").bitwiseAND(31)).cast("long")).alias("bits"))
    table = np.zeros(1 << (bits - 5), np.uint32)
    got = words.toArrow()  # 2**(bits - 5) rows at most
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            found = (sent.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
            yield batch.select(["doc_id", "text"]).filter(pa.array(found))

    return docs.select("doc_id", "text", spot("doc_id").alias("spot")).mapInArrow(lambda batches: work(look(batches)), schema)


def packed(size: int, bits: int, shard_bits: int) -> Work:
    """Makes blocks of texts. To each shard: the block's distinct tokens, the text of the first posting
    and the number of postings. To the block itself (as shard ``-1 - block``): its texts with
    their sizes and numbers of tokens, then all postings but the first of each token."""

    def one(block: int, owners: list[tuple[int, int, int]], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, owner = np.concatenate(held), np.repeat(np.arange(len(held), dtype=U64), [len(x) for x in held])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        first = _starts(token)
        more = np.ones(len(token), bool)
        more[first] = False
        counts = np.diff(np.append(first, len(token))).astype(U64)
        table = np.array(owners, np.int64).T
        rows = [(-1 - block, block, _pack(*table)), (-1 - block, block, _pack(_gaps(token[more]), owner[more]))]
        token, owner = token[first], owner[first]
        shard, low = token >> U64(bits - shard_bits), token & U64((1 << bits - shard_bits) - 1)
        cuts = _starts(shard)
        for a, b in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
            rows.append((int(shard[a]), block, _pack(_gaps(low[a:b]), owner[a:b], counts[a:b] - U64(1))))
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_names(PACKED_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32  # the same in every attempt of a task
        done: set[tuple[int, int, int]] = set()
        owners: list[tuple[int, int, int]] = []
        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in slices(batch.column(1), lower=True):
                for doc_id, own in zip(ids[part.first : part.last], shingle_sets(part, size), strict=True):
                    key = (doc_id, *_digest(own))
                    if not len(own) or key in done:
                        continue
                    done.add(key)
                    token = own >> U64(64 - bits)
                    token = token[_starts(token)]
                    owners.append((doc_id, len(own), len(token)))
                    held.append(token)
                    waiting += len(token)
                    if waiting >= BLOCK:
                        yield from one(block, owners, held)
                        block, owners, held, waiting = block + 1, [], [], 0
        if owners:
            yield from one(block, owners, held)

    return run


def prefixes(blocks: DataFrame, percent: int, bits: int, shard_bits: int) -> DataFrame:
    """The postings (token, node, n, pos) of tokens that two or more texts have, in the texts'
    rare-first prefixes. Tokens of one text that are equal only as tokens count once, which
    makes positions earlier and the filters weaker, never stronger."""

    def meet(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        if shard < 0:
            return table
        own = [_unpack(x) for x in table.column("payload").to_pylist()]
        low = np.concatenate([np.cumsum(x[0], dtype=U64) for x in own])
        source = np.repeat(np.arange(len(own)), [len(x[0]) for x in own])
        owner, count = (np.concatenate([x[k] for x in own]) for k in (1, 2))
        order = np.argsort(low, kind="stable")
        starts = _starts(low[order])
        total = np.add.reduceat(count[order] + U64(1), starts) if len(order) else np.zeros(0, U64)
        frequency = np.zeros(len(low), U64)
        frequency[order] = np.repeat(total, np.diff(np.append(starts, len(low))))
        ids, rows = table.column("block").to_pylist(), []
        ends = np.cumsum([0, *(len(x[0]) for x in own)])
        for k, block in enumerate(ids):
            at = ends[k] + np.flatnonzero(frequency[ends[k] : ends[k + 1]] > 1)
            if len(at):
                token = low[at] + U64(shard << bits - shard_bits)
                rows.append((shard, block, _pack(_gaps(token), owner[at], frequency[at])))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_names(PACKED_SCHEMA))

    def finish(table: pa.Table) -> pa.Table:
        shards, payloads = table.column("shard").to_pylist(), table.column("payload").to_pylist()
        table_of, passing, met = None, None, []
        for shard, payload in zip(shards, payloads, strict=True):
            columns = _unpack(payload)
            if shard >= 0:
                met.append((np.cumsum(columns[0], dtype=U64), *columns[1:]))
            elif len(columns) == 3:
                table_of = [x.view(np.int64) for x in columns]
            else:
                passing = np.cumsum(columns[0], dtype=U64), columns[1]
        none = [np.zeros(0, np.int64)] * 4
        if met:
            token, owner, frequency = (np.concatenate(x) for x in zip(*met, strict=True))
            order = np.argsort(token)
            place = order[np.searchsorted(token, passing[0], sorter=order)]
            token, owner, frequency = np.append(token, passing[0]), np.append(owner, passing[1]).astype(np.int64), np.append(frequency, frequency[place])
            order = np.lexsort((token, frequency, owner))
            token, owner = token[order], owner[order]
            shared = np.bincount(owner, minlength=len(table_of[0]))
            node, n, tokens = (x[owner] for x in table_of)
            rank = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
            pos = tokens - shared[owner] + rank
            chosen = np.flatnonzero(pos < n - -(-n * percent // 100) + 1)
            none = [x[chosen] for x in (token.view(np.int64), node, n, pos)]
        return pa.table([pa.array(x) for x in none], names=_names(POSTING_SCHEMA))

    met = blocks.groupBy("shard").applyInArrow(meet, PACKED_SCHEMA)
    return met.groupBy("block").applyInArrow(finish, POSTING_SCHEMA)


def _bitmap(own: np.ndarray) -> np.ndarray:
    """Which bits an odd number of a set's hashes has as its low ones; the next power of two of bits,
    64 or more. The halves of a bitmap, one exclusive-or the other, are the bitmap half as long."""
    length = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own & U64(length - 1)).astype(np.int64), minlength=length).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def may_reach(p: Column, q: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles with the bitmaps p and q, whose sizes pass the length filter,
    may reach the similarity: bits that differ are shingles that only one of them has."""
    for _ in range((-(-100 // percent) - 1).bit_length()):  # doublings that the length filter leaves
        p, q = (F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.floor(F.size(x) / 2).cast("int")), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.size(x)), lambda a, b: a.bitwiseXOR(b))).otherwise(x) for x, y in ((p, q), (q, p)))
    differ = F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (n + m - differ) * (100 + percent) >= 2 * percent * (n + m)


def class_sets(size: int) -> Work:
    """Makes the sets of documents, with the counts of their hashes in equal ranges and a bitmap. A
    node that several texts have gets the sets of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in slices(batch.column(1), lower=True):
                rows = []
                for node, own in zip(ids[part.first : part.last], shingle_sets(part, size), strict=True):
                    key = (node, *_digest(own))
                    if len(own) and key not in done:
                        done.add(key)
                        ranges = np.bincount((own >> U64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=RANGES)
                        rows.append((node, len(own), ranges.astype(np.int32), _bitmap(own), own.tobytes()))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(SET_SCHEMA))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. Only sets of pairs that pass the suffix
    filter are fetched."""
    reach = F.col("bound") * (100 + percent) >= percent * (F.col("n") + F.col("m"))  # shared * 100 >= percent * (n + m - shared)
    close = pairs.join(sets.select(F.col("node").alias("a"), "n", F.col("ranges").alias("p")), "a").join(sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("ranges").alias("q")), "b")
    close = close.withColumn("bound", F.aggregate(F.zip_with("p", "q", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)).filter(reach)
    close = staged(close.select("a", "b").distinct(), "close")
    fetched = staged(sets.join(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "shingles"), "fetched")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def similar(x: bytes, y: bytes) -> bool:
            p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
            return len(np.intersect1d(p, q, assume_unique=True)) * (100 + percent) >= percent * (len(p) + len(q))

        for whole in batches:
            for at in range(0, len(whole), PAIRS):  # a part at a time: bounded memory
                batch = whole.slice(at, PAIRS)
                keep = [similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = close.join(fetched.toDF("a", "p"), "a").join(fetched.toDF("b", "q"), "b")
    return both.select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the labels (node, label) along links (a, b): each becomes the smallest label that
    it can reach. Every turn hooks each label to its smallest neighbour, follows those hooks,
    and contracts the links, until none is left."""
    ends = labels.select(F.col("node"), "label")
    edges = (
        links.join(ends.toDF("a", "u"), "a").join(ends.toDF("b", "v"), "b").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    )
    edges = staged(edges, "edges")
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("to"))
        moved = True
        while moved:  # pointer jumping: hooks lead to ever smaller labels
            hooks = staged(hooks, "hooks")
            step = hooks.join(hooks.toDF("to", "next"), "to", "left").select("x", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
            moved = not step.filter("moved").isEmpty()
            hooks = step.select("x", "to") if moved else hooks
        labels = labels.join(hooks.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        edges = edges.join(hooks.toDF("u", "s"), "u", "left").join(hooks.toDF("v", "t"), "v", "left")
        edges = edges.select(F.coalesce("s", "u").alias("s"), F.coalesce("t", "v").alias("t")).select(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v")).filter("u <> v").distinct()
        edges = staged(edges, "edges")
    return staged(labels, "labels")


def _bin(size: F.Column) -> F.Column:
    """Ranges of sizes, each a tenth wider than the one below."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1.1))).cast("int")


def _each_piece(df: DataFrame) -> DataFrame:
    """Each row once for every piece of its group."""
    return df.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))


def groups(postings: DataFrame, percent: int) -> DataFrame:
    """The postings by group (a token and two ranges of sizes), as the smaller text of a pair and
    as the larger one; ``turn``: the share of the group's members that lead before. Members of a
    large group are dealt to ``pieces`` by hash, so that no task has to read one whole."""
    n, room = F.col("n"), F.col("n") - F.col("pos")
    partner = F.floor(room * (100 + percent) / percent) - n  # the largest partner that the position leaves
    most = F.least(F.floor(n * 100 / percent), partner)
    small = postings.filter(most >= n).withColumns({"small": _bin(n), "large": F.explode(F.sequence(_bin(n), _bin(most))), "role": F.lit(0)})
    least, most = F.ceil(n * percent / 100), F.least(n, partner)
    large = postings.filter(most >= least).withColumns({"small": F.explode(F.sequence(_bin(least), _bin(most))), "large": _bin(n), "role": F.lit(1)})
    members = staged(small.unionByName(large.select(small.columns)).select(F.xxhash64("token", "small", "large").alias("group"), "node", "n", "pos", "role"), "members")
    sizes = members.groupBy("group").agg(F.count("*").alias("members"), F.sum("role").alias("larger")).filter("larger > 0 and larger < members")
    sizes = staged(sizes.select("group", "members"), "sizes")
    share = F.ceil(F.col("members") * PIECES / F.lit(max(1, members.count()))).cast("int")
    large = F.broadcast(sizes.filter(share > 1).select("group", share.alias("pieces")))  # fewer than PIECES rows
    sizes, members = (x.join(large, "group", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))) for x in (sizes, members))
    members = members.withColumn("piece", F.pmod(F.xxhash64("group", "node"), "pieces").cast("int"))
    turn = F.col("members") * (F.xxhash64("node").bitwiseAND((1 << 40) - 1) / float(1 << 40))
    return members.join(_each_piece(sizes).drop("pieces"), ["group", "piece"]).select("group", "piece", "pieces", "node", "n", "pos", "role", "members", turn.alias("turn"))


def linked(postings: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Labels (node, label) of the components that the postings' pairs make."""
    active, tested, first, last = staged(groups(postings, percent), "groups"), None, 0, LEADERS
    while True:
        now = active.join(labels, "node")
        open_ = now.groupBy("group", "pieces", "label").agg(F.count("*").alias("held")).groupBy("group", "pieces")
        open_ = open_.agg(F.max_by("label", "held").alias("main"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        now = now.filter(F.col("members") > first).join(_each_piece(open_).select("group", "piece", "main"), ["group", "piece"])
        now = staged(now.withColumn("minor", F.col("label") != F.col("main")), "open")
        if now.isEmpty():
            return labels
        # a node of several texts meets the bitmaps of all that have the posting's size
        met = now.join(sets.select("node", "n", "bitmap"), ["node", "n"]) if first >= BARE else now.withColumn("bitmap", F.lit(None).cast("array<bigint>"))
        lead = met.filter((F.col("turn") >= first) & (F.col("turn") < last))
        lead = lead.withColumn("minor", F.explode(F.when(F.col("minor"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
        lead = _each_piece(lead.drop("piece")).select("group", "piece", "minor", F.col("node").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("role").alias("part"), F.col("label").alias("with"), F.col("bitmap").alias("bits"))
        short, long = F.least("n", "m"), F.greatest("n", "m")
        room = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
        fits = (short * 100 >= long * percent) & (room * (100 + percent) >= (short + long) * percent)
        if first >= BARE:
            fits &= may_reach(F.col("bitmap"), F.col("bits"), F.col("n"), F.col("m"), percent)
        pairs = met.join(lead, ["group", "piece", "minor"]).filter((F.col("role") != F.col("part")) & (F.col("label") != F.col("with")) & fits)
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = staged(pairs.join(tested, ["a", "b"], "left_anti") if tested else pairs, "pairs")
        tested = tested.unionByName(pairs) if tested else pairs
        if not pairs.isEmpty():
            labels = connect(labels, staged(verified(pairs, sets, percent), "links"))
        active, first, last = now.select(active.columns), last, last * MORE


def jaccard_components(docs: DataFrame, *, percent: int = 75, size: int = 5) -> DataFrame:
    """Link documents (columns ``doc_id, text``) whose shingle sets have a Jaccard similarity of
    ``percent`` or more, and return for every row doc_id, n_shingles, component_id (long).

    A-Z is lower-cased. A text with fewer than ``size`` words is one shingle of all its words;
    a null or blank text is empty and linked with nothing. Rows that repeat a doc_id are
    compared one by one, and that id stands for all of them: their components are one. A row
    with a null doc_id gets its n_shingles and a null component_id and links nothing. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    docs = needed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    with scratch(spark):
        rows = staged(profile(docs, size), "profile", keep=True)
        named = rows.filter("n > 0 and doc_id is not null")
        classes = staged(named.groupBy("key", "check").agg(F.min("doc_id").alias("node"), F.first("n").alias("n")), "classes", keep=True)
        count, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        bits = min(64, max(32, total.bit_length() + 8))
        shard_bits = max(0, (total // SHARD).bit_length(), (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
        named_docs = docs.filter("doc_id is not null")
        blocks = only(named_docs, classes, count, packed(size, bits, shard_bits), PACKED_SCHEMA)
        postings = staged(prefixes(blocks, percent, bits, shard_bits), "prefixes")
        met = postings.groupBy("token").agg(F.count("*").alias("texts")).filter("texts > 1")
        postings = staged(postings.join(met.select("token"), "token", "left_semi"), "postings")
        nodes = staged(postings.select("node").distinct(), "nodes")
        sets = staged(only(named_docs, nodes, nodes.count(), class_sets(size), SET_SCHEMA), "sets")
        labels = linked(postings, sets, nodes.select("node", F.col("node").alias("label")), percent)
        # texts of one doc_id
        own = named.join(classes.select("key", "check", "node"), ["key", "check"]).select("doc_id", "node")
        several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
        same = staged(own.join(several.select("doc_id", "a"), "doc_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "same")
        if not same.isEmpty():
            ends = same.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
            labels = connect(labels.unionByName(ends.select("node", F.col("node").alias("label"))), same)
        smallest = labels.groupBy("label").agg(F.min("node").alias("component_id"))
        found = staged(labels.join(smallest, "label").select("node", "component_id"), "components", keep=True)
    found = classes.join(found, "node", "left").select("key", "check", F.coalesce("component_id", "node").alias("component_id"))
    out = rows.join(found, ["key", "check"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))
