"""The prefix trie of conversations, built level by level for all of them at once.

At each level the live conversations, those that still share their node with another, are
grouped by that node and their next turn; a group of two or more is a shared node of the next
level, named by its smallest conv_id. A conversation that is alone in its group goes on by itself,
and all its further nodes are known. A round takes a block of levels: within it a group is named
by the node at the block's top and the turns since. Blocks double, so that a trie of any depth
takes few rounds. Then leaves and savings are summed up from the lowest block to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import needed, staged

WORD_RE = r"[^\x20\x09-\x0D]+"
REBUILT = 3  # the most turns that a rebuilt conversation takes from another
CHUNK = 256  # ids in a string that goes into a digest
FIRST_LEVELS, MOST_LEVELS = 4, 64
TURNS = "conv_id long, depth long, turn binary, words long"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), turn (a digest of role and text) and words of each row, by turn,
    nulls first. Rows of one turn are put in the order of their digests; equal rows are
    one after the other. Rows without a conv_id are left out. Null roles and texts are empty.

    Rows are sorted in ranges of (conv_id, turn, digest), so that a conversation may lie in many
    partitions; equal rows are counted first. What a range passes on to the next is one row for
    each conversation that ends a partition, of which there are no more than partitions.
    """
    spark = conversations.sparkSession
    rows = needed(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), digest.alias("turn"), F.regexp_count(text, F.lit(WORD_RE)).cast("long").alias("words"))
    counted = staged(slim.groupBy("conv_id", "at", "turn").agg(F.max("words").alias("words"), F.count("*").alias("n")), "turn-counts")
    order = [F.col("conv_id").asc(), F.col("at").asc_nulls_first(), F.col("turn").asc()]
    ranged = counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, done = None, 0
        for batch in batches:
            before = []
            for own, n in zip(batch.column("conv_id").to_pylist(), batch.column("n").to_pylist(), strict=True):
                conv, done = own, done if own == conv else 0
                before.append(done)
                done += n
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("conv_id", "part", "turn", "words", "n")), pa.array(before, pa.int64())], names=["conv_id", "part", "turn", "words", "n", "before"])

    cut = staged(ranged.select("conv_id", "part", "turn", "words", "n").mapInArrow(run, "conv_id long, part int, turn binary, words long, n long, before long"), "turn-ranges")
    ends = cut.groupBy("part").agg(F.max(F.struct("conv_id", (F.col("before") + F.col("n")).alias("done"))).alias("e")).select("part", "e.*")
    carried = ends.withColumn("carry", F.sum("done").over(Window.partitionBy("conv_id").orderBy("part")))
    # what a conversation has in its earlier partitions; only a partition's last one can go on, so there are no more rows than partitions
    carried = carried.select(F.col("conv_id").alias("__conv"), F.col("part").alias("__from"), F.lead("part").over(Window.partitionBy("conv_id").orderBy("part")).alias("__until"), "carry")
    on = (cut["conv_id"] == carried["__conv"]) & (cut["part"] > carried["__from"]) & (carried["__until"].isNull() | (cut["part"] <= carried["__until"]))
    placed = cut.join(F.broadcast(carried), on, "left").withColumn("first", F.col("before") + F.coalesce("carry", F.lit(0)) + 1)
    depth = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    return placed.select("conv_id", depth.alias("depth"), "turn", "words")


def rebuilt_turns(turns: DataFrame, family: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from their family's: the first ``head`` turns of conversation
    ``family`` (fewer if it has fewer), then their own after the first ``head``. Both are columns
    over conv_id, ``head`` at most :data:`REBUILT`. Returns the turns, and the conversations with
    their length, ``conv_id, size``; one without turns has size 0."""
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("own")).select("conv_id", "own", family.alias("family"), head.cast("long").alias("head"))
    tops = turns.filter(F.col("depth") <= REBUILT).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "words"))).alias("top")).withColumnRenamed("conv_id", "family")
    convs = convs.join(tops, "family", "left").withColumn("top", F.slice(F.coalesce("top", F.array().cast("array<struct<depth:bigint,turn:binary,words:bigint>>")), F.lit(1), F.col("head").cast("int")))
    convs = convs.withColumn("given", F.size("top").cast("long"))
    taken = convs.select("conv_id", F.explode("top").alias("t")).select("conv_id", "t.depth", "t.turn", "t.words")
    shift = convs.select(F.col("conv_id").alias("__conv"), "head", "given")
    kept = turns.join(shift, turns["conv_id"] == shift["__conv"]).filter("depth > head").select("conv_id", (F.col("depth") - F.col("head") + F.col("given")).alias("depth"), "turn", "words")
    sizes = convs.select("conv_id", (F.col("given") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("size"))
    return taken.unionByName(kept), sizes


def _block(turns: DataFrame, live: DataFrame, top: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Shared nodes of the ``levels`` levels under ``top``, and each live conversation's way through
    them. ``live``: conv_id and ``node``, the name of its node at depth ``top``."""
    within = turns.filter((F.col("depth") > top) & (F.col("depth") <= top + levels))
    ways = within.join(live, "conv_id").groupBy("conv_id", "node").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "words"))).alias("ahead"))
    steps = ways.select("conv_id", "node", F.posexplode("ahead").alias("k", "step"), "ahead")
    since = F.transform(F.slice("ahead", F.lit(1), F.col("k") + 1), lambda t: F.hex(t["turn"]))
    steps = steps.select("conv_id", "node", F.col("step.depth").alias("depth"), F.when(F.col("k") == 0, F.col("step.turn")).otherwise(F.unhex(F.sha2(F.array_join(since, ""), 256))).alias("way"), F.col("step.words").alias("words"))
    steps = staged(steps, "trie-steps")
    groups = steps.groupBy("node", "depth", "way").agg(F.min("conv_id").alias("name"), F.count("*").alias("n_convs"), F.max("words").alias("words")).filter("n_convs > 1")
    shared = staged(steps.select("conv_id", "node", "depth", "way").join(groups, ["node", "depth", "way"]).select("conv_id", "node", "depth", "name", "n_convs", "words"), "trie-shared")
    paths = shared.groupBy("conv_id", "node").agg(F.sort_array(F.collect_list(F.struct("depth", "name", "n_convs", "words"))).alias("path"))
    paths = staged(paths, "trie-paths")
    own = paths.select("conv_id", "node", "path", F.posexplode("path").alias("k", "p")).filter("p.name = conv_id")
    above = F.concat(F.array("node"), F.transform(F.slice("path", F.lit(1), F.col("k")), lambda p: p["name"]))
    nodes = own.select(F.col("conv_id"), F.col("p.depth").alias("depth"), F.col("p.n_convs").alias("n_convs"), F.col("p.words").alias("words"), above.alias("above"))
    ends = paths.select("conv_id", F.element_at("path", -1).alias("p")).select("conv_id", F.col("p.depth").alias("shared"), F.col("p.name").alias("node"))
    return nodes, ends


def _ends_digest(ends: DataFrame) -> DataFrame:
    """conv_id, depth and ``ends_sha256`` of nodes at which conversations end (conv_id, depth,
    ``member``). Ids are put together in strings of bounded size first; the digest of a node is
    one sequential computation, which reads these as a stream."""
    strings = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = strings.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
        node, digest = None, None
        for batch in batches:
            out = []
            for conv, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == (conv, depth):
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, x, strict=True)) for x in out], schema=fields)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, (*node, digest.hexdigest()), strict=True))], schema=fields)

    return ordered.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame, *, first_levels: int = FIRST_LEVELS, most_levels: int = MOST_LEVELS) -> DataFrame:
    """The trie of conversations: for each node conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, depth from 1 without holes, turn (equal for equal turns) and words.
    ``sizes``: conv_id and size of all conversations, those without turns too.
    ``first_levels``, ``most_levels``: levels of the first block and of the largest; they change the
    number of rounds, never the result.

    All conversations are members of the root, even if there is one only; without any there are no
    nodes. Groups are summed up before they are shuffled, members of a node are never gathered.
    """
    spark: SparkSession = turns.sparkSession
    turns, sizes = staged(turns, "trie-turns"), staged(sizes, "trie-sizes")
    summary = sizes.agg(F.min("conv_id").alias("first"), F.count("*").alias("n")).first()
    if not summary["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root = summary["first"]
    live = sizes.select("conv_id", F.lit(root).cast("long").alias("node"))
    blocks, reached, top, levels = [], [sizes.select("conv_id", F.lit(0).cast("long").alias("shared"), F.lit(root).cast("long").alias("node"))], 0, first_levels
    while summary["n"] > 1:
        nodes, ends = _block(turns, live, top, levels)
        ends = staged(ends, "trie-ends")
        blocks.append((top, top + levels, staged(nodes, "trie-nodes")))
        reached.append(ends)
        live = ends.filter(F.col("shared") == top + levels).select("conv_id", "node")
        if live.isEmpty():
            break
        top, levels = top + levels, min(2 * levels, most_levels)
    # the deepest shared node of each conversation
    found = reached[0]
    for ends in reached[1:]:
        found = found.unionByName(ends)
    found = found.groupBy("conv_id").agg(F.max(F.struct("shared", "node")).alias("deepest")).select("conv_id", "deepest.*")
    members = staged(found.join(sizes, "conv_id"), "trie-members")
    # conversations that go on alone under a shared node
    alone = members.filter("size > shared").groupBy(F.col("node").alias("conv_id"), F.col("shared").alias("depth")).agg(F.count("*").alias("alone"))
    top_node = spark.range(1).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(summary["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"), F.array().cast("array<bigint>").alias("above"))
    summed = []
    below = None  # of the nodes at the end of a block: children, leaves and savings in lower blocks
    for _, bottom, nodes in [*reversed(blocks), (-1, 0, top_node)]:
        totals = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).join(alone, ["conv_id", "depth"], "left").fillna(0, ["alone"])
        zero = F.lit(0).cast("long")
        if below is not None:
            totals = totals.join(below, ["conv_id", "depth"], "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
        else:
            totals = totals.withColumns({"more_children": zero, "more_leaves": zero, "more_saved": zero})
        last = F.size("above") - 1
        path = F.concat(F.transform("above", lambda a, k: F.struct(a.alias("conv_id"), (F.col("depth") - F.size("above") + k).alias("depth"), (k == last).cast("long").alias("child"), F.lit(False).alias("self"))), F.array(F.struct(F.col("conv_id"), F.col("depth"), zero.alias("child"), F.lit(True).alias("self"))))
        # a node without shared children is childless, if none goes on alone either
        inner = nodes.filter(F.size("above") > 0).select(F.try_element_at("above", F.lit(-1)).alias("conv_id"), (F.col("depth") - 1).alias("depth")).distinct().withColumn("inner", F.lit(1).cast("long"))
        totals = totals.join(inner, ["conv_id", "depth"], "left").fillna(0, ["inner"])
        leaf = (F.col("inner") + F.col("alone") + F.col("more_children") == 0).cast("long")
        parts = totals.withColumn("leaves", F.col("alone") + F.col("more_leaves") + leaf).withColumn("savings", F.col("saved") + F.col("more_saved")).select(F.explode(path).alias("p"), "leaves", "savings", "n_convs", "alone", "more_children", F.try_element_at("above", F.lit(-1)).alias("parent"))
        own = lambda c: F.max(F.when(F.col("p.self"), F.col(c)))
        sums = parts.groupBy("p.conv_id", "p.depth").agg(
            F.sum("p.child").alias("children"), F.sum("leaves").alias("n_leaves"), F.sum("savings").alias("saved_tokens"), own("n_convs").alias("n_convs"), own("alone").alias("alone"), own("more_children").alias("more"), own("parent").alias("parent_conv_id")
        )
        sums = staged(sums, "trie-sums")
        summed.append(sums.filter("n_convs is not null").select("conv_id", "depth", "parent_conv_id", "n_convs", (F.col("children") + F.col("alone") + F.col("more")).alias("n_children"), "n_leaves", "saved_tokens"))
        below = sums.filter("n_convs is null").select("conv_id", "depth", F.col("children").alias("more_children"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
    shared = summed[0]
    for part in summed[1:]:
        shared = shared.unionByName(part)
    digests = _ends_digest(members.filter("size = shared").select(F.col("node").alias("conv_id"), F.col("shared").alias("depth"), F.col("conv_id").alias("member")))
    nothing = F.sha2(F.lit(b""), 256)
    shared = shared.join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    tails = turns.select("conv_id", "depth").join(members, "conv_id").filter("depth > shared")
    tails = tails.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("shared") + 1, F.col("node")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("size")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("depth") == F.col("size"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return shared.select(tails.columns).unionByName(tails)
