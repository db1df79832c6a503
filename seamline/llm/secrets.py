"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Base spans come from fixed patterns. Candidates are these and further long mixed tokens. The
hash of each candidate's value is counted over the corpus by distinct repositories and owners:
a value that many owners or many repositories hold is a widely copied example, one that a
single owner (or a few) holds in few repositories and that looks random is a live-looking
credential. The method adds the latter kind of
further token to the spans; base spans stay whatever their class.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import free, needed, scratch, staged
from .decontamination import let

# Kinds in the order in which they are listed, their patterns, the group that
# holds the value, and the value's least length. Runs of one class of characters are searched
# for with their least length at once: a shorter run uses up no text that a longer one needs.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: The least pattern that a text with a passing match of each kind contains: a quick test.
QUICK = [
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    r"AKIA[A-Z0-9]{16}",
    r"[0-9a-f]{24}",
]
#: Further tokens: 24 or more characters of keys, with a lower-case letter, an upper-case letter and digits.
FURTHER = r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9][A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}"
FURTHER_QUICK = r"[A-Za-z0-9+/_-]{24}"
#: A value in more repositories than this is a copied example, however few owners they have. A credential
#: that a few repositories of one owner share, or that some copies of its document repeat, stays below.
MAX_REPOSITORIES = 20
#: Values with more than one of so many spans each, fewer than this, are judged apart.
HOT = 1000
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


#: Matches whose ends are added up in one array; ends of so many matches are copied for each.
ADDED = 256


Add = Callable[[Column, Column], Column]


def _so_far(numbers: Column, add: Add) -> Column:
    start = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("last"))
    return F.aggregate(numbers, start, lambda s, n: F.struct(F.concat(s["all"], F.array(add(s["last"], n))).alias("all"), add(s["last"], n).alias("last")), lambda s: s["all"])


def _running(numbers: Column, add: Add = operator.add) -> Column:
    """Running sums, or what else ``add`` makes of 0 and the numbers so far, block by block: the
    work is about linear in the array's length."""

    def whole(blocks: Column) -> Column:
        totals = _so_far(F.transform(blocks, lambda b: F.coalesce(F.element_at(b, -1), F.lit(0))), add)
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda e: add(e, F.when(i > 0, t[i - 1]).otherwise(0))))))

    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / ADDED).cast("int")), lambda b: _so_far(F.slice(numbers, b * ADDED + 1, ADDED), add))
    return let(cut, whole)


def _matches(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches with their places in code points: what lies between
    matches comes from splitting the text by the same pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def spans(between: Column) -> Column:
        def of(whole: Column) -> Column:
            def at(ends: Column) -> Column:
                rows = F.transform(
                    F.arrays_zip(whole.alias("whole"), values.alias("value"), ends.alias("end")),
                    lambda z: F.struct((z["end"] - F.length(z["whole"])).alias("start"), F.lit(rank).alias("rank"), z["end"].alias("end"), F.lit(kind).alias("kind"), z["value"].alias("value")),
                )
                return F.filter(rows, lambda s: F.length(s["value"]) >= least)

            lengths = F.transform(whole, lambda x, i: F.length(between[i]) + F.length(x))
            return let(lengths, lambda n: let(_running(n), at))

        return let(found, of)

    return let(F.split(text, pattern, -1), spans)


def _spans(text: Column) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    parts = [F.when(text.rlike(quick), _matches(text, rank, *kind).cast(f"array<{SPAN}>")).otherwise(none) for rank, (kind, quick) in enumerate(zip(KINDS, QUICK, strict=True))]
    return F.concat(*parts)


def _further(text: Column) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    found = _matches(text, len(KINDS), "mixed", FURTHER, 0, 24).cast(f"array<{SPAN}>")
    return F.when(text.rlike(FURTHER_QUICK), F.when(text.rlike(FURTHER), found)).otherwise(none)


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _found(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """The spans of every text: doc_id, row (a hash of id and text), repository, owner, base, further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = needed(docs, *dict.fromkeys(["doc_id", "text", repository, owner])).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _row().alias("row"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        _spans(text).alias("base"),
        F.coalesce(_further(text), F.array().cast(f"array<{SPAN}>")).alias("further"),
    )
    return rows.withColumn("further", F.when(F.size("further") > 0, _apart(F.concat("base", "further"))).otherwise(F.array().cast(f"array<{SPAN}>")))


def _apart(spans: Column) -> Column:
    """The further tokens that no base span overlaps: none before reaches over their start, and
    the next span begins after them (they don't overlap each other)."""
    rank = len(KINDS)

    def found(spans: Column) -> Column:
        reach = _running(F.transform(spans, lambda s: F.when(s["rank"] < rank, s["end"]).otherwise(0)), F.greatest)
        return let(reach, lambda reach: F.filter(spans, lambda s, i: (s["rank"] == rank) & (reach[i] <= s["start"]) & F.coalesce(F.get(spans, i + 1)["start"] >= s["end"], F.lit(True))))

    return let(F.array_sort(spans), found)


def _row() -> Column:
    """Names a row by its id and text, so that rows with one id, or none, stay apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.octet_length("text"), "text")


def _live(held: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """The live-looking spans (row, start, rank, end, kind, value), by the spread of every value.
    A value with more than one of ``HOT`` of all spans is judged where its spans are, so that no
    task meets them all; the others are joined by value."""
    spans = F.explode(F.concat("base", "further")).alias("span")
    each = held.select("repository", "owner", spans).select("repository", "owner", F.xxhash64("span.value").alias("hash"))
    spread = each.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.count("*").alias("held"))
    spread = staged(spread.select("hash", "held", ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("live")), "spread")
    total = spread.agg(F.sum("held")).first()[0] or 0
    hot = F.broadcast(spread.filter(F.col("held") * HOT > total).select("hash", F.col("live").alias("judged")))  # fewer than HOT rows
    found = held.dropDuplicates(["row"]).select("row", spans).select("row", "span.*", F.xxhash64("span.value").alias("hash"))
    found = found.join(hot, "hash", "left").filter(F.coalesce("judged", F.lit(True)))
    found = found.withColumn("key", F.when(F.col("judged").isNull(), F.col("hash")).otherwise(F.xxhash64("row", "start")))  # judged spans: anywhere
    single = spread.filter("live").select(F.col("hash").alias("key"), F.lit(True).alias("single"))
    return found.join(single, "key", "left").filter(F.coalesce("judged", "single", F.lit(False))).drop("key", "hash", "judged", "single")


def mask(
    docs: DataFrame, *, repository: str = "doc_id", owner: str = "source", max_owners: int = 2, max_repositories: int = MAX_REPOSITORIES, put: str = "[secret]", broadcast_rows: int = 200_000
) -> DataFrame:
    """The documents with every live-looking value replaced by ``put``, in all columns that they
    have; ``n_chars``, if there, follows the new text. Widely copied examples stay.

    Spans and verdicts are those of :func:`scan`. Rows without a live-looking value and null
    texts are returned as they are; a null doc_id is no reason to leave a secret in place.
    ``broadcast_rows``: the places of up to so many rows' live values are broadcast; more are
    joined by shuffle, with the rows that may have one only.
    """
    spark = docs.sparkSession
    with scratch(spark):
        rows = staged(_found(docs, repository, owner).filter((F.size("base") > 0) | (F.size("further") > 0)), "spans")
        before = F.max("end").over(Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1))
        cuts = _live(rows, max_owners, max_repositories).withColumn("start", F.col("end") - F.length("value"))
        cuts = cuts.withColumn("from", F.coalesce(before, F.lit(0))).withColumn("cut", F.when(F.col("start") >= F.col("from"), F.struct("from", "start")))
        row_name, cuts_name, tail_name = (free(docs, x) for x in ("row", "cuts", "tail"))
        live = cuts.groupBy(F.col("row").alias(row_name)).agg(F.array_sort(F.collect_list("cut")).alias(cuts_name), F.max("end").alias(tail_name))
        live = staged(live, "live", keep=True)
    text = F.col("text")

    def block(cuts: Column) -> Column:  # a part of the text first: places are counted from its start
        first = cuts[0]["from"]
        return let(
            F.substring(text, first + 1, F.element_at(cuts, -1)["start"] - first),
            lambda part: F.array_join(F.transform(cuts, lambda c: F.concat(F.substring(part, c["from"] - first + 1, c["start"] - c["from"]), F.lit(put))), ""),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts_name) - 1) / ADDED).cast("int")), lambda b: block(F.slice(cuts_name, b * ADDED + 1, ADDED)))
    without = F.concat(F.array_join(blocks, ""), F.substring(text, F.col(tail_name) + 1, F.length(text)))

    def masked(part: DataFrame, live: DataFrame) -> DataFrame:
        joined = part.join(live, _row() == F.col(row_name), "left")
        joined = joined.withColumn("text", F.when(F.col(cuts_name).isNotNull(), without).otherwise(text))
        if "n_chars" in docs.columns:
            joined = joined.withColumn("n_chars", F.when(F.col(cuts_name).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return joined.select(*[F.col(f"`{c}`") for c in docs.columns])

    if live.count() <= broadcast_rows:
        return masked(docs, F.broadcast(live))
    may = F.coalesce(text.rlike("|".join(f"(?:{x})" for x in (*QUICK, FURTHER_QUICK))), F.lit(False))
    return docs.filter(~may).unionByName(masked(docs.filter(may), live))


def scan(docs: DataFrame, *, repository: str = "doc_id", owner: str = "source", max_owners: int = 2, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Find secrets in every whole text (columns ``doc_id, text`` and those named).

    ``repository`` and ``owner``: the columns by which a value's spread is counted. ``max_owners``
    and ``max_repositories``: with up to so many distinct owners and up to so many distinct
    repositories over all documents a value is live-looking, with more of either a copied example.

    A null text is empty. A null repository or owner counts as one of its own; repeated rows
    are scanned one by one.
    An empty table gives no rows. Returns doc_id, n_assign, n_access, n_hex (long), base_sha256,
    spans (string), n_live, n_example, n_added (long), live_spans (string).
    """
    rows = staged(_found(docs, repository, owner), "spans")
    held = rows.filter((F.size("base") > 0) | (F.size("further") > 0))
    live = _live(held, max_owners, max_repositories).groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end", "kind", "value")).alias("live"))
    none = F.array().cast(f"array<{SPAN}>")
    judged = held.select("doc_id", "row", "base").join(live, "row", "left").withColumn("live", F.coalesce("live", none)).drop("row")
    judged = judged.withColumn("added", F.filter("live", lambda s: s["rank"] == len(KINDS)))
    plain = rows.filter((F.size("base") == 0) & (F.size("further") == 0)).select("doc_id", "base", none.alias("live"), none.alias("added"))
    both = judged.select("doc_id", "base", "live", "added").unionByName(plain)

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return both.select(
        "doc_id", *(of(kind[0]) for kind in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        (F.size("base") + F.size("added") - F.size("live")).cast("long").alias("n_example"),
        F.size("added").cast("long").alias("n_added"),
        _joined(F.col("live")).alias("live_spans"),
    )
