"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by size (a class for each power of two of their number of shingles). An
item's sketch is its bottom-k MinHash: its k smallest shingle hashes, with k set by its class
so that a document that holds the wanted share of the item's shingles must hold one of these
k (all but k - 1 at most may be missing). So the search loses nothing, however long the
document is. A document probes with its hashes up to the largest sketch value, and only for
items that are small enough for it; each candidate pair is then verified on the shingles
themselves. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import needed, staged

SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def word_array(text: Column) -> Column:
    """Lower-case words of a text; null and blank texts have none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE)
    return F.filter(words, lambda w: w != "")


def shingle_hashes(text: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words in order; of all words as one, if there are fewer."""

    def of(h: Column) -> Column:
        n = F.size(h)
        full = F.transform(F.slice(h, 1, n - (size - 1)), lambda x, i: F.xxhash64(x, *[h[i + k] for k in range(1, size)]))
        return F.when(n >= size, full).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(word_array(text), lambda w: F.xxhash64(w)), of)


def shingle_texts(text: Column, size: int) -> Column:
    """Distinct windows of words as text, for the exact check."""

    def of(w: Column) -> Column:
        n = F.size(w)
        full = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, size)))
        return F.when(n >= size, F.array_distinct(full)).when(n > 0, F.array(F.concat_ws(" ", w))).otherwise(F.array().cast("array<string>"))

    return let(word_array(text), of)


def _windows(words: Column, lengths: list[int], of: Callable[[Column], Column], kind: str) -> Column:
    """``of`` all windows of each length, as an array."""
    n = F.size(words)

    def all_of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1)))
        return F.when(n >= k, F.transform(starts, lambda i: of(F.slice(words, i, k)))).otherwise(F.array().cast(f"array<{kind}>"))

    each = [all_of(k) for k in lengths]
    return F.concat(F.array().cast(f"array<{kind}>"), *each)


def short_hashes(text: Column, lengths: list[int]) -> Column:
    """Hashes of all windows of so many words, as :func:`shingle_hashes` hashes a text of so many."""
    return let(F.transform(word_array(text), lambda w: F.xxhash64(w)), lambda h: _windows(h, lengths, F.xxhash64, "bigint"))


def short_texts(text: Column, lengths: list[int]) -> Column:
    """Distinct windows of so many words as text."""
    return let(word_array(text), lambda w: F.array_distinct(_windows(w, lengths, lambda x: F.concat_ws(" ", x), "string")))


def contaminated(docs: DataFrame, items: DataFrame, *, percent: int = 75, size: int = 5) -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``percent`` of the distinct
    word shingles of ``size`` words (docs: ``doc_id, text``; items: ``item_id, text``). An item of
    fewer words is one shingle, found wherever a document has these words in a row.

    Null and blank texts hold nothing and are held by nothing. Rows that repeat a doc_id or an
    item_id are compared one by one, and the best pair counts. Rows without a doc_id or an item_id
    can't be named in a pair and give none. Empty tables give no rows.
    Returns doc_id, item_id, n_item, n_common (long), containment (double).
    """
    docs, items = needed(docs, "doc_id", "text"), needed(items, "item_id", "text")
    parts = staged(
        items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("text"), size))).alias("sketch"), shingle_texts(F.col("text"), size).alias("wanted"), F.size(word_array(F.col("text"))).alias("words")).filter(F.size("sketch") > 0),
        "items",
    )
    lengths = sorted(x[0] for x in parts.filter(F.col("words") < size).select("words").distinct().collect())  # fewer than ``size``
    n = F.size("sketch")
    upper = F.lit(2) * F.expr("cast(shiftleft(1L, cast(floor(log2(size(sketch))) as int)) as bigint)") - 1  # of the size class
    kept = F.least(n, F.floor(upper * (100 - percent) / 100).cast("int") + 1)
    sketches = parts.select("item_id", F.ceil(n * percent / 100).cast("int").alias("least"), F.explode(F.slice("sketch", 1, kept)).alias("hash"))
    highest = sketches.agg(F.max("hash")).first()[0]
    if highest is None:
        highest = -(1 << 63)

    hashes = docs.select("doc_id", shingle_hashes(F.col("text"), size).alias("hashes"), *([short_hashes(F.col("text"), lengths).alias("short")] if lengths else []))
    hashes = hashes.select("doc_id", F.size("hashes").alias("held"), (F.concat("hashes", "short") if lengths else F.col("hashes")).alias("hashes"))
    probes = hashes.select("doc_id", "held", F.explode(F.filter("hashes", lambda h: h <= F.lit(highest))).alias("hash"))
    found = probes.join(sketches, (probes.hash == sketches.hash) & (probes.held >= sketches.least)).select("doc_id", "item_id").distinct()
    pairs = staged(found, "candidates")

    held = shingle_texts(F.col("text"), size)
    held = F.array_union(held, short_texts(F.col("text"), lengths)) if lengths else held
    texts = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", held.alias("held"))
    checked = pairs.join(texts, "doc_id").join(parts.select("item_id", "wanted"), "item_id")
    common = checked.select("doc_id", "item_id", F.size("wanted").cast("long").alias("n_item"), F.size(F.array_intersect("wanted", "held")).cast("long").alias("n_common"))
    return (
        common.filter(F.col("n_common") * 100 >= F.col("n_item") * percent)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct(F.col("n_common") / F.col("n_item"), "n_item", "n_common")).alias("best"))
        .select("doc_id", "item_id", "best.n_item", "best.n_common", (F.col("best.n_common") / F.col("best.n_item")).alias("containment"))
    )
