"""Language identification with word-first backoff.

A word that the model knows scores by its log frequency in each language. An unseen word falls
back to its character n-grams, from the longest length to the shortest; the first length of
which the model knows any n-gram decides.

The model is fitted on a bounded sample of labelled rows: ``max_rows`` rows in the mean, chosen
by a hash of the id. All their words and n-grams are kept. The bytes of
the model are counted; beyond a bound it isn't broadcast but joined with the words of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import needed, staged
from .decontamination import let

LENGTHS = (4, 3, 2, 1)
REMEMBERED = 300_000
WORD = r"\p{L}+"
#: Word characters without digits: letters, and numbers of other kinds.
_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, lang_pred string, score double"


def words_of(text: str) -> list[str]:
    """Runs of letters."""
    words = _WORD.findall(text)
    if all(map(str.isalpha, words)):
        return words
    return [run for word in words for run in "".join(c if c.isalpha() else " " for c in word).split()]


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id is in no fold."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def drawn(key: str, share: float) -> Column:
    """Whether a row is among the given share, by 53 bits of a hash of its key: exact for any share."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(17)), 11) < share * float(1 << 53)


def bounded_sample(rows: DataFrame, max_rows: int, key: str = "doc_id") -> DataFrame:
    """About ``max_rows`` rows by a hash of the key, all rows if there are fewer."""
    n = rows.count()
    return rows if n <= max_rows else rows.filter(drawn(key, max_rows / n))


def grams_of(word: str, k: int) -> Column:
    """All n-grams of ``k`` characters of a marked word, in order."""
    chars = F.split(F.concat(F.lit("<"), word, F.lit(">")), "")
    return let(chars, lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - (k - 1))), lambda i: F.array_join(F.slice(c, i, k), "")))


def fit(docs: DataFrame, *, max_rows: int = 20_000) -> DataFrame:
    """Counts of words (length 0) and of n-grams for each language: lang, length, item, n, total.
    The model has all of the sample's words and n-grams; only labelled rows are bounded."""
    rows = bounded_sample(needed(docs, "doc_id", "text", "lang").filter("lang is not null and text is not null"), max_rows)
    words = (
        rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("item"))
        .groupBy("lang", "item").agg(F.count("*").alias("n"))
    )
    words = staged(words, "words")
    grams = [
        words.select("lang", F.lit(k).alias("length"), F.explode(grams_of("item", k)).alias("item"), "n")
        .groupBy("lang", "length", "item").agg(F.sum("n").alias("n"))
        for k in LENGTHS
    ]
    counts = words.select("lang", F.lit(0).alias("length"), "item", "n")
    for g in grams:
        counts = counts.unionByName(g)
    counts = staged(counts, "counts")
    return counts.join(counts.groupBy("lang", "length").agg(F.sum("n").alias("total")), ["lang", "length"])


def _languages(model: DataFrame) -> tuple[list[str], dict[int, np.ndarray]]:
    """The languages, and for each length what an item that a language lacks scores there."""
    totals = {(x["lang"], x["length"]): x["total"] for x in model.select("lang", "length", "total").distinct().collect()}  # languages x lengths
    langs = sorted({lang for lang, _ in totals})
    base = {k: np.log(0.5) - np.log([totals.get((lang, k), 1) + 1.0 for lang in langs]) for k in (0, *LENGTHS)}
    return langs, base


Tables = dict[int, tuple[pa.Array, np.ndarray]]


def _tables(counts: pa.Table, langs: list[str], base: dict[int, np.ndarray]) -> Tables:
    """For each length the items and the matrix of their log frequencies by language; an item
    that a language lacks has half a count there (``base``)."""
    counts = counts.combine_chunks()
    column = pc.index_in(counts["lang"], pa.array(langs, pa.string())).to_numpy()
    length = counts["length"].to_numpy()
    logs = np.log(counts["n"].to_numpy()) - np.log(counts["total"].to_numpy() + 1.0)
    tables: Tables = {}
    for k in (0, *LENGTHS):
        own = np.flatnonzero(length == k)
        coded = counts["item"].take(pa.array(own)).combine_chunks().dictionary_encode()
        matrix = np.tile(base[k].astype(np.float32), (len(coded.dictionary), 1))
        matrix[coded.indices.to_numpy(), column[own]] = logs[own]
        tables[k] = coded.dictionary, matrix
    return tables


class _Scores(dict):
    """Rows of the score matrix by word; unseen words are scored when they first come."""

    def __init__(self, tables: dict[int, tuple[dict[str, int], np.ndarray]], width: int):
        super().__init__()
        self.tables, self.rows, self.none = tables, [], np.zeros(width)

    def __missing__(self, word: str) -> int:
        found = None
        items, matrix = self.tables[0]
        if word in items:
            found = matrix[items[word]]
        marked = f"<{word}>"
        for k in LENGTHS if found is None else ():
            items, matrix = self.tables[k]
            known = [items[g] for i in range(max(1, len(marked) - k + 1)) if (g := marked[i : i + k]) in items]
            if known:
                found = matrix[known].mean(axis=0)
                break
        self[word] = len(self.rows)
        self.rows.append(self.none if found is None else found)
        return self[word]


def predict(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The language of every whole text, with the posterior of the mean log score of up to 100 words.
    The model goes to every executor: for models that :func:`identify` has found small."""
    langs, base = _languages(model)
    sent = docs.sparkSession.sparkContext.broadcast((langs, _tables(model.toArrow(), langs, base)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, packed = sent.value
        tables = {k: (dict(zip(items.to_pylist(), range(len(items)), strict=True)), matrix) for k, (items, matrix) in packed.items()}
        scores = _Scores(tables, len(langs))
        for batch in batches:
            best, sure = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text.lower()) if text else []
                if not words or not langs:
                    best.append("und")
                    sure.append(0.0)
                    continue
                if len(scores.rows) > REMEMBERED:
                    scores = _Scores(tables, len(langs))
                used, counts = np.unique(np.fromiter(map(scores.__getitem__, words), np.int64, len(words)), return_counts=True)
                total = counts @ np.array([scores.rows[k] for k in used.tolist()])
                p = np.exp((total - total.max()) * min(1.0, 100 / len(words)))
                best.append(langs[int(p.argmax())])
                sure.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return needed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)


def marked(length: int) -> Callable[[Column], Column]:
    return lambda item: F.struct(F.lit(length).alias("length"), item.alias("item"))


def predict_joined(docs: DataFrame, model: DataFrame) -> DataFrame:
    """As :func:`predict`, for a model of any size: each distinct word is scored once, by joins
    with the model, and its scores are joined with the texts' counts of words."""
    langs, base = _languages(model)
    texts = needed(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    texts = texts.select("doc_id", "row", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    counted = staged(texts.groupBy("row", "doc_id", "word").agg(F.count("word").alias("n")), "words")
    if not langs:
        return counted.select("row", "doc_id").distinct().select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    lang = F.array_position(F.array(*map(F.lit, langs)), F.col("lang"))
    log = F.log("n") - F.log(F.col("total") + 1.0)
    held = model.groupBy("length", "item").agg(F.map_from_entries(F.collect_list(F.struct(lang.alias("lang"), log.alias("log")))).alias("logs"))  # a language each
    absent = F.create_map(*[x for k, row in base.items() for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in row]))])[F.col("length")]
    rows = held.select("length", "item", F.transform(absent, lambda b, i: F.coalesce(F.try_element_at("logs", (i + 1).cast("long")), b)).alias("scores"))

    words = counted.filter("word is not null").select("word").distinct()
    known = rows.filter("length = 0").select(F.col("item").alias("word"), "scores")
    looked = staged(words.join(known, "word", "left"), "looked-up")
    grams = F.concat(*[F.transform(grams_of("word", k), marked(k)) for k in LENGTHS])
    unseen = looked.filter("scores is null").select("word", F.inline(grams)).join(rows.filter("length > 0"), ["length", "item"])
    means = unseen.groupBy("word", "length").agg(F.array(*[F.avg(F.col("scores")[i]) for i in range(len(langs))]).alias("scores"))
    backed = means.groupBy("word").agg(F.max_by("scores", "length").alias("scores"))
    scored = looked.filter("scores is not null").unionByName(backed)

    sums = (
        counted.join(scored, "word", "left").groupBy("row", "doc_id")
        .agg(F.sum("n").alias("words"), F.array(*[F.coalesce(F.sum(F.col("n") * F.col("scores")[i]), F.lit(0.0)) for i in range(len(langs))]).alias("sums"))
    )
    top = F.array_max("sums")
    p = F.transform("sums", lambda x: F.exp((x - top) * F.least(F.lit(1.0), 100 / F.col("words"))))
    best = F.array(*map(F.lit, langs))[(F.array_position("sums", top) - 1).cast("int")]
    return sums.select(
        "doc_id",
        F.when(F.col("words") > 0, best).otherwise("und").alias("lang_pred"),
        F.when(F.col("words") > 0, 1 / F.aggregate(p, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0).alias("score"),
    )


def identify(docs: DataFrame, *, max_rows: int = 20_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Learn from the text and lang of rows outside fold 1, and predict every row
    (columns ``doc_id, text, lang``; others are ignored). A model of up to ``most_bytes`` is
    broadcast, a larger one joined (long sums may then differ in their last digits).

    A null text, or one without letters (numbers such as ½ or Ⅻ are none), gives ``und`` with score 0;
    so does everything if no row can be learnt from. Of languages with one score the first in
    the alphabet wins. Rows with a null lang are not learnt from; rows with a null doc_id
    are predicted with a null held_out and not learnt from. Repeated rows are predicted one by
    one; an empty table gives no rows. Returns doc_id, held_out, lang_pred, score.
    """
    model = fit(docs.filter(fold() != 1), max_rows=max_rows)
    items = model.groupBy("length", "item").agg(F.count("*").alias("n"))
    row = F.octet_length("item") + 32 + 4 * F.lit(model.agg(F.count_distinct("lang")).first()[0])  # a row of the matrix that is sent
    size = items.agg(F.sum(F.greatest(row, 32 * F.col("n")))).first()[0] or 0  # or, if larger, of the counts it is made from
    out = (predict if size <= most_bytes else predict_joined)(docs, model)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")
