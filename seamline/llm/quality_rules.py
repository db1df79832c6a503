"""Quality rules: base statistics, and perplexity bands of an n-gram model.

The model is a character n-gram model with modified Kneser-Ney smoothing. Spark counts the
n-grams of every text up to one character more than the model's order; n-grams are keyed by
64-bit hashes that include the language, so counts are exact whatever the corpus's size. Each
order is stored as a sorted array of hashes with the log probabilities and back-off weights in
the same order (16 bytes an entry). A model of more than ``MOST_ENTRIES`` entries is neither
collected nor broadcast: Spark computes its probabilities, and n-grams are looked up by a join.

All orders, the highest too, use continuation counts (distinct characters before an n-gram),
so that thousands of copies of one text make its n-grams no likelier than one copy does and
the lower end of a band finds monotonous text, not copied text.

For each language, all documents give the median log perplexity and its median absolute
deviation; documents below the lower or above the upper end of the band are rejected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import needed, scratch, staged
from ._words import IS_SPACE, U64, mix, slices, text_buffers, windows

ORDER = 4
#: Entries of a model that the driver computes and broadcasts: some 130 MB there, 70 MB in a worker.
MOST_ENTRIES = 4_000_000
_RADIX = 0x2545F4914F6CDD1D
_BLANK = " \t\n\v\f\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
CHUNK_BYTES = 1 << 19
RECENT_BITS, REMEMBERED = 18, 1 << 21

NGRAM_SCHEMA = "n int, gram long, context long, suffix long"
SCORE_SCHEMA = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_chars long, log_loss double"
)


@lru_cache(maxsize=10_000)
def _seed(lang: str) -> int:
    """64 bits of a hash of a language's whole name."""
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _seeds(langs: list[str | None]) -> np.ndarray:
    return np.array([_seed(x or "und") for x in langs], U64)


def _hashes(column: pa.Array, langs: list[str | None], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of texts: their first row, the offsets of texts among scored characters, and for
    each order the hash of the n-gram that ends at each padded character; row 0 is the mask
    of scored characters."""
    seeds, at = mix(_seeds(langs)), text_buffers(column)[1]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        parts = [np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32) for x in column.slice(first, last - first).to_pylist()]
        sizes = np.array([len(p) for p in parts])
        starts = np.concatenate(([0], np.cumsum(sizes + order)))
        code = np.full(starts[-1], 2, U64)
        real = np.zeros(starts[-1], bool)
        for p, s in zip(parts, starts, strict=False):
            code[s + order : s + order + len(p)] = p
            real[s + order : s + order + len(p)] = True
        seed = np.repeat(seeds[first:last], sizes + order)
        rows, total_hash, power = [], np.zeros(len(code), U64), 1
        for n in range(order):
            total_hash[n:] += code[: len(code) - n] * U64(power)
            power = power * _RADIX & (1 << 64) - 1
            rows.append(mix(total_hash + seed, n + 1))
        yield first, real, np.concatenate(([0], np.cumsum(sizes))), rows
        first = last


class _Seen:
    """The n-grams that a task has sent, up to ``REMEMBERED`` of them: what it forgets is sent again."""

    def __init__(self) -> None:
        self.recent = np.zeros(1 << RECENT_BITS, U64)  # most n-grams are found here, by the whole hash
        self.all = np.zeros(0, U64)

    def new(self, grams: np.ndarray) -> np.ndarray:
        """The places of one of each n-gram that is not yet sent."""
        slot = (grams >> U64(64 - RECENT_BITS)).astype(np.int32)
        at = np.flatnonzero(self.recent[slot] != grams)
        self.recent[slot[at]] = grams[at]
        found, first = np.unique(grams[at], return_index=True)
        if len(self.all):
            fresh = self.all[np.minimum(np.searchsorted(self.all, found), len(self.all) - 1)] != found
            found, first = found[fresh], first[fresh]
        self.all = np.sort(np.concatenate((self.all if len(self.all) <= REMEMBERED else self.all[:0], found)), kind="stable")
        return at[first]


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Continuation counts of all n-grams of all texts: how many distinct characters stand
    before each. A task sends each n-gram of up to ``order + 1`` characters about once."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [_Seen() for _ in range(order + 1)]
        for batch in batches:
            for _, real, _, rows in _hashes(batch.column(0), batch.column(1).to_pylist(), order + 1):
                at = np.flatnonzero(real)
                for n in range(order + 1):
                    own = at[seen[n].new(rows[n][at])]
                    for a in range(0, len(own), 50_000):
                        u = own[a : a + 50_000]
                        none = np.zeros(len(u), U64)
                        columns = rows[n][u], rows[n - 1][u - 1] if 0 < n < order else none, rows[n - 1][u] if n else none
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), n + 1, np.int32)), *(pa.array(x.view(np.int64)) for x in columns)], names=["n", "gram", "context", "suffix"])

    grams = (
        needed(docs, "text", "lang")
        .mapInArrow(distinct, NGRAM_SCHEMA)
        .groupBy("n", "gram")
        .agg(F.max("context").alias("context"), F.max("suffix").alias("suffix"))
    )
    grams = staged(grams, "ngrams")
    before = grams.filter(F.col("n") > 1).groupBy((F.col("n") - 1).alias("n"), F.col("suffix").alias("gram")).agg(F.count("*").cast("int").alias("count"))
    return grams.filter(F.col("n") <= order).join(before, ["n", "gram"], "left").select("n", "gram", F.coalesce("count", F.lit(1)).alias("count"), "context", "suffix")


def _discounts(of: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more, from the numbers of
    n-grams with counts of 1, 2, 3 and 4."""
    of = of.astype(float) + 1e-9
    y = of[0] / (of[0] + 2 * of[1])
    d = np.array([0, *(k - (k + 1) * y * of[k] / of[k - 1] for k in (1, 2, 3))])
    return np.clip(d, [0, 0.01, 0.01, 0.01], [0, 0.99, 1.99, 2.99])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> list[tuple[np.ndarray, ...]]:
    """The model from the counts: for each order sorted hashes, log probabilities and log
    back-off weights. Contexts that are no n-grams of a text (its start) have a weight only."""
    table = counts.toArrow()
    held = {k: table.column(k).to_numpy() for k in ("n", "gram", "count", "context", "suffix")}
    model, lower = [], None
    for n in range(order):
        own = np.flatnonzero(held["n"] == n + 1)
        t = {k: v[own].view(U64) if v.dtype == np.int64 else v[own] for k, v in held.items()}
        by = np.argsort(t["gram"])
        gram, context, suffix, c = t["gram"][by], t["context"][by], t["suffix"][by], t["count"][by].astype(np.int64)
        d = _discounts(np.bincount(np.minimum(c, 5), minlength=6)[1:5])[np.minimum(c, 3)]
        contexts, where = np.unique(context, return_inverse=True)
        total, left = np.bincount(where, c), np.bincount(where, d)
        share = left / np.maximum(total, 1)
        base = lower[np.searchsorted(model[n - 1][0], suffix)] if n else 1.0 / max(2, len(gram) + 1)
        p = (c - d) / np.maximum(total[where], 1) + share[where] * base
        if n:
            grams, logp, _ = model[n - 1]
            every = np.union1d(grams, contexts)
            known, back = np.full(len(every), -np.inf, np.float32), np.zeros(len(every), np.float32)
            known[np.searchsorted(every, grams)] = logp
            back[np.searchsorted(every, contexts)] = np.log(np.maximum(share, 1e-12))
            model[n - 1] = (every, known, back)
        model.append((gram, np.log(np.maximum(p, 1e-12)).astype(np.float32), np.zeros(len(gram), np.float32)))
        lower = p
    return model


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """The log probabilities of the n-grams of the highest order, as :func:`kneser_ney` has them,
    computed by Spark for counts of any size: gram, logp."""
    numbers = np.zeros((order + 1, 6))
    for n, count, number in counts.groupBy("n", F.least("count", F.lit(5)).alias("count")).agg(F.count("*")).collect():
        numbers[n, count] = number
    lower = None
    for n in range(1, order + 1):
        d = [float(x) for x in _discounts(numbers[n, 1:5])]
        discount = F.when(F.col("count") == 1, d[1]).when(F.col("count") == 2, d[2]).otherwise(d[3])
        own = counts.filter(F.col("n") == n).withColumn("discount", discount)
        totals = own.groupBy("context").agg(F.sum("count").alias("total"), F.sum("discount").alias("left"))
        rows = own.join(totals, "context")
        rows = rows.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("base")), "suffix") if n > 1 else rows.withColumn("base", F.lit(1.0 / max(2, int(numbers[1].sum()) + 1)))
        p = (F.col("count") - F.col("discount") + F.col("left") * F.col("base")) / F.col("total")
        lower = staged(rows.select("gram", p.alias("p")), f"probabilities{n}")
    return lower.select("gram", F.log(F.greatest("p", F.lit(1e-12))).alias("logp"))


def text_statistics(column: pa.Array, size: int = 5) -> Iterator[tuple[int, int, int, int, int]]:
    """Words, characters in words, symbols, duplicate lines and repeated words of each text."""
    for part in slices(column, lower=False):
        in_word = ~IS_SPACE[part.data] & ((part.data & 0xC0) != 0x80)
        chars = np.concatenate(([0], np.cumsum(in_word)))[part.at]
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[part.data])))[part.at]
        full = windows(part.words, size)
        for k in range(part.last - part.first):
            a, b = part.word_at[k], part.word_at[k + 1]
            repeated = 0
            if b - a > size:
                own = full[a : b - size + 1]
                order = np.argsort(own, kind="stable")
                same = own[order][1:] == own[order][:-1]
                if same.any():
                    marks = np.zeros(b - a + 1, np.int64)
                    twice = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
                    marks[twice] += 1
                    marks[twice + size] -= 1
                    repeated = int((np.cumsum(marks) > 0).sum())
            lines = part.data[part.at[k] : part.at[k + 1]].tobytes().split(b"\n")
            lines = [x for x in lines if x.strip(b" \t\n\v\f\r")] if len(lines) > 1 else []
            yield int(b - a), int(chars[k + 1] - chars[k]), int(symbols[k + 1] - symbols[k]), len(lines) - len(set(lines)), repeated


class _Order:
    """The sorted hashes of one order, with an index of where each prefix of bits begins."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray, back: np.ndarray) -> None:
        self.shift = U64(64 - max(1, len(grams).bit_length()))
        prefixes = np.arange(1 << 64 - int(self.shift), dtype=U64) << self.shift
        self.starts = np.searchsorted(grams, prefixes).astype(np.int32)
        self.grams = np.append(grams, U64((1 << 64) - 1))
        self.logp, self.back = np.append(logp, np.float32(-np.inf)), np.append(back, np.float32(0))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The place of each hash; the last one, without a probability, if it isn't there."""
        at = self.starts[(grams >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.grams[at] < grams)
        while len(todo):
            at[todo] += 1
            todo = todo[self.grams[at[todo]] < grams[todo]]
        return np.where(self.grams[at] == grams, at, len(self.grams) - 1)


def _losses(model: list[_Order], rows: list[np.ndarray], where: np.ndarray) -> np.ndarray:
    """Log probabilities of the characters at some places, by the longest known n-gram."""
    logp = model[-1].logp[model[-1].find(rows[-1][where])]
    missing = np.flatnonzero(np.isneginf(logp))
    if len(missing):
        at = where[missing]
        low = model[0].logp[model[0].find(rows[0][at])]
        low[np.isneginf(low)] = np.log(1e-9)
        for n in range(1, len(model)):
            found = model[n].logp[model[n].find(rows[n][at])]
            back = model[n - 1].back[model[n - 1].find(rows[n - 1][at - 1])]
            low = np.where(np.isneginf(found), low + back, found)
        logp[missing] = low
    return logp


def score(docs: DataFrame, model: list[tuple[np.ndarray, ...]], order: int = ORDER) -> DataFrame:
    """Base statistics and the model's total log loss of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_Order(*x) for x in sent.value]
        for batch in batches:
            text, langs = batch.column(1), batch.column(2).to_pylist()
            sizes, losses = np.zeros(len(text), np.int64), np.zeros(len(text))
            for first, real, at, rows in _hashes(text, langs, order):
                sums = np.concatenate(([0.0], np.cumsum(_losses(own, rows, np.flatnonzero(real)), dtype=np.float64)))
                sizes[first : first + len(at) - 1] = np.diff(at)
                losses[first : first + len(at) - 1] = -np.diff(sums[at])
            stats = np.array(list(text_statistics(text)), np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(stats[:, k]) for k in range(5)), pa.array(sizes), pa.array(losses)],
                names=[x.split()[0] for x in SCORE_SCHEMA.split(", ")],
            )

    return needed(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(rate, SCORE_SCHEMA)


def score_by_join(docs: DataFrame, logp: DataFrame, order: int = ORDER) -> DataFrame:
    """As :func:`score`, for the texts that the model was counted on: all their n-grams of the
    highest order have a probability, and each text's distinct ones are joined with it."""
    parts = SCORE_SCHEMA.split(", ")[:-1]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(x.split()[0] for x in parts), "grams", "times"]
        for batch in batches:
            text, langs = batch.column(1), batch.column(2).to_pylist()
            stats = np.array(list(text_statistics(text)), np.int64).reshape(-1, 5)
            for first, real, at, rows in _hashes(text, langs, order):
                n, grams = len(at) - 1, rows[-1][real]
                each = [np.unique(grams[at[k] : at[k + 1]], return_counts=True) for k in range(n)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x, _ in each]))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in each]).view(np.int64))) for k in (0, 1)]
                own = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), *(pa.array(stats[first : first + n, k]) for k in range(5)), pa.array(np.diff(at).astype(np.int64)), *lists], names=names)

    rows = needed(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.mapInArrow(rate, ", ".join([*parts, "grams array<long>, times array<long>"])).withColumn("row", F.monotonically_increasing_id())
    # what belongs to a text goes with its first n-gram only
    held = F.struct(*[x.split()[0] for x in parts])
    each = rows.select("row", held.alias("held"), F.posexplode_outer(F.arrays_zip("grams", "times")).alias("k", "z"))
    each = each.select("row", F.when(F.coalesce("k", F.lit(0)) == 0, F.col("held")).alias("held"), F.col("z.grams").alias("gram"), F.col("z.times").alias("times"))
    summed = each.join(logp, "gram", "left").groupBy("row").agg(F.max("held").alias("held"), F.sum(-F.col("times") * F.col("logp")).alias("log_loss"))
    return summed.select("held.*", F.coalesce("log_loss", F.lit(0.0)).alias("log_loss"))


def quality_rules(
    docs: DataFrame, *, lower: float = 4.0, upper: float = 4.0, least_sd: float = 0.02, order: int = ORDER, most_entries: int = MOST_ENTRIES, min_words: int = 10, max_repeat_percent: int = 20, broadcast_langs: int = 10_000
) -> DataFrame:
    """Judge every document (columns ``doc_id, text, lang``; others are ignored).

    ``lower`` and ``upper``: ends of a language's band below and above its median log
    perplexity, in standard deviations (as 1.4826 times the median absolute deviation). Four keep
    clean documents even where a third of a language's rows are copies of one text, which move the
    median by 0.7 deviations at most;
    short texts get a wider band, by ``sqrt(1 + median length / length)``. ``least_sd``:
    the least standard deviation assumed, in nats a character. ``broadcast_langs``: up to so many
    languages' bands are broadcast, more are joined by shuffle. ``most_entries``: a model of up to
    so many n-grams is broadcast, a larger one joined by shuffle.

    A null or empty text has no words and fails the base rules; a null ``lang`` counts as the
    language ``und``; repeated rows are judged one by one; an empty table gives no rows.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), lang, perplexity (double, null without characters), reason.
    """
    with scratch(docs.sparkSession):
        counts = staged(count_ngrams(docs, order), "counts")
        if counts.count() <= most_entries:
            scored = score(docs, kneser_ney(counts, order), order)
        else:
            scored = score_by_join(docs, log_probabilities(counts, order), order)
        scored = staged(scored, "scored", keep=True)
    loss = F.when(F.col("n_chars") > 0, F.col("log_loss") / F.col("n_chars"))
    rated = scored.withColumns({"lang": F.coalesce("lang", F.lit("und")), "loss": loss})
    full = rated.filter(F.col("n_words") >= min_words)
    few = F.broadcast if full.select("lang").distinct().count() <= broadcast_langs else lambda x: x
    middle = staged(full.groupBy("lang").agg(F.percentile_approx("loss", 0.5, 10_000).alias("mid"), F.percentile_approx("n_chars", 0.5, 10_000).alias("mid_chars")), "middle")
    spread = full.join(few(middle), "lang").groupBy("lang").agg((1.4826 * F.percentile_approx(F.abs(F.col("loss") - F.col("mid")), 0.5, 10_000)).alias("sd"))
    bands = few(staged(middle.join(spread, "lang"), "bands"))
    width = F.greatest(F.lit(least_sd), F.col("sd")) * F.sqrt(1 + F.col("mid_chars") / F.col("n_chars"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    far = F.col("loss") - F.col("mid")
    reason = (
        F.when(failed, "base").when(far > upper * width, "perplexity above band").when(far < -lower * width, "perplexity below band")
    )
    return (
        rated.join(bands, "lang", "left")
        .withColumn("reason", reason)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
            F.col("reason").isNull().alias("kept"), "lang", F.exp("loss").alias("perplexity"), "reason",
        )
    )
