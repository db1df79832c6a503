"""Language identification against a plain Python version, with the model sent and with it joined."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from seamline.llm.language_id import LENGTHS, identify

from . import brute


def grams(word, k):
    marked = f"<{word}>"
    return [marked[i : i + k] for i in range(max(1, len(marked) - k + 1))]


def letters(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def plain(docs):
    """lang_pred and score of each row, by loops over all rows."""
    counts = defaultdict(Counter)
    for doc_id, text, lang, _ in docs:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1 and lang is not None:
            for w in letters(text):
                counts[lang, 0][w] += 1
                for k in LENGTHS:
                    counts[lang, k].update(grams(w, k))
    langs = sorted({lang for lang, _ in counts})
    totals = {key: sum(c.values()) for key, c in counts.items()}

    def score(item, k, lang):
        return math.log(counts[lang, k][item] or 0.5) - math.log(totals.get((lang, k), 1) + 1)

    def known(item, k):
        return any(counts[lang, k][item] for lang in langs)

    def word_scores(w):
        if known(w, 0):
            return [score(w, 0, lang) for lang in langs]
        for k in LENGTHS:
            found = [g for g in grams(w, k) if known(g, k)]
            if found:
                return [sum(score(g, k, lang) for g in found) / len(found) for lang in langs]
        return [0.0] * len(langs)

    rows, scores = [], {}
    for doc_id, text, *_ in docs:
        words = letters(text)
        if not words or not langs:
            rows.append((doc_id, "und", 0.0))
            continue
        sums = [0.0] * len(langs)
        for w in words:
            if w not in scores:
                scores[w] = word_scores(w)
            sums = [a + b for a, b in zip(sums, scores[w], strict=True)]
        p = [math.exp((x - max(sums)) * min(1.0, 100 / len(words))) for x in sums]
        rows.append((doc_id, langs[p.index(max(p))], 1 / sum(p)))
    return rows


def held_against(found, docs):
    def order(row):
        return (row[0] is None, row[0] or 0, row[1], row[2])

    found = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in found.collect()), key=order)
    want = sorted(plain(docs), key=order)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in want], abs=1e-5)


UNSEEN = [(100_003 + i, t, None, "s") for i, t in enumerate(["zzzqqq thes unddie", "漢字", "ab", "x" * 3000, "ñandú" * 5])]


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_both_ways_equal_the_plain_version(spark, sf_dir, most_bytes):
    docs = brute.table(sf_dir, "documents", "doc_id, text, lang, source") + UNSEEN
    held_against(identify(spark.createDataFrame(docs, brute.DOC_SCHEMA), most_bytes=most_bytes), docs)


@pytest.mark.parametrize("most_bytes", [64 << 20, -1])
def test_both_ways_on_awkward_rows(spark, most_bytes):
    held_against(identify(spark.createDataFrame(brute.AWKWARD, brute.DOC_SCHEMA), most_bytes=most_bytes), brute.AWKWARD)
    unlabelled = [(d, t, None, s) for d, t, _, s in brute.AWKWARD]
    held_against(identify(spark.createDataFrame(unlabelled, brute.DOC_SCHEMA), most_bytes=most_bytes), unlabelled)
    assert identify(spark.createDataFrame([], brute.DOC_SCHEMA), most_bytes=most_bytes).count() == 0
