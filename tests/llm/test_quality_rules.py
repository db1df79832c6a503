"""The n-gram model against a plain Kneser-Ney, and both ends of the band."""

import math
import random
from collections import Counter, defaultdict

import pytest

from seamline.llm.quality_rules import ORDER, quality_rules


def plain_perplexities(rows, order=ORDER):
    """Modified Kneser-Ney on continuation counts of all orders, with dictionaries."""
    grams = {n: set() for n in range(1, order + 2)}
    padded = [(lang, "\2" * order + text) for text, lang in rows]
    for lang, t in padded:
        for i in range(order, len(t)):
            for n in grams:
                grams[n].add((lang, t[i + 1 - n : i + 1]))
    count = {n: Counter((lang, g[1:]) for lang, g in grams[n + 1]) for n in range(1, order + 1)}
    p = {}
    for n in range(1, order + 1):
        of = [sum(c == k for c in count[n].values()) + 1e-9 for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        d = [min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.01), k - 0.01) for k in (1, 2, 3)]
        discount = lambda c, d=d: d[min(c, 3) - 1]
        total, left = defaultdict(float), defaultdict(float)
        of_context = lambda lang, g, n=n: (lang, g[:-1]) if n > 1 else None
        for (lang, g), c in count[n].items():
            total[of_context(lang, g)] += c
            left[of_context(lang, g)] += discount(c)
        for (lang, g), c in count[n].items():
            base = p[lang, g[1:]] if n > 1 else 1 / max(2, len(count[1]) + 1)
            context = of_context(lang, g)
            p[lang, g] = (c - discount(c)) / total[context] + left[context] / total[context] * base
    return [math.exp(-sum(math.log(p[lang, t[i + 1 - order : i + 1]]) for i in range(order, len(t))) / (len(t) - order)) for lang, t in padded]


def sentences(r, n):
    words = ["the", "river", "runs", "under", "an", "old", "stone", "bridge", "and", "every", "morning", "boats", "pass", "with", "fresh", "bread", "for", "markets", "beyond", "hills"]
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.mark.parametrize("most_entries", [4_000_000, 0])
def test_perplexities(spark, most_entries):
    r = random.Random(1)
    rows = [(sentences(r, 30), r.choice(["en", "xx"])) for _ in range(25)] + [("übergrößen 漢字 🙂 ab ab ab ab ab ab ab ab ab", "xx")]
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = {x["doc_id"]: x["perplexity"] for x in quality_rules(df, most_entries=most_entries).collect()}
    assert [got[k] for k in range(len(rows))] == pytest.approx(plain_perplexities(rows), rel=1e-4)


def reasons(spark, texts):
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    return [r["reason"] for r in quality_rules(df, max_repeat_percent=100).orderBy("doc_id").collect()]


def test_both_ends_of_the_band(spark):
    r = random.Random(2)
    noise = "".join(chr(c) for c in range(33, 126)) + " " * 12
    found = reasons(spark, [sentences(r, 120) for _ in range(200)] + ["".join(r.choice(noise) for _ in range(700)) for _ in range(4)])
    assert found == [None] * 200 + ["perplexity above band"] * 4
    letters = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 8)))
    varied = [" ".join(r.choice((letters(), sentences(r, 1))) for _ in range(120)) for _ in range(100)]
    assert reasons(spark, [*varied, "ab " * 250]) == [None] * 100 + ["perplexity below band"]
