"""The n-gram join on groups of near copies: exact components, and no pair twice."""

import random
from collections import Counter

import numpy as np

from seamline.llm import ngram_join
from seamline.llm.ngram_join import _pack, _unpack, jaccard_components

from . import brute


def noisy_copies(count, seed=3):
    """Copies of one text with more and more words changed, and texts that only share a passage."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    out = []
    for i in range(count):
        own = list(base)
        for _ in range(r.randrange(8)):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        out.append((i, " ".join(own)))
    passage = [f"p{k}" for k in range(40)]
    for i in range(count, count + 15):
        own = [f"q{r.randrange(10**6)}" for _ in range(r.choice((3, 8, 11, 14, 30)))]
        out.append((i, " ".join(own + passage)))
    r.shuffle(out)
    return out


def test_groups_of_near_copies(spark, monkeypatch):
    rows = noisy_copies(70)
    seen, before = Counter(), ngram_join.verified

    def counted(pairs, sets, percent):
        seen.update((r["a"], r["b"]) for r in pairs.collect())
        return before(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()} == brute.components(rows)
    assert max(seen.values()) == 1  # each pair once
    assert len(seen) < 85 * 84 / 4  # and far from all of them


def templated(count, seed=8):
    """Texts of twelve slots with five variants each, a few with a word changed: nearly all pairs share
    prefix tokens, next to none reach the similarity."""
    r = random.Random(seed)
    slots = [[[f"s{k}v{v}w{w}" for w in range(9)] for v in range(5)] for k in range(12)]
    out = []
    for i in range(count):
        own = [w for slot in slots for w in r.choice(slot)]
        if i % 10 == 9:
            own = out[-1][1].split(" ")
            own[r.randrange(len(own))] = f"x{i}"
        out.append((i, " ".join(own)))
    return out


def test_templated_texts_make_pairs_in_proportion(spark, monkeypatch):
    sent, before = [], ngram_join.verified

    def counted(pairs, sets, percent):
        sent.append(pairs.count())
        return before(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "verified", counted)
    totals = []
    for count in (300, 1200):
        sent.clear()
        rows = templated(count)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()}
        totals.append(sum(sent))
        assert got == brute.components(rows)
    assert totals[1] < 6 * totals[0], totals
    assert totals[1] < 1200 * 1199 / 2 / 10, totals


def test_bitmaps_leave_no_similar_pair_out(spark):
    """On sets of all kinds of sizes and overlaps, lengths of bitmaps that differ included."""
    r = np.random.default_rng(5)
    for percent in (75, 40):
        rows = []
        for n in (1, 2, 63, 64, 65, 127, 128, 129, 300, 1000):
            for share in (0.0, 0.5, 0.8, 0.9, 0.97, 1.0):
                a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
                extra = np.unique(r.integers(0, 2**63, int(n * r.random() * (100 / percent - 1)), dtype=np.uint64))
                b = np.union1d(a[: round(share * len(a))], extra)
                if not len(b) or min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
                    continue
                common = len(np.intersect1d(a, b))
                similar = common * 100 >= percent * (len(a) + len(b) - common)
                rows.append((ngram_join._bitmap(a).tolist(), ngram_join._bitmap(b).tolist(), len(a), len(b), similar, common))
        df = spark.createDataFrame(rows, "p array<long>, q array<long>, n long, m long, similar boolean, common long")
        got = df.withColumn("may", ngram_join.may_reach(*(df[c] for c in "pqnm"), percent)).collect()
        assert sum(x["similar"] for x in got) > 10
        assert all(x["may"] for x in got if x["similar"])
        if percent == 75:
            assert not any(x["may"] for x in got if x["common"] == 0 and x["n"] > 100)


def test_many_blocks_and_joined_lookups(spark, monkeypatch):
    """Blocks of a few tokens, and nodes that don't fit a bit table, give the same."""
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    monkeypatch.setattr(ngram_join, "SHARD", 500)
    monkeypatch.setattr(ngram_join, "MOST_NODES", 10)
    rows = noisy_copies(25, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()} == brute.components(rows)


def test_one_id_with_several_texts_joins_their_components(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    df = spark.createDataFrame([(7, a), (7, b), (3, a), (5, b), (9, b + " more")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_components(df).collect()} == {3}


def test_payloads_keep_their_columns():
    columns = np.array([5, 2**63, 0], np.uint64), np.array([1, 2, 3], np.uint64)
    assert all((x == y).all() for x, y in zip(_unpack(_pack(*columns)), columns, strict=True))
    assert [len(x) for x in _unpack(_pack(columns[0][:0], columns[1][:0]))] == [0, 0]
