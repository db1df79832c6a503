"""Nulls, empty and long texts, ties, repeated rows, empty tables, and clashing extra columns."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seamline.llm import secrets
from seamline.llm.decontamination import contaminated
from seamline.llm.html_extraction import extract_text
from seamline.llm.language_id import identify
from seamline.llm.ngram_join import connect, jaccard_components
from seamline.llm.packing import first_fit_decreasing, pack
from seamline.llm.quality_classifier import classify
from seamline.llm.quality_rules import quality_rules
from seamline.llm.secrets import mask, scan
from seamline.llm.token_counts import Encoder, count_in_chunks, token_counts
from seamline.llm.url_filter import judge_urls

from . import brute

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
#: Names that operators use themselves.
CLASHING = ("n", "key", "node", "token", "hash", "held", "base", "live", "label", "loss", "group", "host", "score", "n_words", "kept", "part", "counts", "item_id", "start", "order")


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(brute.AWKWARD, brute.DOC_SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def by_id(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def expected(*functions):
    return sorted(((d, *(f(t) for f in functions)) for d, t, *_ in brute.AWKWARD), key=lambda r: tuple((x is None, x) for x in r))


def test_quality_rules(awkward, empty):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = by_id(quality_rules(awkward), "doc_id", *names)
    assert got == expected(*[lambda t, k=k: brute.base_rules(t)[k] for k in range(5)])
    assert quality_rules(empty).count() == 0


def test_token_counts(awkward, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = expected(lambda t: len((t or "").encode()), lambda t: len(model.encode(t or "")))
    assert by_id(token_counts(awkward, PIECES), "doc_id", "n_bytes", "n_tokens") == want
    # every text that is long enough in chunks, with small chunks and overlaps
    assert by_id(token_counts(awkward, PIECES, huge_bytes=64, chunk_bytes=48, overlap_bytes=8), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts(empty, PIECES).count() == 0


def test_chunks_of_hostile_texts():
    import random

    encoder, chance = Encoder(PIECES), random.Random(3)
    for k in range(150):
        alphabet = ["ab ", "a  b", " é漢🙂", "aaaa", "▁ x", "\n\t y", "the quick brown "][k % 7]
        text = "".join(chance.choice(alphabet) for _ in range(chance.randint(40, 900)))
        assert count_in_chunks(encoder, text, 50, 6)[0] == len(encoder.model.encode(text)), repr(text)
        assert encoder.counts([text]) == [len(encoder.model.encode(text))], repr(text)


def test_packing(awkward, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    want = Counter((d, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")[:1024].tobytes())) for d, t, *_ in brute.AWKWARD)
    for given in ({}, {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}):
        found = pack(awkward, BYTES, **given).collect()
        assert Counter((r["doc_id"], r["ids_crc32"]) for r in found if r["start"] == 0) == want
        assert sum(r["length"] for r in found) == sum(r["doc_tokens"] for r in found if r["start"] == 0)
    assert pack(empty, BYTES).count() == 0


def test_first_fit_decreasing():
    chance = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 300):
        sizes = chance.integers(1, 101, n)
        bins, offsets, used = first_fit_decreasing(sizes, 100)
        free: list[int] = []
        for k in np.argsort(-sizes, kind="stable"):
            at = next((b for b, f in enumerate(free) if f >= sizes[k]), len(free))
            if at == len(free):
                free.append(100)
            assert (bins[k], offsets[k]) == (at, 100 - free[at])
            free[at] -= sizes[k]
        assert used == len(free)


def test_decontamination(spark, awkward, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "One Two THREE"), (1, item), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(50, "x " * 5000 + item + " y" * 5000), (51, item.replace("kappa", "other")), (52, "alpha beta gamma"), (53, None), (54, item.upper())], "doc_id long, text string")
    found = by_id(contaminated(docs.withColumn("hash", F.lit(1)), items).filter("item_id is not null"), "doc_id", "item_id", "n_item", "n_common")
    assert found == [(50, 1, 6, 6), (51, 1, 6, 5), (54, 1, 6, 6)]
    assert by_id(contaminated(awkward, items).filter("item_id = 4"), "doc_id", "item_id") == [(4, 4)]
    assert contaminated(empty, items).count() == contaminated(awkward, items.limit(0)).count() == 0


def test_short_items_are_found_inside_documents(spark):
    items = spark.createDataFrame([(1, "Solo"), (2, "two words"), (4, "a b  c D"), (5, "a b c d e"), (6, "absent item")], "item_id long, text string")
    texts = {10: "here stands SOLO among other words", 11: "x two words y z and more", 12: "two other words in this text", 13: "w a b c d e", 14: "a b c", 15: "two\nwords", 16: "words solo", 17: None, 18: "b c a b c d"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = by_id(contaminated(docs, items), "doc_id", "item_id", "n_item", "n_common")
    assert found == [(d, i, 1, 1) for d, i in ((10, 1), (11, 2), (13, 4), (13, 5), (15, 2), (16, 1), (18, 4))]


def test_secret_scans(spark, awkward, empty):
    found = by_id(scan(awkward), "doc_id", "n_assign", "n_access", "n_hex")
    assert found == expected(*[lambda t, k=k: sum(s[2] == k for s in brute.secrets(t)) for k in ("assign", "access", "hex")])
    assert max(found, key=lambda r: r[1] if r[0] == 10 else 0)[1:] == (1, 1, 1)
    assert scan(empty).count() == 0
    # one value that many owners hold, one that a single owner holds, a further token of a single owner
    copied, own, further = "password=changeme123", "api_key = s3cr3tS3CR3T99", "Zx81QpLm04TyUi77AsDfGhJk22Zz"
    docs = [(k, f"see {copied} here" + (f" and {own} or {further} 🙂" if k == 3 else ""), f"owner{k}") for k in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    r = {x["doc_id"]: x for x in scan(df).collect()}
    assert (r[3]["n_assign"], r[3]["n_live"], r[3]["n_example"], r[3]["n_added"]) == (2, 2, 1, 1)
    assert (r[0]["n_live"], r[0]["n_example"]) == (0, 1)
    text = docs[3][1]
    assert f"mixed:{text.index(further)}:{text.index(further) + len(further)}" in r[3]["spans"]
    masked = {x["doc_id"]: x for x in mask(df.withColumns({"live": F.lit(1), "n_chars": F.length("text")})).collect()}
    assert masked[3]["text"] == text.replace("s3cr3tS3CR3T99", "[secret]").replace(further, "[secret]")
    assert masked[3]["n_chars"] == len(masked[3]["text"]) and masked[3]["live"] == 1
    assert masked[0]["text"] == docs[0][1] and len(masked) == 6
    assert mask(awkward).count() == len(brute.AWKWARD)


@pytest.mark.parametrize("hot", [0, 4, 1000])
def test_secrets_copied_within_one_source(spark, monkeypatch, hot):
    """Values in many documents of a single source, or without one, are copied examples; those in a few are not.
    No value is judged apart, or some are, or all."""
    monkeypatch.setattr(secrets, "HOT", hot)
    copied, mixed, orphan = "password=changeme123", "Zx81QpLm04TyUi77AsDfGhJk22Zz", "token=n0s0urce99"
    few = "secret=s3cr3tS3CR3T99"
    docs = [(k, f"see {copied} or {mixed} here" + (f" and {few}" if k < 20 else ""), "hot") for k in range(40)] + [(100 + k, f"see {orphan}", None) for k in range(21)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    r = {x["doc_id"]: x for x in scan(df).collect()}
    assert {(r[k]["n_live"], r[k]["n_example"], r[k]["n_added"]) for k in range(20)} == {(1, 1, 0)}
    assert {(r[k]["n_live"], r[k]["n_example"], r[k]["n_added"]) for k in (*range(20, 40), *range(100, 121))} == {(0, 1, 0)}
    assert not any("mixed" in x["spans"] for x in r.values())
    masked = {x["doc_id"]: x["text"] for x in mask(df).collect()}
    assert masked == {d: t.replace("s3cr3tS3CR3T99", "[secret]") for d, t, _ in docs}
    # a repository that two owners hold counts once; the bound is a parameter
    shared = spark.createDataFrame([(k, copied, f"owner{k % 2}", f"repo{k // 2}") for k in range(6)], "doc_id long, text string, source string, repo string")
    assert {x["n_live"] for x in scan(shared, repository="repo", max_repositories=3).collect()} == {1}
    assert {x["n_live"] for x in scan(shared, repository="repo", max_repositories=2).collect()} == {0}


def test_language_id(spark, awkward, empty):
    found = identify(awkward).collect()
    assert len(found) == len(brute.AWKWARD)
    assert {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert all(0 <= r["score"] <= 1 for r in found)
    assert identify(empty).count() == 0


def test_url_filters(spark, empty):
    urls = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/7?x=1#y", "http://a.org/es/q", "http://example.net/de/81", "http://net/de/", "ftp://ü.example/ä b?#", "http://x.y?en/" + "9" * 5000, "http://com/en/", "http://com/en/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumns({"label": F.lit(1), "host": F.lit("h"), "suffix": F.lit("s")})
    r = {x["page_id"]: x for x in judge_urls(df).collect()}
    assert len(r) == len(urls)
    assert (r[0]["host"], r[0]["path"], r[2]["host"], r[3]["host"]) == ("", "", "", "")
    assert (r[4]["host"], r[4]["rule"], r[4]["verdict"]) == ("www.example.com", "example.com/en/7", "allow")
    assert (r[5]["rule"], r[6]["rule"], r[7]["rule"], r[10]["rule"]) == ("org/es/", "example.net/de/8", "net/de/", "com/en/")
    assert (r[8]["host"], r[8]["path"], r[9]["path"]) == ("ü.example", "/ä b", "")
    assert all(x["verdict"] in ("allow", "block") and 0 <= x["score"] <= 1 for x in r.values())
    assert judge_urls(df.limit(0)).count() == 0


def test_url_trees_learn(spark):
    df = spark.range(400).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://spam-"), "id", F.lit("-99-88.bad/a/b/c/d?x=1&y=2"))).otherwise(F.concat(F.lit("https://news"), F.lit(".good/article"))).alias("url"))
    rules = [("block", f"spam-{k}-99-88.bad/") for k in range(0, 100, 2)] + [("allow", "news.good/art")]
    found = judge_urls(df.filter("page_id % 2 = 0 or page_id < 100"), rules=rules).filter("rule is null").collect()
    assert len(found) == 150 and all(r["verdict"] == "block" for r in found)


def test_ngram_jaccard_join(spark, awkward, empty):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(awkward).filter("doc_id is not null").collect()}
    assert found == brute.components([(d, t) for d, t, *_ in brute.AWKWARD if d is not None])
    assert jaccard_components(awkward).filter("doc_id is null").first()["component_id"] is None
    assert jaccard_components(empty).count() == 0


def test_ngram_jaccard_join_of_random_texts(spark):
    import random

    chance = random.Random(5)
    rows, base = [], []
    for k in range(160):
        if base and chance.random() < 0.6:
            words = list(chance.choice(base))
            for _ in range(chance.choice([0, 0, 1, 1, 2, 3])):
                words[chance.randrange(len(words))] = f"w{chance.randrange(50)}"
            words = words[: max(1, len(words) - chance.choice([0, 0, 1, 4]))]
        else:
            words = [f"w{chance.randrange(30)}" for _ in range(chance.choice([2, 5, 8, 30, 60]))]
        base.append(words)
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()} == brute.components(rows)


def test_connect_follows_chains(spark):
    labels = spark.range(40).select(F.col("id").alias("node"), F.col("id").alias("label"))
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 29)] + [(35, 31), (31, 38)], "a long, b long")
    found = {r["node"]: r["label"] for r in connect(labels, links).collect()}
    assert found == {k: 0 if k <= 29 else 31 if k in (31, 35, 38) else k for k in range(40)}


def test_html_extraction(spark, empty):
    article = "<article><header><h1>Title &amp; more</h1><div>by x</div></header><p>One <b>two<p>Three&nbsp;four <span class='ad'>buy <span>now</span></span> five<aside>no</aside><div class=comments><p>nice</div></article>"
    pages = [(1, "http://a/1", f"<html><body class='has-sidebar'><header>Site</header><nav>m</nav>{article}<footer>f</footer>"), (2, None, None), (3, "http://a/2", ""), (4, "x", "plain  text\n here"),
             (5, "http://a/3", "<div><!-- unclosed <p>gone"), (6, "http://a/4", "<ul><li>a<li>b</ul><script>if (a<b) {}"), (6, "http://a/4", "<ul><li>a<li>b</ul><script>if (a<b) {}"), (7, "http://a/5", "<div>" * 3000 + "deep" + "<p q='" * 2000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "reference": F.lit("r"), "constant": F.lit(2)})
    found = [(r["page_id"], r["text"]) for r in extract_text(df).collect()]
    assert sorted(found)[:4] == [(1, "Title & more\n\nOne two\n\nThree four\n\nfive"), (2, ""), (3, ""), (4, "plain text here")]
    assert sorted(found)[4:7] == [(5, ""), (6, "a\n\nb"), (6, "a\n\nb")]
    assert sorted(found)[7][1].startswith("deep")
    assert extract_text(df.limit(0)).count() == 0


def test_marks_of_elements():
    from seamline.llm._dom import body, parse

    parts = {"<div class='page has-sidebar no-menu'>in</div>": "in", "<div class=topnav>x</div>in": "in", "<p>in<div id=ad12>x</div>": "in", "<section id='comments'><p>x</section>in": "in", "<div role=search>x</div>in": "in",
             "<ol class='comment-list'><li>x</ol>in": "in", "<div class='cookie-notice'>x</div>in": "in", "<div hidden>x</div>in": "in", "<form>x<p>y</form>in": "in", "<article class=comment>x</article><article>in</article>": "in", "<main><nav>x</nav>in</main>out": "in"}
    for html, text in parts.items():
        assert "\n\n".join(n.text for n in body(parse(html))[0]) == text, html


def test_marks_of_deep_elements():
    from seamline.llm._dom import align, body, leaves, parse

    for n in (160, 5000):
        deep, ends = "<div>" * n, "</div>" * n
        parts = {f"<div><article><p>a{deep}b{ends}<p>c</article>out</div>": "a\n\nb\n\nc", f"{deep}a<nav>x<div>x</div></nav><aside>x</aside>b<p>c{ends}d": "a\n\nb\n\nc\n\nd", f"{deep}out<article><header><h1>t</h1>x</header>in</article>out": "t\n\nin"}
        for html, text in parts.items():
            assert "\n\n".join(x.text for x in body(parse(html))[0]) == text, html[:40]
    # trees that differ at the bottom only, or in depth
    for a, b, alike in ((f"top{deep}<p>x<p>y<h2>z</h2>{ends}end", f"top{deep}<p>x<h2>z</h2>{ends}end", ["top", "x", "z", "end"]), (f"top{deep}x{ends}end", f"top{deep}<div>x</div>{ends}end", ["top", "end"])):
        found, one = {}, parse(a)
        align(one, parse(b), {}, found)
        assert [x.text for x in leaves(one) if id(x) in found and found[id(x)].text == x.text] == alike


def test_long_lists_are_aligned():
    """The best matching of lists of more than 40,000 pairs, with template between blocks that differ."""
    import random

    from seamline.llm._dom import MOST_CELLS, align, leaves, pairs_of, parse, table, unknown, weigh

    chance = random.Random(6)

    def page(name):
        blocks = [chance.choice(["<p>{}", "<h2>{}</h2>", "<ul><li>{}<li>x</ul>", "<pre>{}</pre>", "<ul><li>{}</ul>"]).format(f"{name}{k}") for k in range(300)]
        return "<section>" + "".join(blocks[:150]) + "<table><tr><td>share this</table>" + "".join(blocks[150:]) + f"<h{3 + (name == 'b')}>end</h{3 + (name == 'b')}></section>"

    a, b = parse(page("a")), parse(page("b"))
    found, memo = {}, {}
    align(a, b, memo, found)
    assert [found[id(x)].text for x in leaves(a) if x.text == "share this"] == ["share this"]
    left, right = a.children[0].children, b.children[0].children
    assert len(left) * len(right) > MOST_CELLS
    weigh(unknown(left, right, memo), memo)
    rows = [[0] * (len(right) + 1)]
    for x in left:
        rows.append([0])
        for k, y in enumerate(right):
            w = 0 if x.label != y.label else x.size if x.shape == y.shape else memo[x.shape, y.shape]
            rows[-1].append(max(rows[-2][k + 1], rows[-1][k], rows[-2][k] + w))
    pairs = pairs_of(left, right, memo)
    assert sum(x.size if x.shape == y.shape else memo[x.shape, y.shape] for x, y in pairs) == rows[-1][-1]
    assert table(left[:20], right[:30], memo)[-1][-1] == rows[20][30]


def test_wrappers_are_induced(spark):
    def page(k, extra=""):
        return f"<div><div>Welcome to the site</div><div><p>story {k} begins {'word%d ' % k * 20}<p>and ends {k}{extra}</div><div>All rights reserved by us</div></div>"

    pages = [(k, f"http://host.example/{k}", page(k)) for k in range(12)]
    copies = [(100 + k, f"http://copies.example/{k}", page(1)) for k in range(12)]
    df = spark.createDataFrame([*pages, *copies, (200, "http://lone.example/", page(7))], "page_id long, url string, html string").repartition(4)
    found = {r["page_id"]: r["text"] for r in extract_text(df).collect()}
    for k in range(12):
        assert found[k] == f"story {k} begins {'word%d ' % k * 20}".strip() + f"\n\nand ends {k}"
        assert "Welcome" in found[100 + k] and "story 1" in found[100 + k]
    assert found[200].startswith("Welcome")


def test_quality_classifier(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (6, None), (None, 1), (7, 1)], "doc_id long, quality int").withColumn("label", F.lit(9))
    found = classify(awkward, labels).collect()
    assert len(found) == len(brute.AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    assert classify(awkward, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert classify(empty, labels).count() == 0


def test_ngram_counts_are_exact(spark):
    """Continuation counts of more n-grams than a fixed table would hold apart, and both ways to score."""
    import random

    from seamline.llm.quality_rules import count_ngrams

    chance = random.Random(4)
    texts = [("".join(chr(chance.randrange(0x4E00, 0x9E00)) for _ in range(2500)), chance.choice(["zh", "ja"])) for _ in range(80)]
    seen = [{(lang, ("\2" * 5 + text)[k + 5 - n : k + 6]) for text, lang in texts for k in range(len(text))} for n in range(5)]
    want = Counter()
    for n in range(4):
        before = Counter((lang, gram[1:]) for lang, gram in seen[n + 1])
        want.update((n + 1, before[x]) for x in seen[n])
    docs = spark.createDataFrame([(k, *x) for k, x in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    assert {(r["n"], r["count"]): r["number"] for r in count_ngrams(docs).groupBy("n", "count").agg(F.count("*").alias("number")).collect()} == dict(want)


def test_quality_rules_of_a_large_model(spark, awkward, empty):
    """A model over the bound of a broadcast gives the same perplexities by a join."""
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_words"], r["reason"] or "")
    for df in (awkward, spark.createDataFrame([(k, f"row {k} of text {'abc' * (k % 7)} and more words to fill the line up to ten", "en") for k in range(60)], "doc_id long, text string, lang string")):
        small, large = (sorted(quality_rules(df, most_entries=m).collect(), key=key) for m in (10**6, 0))
        assert [r.asDict() | {"perplexity": None} for r in small] == [r.asDict() | {"perplexity": None} for r in large]
        assert [r["perplexity"] or 0 for r in small] == pytest.approx([r["perplexity"] or 0 for r in large], rel=1e-4)
    assert quality_rules(empty, most_entries=-1).count() == 0


def test_perplexity_of_the_model(spark):
    """The model's probabilities of all next characters sum to one, and it tells text from noise."""
    import random

    from seamline.llm.quality_rules import count_ngrams, kneser_ney, score

    chance = random.Random(1)
    rows = [(k, " ".join(chance.choice(["river", "stone", "cloud", "paper", "green", "house"]) for _ in range(30)), "en") for k in range(300)]
    noise = "".join(chance.choice("qxzjkvw") for _ in range(200))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = kneser_ney(count_ngrams(df))
    slots, logp, _ = model[0]
    assert abs(np.exp(logp.astype(float)).sum() - 1) < 0.1
    judged = score(spark.createDataFrame([(1, rows[0][1], "en"), (2, noise, "en")], "doc_id long, text string, lang string"), model).collect()
    loss = {r["doc_id"]: r["log_loss"] / r["n_chars"] for r in judged}
    assert loss[1] < 1.5 < 4 < loss[2]
