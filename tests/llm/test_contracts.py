"""The registered queries over whole small tables, against plain Python versions."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from seamline.llm import queries

from . import brute


@pytest.fixture(scope="module")
def docs(sf_dir):
    return brute.table(sf_dir, "documents", "doc_id, text, lang, source")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_quality_rules(spark, sf_dir, docs):
    found = {r["doc_id"]: r for r in rows(queries.op1_quality_rules(spark, sf_dir))}
    assert len(found) == len(docs)
    for doc_id, text, *_ in docs:
        r, own = found[doc_id], brute.base_rules(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == own, doc_id
        failed = own[0] < 10 or 100 * own[4] > 20 * own[0]
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])
    quality = dict(brute.table(sf_dir, "labels", "doc_id, quality"))
    good = [found[d]["kept"] for d, q in quality.items() if q == 1 and d in found and not found[d]["base_failed"]]
    assert sum(good) >= 0.95 * len(good)


def test_token_counts(spark, sf_dir, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {d: (len((t or "").encode()), len(model.encode(t or ""))) for d, t, *_ in docs}
    found = rows(queries.op2_token_counts(spark, sf_dir))
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in found} == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in found)


def test_packing(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t, *_ in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(queries.op3_packing(spark, sf_dir)):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(ids[d])
    total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        total += 1024 if at & (at - 1) else at
    assert sum(map(len, ids.values())) >= 0.93 * total


def test_decontamination(spark, sf_dir, docs):
    items = {i: {" ".join(x) for x in brute.shingles(t.lower())} for i, t in brute.table(sf_dir, "benchmark", "item_id, text")}
    expected = set()
    for d, text, *_ in docs:
        own = {" ".join(x) for x in brute.shingles((text or "").lower())}
        expected |= {(d, i, len(x), len(x & own)) for i, x in items.items() if x and 100 * len(x & own) >= 75 * len(x)}
    found = rows(queries.op4_decontamination(spark, sf_dir))
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_common"]) for r in found} == expected
    assert expected


def test_secret_scans(spark, sf_dir, docs):
    found = {r["doc_id"]: r for r in rows(queries.op5_secret_scans(spark, sf_dir))}
    assert len(found) == len(docs)
    for d, text, *_ in docs:
        spans, r = brute.secrets(text), found[d]
        said = [f"{kind}:{start}:{end}" for start, _, kind, end in spans]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(","))
        for kind, start, end in (x.split(":") for x in r["spans"].split(",") if x):
            assert 0 <= int(start) < int(end) <= len(text or "")
            assert kind in ("assign", "access", "hex", "mixed")

def test_language_id(spark, sf_dir, docs):
    found = {r["doc_id"]: r for r in rows(queries.op6_language_id(spark, sf_dir))}
    assert len(found) == len(docs)
    held = [(lang, found[d]["lang_pred"]) for d, text, lang, _ in docs if zlib.crc32(str(d).encode()) % 3 == 1 and lang and text]
    assert all(found[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, *_ in docs)
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    for d, text, *_ in docs:
        assert 0 <= found[d]["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert found[d]["lang_pred"] == "und"


def test_url_filters(spark, sf_dir):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    found = {r["page_id"]: r for r in rows(queries.op7_url_filters(spark, sf_dir))}
    for page_id, url in brute.table(sf_dir, "pages", "page_id, url"):
        rest = url.partition("://")[2] if url else ""
        ends = [rest.find(c) for c in "/?#" if c in rest]
        host = rest[: min(ends)] if ends else rest
        path = rest[len(host) :].partition("#")[0].partition("?")[0]
        host = host.translate(brute.UPPER_TO_LOWER)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = found[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")


def test_ngram_jaccard_join(spark, sf_dir, docs):
    expected = brute.components([(d, t) for d, t, *_ in docs])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(queries.op8_ngram_jaccard_join(spark, sf_dir))}
    assert found == expected
    assert any(d != c for d, (_, c) in expected.items())


def test_html_extraction(spark, sf_dir):
    import html
    import re

    found = {r["page_id"]: r for r in rows(queries.op9_html_extraction(spark, sf_dir))}
    pages = brute.table(sf_dir, "pages", "page_id, html")
    assert len(found) == len(pages)
    for page_id, page in pages:
        article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert found[page_id]["text"] == "\n\n".join(x for x in blocks if x)
        assert found[page_id]["n_chars"] == len(found[page_id]["text"])


def test_quality_classifier(spark, sf_dir, docs):
    found = {r["doc_id"]: r for r in rows(queries.op10_quality_classifier(spark, sf_dir))}
    assert len(found) == len(docs)
    held = [(q, found[d]["score"]) for d, q in brute.table(sf_dir, "labels", "doc_id, quality") if q is not None and d in found and found[d]["held_out"]]
    ones, zeros = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert auc >= 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found.values())
