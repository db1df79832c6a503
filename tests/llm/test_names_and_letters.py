"""Whole names of languages, and what counts as a letter."""

import unicodedata

from seamline.llm import language_id, quality_rules
from seamline.llm.language_id import identify

SCHEMA = "doc_id long, text string, lang string, source string"


def test_numbers_that_look_like_letters_are_none(spark):
    rows = [(i, "der die das und nicht" if i % 2 else "the and of with not", "de" if i % 2 else "en", "s") for i in range(200)]
    odd = {1000: "½ ²", 1001: "Ⅻ", 1002: "① 7", 1003: "_ 12 !", 1004: None, 1005: "½ the ²"}
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows + [(k, v, None, "s") for k, v in odd.items()], SCHEMA)).collect()}
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in range(1000, 1005)] == [("und", 0.0)] * 5
    assert got[1005]["lang_pred"] == "en"


def test_words_are_runs_of_letters():
    for c in map(chr, range(0x3000)):
        assert (language_id.words_of(c) == [c]) == unicodedata.category(c).startswith("L"), hex(ord(c))
    assert language_id.words_of("don't ²x½y") == ["don", "t", "x", "y"]


def test_languages_with_one_end_are_apart():
    names = ["old-english-variant", "new-english-variant", "zh-Hans-variant", "variant", "english-variant", None, ""]
    seeds = quality_rules._seeds(names)
    assert len(set(seeds.tolist())) == 6 and seeds[5] == seeds[6]
