"""Wrapper induction on pages whose markup says nothing about the article."""

import random

from seamline.llm.html_extraction import extract_text


def page(r, n, extra="", template=6):
    box = "".join(f"<li>Entry {k} of the list that all pages have" for k in range(template))
    text = "".join(f"<p>{' '.join(f'w{r.randrange(5000)}' for _ in range(n))}</p>" for _ in range(3))
    html = f"<html><body><div class=x1><ul>{box}</ul></div>{extra}<div class=x2>{text}</div><div class=x3><p>All rights of this site reserved<p>Page {r.randrange(10**6)}</div></body></html>"
    return html, [x.split("</p>")[0] for x in text.split("<p>")[1:]]


def found(spark, rows):
    df = spark.createDataFrame([(k, f"http://{host}/{k}", html) for k, (host, html) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    return [(r["text"], r["n_template"]) for r in extract_text(df).orderBy("page_id").collect()]


def test_repeated_blocks_without_marks(spark):
    r = random.Random(1)
    pages = [page(r, 40) for _ in range(12)]
    got = found(spark, [("a.org", html) for html, _ in pages])
    for (_, want), (text, template) in zip(pages, got, strict=True):
        assert template == 7  # the six entries and the notice
        assert text.split("\n\n")[:3] == want and "Entry" not in text and "rights" not in text


def test_short_articles_in_a_long_template(spark):
    """Every page shares most of the reference's text, which makes none of them a copy."""
    r = random.Random(2)
    pages = [page(r, 4, template=40) for _ in range(12)]
    got = found(spark, [("a.org", html) for html, _ in pages])
    assert [t.split("\n\n")[:3] for t, _ in got] == [want for _, want in pages]
    assert all("Entry" not in t for t, _ in got)


def test_copied_articles_stay(spark):
    r = random.Random(3)
    copied = page(r, 60)
    pages = [copied] * 4 + [page(r, 60) for _ in range(8)]
    got = found(spark, [("a.org", html.replace("Page ", f"Page {k} ")) for k, (html, _) in enumerate(pages)])
    assert [t.split("\n\n")[:3] for t, _ in got] == [want for _, want in pages]


def test_few_pages_and_other_hosts_are_left_alone(spark):
    r = random.Random(4)
    pages = [page(r, 20) for _ in range(3)]
    got = found(spark, [(f"h{k}.org", html) for k, (html, _) in enumerate(pages)])
    assert all(template == 0 and "Entry 0" in text for text, template in got)


def test_marks_are_whole_names():
    from seamline.llm._dom import body, parse

    for name in ("related-work", "search-results", "social-history", "header-files-in-c", "share-prices", "menu-of-the-day-recipe"):
        for html in (f"<article><p>a<section class='{name}'><p>b</section></article>", f"<article><p>a<section id={name}><p>b</section></article>", f"<p>a<div id={name}>b</div>"):
            assert [n.text for n in body(parse(html))[0]] == ["a", "b"], html
    for name in ("related-posts", "share-buttons", "site-header", "cookie_banner", "ad-slot-3", "main-nav", "comment-list", "sidebar", "newsletter-form", "social"):
        assert [n.text for n in body(parse(f"<p>a<div class='{name}'>b</div>"))[0]] == ["a"], name
