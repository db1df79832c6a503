"""The trees of the URL filter on URLs that no rule decides."""

import random

from seamline.llm.url_filter import judge_urls


def auc(scored):
    """The share of pairs of a block and an allow in which the block has the higher score."""
    blocks, allows = ([s for s, y in scored if y == k] for k in (1, 0))
    return sum((b > a) + (b == a) / 2 for b in blocks for a in allows) / (len(blocks) * len(allows))


def test_held_out_hosts(spark):
    r = random.Random(8)
    words = "river bridge market bread garden morning letter winter mountain harbour".split()

    def url(host, bad):
        if bad and r.random() < 0.9:  # every tenth looks like one of the other kind
            return f"http://{r.randrange(10**6)}-{host}/{r.randrange(10**9)}/x?" + "&".join(f"p{k}={r.randrange(10**6)}" for k in range(r.randrange(1, 5)))
        return f"https://{host}/" + "/".join(r.choice(words) for _ in range(r.randrange(1, 5)))

    rows, rules = [], []
    for k in range(60):
        bad, host = k % 2, f"site{'abcdefghij'[k % 10]}{k // 10}.{'com' if k % 3 else 'org'}"
        if k < 40:  # rules decide two thirds of the hosts, by subdomains and paths alike
            rules.append(("block" if bad else "allow", f"{host}/"))
        rows += [(len(rows) + i, url(f"w.{host}" if bad else host, bad), bad, k) for i in range(40)]
    df = spark.createDataFrame([x[:2] for x in rows], "page_id long, url string").repartition(4)
    got = {x["page_id"]: x for x in judge_urls(df, rules=rules).collect()}
    decided = [got[i]["rule"] for i, *_ in rows]
    held_out = [(got[i]["score"], bad) for (i, _, bad, _), rule in zip(rows, decided, strict=True) if rule is None]
    assert len(held_out) > 700 and all(0 <= s <= 1 for s, _ in held_out)
    assert auc(held_out) > 0.9


def test_undecided_urls_of_one_suffix_differ(spark):
    """Rules that name whole suffixes don't make the verdict a look-up of the suffix."""
    from collections import defaultdict

    r = random.Random(3)
    rows = []
    for k in range(1500):
        host = "".join(r.choice(("th", "er", "on", "ble", "ing")) for _ in range(r.randrange(2, 5)))
        end = r.choice(("", ".html", "/", "#top", "?page=2&ref=x", "?utm_source=feed"))
        rows.append((k, f"http{r.choice(('', 's'))}://{r.choice(('', 'www.', 'm.', 'blog.'))}{host}.example.{r.choice(('com', 'net', 'org'))}/{r.choice(('en', 'de', 'es', 'fr'))}/{r.randrange(1000, 9999)}{end}"))
    verdicts, scores = defaultdict(set), set()
    for x in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).filter("rule is null").collect():
        verdicts[x["host"].rpartition(".")[2]].add(x["verdict"])
        scores.add(round(x["score"], 6))
    assert len(scores) > 50 and all(len(v) == 2 for v in verdicts.values())
