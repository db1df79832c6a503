"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features.

Rules decide first. URLs that a rule decides are the labelled ones: boosted trees learn from
them to judge all others by lexical features and by statistics of the host's suffix. The trees
are compiled into one Spark column expression, so scoring a URL is plain DataFrame work.

The trees are fitted on a bounded sample of labelled URLs (``max_rows`` in the mean, chosen by
a hash of the URL); the statistics of suffixes count all URLs.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import needed, staged
from .decontamination import let
from .language_id import drawn

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]

#: A verdict, and host and path, of each rule.
RULES: list[Rule] = [
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
]

FEATURES = [
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "parameters", "digit_ratio", "host_digit_ratio",
    "letter_ratio", "hyphens", "host_hyphens", "entropy", "host_entropy", "longest_label", "fragment", "secure", "suffix_urls", "suffix_share",
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. The host reaches from after the first ``://`` to ``/``, ``?``, ``#`` or the
    end, with A-Z lower-cased; the path from there to ``?``, ``#`` or the end. Without ``://``, or
    for null, both are empty."""
    given = F.coalesce(url, F.lit(""))
    at = F.instr(given, "://")
    rest = F.when(at > 0, F.substring(given, at + 3, F.length(given))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits. A rule fits its host and
    the host's subdomains, if the path starts with the rule's. Of rules of one length the first
    in the list wins."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit(f".{own_host}"))) & F.startswith(path, F.lit(slash + own_path))
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 for an empty text."""

    def of(n: Column) -> Column:
        def add(total: Column, c: Column) -> Column:
            share = (n - F.length(F.replace(text, c, F.lit("")))) / n
            return total - share * F.log2(share)

        return F.when(n > 0, F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), add)).otherwise(0.0)

    return let(F.length(text), of)


def suffix_of(host: Column) -> Column:
    """The last label of a host, without a port."""
    return F.substring_index(F.regexp_replace(host, ":[0-9]*$", ""), ".", -1)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that come from the URL alone; all are numbers for any text."""
    given = F.coalesce(url, F.lit(""))

    def count(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    def ratio(part: Column, text: Column) -> Column:
        return part / F.greatest(F.length(text), F.lit(1))

    query = F.regexp_extract(given, r"\?([^#]*)", 1)
    out = {
        "url_length": F.length(given), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "depth": count(path, "/[^/]"), "labels": count(host, r"[^.]+"), "parameters": count(query, "[^&;]+"),
        "digit_ratio": ratio(count(given, "[0-9]"), given), "host_digit_ratio": ratio(count(host, "[0-9]"), host),
        "letter_ratio": ratio(count(given, r"\p{L}"), given), "hyphens": count(given, "-"), "host_hyphens": count(host, "-"),
        "entropy": entropy(given), "host_entropy": entropy(host),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))),
        "fragment": F.contains(given, F.lit("#")), "secure": F.startswith(F.translate(given, UPPER, LOWER), F.lit("https://")),
    }
    return {k: v.cast("int").cast("double") if k in ("fragment", "secure") else v.cast("double") for k, v in out.items()}


def tree_column(description: str, features: list[str]) -> Column:
    """A regression tree as nested conditions, from its description."""
    lines = [x.strip() for x in description.splitlines() if re.match(r" *(If|Else|Predict)", x)]

    def node(at: int) -> tuple[Column, int]:
        if m := re.match(r"Predict: (\S+)", lines[at]):
            return F.lit(float(m[1])), at + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        yes, at = node(at + 1)
        no, at = node(at + 1)  # past the line of Else
        return F.when(F.col(features[int(m[1])]) <= float(m[2]), yes).otherwise(no), at

    return node(0)[0]


def fit(rows: DataFrame, *, label: str = "label", features: list[str] = FEATURES, weight: str | None = None, trees: int = 12, depth: int = 3, seed: int = 5) -> Column:
    """Boosted trees as a column: the probability of label 1. With one label only, or none, its
    smoothed share."""
    seen = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # two rows at most
    if len(seen) < 2:
        return F.lit((seen.get(1, 0) + 1) / (sum(seen.values()) + 2))
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select(F.col(label).cast("double").alias("label"), "features", (F.col(weight) if weight else F.lit(1.0)).alias("weight"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=32, weightCol="weight").fit(data)
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        margin = margin + F.lit(float(weight)) * tree_column(tree.toDebugString, features)
    return 1 / (1 + F.exp(-2 * margin))


def judge_urls(pages: DataFrame, *, rules: list[Rule] = RULES, max_rows: int = 20_000, threshold: float = 0.5, broadcast_rows: int = 100_000) -> DataFrame:
    """Judge every url (columns ``page_id, url``; others are ignored).

    ``max_rows``: the mean size of the sample of labelled URLs that the trees learn from.
    ``threshold``: from this score on an undecided URL is blocked. ``broadcast_rows``: a table
    of so many suffixes at most is broadcast, a larger one is joined by shuffle.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is judged
    by its features. Repeated rows are judged one by one; an empty table gives no rows; without
    labelled URLs the score is 0.5. Returns page_id (long), host, path, rule, verdict (string),
    score (double: how likely a block).
    """
    host, path = split_url(F.col("url"))
    rows = needed(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"), suffix_of(F.col("host")).alias("suffix"))
    rows = staged(rows.select("page_id", "host", "path", "rule", "said", "suffix", *[v.alias(k) for k, v in lexical(F.col("url"), F.col("host"), F.col("path")).items()], F.xxhash64("url").alias("draw")), "urls")

    is_block = (F.col("said") == "block").cast("long")
    suffixes = staged(rows.groupBy("suffix").agg(F.log1p(F.count("*")).alias("suffix_urls"), F.coalesce(F.sum(is_block), F.lit(0)).alias("blocked"), F.count("said").alias("decided")), "suffixes")
    if suffixes.count() <= broadcast_rows:
        suffixes = F.broadcast(suffixes)
    # a suffix's share of blocked URLs leaves out the row's own label
    own = F.col("said").isNotNull().cast("long")
    share = (F.col("blocked") - F.coalesce(is_block, F.lit(0)) + 1) / (F.col("decided") - own + 2)
    # where a rule names a whole suffix, the suffix's labels are that rule over again: it has no statistics
    named = F.col("suffix").isin([r.partition("/")[0] for _, r in rules if "." not in r.partition("/")[0]])
    full = rows.join(suffixes, "suffix").withColumns({"suffix_share": F.when(named, 0.5).otherwise(share), "suffix_urls": F.when(named, 0.0).otherwise(F.col("suffix_urls"))})

    known = full.filter("said is not null").withColumn("label", (F.col("said") == "block").cast("int"))
    n = rows.filter("said is not null").count()
    if n > max_rows:
        known = known.filter(drawn("draw", max_rows / n))
    # a rule counts as one, however many URLs it decides
    each = known.groupBy("rule").agg((1 / F.count("*")).alias("weight"))
    known = known.join(F.broadcast(each), "rule")  # a row for each rule
    learnt = staged(known.select("label", "weight", *FEATURES), "labelled").coalesce(4).cache()
    score = fit(learnt, weight="weight")
    learnt.unpersist()
    scored = full.select("page_id", "host", "path", "rule", "said", score.alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
