"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow random trees are grown on the statistics of labelled texts. Each path from a root to
a node is a conjunctive rule; a logistic regression with a lasso penalty weighs the rules, and
those with weight are compiled into one Spark column expression.

Trees and weights are fitted on a bounded sample of labelled rows: ``max_rows`` in the mean,
chosen by a hash of the id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import needed, staged
from ._words import IS_SPACE, slices
from .language_id import bounded_sample, fold
from .quality_rules import text_statistics

FEATURES = [
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "bar_share", "other_share",
    "duplicate_lines", "repeated_words", "distinct_words", "line_words", "stops",
]
SCHEMA = "doc_id long, " + ", ".join(f"{x} double" for x in FEATURES)
_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "mark": b"!?", "bar": b"|", "stop": b".,;:", "high": range(128, 256), "lower": range(97, 123),
}


def statistics(docs: DataFrame) -> DataFrame:
    """The statistics of every whole text; a null or empty one has 0 in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
        for batch in batches:
            base = np.array(list(text_statistics(batch.column(1))), np.float64).reshape(-1, 5)
            rows = np.zeros((len(base), len(FEATURES)))
            for part in slices(batch.column(1), lower=True):
                for k in range(part.last - part.first):
                    data = part.data[part.at[k] : part.at[k + 1]]
                    if not len(data):
                        continue
                    seen = np.bincount(data, minlength=256)
                    n = {name: seen[t].sum() for name, t in tables.items()}
                    words, chars, symbols, lines, repeats = base[part.first + k]
                    inside = max(1.0, float(len(data) - seen[IS_SPACE].sum()))
                    line_count = seen[10] + 1
                    own = part.words[part.word_at[k] : part.word_at[k + 1]]
                    some = max(1.0, words)
                    rows[part.first + k] = (
                        np.log1p(words), chars / some, symbols / inside, n["upper"] / inside, n["digit"] / inside, n["mark"] / inside, n["bar"] / inside,
                        (inside - n["upper"] - n["lower"] - n["digit"] - n["high"]) / inside, lines / line_count, repeats / some, len(np.unique(own)) / some, words / line_count, n["stop"] / some,
                    )
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))], names=["doc_id", *FEATURES])

    return needed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)


Rule = tuple[tuple[int, str, float], ...]


def tree_paths(description: str) -> list[Rule]:
    """The paths to all nodes but the roots, from a forest's description."""
    rules, path = [], []
    for line in description.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
            rules.append(tuple(x for _, x in path))
        elif line.lstrip().startswith("Tree "):
            path = []
    return sorted(set(rules))


def rule_column(rule: Rule, features: list[str]) -> Column:
    out = F.lit(True)
    for feature, sign, value in rule:
        column = F.col(features[feature])
        out = out & (column <= value if sign == "<=" else column > value)
    return out


def fit(rows: DataFrame, *, label: str = "label", features: list[str] = FEATURES, trees: int = 16, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """The intercept and the weighted rules that a lasso logistic regression keeps."""
    seen = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if len(seen) < 2:  # nothing to tell apart: the smoothed share of label 1
        ones, total = seen.get(1, 0), sum(seen.values())
        return float(np.log((ones + 1) / (total - ones + 1))), []
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select(F.col(label).cast("double").alias("label"), *features, "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="0.5").fit(data)
    rules = tree_paths(forest.toDebugString)
    if not rules:
        return float(np.log((seen.get(1, 0) + 1) / (seen.get(0, 0) + 1))), []
    hits = data.select("label", F.array(*[rule_column(r, features).cast("double") for r in rules]).alias("hits"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=40, standardization=False).fit(hits.select("label", array_to_vector("hits").alias("features")))
    return float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]


def score_column(intercept: float, rules: list[tuple[Rule, float]], features: list[str] = FEATURES) -> Column:
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(rule_column(rule, features), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def classify(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000) -> DataFrame:
    """Score every whole text (docs: ``doc_id, text``; labels: ``doc_id, quality``), learning from
    labels outside fold 1 only.

    A null or empty text has statistics of 0 and is scored by them. Rows with a null doc_id are
    scored with a null held_out; a null quality is not learnt from; without any label the score
    is 0.5. Repeated rows are scored one by one; an empty table gives no rows. Returns doc_id,
    held_out (boolean), score (double), predicted (int).
    """
    rows = staged(statistics(docs), "statistics")
    known = needed(labels, "doc_id", "quality").filter("quality is not null").filter(fold() != 1)
    known = bounded_sample(known, max_rows).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    learnt = staged(known.join(rows, "doc_id"), "labelled").coalesce(4).cache()
    score = score_column(*fit(learnt))
    learnt.unpersist()
    return rows.select("doc_id", (fold() == 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
