"""The corpus pipeline: stages over documents, each written before the next one reads it.

Rows that repeat a doc_id are one document here: they stay or go together. Rows with a null
doc_id can't be named by a verdict and stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm._stage import free, scratch, staged, table, unstage
from seamline.llm.decontamination import contaminated
from seamline.llm.ngram_join import jaccard_components
from seamline.llm.packing import pack
from seamline.llm.quality_rules import quality_rules
from seamline.llm.secrets import mask


def without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """The documents whose doc_id is not among the rejected ones."""
    own = free(docs, "gone")
    gone = staged(rejected.select(F.col("doc_id").alias(own)).distinct(), name)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return without(docs, quality_rules(docs).filter("not kept"), "rejected")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies."""
    return without(docs, jaccard_components(docs).filter("doc_id <> component_id"), "copies")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")), "contaminated")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked."""
    return mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    import public_tokenizers

    path = public_tokenizers.path
    return pack(docs, path("byte_bpe_50k.json"), ranks_path=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", decontaminate),
    ("secret_scans", mask_secrets),
    ("packing", packed),
]

#: SQL can't express the perplexity bands or the packing; tests/llm/test_pipeline.py holds each
#: stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            kept = staged(stage(spark, docs, sf_dir), name, keep=True)
        if docs is not given:
            unstage(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
