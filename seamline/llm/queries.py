"""The registered queries of this subpackage: the numbered operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import staged, table
from .conversation_repair import damaged, plan_repairs, repaired_turns, turn_digests
from .conversation_trie import numbered_turns, prefix_trie, rebuilt_turns
from .decontamination import contaminated
from .html_extraction import extract_text
from .inverted_multi_index import nearest
from .language_id import identify
from .ngram_join import jaccard_components
from .packing import pack
from .quality_classifier import classify
from .quality_rules import quality_rules
from .secrets import scan
from .token_counts import token_counts
from .url_filter import judge_urls


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), ranks_path=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    plans = staged(plan_repairs(rows), "repairs")
    digests = turn_digests(repaired_turns(rows, plans)).withColumnRenamed("conv_id", "repaired_id")
    found = plans.withColumnRenamed("conv_id", "planned_id")
    counts = [c for c in plans.columns if c not in ("conv_id", "audit")]
    ids = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("planned_id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    nothing = F.sha2(F.lit(b""), 256)
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = staged(numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    conv = F.col("conv_id")
    return prefix_trie(*rebuilt_turns(turns, conv - conv % 20, F.crc32(conv.cast("string")) % 4))


def op13_approximate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_packing, op4_decontamination, op5_secret_scans, op6_language_id, op7_url_filters, op8_ngram_jaccard_join, op9_html_extraction, op10_quality_classifier, op11_conversation_repair, op12_conversation_trie, op13_approximate_nearest)}

_SHINGLES = """(SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (
  SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (
    SELECT {id} AS id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0))"""


def _shingles(table: str, id: str, lower: str) -> str:
    return _SHINGLES.format(table=table, id=id, lower=lower)


#: For the operators whose results SQL can express; tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": f"""WITH d AS {_shingles('documents', 'doc_id', 'lower(text)')}, t AS {_shingles('benchmark', 'item_id', 'lower(text)')},
n AS (SELECT id, count(*) AS n_item FROM t GROUP BY id)
SELECT d.id AS doc_id, t.id AS item_id, n_item, count(*) AS n_common, count(*) / n_item AS containment
FROM d JOIN t USING (s) JOIN n ON n.id = t.id GROUP BY d.id, t.id, n_item HAVING count(*) * 100 >= n_item * 75""",
    "op8_ngram_jaccard_join": f"""WITH RECURSIVE d AS MATERIALIZED {_shingles('documents', 'doc_id', "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
n AS MATERIALIZED (SELECT id, count(*) AS n FROM d GROUP BY id),
shared AS MATERIALIZED (SELECT s FROM d GROUP BY s HAVING count(*) > 1),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM d x JOIN shared USING (s) JOIN d y USING (s) WHERE x.id < y.id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(r.b, doc_id)) AS component_id
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = doc_id""",
}
