"""Queries and SQL of the operators on training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verseframe.llm import consensus, encoding, leakage, packing, pairs, truncation
from verseframe.sources import table


SWEEP = "style_tradeoff_v1_20260311_191359"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "outputs_flat"), table(spark, d, SWEEP), table(spark, d, "documents"), ("outputs_flat", SWEEP))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_posteriors(table(spark, d, SWEEP)).where("filled and log_odds > 0").select("row_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(truncation.cut_posteriors(table(spark, d, SWEEP)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    labels, _, _ = consensus.consensus(table(spark, d, "results"))
    return labels.select(F.col("item_id").alias("comparison_id"), F.col("item_model").alias("model"), "dimension", "label")


def p4_reliability(spark: SparkSession, d: str) -> DataFrame:
    _, judges, _ = consensus.consensus(table(spark, d, "results"))
    return judges.select(F.col("annotator").alias("reviewer"), "dimension", "n_votes", "shift", "accuracy")


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    got = consensus.agreement(consensus.last_votes(table(spark, d, "results")).withColumn("_item", F.concat_ws("\x1f", "item_id", "item_model", "dimension")))
    return got.select("dimension", "n_items", "n_votes", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def p6_blocks(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p6_blocks(spark, d))


def p6_fits(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must hold: all documents, no block over the capacity, and no text split that fits one."""
    packed = p6_blocks(spark, d)
    over = packed.groupBy("block").agg(F.sum("n_tokens").alias("load")).where(F.col("load") > packing.CAPACITY)
    per = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("parts"))
    wrong = F.sum(F.when(F.col("parts") != F.greatest(F.ceil(F.col("n") / packing.CAPACITY), F.lit(1)), 1).otherwise(0))
    return per.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(wrong, F.lit(0)).alias("n_split_wrong")).crossJoin(over.agg(F.count(F.lit(1)).alias("n_over")))  # one row each


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_per_item(p7_found(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return encoding.restored(documents, encoding.garbled(documents))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_report, p4_found, p4_reliability, p4_agreement, p6_blocks, p6_report, p6_fits, p7_found, p7_items, p8_found, p8_restored)}
ORACLE: dict[str, str] = {
    "p6_fits": "SELECT count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS n_split_wrong, 0::BIGINT AS n_over FROM documents",
    "p4_agreement": """
WITH v AS (
  SELECT comparison_id, model, lower(trim(reviewer, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS who, submitted_at, originality, emotion, imagery FROM results
  WHERE originality BETWEEN 1 AND 5 AND emotion BETWEEN 1 AND 5 AND imagery BETWEEN 1 AND 5 AND comparison_id IS NOT NULL AND model IS NOT NULL),
last AS (SELECT comparison_id, model, who, arg_max({'o': originality, 'i': imagery}, (submitted_at, originality, emotion, imagery)) AS s FROM v WHERE who <> '' GROUP BY ALL),
votes AS (SELECT comparison_id, model, 'originality' AS dimension, s.o AS vote FROM last UNION ALL SELECT comparison_id, model, 'imagery', s.i FROM last),
cells AS (SELECT dimension, comparison_id, model, vote, count(*) AS n FROM votes GROUP BY ALL),
items AS (SELECT dimension, comparison_id, model, sum(n) AS n, sum(n * (n - 1)) AS same FROM cells GROUP BY ALL HAVING sum(n) > 1),
obs AS (SELECT dimension, count(*) AS n_items, sum(n)::BIGINT AS n_votes, avg(same / (n * (n - 1))) AS observed FROM items GROUP BY 1),
ex AS (SELECT dimension, sum(p * p) AS expected FROM (SELECT c.dimension, c.vote, sum(c.n) / any_value(o.n_votes) AS p FROM cells c JOIN items USING (dimension, comparison_id, model) JOIN obs o ON o.dimension = c.dimension GROUP BY 1, 2) GROUP BY 1)
SELECT dimension, n_items, n_votes, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / (1 - expected), 6) AS kappa FROM obs JOIN ex USING (dimension)
""",
}
