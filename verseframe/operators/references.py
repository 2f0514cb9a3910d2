"""References to records that do not exist (problem 2).

References and parent keys are co-partitioned and sorted by key and merged in one linear pass (a sort-merge
join). The parent side is first reduced to one validity interval per key: from its earliest record to its
deletion, if its last version is deleted. The interval tells missing, deleted and late references apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verseframe.operators.skew import HOT_ROWS, salted_lookup

#: Characters stripped around ids.
BLANKS = " \t\r\n "


def clean_id(value: Column) -> Column:
    """An id trimmed and in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.btrim(value, F.lit(BLANKS))), F.lit(""))


def ids_in(values: Column) -> Column:
    """All ids of an array whose elements may be null, blank, or hold several ids separated by commas; order kept."""
    parts = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.split(F.coalesce(v, F.lit("")), ",")))
    cleaned = F.transform(parts, clean_id)
    return F.filter(cleaned, lambda v: v.isNotNull())


def validity(people: DataFrame, key: str = "id", recorded: str = "recorded_at", deleted: str = "deleted_at", order: str = "record_no") -> DataFrame:
    """One row per key: first_at (earliest version) and deleted_at of the last version (ties: larger `order`)."""
    rows = people.select(clean_id(F.col(key)).alias("_key"), F.col(recorded).alias("_at"), F.col(order).alias("_no"), F.col(deleted).alias("_del"))
    rows = rows.where(F.col("_key").isNotNull())
    last = F.max_by("_del", F.struct(F.col("_at"), F.col("_no")))
    return rows.groupBy("_key").agg(F.min("_at").alias("_first_at"), last.alias("_deleted_at"))


def references(df: DataFrame, source_table: str, links: str, record: str = "record_no", recorded: str = "recorded_at") -> DataFrame:
    """Distinct (source_table, record_no, ref_id, recorded_at); repeated rows and repeated ids count once.

    Where one record_no appears with several recorded_at, the earliest counts.
    """
    rows = df.select(F.col(record).alias("record_no"), F.col(recorded).alias("recorded_at"), F.explode(F.array_distinct(ids_in(F.col(links)))).alias("_key"))
    rows = rows.groupBy("record_no", "_key").agg(F.min("recorded_at").alias("recorded_at"))
    return rows.select(F.lit(source_table).alias("source_table"), "record_no", "recorded_at", "_key")


def orphan_references(refs: DataFrame, intervals: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """References that lead nowhere: source_table, record_no, recorded_at, ref_id, reason (missing, deleted, late).

    `refs` as from references(), `intervals` as from validity(). A reference without recorded_at can be missing or
    deleted but never late. Empty inputs give an empty result; other columns of the tables play no part.
    """
    merged = salted_lookup(refs, intervals.withColumn("_known", F.lit(True)), "_key", min_rows=min_rows)
    reason = F.when(F.col("_known").isNull(), "missing").when(F.col("_deleted_at").isNotNull(), "deleted").when(F.col("_first_at") > F.col("recorded_at"), "late")
    return merged.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("source_table", "record_no", "recorded_at", F.col("_key").alias("ref_id"), "reason")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, month of the referring row (null where it has no date) and reason."""
    month = F.date_format("recorded_at", "yyyy-MM").alias("month")
    return orphans.groupBy("source_table", month, "reason").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("record_no").alias("n_records"))
