"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: At most so many keys are salted; every other key then holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 200
#: Keys with fewer rows are never salted.
HOT_ROWS = 100_000
SALTS = 64


def hot_keys(df: DataFrame, key: str, max_keys: int = HOT_KEYS, min_rows: int = HOT_ROWS) -> list:
    """The up to max_keys most frequent non-null keys with more than min_rows rows, counted with map-side combine."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > min_rows)
    return [r[0] for r in counts.orderBy(F.desc("__rows"), key).limit(max_keys).collect()]


def salted_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = SALTS, min_rows: int = HOT_ROWS, hot: list | None = None) -> DataFrame:
    """left joined with right, which has one row per key, by co-partitioning and sorting both sides.

    Rows of hot keys on the left are spread over `salts` sub-keys by a hash of the row; only the few hot rows
    of the right side are repeated for it. Null keys match nothing and are kept for how="left".
    """
    hot = hot_keys(left, key, min_rows=min_rows) if hot is None else hot
    if not hot:
        return left.join(right.hint("merge"), key, how)
    is_hot = F.col(key).isin(hot)
    salted = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    spread = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread.hint("merge"), [key, "__salt"], how).drop("__salt")
