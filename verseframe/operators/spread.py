"""Use of all cores on inputs with few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """df as it is where its scan has a split for every core; else dealt out evenly, which then moves little.

    A frame with a shuffle of its own stays as it is: asking for its partitions would run that shuffle.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= wanted // per_core else df.repartition(wanted)
