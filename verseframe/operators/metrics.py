"""Text metrics over collections: vocabulary joins, summaries, divergence, densities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from verseframe.functions import text as T
from verseframe.functions.vectors import dot
from verseframe.operators.skew import HOT_ROWS, salted_lookup

#: Metrics by name; more can be added, each a function of the text column.
REGISTRY: dict[str, Callable[[Column], Column]] = {
    "imagery_density": T.imagery_density, "metaphor_density": T.metaphor_density, "compound_imagery_density": T.compound_imagery, "narrative_density": T.narrative_density,
    "repetition_index": lambda c: T.repetition_index(T.words(c)),
}


def register_metric(name: str, build: Callable[[Column], Column]) -> None:
    REGISTRY[name] = build


def with_metrics(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """df with one column per requested metric; a name nobody registered gives a null column."""
    return df.withColumns({n: REGISTRY[n](F.col(text)) if n in REGISTRY else F.lit(None).cast("double") for n in names})


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """token: the distinct words of all texts."""
    return df.select(F.explode(T.words(text)).alias("token")).distinct()


def lexical_novelty(df: DataFrame, key: str, text: str, known: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """key, n_words, lexical_novelty: the share of a text's words that are not in `known` (token); 0 for no words."""
    tokens = df.select(key, F.explode_outer(T.words(text)).alias("token"))
    counted = tokens.groupBy(key, "token").agg(F.count("token").alias("n"))
    joined = salted_lookup(counted, known.select("token", F.lit(1).alias("_known")), "token", min_rows=min_rows)
    n, new = F.sum("n"), F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0))
    return joined.groupBy(key).agg(n.alias("n_words"), T.ratio(new, n).alias("lexical_novelty"))


def token_counts(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(T.words(text)).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def token_shift(base: DataFrame, tuned: DataFrame, eps: float = 1e-12) -> DataFrame:
    """kl: divergence of the tuned histogram (token, n) from the base one, eps added after normalising; 0 where one is empty."""
    totals = base.agg(F.sum("n").alias("_b")).crossJoin(tuned.agg(F.sum("n").alias("_t")))  # one row each
    both = base.select("token", F.col("n").alias("b")).join(tuned.select("token", F.col("n").alias("t")), "token", "full_outer")
    p = F.coalesce(F.col("t") / F.col("_t"), F.lit(0.0)) + eps
    q = F.coalesce(F.col("b") / F.col("_b"), F.lit(0.0)) + eps
    term = F.when(F.col("_b").isNotNull() & F.col("_t").isNotNull(), p * F.ln(p / q)).otherwise(0.0)
    return both.join(F.broadcast(totals)).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("kl"))  # totals: one row


def token_shifts(base: DataFrame, tuned: DataFrame, key: str, eps: float = 1e-12) -> DataFrame:
    """key, kl: token_shift of every key of tuned (key, token, n) at once; tokens of the base that a key lacks are
    accounted for by their number and sums, not by rows of their own."""
    b_total = base.agg(F.sum("n").cast("double").alias("_b"))  # one row
    q0 = F.lit(eps)
    own = tuned.join(base.select("token", F.col("n").alias("b")).hint("merge"), "token", "left").join(tuned.groupBy(key).agg(F.sum("n").alias("_t")).hint("merge"), key)
    every = base.join(F.broadcast(b_total)).select((F.col("n") / F.col("_b") + eps).alias("q")).agg(F.sum(q0 * F.ln(q0 / F.col("q"))).alias("_rest"))  # one row
    own = own.join(F.broadcast(b_total)).withColumn("p", F.col("n") / F.col("_t") + eps).withColumn("q", F.coalesce(F.col("b") / F.col("_b"), F.lit(0.0)) + eps)
    shared = F.when(F.col("b").isNotNull(), q0 * F.ln(q0 / F.col("q"))).otherwise(0.0)
    per = own.groupBy(key).agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q")) - shared).alias("_s"), F.max("_b").alias("_b"))
    return per.join(F.broadcast(every)).select(key, F.when(F.col("_b").isNotNull(), F.col("_s") + F.coalesce("_rest", F.lit(0.0))).otherwise(0.0).alias("kl"))


def adjacent_distance(df: DataFrame, key: str, order: str, vector: str, span: int = 4096) -> DataFrame:
    """key, n, distance: mean of 1 - dot over all neighbours in `order` (whole numbers) of a key; 0 without any.

    Neighbours are found within ranges of `span` of the order, and those across borders from the ends of the ranges,
    so no task holds a whole key.
    """
    rows = df.select(key, F.col(order).alias("_o"), F.floor(F.col(order) / span).alias("_r"), F.col(vector).alias("_v"))
    within = rows.withColumn("_d", 1 - dot(F.lag("_v").over(Window.partitionBy(key, "_r").orderBy("_o")), "_v"))
    per = within.groupBy(key, "_r").agg(F.count("_d").alias("_n"), F.sum("_d").alias("_s"), F.min_by("_v", "_o").alias("_first"), F.max_by("_v", "_o").alias("_last"))
    across = per.withColumn("_d", 1 - dot(F.lag("_last").over(Window.partitionBy(key).orderBy("_r")), "_first"))
    n = F.sum("_n") + F.count("_d")
    return across.groupBy(key).agg(n.alias("n"), F.coalesce((F.coalesce(F.sum("_s"), F.lit(0.0)) + F.coalesce(F.sum("_d"), F.lit(0.0))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("distance"))


def nearest(asked: DataFrame, rows: DataFrame, key: str, vector: str, digits: int = 6, block: int = 25_600, chunk: int = 4096) -> DataFrame:
    """key, nearest, similarity: for each asked vector the other row of the largest cosine (rounded; of equal ones the
    smallest key). A stated query set against all rows: whole blocks of queries meet whole chunks of rows, so that a
    pair of blocks is one matrix product and only one row per query and chunk goes on.

    key is a unique whole number; blocks and chunks are ranges of it. Null vectors and those of another length than the
    query's have similarity 0.5; a query that meets nothing but itself has no row.
    """
    kind = rows.schema[key].dataType.simpleString()
    pack = lambda df, span, ids, vectors: df.where(F.col(key).isNotNull()).groupBy(F.floor(F.col(key) / span).alias(f"_{ids}")).agg(F.collect_list(F.struct(key, F.col(vector).cast("array<double>").alias("v"))).alias(vectors)).drop(f"_{ids}")
    pairs = pack(asked, block, "q", "asked").crossJoin(pack(rows, chunk, "r", "rows"))  # of blocks, not of rows

    def unit(items: list, size: int) -> np.ndarray:
        out = np.full((len(items), size), np.nan)
        for i, x in enumerate(items):
            if x["v"] is not None and len(x["v"]) == size:
                out[i] = x["v"]
        return out

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked_, rows_ in zip(batch["asked"], batch["rows"]):
                ids = np.array([x[key] for x in rows_])
                order = np.argsort(ids)
                sizes = np.array([-1 if x["v"] is None else len(x["v"]) for x in asked_])
                for size in np.unique(sizes):
                    mine = [asked_[i] for i in np.flatnonzero(sizes == size)]
                    if size < 0:
                        s = np.full((len(mine), len(ids)), 0.5)
                    else:
                        a, b = unit(mine, size), unit(list(rows_), size)
                        s = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :] + 1e-10)
                        s = np.where(np.isnan(s), 0.5, s)
                    own = np.array([x[key] for x in mine])
                    s = np.round(np.where(own[:, None] == ids[None, :], -np.inf, s), digits)[:, order]
                    at = s.argmax(axis=1)
                    top = s[np.arange(len(mine)), at]
                    keep = np.isfinite(top)
                    yield pd.DataFrame({key: own[keep], "nearest": ids[order][at[keep]], "similarity": top[keep]})

    got = pairs.mapInPandas(best, f"{key} {kind}, nearest {kind}, similarity double")
    return got.groupBy(key).agg(F.max_by("nearest", F.struct("similarity", -F.col("nearest"))).alias("nearest"), F.max("similarity").alias("similarity"))


def surrealism_index() -> Column:
    """Of the four scores by their names."""
    return F.col("imagery_density") + F.col("metaphor_density") + F.col("surreal_imagery_score") + F.col("conceptual_distance_score")


def percent_delta(base: Column, other: Column) -> Column:
    """Rounded percentage of change, "n/a" for base 0, "nan%" for a missing value."""
    pct = F.when(base.isNull() | other.isNull() | F.isnan(base) | F.isnan(other), "nan%").otherwise(F.concat(F.bround((other - base) / F.nullif(base, F.lit(0.0)) * 100, 0).cast("long").cast("string"), F.lit("%")))
    return F.when(base == 0, "n/a").otherwise(pct)


def equal_width_density(df: DataFrame, value: str, group: str, bins: int = 30) -> DataFrame:
    """group, bin (1..bins), n, density over the range of all values; nulls are left out."""
    edge = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(edge))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width) + 1, F.lit(bins))).cast("int")
    per = rows.groupBy(group, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first(width).alias("_w"))
    total = F.sum("n").over(Window.partitionBy(group))
    return per.select(group, "bin", "n", (F.col("n") / (total * F.col("_w"))).alias("density"))


def gaussian_kde(df: DataFrame, value: str, group: str, points: int = 21) -> DataFrame:
    """group, x, density on `points` places between the least and largest value, with Scott's bandwidth per group.

    The places are an array on each row, so a value meets them without a join.
    """
    edge = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    band = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(value).alias("_s"))
    band = band.withColumn("_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).where("_h > 0")
    rows = salted_lookup(df.where(F.col(value).isNotNull()).select(group, value), band, group, "inner").join(F.broadcast(edge))
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (points - 1))
    rows = rows.select(group, value, "_h", F.posexplode(at).alias("_i", "x"))
    u = (F.col("x") - F.col(value)) / F.col("_h")
    return rows.groupBy(group, "_i").agg(F.first("x").alias("x"), (F.avg(F.exp(-u * u / 2)) / F.first("_h") / 2.5066282746310002).alias("density")).drop("_i")


def lower_upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, min, median, upper median (the upper middle element) and max per key."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.percentile(value, F.lit(0.5)).alias("median"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)").alias("upper_median"), F.max(value).alias("most"))
