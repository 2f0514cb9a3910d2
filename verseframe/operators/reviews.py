"""Review rows: cleaning, means, agreement of reviewers, pairs of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verseframe.functions import text as T
from verseframe.operators.skew import hot_keys

DIMENSIONS = ("originality", "emotion", "imagery")


def valid_scores(df: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Rows whose scores are all numbers in 1..5."""
    ok = F.lit(True)
    for d in dimensions:
        ok = ok & F.col(d).try_cast("double").between(1, 5)
    return df.where(ok)


def lenient_score(c: Column) -> Column:
    """Text or number as an integer score: fractions of numbers are cut, texts must be whole; null outside 1..5."""
    whole = F.when(c.try_cast("string").rlike(r"^\s*[+-]?\d+\s*$"), c.try_cast("int"))
    return F.when(whole.between(1, 5), whole)


def keep_last(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key with the values of its last row in the given order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def means(df: DataFrame, keys: list[str], dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reviews"), *[F.avg(d).alias(d) for d in dimensions])


def cohen_kappa(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", labels: range = range(1, 6)) -> DataFrame:
    """keys, n, exact_match, kappa of the score pairs a, b; kappa is 1 where chance agreement is 1."""
    n = F.count(F.lit(1)).alias("n")
    sides = [F.sum(F.when(F.col(s) == k, 1).otherwise(0)).alias(f"_{s}{k}") for s in (a, b) for k in labels]
    per = pairs.groupBy(*keys).agg(n, F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)).alias("exact_match"), *sides)
    expected = sum(F.col(f"_{a}{k}") * F.col(f"_{b}{k}") for k in labels) / (F.col("n") * F.col("n"))
    return per.withColumn("_e", expected).select(*keys, "n", "exact_match", F.when(F.col("_e") >= 1, 1.0).otherwise((F.col("exact_match") - F.col("_e")) / (1 - F.col("_e"))).alias("kappa"))


def reviewer_pair_counts(votes: DataFrame, item: str, reviewer: str, score: str, blocks: int = 16, min_rows: int = 10_000) -> DataFrame:
    """r1, r2, a, b, n: how often two reviewers (r1 < r2) gave an item the scores a and b.

    The reviewers' pairs are the result asked for. The votes of an item are gathered to one array, those of an item with
    more than min_rows votes to one of `blocks` arrays each, and every two arrays meet in a row of their own, so that no
    task has all votes of a much reviewed item. Null items match each other; null reviewers make no pairs.
    """
    rows = votes.select(F.col(item).alias("_item"), F.col(reviewer).alias("r"), F.col(score).alias("s")).where("r is not null").distinct()
    hot = hot_keys(rows, "_item", min_rows=min_rows)
    number = F.when(F.col("_item").isin(hot), blocks).otherwise(1) if hot else F.lit(1)
    parts = rows.groupBy("_item", F.pmod(F.xxhash64("r"), number).cast("int").alias("_b")).agg(F.collect_list(F.struct("r", "s")).alias("v"))
    if hot:
        left = parts.select("_item", "_b", F.explode(F.sequence("_b", number - 1)).alias("_c"), F.col("v").alias("x"))
        right = parts.select(F.col("_item").alias("_i"), F.explode(F.sequence(F.lit(0), "_b")).alias("_d"), F.col("_b").alias("_e"), F.col("v").alias("y"))
        parts = left.join(right, F.col("_item").eqNullSafe(F.col("_i")) & (F.col("_b") == F.col("_d")) & (F.col("_c") == F.col("_e")))
        parts = parts.select("x", "y", (F.col("_b") == F.col("_c")).alias("same"))
    else:
        parts = parts.select(F.col("v").alias("x"), F.col("v").alias("y"), F.lit(True).alias("same"))
    both = parts.select(F.explode("x").alias("x"), "y", "same").select("x", F.explode("y").alias("y"), "same")
    both = both.where("x.r < y.r or (not same and x.r > y.r)").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return both.groupBy(F.col("x.r").alias("r1"), F.col("y.r").alias("r2"), F.col("x.s").alias("a"), F.col("y.s").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def kappa_of_counts(counts: DataFrame, keys: list[str], labels: range = range(1, 6)) -> DataFrame:
    """As cohen_kappa, of counted pairs a, b, n."""
    sides = [F.sum(F.when(F.col(s) == k, F.col("n")).otherwise(0)).alias(f"_{s}{k}") for s in ("a", "b") for k in labels]
    per = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("_same"), *sides)
    e = sum(F.col(f"_a{k}") * F.col(f"_b{k}") for k in labels) / (F.col("_n") * F.col("_n"))
    o = F.col("_same") / F.col("_n")
    return per.select(*keys, F.col("_n").alias("n"), o.alias("exact_match"), F.when(e >= 1, 1.0).otherwise((o - e) / (1 - e)).alias("kappa"))


def nest_pairs(flat: DataFrame, order: str) -> DataFrame:
    """id, prompt, outputs: the first two outputs of each comparison with two or more, in the given order."""
    rows = flat.where("id is not null and prompt is not null and model is not null and poem is not null")
    per = rows.groupBy("id", "prompt").agg(F.array_sort(F.collect_list(F.struct(order, "model", "base_model", "poem"))).alias("o"))
    return per.where(F.size("o") >= 2).select("id", "prompt", F.transform(F.slice("o", 1, 2), lambda x: F.struct(x["model"].alias("model"), x["base_model"].alias("base_model"), x["poem"].alias("poem"))).alias("outputs"))


def flatten_pairs(nested: DataFrame) -> DataFrame:
    return nested.select("id", "prompt", F.posexplode("outputs").alias("_p", "o")).select("id", "prompt", (F.col("_p") + 1).alias("position"), "o.model", "o.base_model", "o.poem")


def blind(nested: DataFrame, reviewer: Column) -> DataFrame:
    """Flat outputs with a position and blind label that depend only on reviewer and comparison."""
    flip = F.conv(F.substring(F.sha2(F.concat(T.normal_name(reviewer), F.lit("::"), F.col("id").cast("string")), 256), 1, 1), 16, 10).cast("int") >= 8
    rows = nested.withColumn("_o", F.when(flip, F.reverse("outputs")).otherwise(F.col("outputs"))).select("id", "prompt", F.posexplode("_o").alias("_p", "o"))
    return rows.select("id", "prompt", (F.col("_p") + 1).alias("display_position"), F.element_at(F.array(F.lit("A"), F.lit("B")), F.col("_p") + 1).alias("blind_label"), "o.model", "o.poem")


def dense_rank_by(df: DataFrame, order: str, name: str, width: int = 100_000) -> DataFrame:
    """df with the 1-based place of each row by the whole number `order` (unique): places within ranges of `width`
    numbers, plus the rows of all ranges before; only one row per range meets in one task."""
    rows = df.withColumn("_b", F.floor(F.col(order) / width))
    per = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = per.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    local = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(order)))
    return local.join(before, "_b").withColumn(name, F.col("_n") + F.col("_before")).drop("_b", "_n", "_before")


def next_item(items: DataFrame, results: DataFrame, reviewers: DataFrame, order: str) -> DataFrame:
    """reviewer, id: the first item in order that the reviewer (whatever the case) has not scored; null when all are done.

    Per reviewer the scored items come as ranks; the first gap in the ranks is the next item, so that items and
    reviewers are never multiplied.
    """
    ranked = dense_rank_by(items.groupBy("id").agg(F.min(order).alias("_o")), "_o", "_k")
    who = T.normal_name("reviewer")
    done = results.select(who.alias("reviewer"), F.col("id")).distinct().join(ranked, "id").withColumn("_r", F.row_number().over(Window.partitionBy("reviewer").orderBy("_k")))
    reached = done.groupBy("reviewer").agg(F.max(F.when(F.col("_k") == F.col("_r"), F.col("_r"))).alias("_done"))
    people = reviewers.select(who.alias("reviewer")).distinct().join(reached, "reviewer", "left").select("reviewer", (F.coalesce("_done", F.lit(0)) + 1).alias("_k"))
    return people.join(ranked.select("_k", "id"), "_k", "left").select("reviewer", "id")
