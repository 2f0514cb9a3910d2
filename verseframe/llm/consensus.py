"""Consensus from several annotators' labels, by the triplet moment method (problem 4).

Votes are reduced to histograms per item: annotators are dealt into `POOLS` pools by a hash, and an item keeps one
histogram of votes per pool. The agreement rate of an annotator with a pool, and of two pools with each other, come
from these histograms alone, so no pairs of votes are ever formed and an item may have any number of votes. Corrected
for chance, the agreement of two independent judges is the product of their accuracies; three of them (an annotator
and two pools) give the annotator's accuracy as sqrt(a_1 a_2 / a_12), and the median over pairs of pools is taken.
Agreement and accuracy are taken per dimension. A judge's habit of voting higher or lower than others, or of using the
scale the wrong way round, is measured first and taken out. Votes are then combined with log-odds weights: an
annotator's chance to give a vote for a true label, from the accuracy, the habit, and how often the vote is given at
all; labels start with their shares among the votes of the accurate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verseframe.operators.skew import HOT_KEYS, HOT_ROWS, salted_lookup
from verseframe.session import cut_lineage

LABELS = 5
POOLS = 6
#: Of the votes that miss the true label, the share that stay near it, by NEAR for every step; the others fall as the
#: annotator's votes do in general.
MISSES, NEAR = 0.7, 0.25


def last_votes(results: DataFrame, reviewer: str = "reviewer", item: tuple[str, str] = ("comparison_id", "model"), dimensions: tuple[str, ...] = ("originality", "imagery"), scores: tuple[str, ...] = ("originality", "emotion", "imagery"), at: str = "submitted_at") -> DataFrame:
    """item_id, item_model, dimension, annotator, vote: per annotator and item the last submission with all scores in 1..5.

    Annotators are the same whatever case and outer blanks; blank or null ones, and null items, are left out. Ties in
    time go to the larger scores, so that the choice is the same on every run.
    """
    who = F.lower(F.btrim(F.col(reviewer), F.lit(" \t\r\n ")))
    rows = results.select(F.col(item[0]).alias("item_id"), F.col(item[1]).alias("item_model"), who.alias("annotator"), F.col(at).alias("_at"), *[F.col(s).cast("int").alias(s) for s in scores])
    ok = (F.col("annotator") != "") & F.col("item_id").isNotNull() & F.col("item_model").isNotNull()
    for s in scores:
        ok = ok & F.col(s).between(1, LABELS)
    last = rows.where(ok).groupBy("item_id", "item_model", "annotator").agg(F.max(F.struct("_at", *scores)).alias("_v"))
    votes = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"_v.{d}").alias("vote")) for d in dimensions])).alias("_d")
    return last.select("item_id", "item_model", "annotator", votes).select("item_id", "item_model", "_d.dimension", "annotator", "_d.vote")


def _keyed(votes: DataFrame) -> DataFrame:
    key = F.concat_ws("\x1f", "item_id", "item_model", "dimension")
    return votes.select("item_id", "item_model", "dimension", key.alias("_item"), F.concat_ws("\x1f", "annotator", "dimension").alias("_judge"), "annotator", "vote", F.pmod(F.xxhash64("annotator"), F.lit(POOLS)).cast("int").alias("pool"))


def _hot(counts: DataFrame, key: str, min_rows: int) -> list:
    """The keys of counts (key, n) to be salted."""
    return [r[0] for r in counts.where(F.col("n") > min_rows).orderBy(F.desc("n"), key).limit(HOT_KEYS).select(key).collect()]


def _histograms(votes: DataFrame, vote: str) -> DataFrame:
    """_item, dimension, h: counts of votes per pool and label, POOLS * LABELS numbers."""
    cell = F.col("pool") * LABELS + F.col(vote) - 1
    cells = [F.sum((cell == c).cast("double")) for c in range(POOLS * LABELS)]
    return votes.groupBy("_item", "dimension").agg(F.array(*cells).alias("h"))


def _summed(parts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, n, m: sums of partial rows (n, m of `size` numbers)."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m"))


def pool_agreement(hist: DataFrame) -> dict[str, np.ndarray]:
    """Per dimension the agreement of every two pools, corrected for chance; nan where they share no item."""
    ps, qs = np.triu_indices(POOLS, 1)

    def add(batches):
        for b in batches:
            for dim, rows in b.groupby("dimension"):
                h = np.stack(rows["h"].to_numpy()).reshape(-1, POOLS, LABELS)
                n = h.sum(axis=2)
                both = n[:, ps] * n[:, qs]
                dots = (h[:, ps] * h[:, qs]).sum(axis=2)
                m = np.concatenate([np.where(both > 0, dots / np.maximum(both, 1), 0).sum(axis=0), (both > 0).sum(axis=0), h.sum(axis=0).ravel()])
                yield pd.DataFrame({"dimension": [dim], "n": [len(h)], "m": [m.tolist()]})

    out, k = {}, len(ps)
    for r in _summed(hist.mapInPandas(add, "dimension string, n long, m array<double>"), ["dimension"], 2 * k + POOLS * LABELS).collect():
        m = np.array(r["m"])
        share = m[2 * k :].reshape(POOLS, LABELS)
        share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-9)
        chance = (share[ps] * share[qs]).sum(axis=1)
        found = np.full((POOLS, POOLS), np.nan)
        rate = m[:k] / np.where(m[k : 2 * k] > 0, m[k : 2 * k], np.nan)
        found[ps, qs] = found[qs, ps] = (rate - chance) / np.maximum(1 - chance, 1e-9)
        out[r["dimension"]] = found
    return out


def judge_moments(votes: DataFrame, hist: DataFrame, hot: list) -> DataFrame:
    """_judge, dimension, n, m: per pool the sum of agreements with the pool's other votes on the same items, the items
    that have some, and the sum of the pool's shares of every label; then counts of the judge's votes per label, without
    and with the habit. Agreement of a vote with a pool is the share of the pool's other votes that equal it."""
    joined = salted_lookup(votes.select("_item", "_judge", "dimension", "pool", "even", "vote"), hist.drop("dimension"), "_item", "inner", hot=hot)

    def add(batches):
        for b in batches:
            h = np.stack(b["h"].to_numpy()).reshape(-1, POOLS, LABELS) if len(b) else np.zeros((0, POOLS, LABELS))
            row, even = np.arange(len(b)), b["even"].to_numpy(int) - 1
            h[row, b["pool"].to_numpy(int), even] -= 1
            n = h.sum(axis=2)
            share = np.where(n[:, :, None] > 0, h / np.maximum(n, 1)[:, :, None], 0.0)
            kinds = [np.eye(LABELS)[even], np.eye(LABELS)[b["vote"].to_numpy(int) - 1]]
            m = np.concatenate([share[row, :, even], n > 0, share.reshape(len(b), -1), *kinds], axis=1)
            code, judges = pd.factorize(b["_judge"])
            total = np.zeros((len(judges), m.shape[1]))
            np.add.at(total, code, m)
            dims = b["dimension"].groupby(code).first()
            yield pd.DataFrame({"_judge": judges, "dimension": dims.to_numpy(), "n": np.bincount(code, minlength=len(judges)), "m": total.tolist()})

    size = POOLS * (2 + LABELS) + 2 * LABELS
    return _summed(joined.mapInPandas(add, "_judge string, dimension string, n long, m array<double>"), ["_judge", "dimension"], size)


def judge_accuracies(moments: DataFrame, pools: dict[str, np.ndarray]) -> DataFrame:
    """_judge, dimension, n_votes, accuracy, even, given: chance-corrected accuracy in [0, 0.98], the median over the
    triplets (judge, pool, pool), 0.3 where there are none; and the counts of votes per label without and with habit."""
    ps, qs = np.triu_indices(POOLS, 1)

    def solve(batches):
        for b in batches:
            m = np.stack(b["m"].to_numpy()) if len(b) else np.zeros((0, POOLS * (2 + LABELS) + 2 * LABELS))
            same, n = m[:, :POOLS], m[:, POOLS : 2 * POOLS]
            shares = m[:, 2 * POOLS : -2 * LABELS].reshape(-1, POOLS, LABELS) / np.maximum(n, 1e-9)[:, :, None]
            even, given = m[:, -2 * LABELS : -LABELS], m[:, -LABELS:]
            chance = (even[:, None, :] / np.maximum(even.sum(axis=1), 1)[:, None, None] * shares).sum(axis=2)
            agree = np.where(n > 0, (same / np.maximum(n, 1e-9) - chance) / np.maximum(1 - chance, 1e-3), np.nan)
            between = np.array([pools[d][ps, qs] for d in b["dimension"]]).reshape(len(b), len(ps))
            known = (between > 0.01) & ~np.isnan(agree[:, ps]) & ~np.isnan(agree[:, qs])
            product = agree[:, ps] * agree[:, qs] / np.where(known, between, 1.0)
            each = np.where(known, np.where((product > 0) & (agree[:, ps] > 0), np.sqrt(np.abs(product)), 0.0), np.nan)
            some = known.any(axis=1)
            accuracy = np.full(len(b), 0.3)
            accuracy[some] = np.clip(np.nanmedian(each[some], axis=1), 0.0, 0.98)
            yield pd.DataFrame({"_judge": b["_judge"], "dimension": b["dimension"], "n_votes": b["n"], "accuracy": accuracy, "even": even.tolist(), "given": given.tolist()})

    return moments.mapInPandas(solve, "_judge string, dimension string, n_votes long, accuracy double, even array<double>, given array<double>")


def label_shares(accuracies: DataFrame) -> dict[str, np.ndarray]:
    """Per dimension the shares of the labels among the votes of accurate judges, habits taken out."""
    sums = accuracies.where("accuracy > 0.3").groupBy("dimension").agg(*[F.sum(F.col("even")[k]).alias(f"s{k}") for k in range(LABELS)])
    out = {}
    for r in sums.collect():
        n = np.array([r[f"s{k}"] for k in range(LABELS)]) + 1.0
        out[r["dimension"]] = n / n.sum()
    return out


def vote_weights(accuracies: DataFrame, confusion: DataFrame | None = None, strength: float = 8.0) -> DataFrame:
    """_judge, w: log P(vote | label) per label and vote. confusion: votes counted per label and vote (c), which the
    model's chances then smooth."""
    base = accuracies if confusion is None else accuracies.join(confusion.hint("merge"), "_judge", "left")

    def weigh(batches):
        near = np.zeros((LABELS, LABELS))
        for step in [d for d in range(1 - LABELS, LABELS) if d]:  # a miss beyond the end of the scale is a vote for its end
            near[np.arange(LABELS), np.clip(np.arange(LABELS) + step, 0, LABELS - 1)] += NEAR ** abs(step)
        near /= near.sum(axis=1, keepdims=True)
        for b in batches:
            out = []
            for i in range(len(b)):
                a, at = min(b["accuracy"].iloc[i], 0.97), np.clip(np.arange(LABELS) + int(b["shift"].iloc[i]), 0, LABELS - 1)
                given = (np.asarray(b["given"].iloc[i]) + 1) / (np.sum(b["given"].iloc[i]) + LABELS)
                e = min(MISSES, 2 * a)  # the votes of one who agrees with nobody tell nothing
                meant = (a * np.eye(LABELS) + (1 - a) * e * near)[at]
                p = (meant[:, ::-1] if b["turned"].iloc[i] else meant) + (1 - a) * (1 - e) * given[None, :]
                if "c" in b.columns and b["c"].iloc[i] is not None:
                    c = np.asarray(b["c"].iloc[i], dtype=float).reshape(LABELS, LABELS)
                    p = (c + strength * p) / (c.sum(axis=1, keepdims=True) + strength)
                out.append(np.log(p / p.sum(axis=1, keepdims=True)).ravel().tolist())
            yield pd.DataFrame({"_judge": b["_judge"], "w": out})

    return base.mapInPandas(weigh, "_judge string, w array<double>")


def weighted_labels(votes: DataFrame, weights: DataFrame, shares: dict[str, np.ndarray], hot: list) -> DataFrame:
    """_item, label, margin: votes combined with the log-odds `w` of each judge (LABELS true labels by LABELS votes)."""
    joined = salted_lookup(votes, weights, "_judge", "inner", hot=hot)
    odds = [F.sum(F.element_at("w", F.lit((k - 1) * LABELS) + F.col("vote"))).alias(f"o{k}") for k in range(1, LABELS + 1)]
    summed = joined.groupBy("_item", "item_id", "item_model", "dimension").agg(F.count(F.lit(1)).alias("n_votes"), *odds)
    start = [F.coalesce(*[F.when(F.col("dimension") == d, float(np.log(s[k - 1]))) for d, s in shares.items()], F.lit(0.0)) for k in range(1, LABELS + 1)]
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.round(F.col(f"o{k}") + start[k - 1], 9).alias("o"), F.lit(-abs(k - 3)).alias("t"), F.lit(k).alias("k")) for k in range(1, LABELS + 1)])))
    return summed.withColumn("_r", ranked).select("_item", "item_id", "item_model", "dimension", "n_votes", F.element_at("_r", 1)["k"].cast("long").alias("label"), (F.element_at("_r", 1)["o"] - F.element_at("_r", 2)["o"]).alias("margin"))


def consensus(results: DataFrame, min_rows: int = HOT_ROWS, rounds: int = 0, **columns) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, judges, votes).

    labels: item_id, item_model, dimension, n_votes, label (1..5), margin (log-odds over the second label); an item
    without a valid vote has no row. judges: annotator, dimension, n_votes, shift, turned (whether the scale was used the
    wrong way round), accuracy (0 for a judge who agrees with nobody beyond chance, habits apart). Ties between labels go to the one nearer the middle of the scale, then the higher.
    rounds: after the vote, so often count each judge's votes per label found and weigh anew; 0 leaves it at the
    triplets.
    """
    votes = cut_lineage(_keyed(last_votes(results, **columns)))
    # habits: the mean distance from the other votes on the same items
    total = cut_lineage(votes.groupBy("_item").agg(F.sum("vote").alias("_s"), F.count(F.lit(1)).alias("n")))
    hot_items = _hot(total, "_item", min_rows)
    with_total = salted_lookup(votes, total, "_item", "inner", hot=hot_items)
    others = F.when(F.col("n") > 1, (F.col("_s") - F.col("vote")) / (F.col("n") - 1))
    v, o = F.when(F.col("n") > 1, F.col("vote").cast("double")), F.col("o")
    pairs = with_total.select("_judge", v.alias("v"), others.alias("o"))
    sums = pairs.groupBy("_judge").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(o.isNotNull(), F.col("v"))).alias("_v"), F.avg("o").alias("_o"), F.covar_pop("v", "o").alias("_cov"), F.var_pop("v").alias("_vv"), F.var_pop("o").alias("_oo"))
    least, cov = 0.15 * F.sqrt(F.col("_vv") * F.col("_oo")), F.coalesce(F.col("_cov"), F.lit(0.0))
    turned = F.coalesce(cov < -least, F.lit(False))
    shift = F.when(turned, F.round(LABELS + 1 - F.col("_v") - F.col("_o"))).when(cov > least, F.round(F.col("_v") - F.col("_o"))).otherwise(0).cast("int")
    habits = cut_lineage(sums.select("_judge", "n", shift.alias("shift"), turned.alias("turned")))
    hot_judges = _hot(habits, "_judge", min_rows)
    aligned = salted_lookup(votes, habits.drop("n"), "_judge", "inner", hot=hot_judges)
    upright = F.when(F.col("turned"), LABELS + 1 - F.col("vote")).otherwise(F.col("vote"))
    aligned = cut_lineage(aligned.withColumn("even", F.greatest(F.lit(1), F.least(F.lit(LABELS), upright - F.col("shift")))))
    hist = cut_lineage(_histograms(aligned, "even"))
    solved = judge_accuracies(judge_moments(aligned, hist, hot_items), pool_agreement(hist))
    solved = cut_lineage(solved.join(habits.drop("n").hint("merge"), "_judge"))
    shares = label_shares(solved)
    labels = weighted_labels(aligned, vote_weights(solved), shares, hot_judges)
    for _ in range(rounds):
        labels = cut_lineage(labels)
        known = salted_lookup(aligned.select("_item", "_judge", "vote"), labels.select("_item", "label", "margin"), "_item", "inner", hot=hot_items)
        sure = F.lit(1.0) - F.exp(-F.col("margin"))
        cells = [F.sum(F.when((F.col("label") == k) & (F.col("vote") == v), sure).otherwise(0.0)) for k in range(1, LABELS + 1) for v in range(1, LABELS + 1)]
        confusion = known.groupBy("_judge").agg(F.array(*cells).alias("c"))
        labels = weighted_labels(aligned, vote_weights(solved, confusion), shares, hot_judges)
    judges = solved.select(F.substring_index("_judge", "\x1f", 1).alias("annotator"), "dimension", "n_votes", "shift", "turned", "accuracy")
    return labels.drop("_item"), judges, votes


def agreement(votes: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """dimension, n_items, n_votes, observed, expected, kappa: chance-corrected agreement of two votes on an item.

    From the histogram of each item with two votes or more: observed is the mean share of equal pairs, expected the
    chance of equal votes under the overall distribution. Kappa is null where everybody always votes the same.
    """
    per = votes.groupBy("dimension", "_item").agg(*[F.sum(F.when(F.col("vote") == k, 1).otherwise(0)).cast("double").alias(f"h{k}") for k in range(1, LABELS + 1)])
    n = sum(F.col(f"h{k}") for k in range(1, LABELS + 1))
    pairs = sum(F.col(f"h{k}") * (F.col(f"h{k}") - 1) for k in range(1, LABELS + 1))
    sums = per.withColumn("n", n).where("n > 1").groupBy("dimension").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").cast("long").alias("n_votes"), F.avg(pairs / (F.col("n") * (F.col("n") - 1))).alias("observed"), *[F.sum(f"h{k}").alias(f"h{k}") for k in range(1, LABELS + 1)])
    expected = sum((F.col(f"h{k}") / F.col("n_votes")) * (F.col(f"h{k}") / F.col("n_votes")) for k in range(1, LABELS + 1))
    return sums.withColumn("expected", expected).select("dimension", "n_items", "n_votes", "observed", "expected", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")).alias("kappa"))
