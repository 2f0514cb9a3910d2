"""Text cut off by field limits or in transfer (problem 3).

Per source the right-censored length distribution is fitted by maximum likelihood: lengths are log-normal, and a
length with far more rows than the distribution allows is a candidate limit, at which a share of the texts that
would have been longer was cut. The share is estimated by EM together with the endings of the rows at the limit,
so that texts which happen to end there stay sound. A row's posterior joins the censoring odds at its length, the
ending evidence, and what the recorded length says, in the unit the source measures lengths in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from verseframe.llm import endings
from verseframe.llm.linear import LinearModel
from verseframe.llm.pairtext import folded, is_copy, is_empty, without_prompt
from verseframe.operators.sampling import hash_sample
from verseframe.operators.skew import HOT_ROWS, salted_lookup
from verseframe.operators.spread import spread
from verseframe.session import cut_lineage

UNITS = ("chars", "bytes", "words")
#: Recorded lengths may exceed a sound text's by this much, for outer blanks that were stripped.
SLACK = 3
#: Log-odds that a row was cut in transfer, before any evidence.
PRIOR = -2.2
#: Log-likelihood ratio of a recorded length beyond the slack, and of one within it.
LONGER, EQUAL = 9.0, -0.7
_BINS = np.arange(-12.0, 13.0, 1.0)


def _phi(x: np.ndarray | float) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(np.asarray(x, dtype=float) / math.sqrt(2)))


def fit_censored(lengths: np.ndarray, counts: np.ndarray, censored: dict[int, float], rounds: int = 40) -> tuple[float, float]:
    """Mean and deviation of log lengths by EM for right-censored data; censored: rows at a length that were cut there."""
    x, n = np.log(np.maximum(lengths, 1)), counts.astype(float).copy()
    c_at, c_n = [], []
    for i, length in enumerate(lengths):
        k = min(censored.get(int(length), 0.0), n[i])
        if k:
            n[i] -= k
            c_at.append(math.log(max(length, 1)))
            c_n.append(k)
    total = n.sum() + sum(c_n)
    if total < 2:
        return 0.0, 1.0
    mu = float((n * x).sum() / max(n.sum(), 1e-9))
    sd = max(float(math.sqrt((n * (x - mu) ** 2).sum() / max(n.sum(), 1e-9))), 0.05)
    for _ in range(rounds if c_at else 0):
        a = (np.array(c_at) - mu) / sd
        tail = np.maximum(1 - _phi(a), 1e-9)
        haz = np.exp(-0.5 * a * a) / math.sqrt(2 * math.pi) / tail
        e1 = mu + sd * haz
        e2 = mu * mu + sd * sd + sd * haz * (np.array(c_at) + mu)
        mu2 = float(((n * x).sum() + (np.array(c_n) * e1).sum()) / total)
        sd2 = float(((n * x * x).sum() + (np.array(c_n) * e2).sum()) / total - mu2 * mu2)
        mu, sd = mu2, max(math.sqrt(max(sd2, 1e-9)), 0.05)
    return mu, sd


def find_limits(hist: pd.DataFrame, min_rows: int = 3, max_p: float = 1e-4, tolerance: float = 0.5) -> pd.DataFrame:
    """hist: length, bin, n of one source and unit. Returns length, share: limits and the share of rows cut there.

    Candidates are lengths with more rows than chance allows beside their neighbours. The share of cut rows at each is
    the most likely one given the endings of its rows and the number of whole texts that may end there, which is what
    the fitted length distribution and the neighbours let expect, up to a factor of about exp(tolerance). Linear in
    the number of different lengths but for sorting.
    """
    per = hist.groupby("length")["n"].sum().sort_index()
    lengths, counts = per.index.to_numpy(), per.to_numpy().astype(float)
    empty = pd.DataFrame({"length": np.zeros(0, int), "share": np.zeros(0)})
    if not len(lengths):
        return empty
    total, sums = counts.sum(), np.concatenate([[0.0], np.cumsum(counts)])
    width = np.maximum(10, (lengths * 0.15).astype(int))
    near = sums[np.searchsorted(lengths, lengths + width, "right")] - sums[np.searchsorted(lengths, lengths - width, "left")] - counts
    expect = np.maximum(np.maximum(near / (2 * width), 0.02 * total / max(lengths.max(), 1)), 1e-9)
    level = max_p / len(lengths) * 10
    least = counts * np.log(expect) - expect - np.array([math.lgamma(n + 1) for n in counts])  # of the tail's logarithm
    likely = np.flatnonzero((counts >= min_rows) & (counts > expect) & (least < math.log(level)))
    found = [i for i in likely if _poisson_tail(int(counts[i]), float(expect[i])) < level]
    if not found:
        return empty
    at = hist[hist["length"].isin(lengths[found])]
    endings_at = {int(k): (np.exp(np.clip(g["bin"].to_numpy(float), -12, 12)), g["n"].to_numpy(float)) for k, g in at.groupby("length")}
    shares = np.linspace(0.001, 0.999, 400)
    cut = {int(lengths[i]): max(counts[i] - expect[i], 0.0) for i in found}
    for _ in range(3):
        mu, sd = fit_censored(lengths, counts, cut)
        for i in found:
            length = int(lengths[i])
            z = (math.log(max(length, 1)) - mu) / sd
            natural = max(expect[i], total * math.exp(-0.5 * z * z) / (max(length, 1) * sd * math.sqrt(2 * math.pi)))
            ratio, n = endings_at[length]
            score = (np.log(shares[:, None] * ratio[None, :] + 1 - shares[:, None]) * n[None, :]).sum(axis=1)
            score -= np.log(((1 - shares) * counts[i] + 0.5) / (natural + 0.5)) ** 2 / (2 * (tolerance**2 + 1 / (natural + 0.5)))
            cut[length] = float(shares[np.argmax(score)]) * counts[i]
    return pd.DataFrame([(int(lengths[i]), cut[int(lengths[i])] / counts[i]) for i in found], columns=["length", "share"])


def _poisson_tail(n: int, rate: float) -> float:
    """P(X >= n), summed from the term nearest to n outwards, whose logarithm stays in range at any rate."""
    if n <= 0 or rate <= 0:
        return float(n <= 0)
    k = n if n > rate else n - 1
    term, total = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)), 0.0
    while term > total * 1e-17:
        total += term
        term *= rate / (k + 1) if n > rate else k / rate
        k += 1 if n > rate else -1
    return min(total, 1.0) if n > rate else max(1 - total, 0.0)


def fit_endings(rows: DataFrame) -> tuple[endings.WordUse, LinearModel]:
    """Word counts over all rows (row_id, text) and the line model trained on a bounded sample of them."""
    use = endings.word_use(rows)
    sample = hash_sample(rows.select("row_id", "text").where("length(text) > 40"), endings.SAMPLE, "row_id")
    return use, endings.train(sorted({r["text"] for r in sample}), use)


def ending_evidence(texts: list[str], bodies: list[str], use: endings.WordUse, lines: LinearModel) -> np.ndarray:
    """Log-likelihood ratio of cut against complete, from the ending of every body (of the text where that is blank)."""
    ends = [endings.ending_of(b if b.strip() else t) for t, b in zip(texts, bodies)]
    got = np.array([endings.cut_evidence(e, w) for e, w in zip(ends, endings.line_odds(ends, use, lines))])
    lost = np.array([t.rstrip().endswith("�") for t in texts], dtype=bool)
    return np.where(lost, np.maximum(got, 6.0), got) if len(got) else np.zeros(0)


#: What is known of a row's text once it has been read.
SCORED = "row_id {kind}, source string, chars int, bytes int, words int, recorded long, evidence double, usable boolean, filled boolean"


def measured(batch: pd.DataFrame, evidence: np.ndarray, usable: list[bool]) -> pd.DataFrame:
    """The columns of SCORED for a batch of row_id, source, text, recorded."""
    texts = batch["text"].tolist()
    out = pd.DataFrame({"row_id": batch["row_id"], "source": batch["source"]})
    out["chars"], out["bytes"] = [len(t) for t in texts], [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
    out["words"], out["recorded"] = [len(t.split()) for t in texts], batch["recorded"].astype("Int64")
    out["evidence"], out["usable"], out["filled"] = evidence, usable, [bool(t.strip()) for t in texts]
    return out


def read_rows(df: DataFrame, row_id: str, source: str, prompt: str, text: str, length: str | None) -> DataFrame:
    """row_id, source, prompt, text, recorded of the rows with an id."""
    recorded = F.col(length).cast("long") if length else F.lit(None).cast("long")
    rows = df.select(F.col(row_id).alias("row_id"), F.col(source).cast("string").alias("source"), F.col(prompt).alias("prompt"), F.col(text).alias("text"), recorded.alias("recorded"))
    return spread(rows.where("row_id is not null"))


def scored_rows(rows: DataFrame, fitted: tuple | None = None) -> DataFrame:
    """SCORED of the distinct rows (read_rows) with a text: one pass over the texts, none shuffled."""
    rows = rows.where("text is not null")
    shared = rows.sparkSession.sparkContext.broadcast(fitted or fit_endings(rows))
    kind = rows.schema["row_id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use, model = shared.value
        for b in batches:
            texts, prompts = b["text"].tolist(), b["prompt"].tolist()
            usable = [not is_empty(t, w) and not is_copy(t, p, w) for t, p, w in zip(texts, prompts, map(folded, texts))]
            yield measured(b, ending_evidence(texts, [without_prompt(t, p) for t, p in zip(texts, prompts)], use, model), usable)

    return cut_lineage(rows.mapInPandas(score, SCORED.format(kind=kind)).distinct())


def source_units(rows: DataFrame) -> DataFrame:
    """source, unit: the unit in which most recorded lengths of a source fit the texts (ties: characters first)."""
    fits = [F.sum(F.when((F.col("recorded") - F.col(u)).between(0, SLACK), 1).otherwise(0)).alias(u) for u in UNITS]
    best = F.when((F.col("chars") >= F.col("bytes")) & (F.col("chars") >= F.col("words")), "chars").when(F.col("bytes") >= F.col("words"), "bytes").otherwise("words")
    return rows.where("recorded is not null and usable").groupBy("source").agg(*fits).select("source", best.alias("unit"))


def _at(unit: str) -> Column:
    return F.concat_ws("\x1f", F.lit(unit), F.coalesce("source", F.lit("\x00")), F.col(unit).cast("string"))


def source_limits(rows: DataFrame) -> DataFrame:
    """unit, source, length, share of every candidate limit; rows are first reduced to counts per length and evidence."""
    parts = None
    for unit in ("chars", "bytes"):
        part = rows.where("usable").select(F.lit(unit).alias("unit"), "source", F.col(unit).alias("length"), F.round("evidence").cast("int").alias("bin"))
        parts = part if parts is None else parts.unionByName(part)
    hist = parts.groupBy("unit", "source", "length", "bin").agg(F.count(F.lit(1)).alias("n"))

    def limits(hist: pd.DataFrame) -> pd.DataFrame:
        got = find_limits(hist)
        got.insert(0, "source", hist["source"].iloc[0])
        got.insert(0, "unit", hist["unit"].iloc[0])
        return got

    return hist.groupBy("unit", "source").applyInPandas(limits, "unit string, source string, length int, share double")


def at_limits(rows: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """rows (source, chars, bytes, evidence, usable) with _share: the share of rows cut at a limit of their length, else null."""
    limits = cut_lineage(source_limits(rows))
    for unit in ("chars", "bytes"):
        at = limits.where(F.col("unit") == unit).select(F.concat_ws("\x1f", F.lit(unit), F.coalesce("source", F.lit("\x00")), F.col("length").cast("string")).alias(f"_{unit}"), F.col("share").alias(f"_{unit}_share"))
        rows = salted_lookup(rows.withColumn(f"_{unit}", _at(unit)), at, f"_{unit}", min_rows=min_rows)
    return rows.withColumn("_share", F.greatest("_chars_share", "_bytes_share"))


def limit_log_odds() -> Column:
    """Log-odds of a cut before the ending is looked at."""
    share = F.col("_share")
    return F.when(share.isNotNull(), F.greatest(F.log(share / (1 - share)), F.lit(PRIOR))).otherwise(F.lit(PRIOR))


def cut_posteriors(df: DataFrame, row_id: str = "row_id", source: str = "run_name", prompt: str = "prompt", text: str = "output", length: str | None = "output_length", min_rows: int = HOT_ROWS, fitted: tuple | None = None) -> DataFrame:
    """row_id, source, log_odds, filled: the log-odds that a row's text lacks its end.

    One row per row_id (exact duplicates fall together; of others the largest log-odds count). Rows with a null
    text do not appear; blank texts, texts that hold no answer and mere copies of the prompt get very small odds
    unless the recorded length tells that more was there. A null source is a source of its own.
    """
    return posteriors_of(scored_rows(read_rows(df, row_id, source, prompt, text, length), fitted), min_rows)


def posteriors_of(rows: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """cut_posteriors from the columns of SCORED."""
    units = source_units(rows).select(F.coalesce("source", F.lit("\x00")).alias("_s"), "unit")
    keyed = salted_lookup(rows.withColumn("_s", F.coalesce("source", F.lit("\x00"))), units, "_s", min_rows=min_rows)
    size = F.when(F.col("unit") == "bytes", F.col("bytes")).when(F.col("unit") == "words", F.col("words")).otherwise(F.col("chars"))
    excess = F.col("recorded") - size
    keyed = keyed.withColumn("_recorded", F.when(excess.isNull(), 0.0).when(excess > SLACK, LONGER).when(excess >= 0, EQUAL).otherwise(0.0))
    keyed = at_limits(keyed, min_rows)
    prior = limit_log_odds()
    odds = F.when(F.col("usable"), prior + F.col("evidence") + F.col("_recorded")).when(F.col("filled") & (F.col("_recorded") == LONGER), F.lit(1.0)).otherwise(F.lit(-20.0))
    keyed = keyed.withColumn("log_odds", odds)
    return keyed.groupBy("row_id").agg(F.max("source").alias("source"), F.max("log_odds").alias("log_odds"), F.max("filled").alias("filled"))


def truncation_report(posteriors: DataFrame) -> DataFrame:
    """Per source: rows with a text, cut rows and their share."""
    cut = F.sum(F.when(F.col("log_odds") > 0, 1).otherwise(0))
    return posteriors.where("filled").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), cut.alias("n_cut"), (cut / F.count(F.lit(1))).alias("share_cut"))
