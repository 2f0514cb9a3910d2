"""Samples, splits and augmentation by keyed hashes: the same rows on every run and at every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verseframe.functions import fixed as K


def keyed(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on seed and keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def sample(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """k rows, or all where k <= 0 or there are no more; a top-k by hash."""
    return df if k <= 0 else df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k)


def hash_sample(df: DataFrame, k: int, *key: str, by: str | None = None, seed: int = 42) -> list:
    """The rows of the k smallest keyed hashes (of each value of `by`, which has few), one per hash and in its order;
    all hashes where there are no more.

    Counts set thresholds on the hash that leave little more than k rows, so that no task sorts or sends k of its
    own: the bounded sample alone travels, at any number of partitions. Repeated keys fall together.
    """
    groups = df.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("n")).collect()
    h = F.xxhash64(F.lit(seed), *key)
    test = F.lit(False)
    for g in groups:
        share = min(1.0, (1.1 * k + 6 * k**0.5 + 20) / max(g["n"], 1))
        low = F.lit(True) if share >= 1 else h <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)))
        test = test | (low & (F.col(by).eqNullSafe(F.lit(g[by])) if by else F.lit(True)))
    per = df.where(test).groupBy(*([by] if by else []), h.alias("_h")).agg(F.min(F.struct(*df.columns)).alias("_r"))
    out, taken = [], {}
    for r in sorted(per.collect(), key=lambda r: r["_h"]):
        g = r[by] if by else None
        taken[g] = taken.get(g, 0) + 1
        if taken[g] <= k:
            out.append(r["_r"])
    return out


def unique_ids(df_session, count: int, least: int = 100_000, most: int = 999_999, seed: int = 42) -> DataFrame:
    """`count` distinct ids from the range, as id; more than it holds raise."""
    if count > most - least + 1:
        raise ValueError("more ids than the range holds")
    ids = df_session.range(least, most + 1)
    return ids.orderBy(F.xxhash64(F.lit(seed), "id")).limit(count)


def split(df: DataFrame, key: str, test_share: float = 0.1, seed: int = 42) -> DataFrame:
    """df with part ("train" or "test"), by a threshold on the keyed hash: no sort, no count, sizes right on average."""
    return df.withColumn("part", F.when(keyed(seed, key) < test_share, "test").otherwise("train"))


def bernoulli_prefix(chunk: Column | str, fragments: Column, key: Column | str, rate: float = 0.15, seed: int = 42) -> Column:
    c = F.col(chunk) if isinstance(chunk, str) else chunk
    pick = F.element_at(fragments, (F.pmod(F.xxhash64(F.lit(seed + 1), key), F.greatest(F.size(fragments), F.lit(1))) + 1).cast("int"))
    return F.when((F.size(fragments) > 0) & (keyed(seed, key) < rate), F.concat(pick, F.lit("\n"), c)).otherwise(c)


def augment(text: Column | str, key: Column | str, gate: float = 0.35, shuffle: float = 0.2, drop: float = 0.05, seed: int = 42) -> Column:
    """With chance `gate`: with chance `shuffle` the lines of stanzas over two lines are reordered, and words of lines
    over four words are dropped with chance `drop`, never below the first two."""
    t = F.col(text) if isinstance(text, str) else text
    k = F.col(key) if isinstance(key, str) else key

    def stir(s: Column) -> Column:
        lines = F.split(s, "\n")
        order = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.xxhash64(F.lit(seed + 2), k, i, x).alias("h"), i.alias("i"), x.alias("x"))))
        return F.when(F.size(lines) > 2, F.array_join(F.transform(order, lambda o: o["x"]), "\n")).otherwise(s)

    stirred = F.array_join(F.transform(F.split(t, "\n\n"), stir), "\n\n")
    base = F.when(keyed(seed + 1, k) < shuffle, stirred).otherwise(t)

    def thin(line: Column, n: Column) -> Column:
        w = F.split(line, " ")
        kept = F.filter(w, lambda x, i: F.pmod(F.xxhash64(F.lit(seed + 3), k, n, i), F.lit(10_000)) >= int(drop * 10_000))
        return F.when(F.size(w) > 4, F.array_join(F.when(F.size(kept) < 2, F.slice(w, 1, 2)).otherwise(kept), " ")).otherwise(line)

    return F.when(keyed(seed, k) < gate, F.array_join(F.transform(F.split(base, "\n"), thin), "\n")).otherwise(t)


def chat_example(poem: Column | str, key: Column | str, seed: int = 42) -> Column:
    """messages: an instruction chosen by the key, and the poem."""
    options = F.array(*[F.lit(x) for x in K.INSTRUCTIONS])
    pick = F.element_at(options, (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(K.INSTRUCTIONS))) + 1).cast("int"))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("user", pick), turn("assistant", F.col(poem) if isinstance(poem, str) else poem))
