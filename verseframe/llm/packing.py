"""Filling fixed-capacity blocks with texts by a distributed grouping genetic algorithm (problem 6).

Sizes are tokens of a public tokenizer. Texts are dealt into shards of about `shard_items` by a hash; each shard is
packed on several islands, every island evolving its own population. Crossover injects whole well-filled blocks of
one parent into another, drops the blocks that hold duplicates of their texts and puts the displaced texts back by
best fit, largest first; mutation dissolves poorly filled blocks. Between epochs the elites of each island migrate to
the next. Of each shard's best packing the well-filled blocks are kept, and the texts of the others are dealt anew
into shards of their own until one shard holds the rest, so that the loss at shard borders vanishes.

Only a text over the capacity is split, into full blocks and one rest, which is packed like any other text.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verseframe.operators.spread import spread
from verseframe.session import cut_lineage

CAPACITY = 2048
#: The rank form of a vocabulary gives the same tokens as its JSON form, in a quarter of the time.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how texts are split before the merges of this vocabulary
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_ITEMS = 2000
ISLANDS, POPULATION, GENERATIONS, EPOCHS, ELITES = 3, 6, 8, 2, 2
#: Blocks at least this full are final before the last level.
GOOD = 0.995


def counter(tokenizer: str, pattern: str = SPLIT) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts. tokenizer: path of a rank file (.tiktoken; `pattern` splits texts before the merges)
    or of a tokenizers JSON file. Names of special tokens in a text are ordinary text."""
    if tokenizer.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encode = tiktoken.Encoding(tokenizer, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer)
    made.encode_special_tokens = True
    return lambda texts: [len(e) for e in made.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens of whole texts; null and empty texts have 0. tokenizer: a file that `counter` reads."""
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = counter(tokenizer)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            n = [k for lo in range(0, len(texts), 256) for k in number(texts[lo : lo + 256])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.array(n, dtype=np.int64)})

    return docs.mapInPandas(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, size: one piece per text, or the full blocks and the rest of a text over the capacity."""
    full = F.floor((F.col("n_tokens") - 1) / capacity)
    cut = F.when(F.col("n_tokens") > capacity, F.transform(F.sequence(F.lit(0).cast("long"), full), lambda k: F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - k * capacity))).otherwise(F.array("n_tokens"))
    return sizes.select("doc_id", F.posexplode(cut).alias("piece", "size")).select("doc_id", "piece", F.col("size").cast("int").alias("size"))


class Packing:
    """One member of a population: the block of every item."""

    __slots__ = ("bin_of", "loads", "fitness")

    def __init__(self, bin_of: np.ndarray, sizes: np.ndarray, capacity: int) -> None:
        _, self.bin_of = np.unique(bin_of, return_inverse=True)
        self.loads = np.bincount(self.bin_of, weights=sizes).astype(np.int64)
        self.fitness = float(((self.loads / capacity) ** 2).sum() / len(self.loads)) if len(self.loads) else 1.0


def best_fit(bin_of: np.ndarray, sizes: np.ndarray, items: np.ndarray, room: dict[int, int], capacity: int) -> None:
    """Puts the items, in the given order, where the least room is left; opens new blocks as needed."""
    free = sorted((r, b) for b, r in room.items() if r > 0)
    fresh = max(room, default=-1) + 1
    full = min(room, default=None) if room else None
    for i in items:
        s = int(sizes[i])
        if s == 0 and full is not None:
            bin_of[i] = full
            continue
        k = bisect.bisect_left(free, (s, -1))
        if k == len(free):
            bin_of[i] = fresh
            left, b = capacity - s, fresh
            fresh += 1
        else:
            r, b = free.pop(k)
            bin_of[i] = b
            left = r - s
        full = b if full is None else full
        if left > 0:
            bisect.insort(free, (left, b))


def _decreasing(sizes: np.ndarray, items: np.ndarray, rng: np.random.Generator, noise: float) -> np.ndarray:
    key = sizes[items] * (1 + noise * rng.standard_normal(len(items))) if noise else sizes[items].astype(float)
    return items[np.argsort(-key, kind="stable")]


def _rebuilt(kept: np.ndarray, parent: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> Packing:
    """The parent with only the kept blocks; all other items put back by best fit."""
    bin_of = np.where(kept[parent.bin_of], parent.bin_of, -1)
    room = {int(b): int(capacity - parent.loads[b]) for b in np.flatnonzero(kept)}
    best_fit(bin_of, sizes, _decreasing(sizes, np.flatnonzero(bin_of < 0), rng, noise), room, capacity)
    return Packing(bin_of, sizes, capacity)


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """b's well-filled blocks injected into a; a's blocks with duplicates go, displaced items are best-fitted."""
    fill = b.loads / capacity
    inject = (rng.random(len(fill)) < 0.6) & (fill >= np.quantile(fill, 0.4))
    taken = inject[b.bin_of]
    hit = np.zeros(len(a.loads), bool)
    hit[a.bin_of[taken]] = True
    n = len(a.loads)
    bin_of = np.where(taken, b.bin_of + n, np.where(hit[a.bin_of], -1, a.bin_of))
    room = {int(k): int(capacity - a.loads[k]) for k in np.flatnonzero(~hit)} | {int(k + n): int(capacity - b.loads[k]) for k in np.flatnonzero(inject)}
    best_fit(bin_of, sizes, _decreasing(sizes, np.flatnonzero(bin_of < 0), rng, 0.0), room, capacity)
    return Packing(bin_of, sizes, capacity)


def mutate(a: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """The least filled blocks and a few others dissolved and best-fitted again."""
    kept = rng.random(len(a.loads)) > 0.03
    kept[np.argsort(a.loads)[: max(2, len(a.loads) // 50)]] = False
    return _rebuilt(kept, a, sizes, capacity, rng, 0.05)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, size: int, seed: int) -> list[np.ndarray]:
    """The population, fittest first, after so many generations; an empty one is founded by best fit with noise."""
    rng = np.random.default_rng(seed)
    members = [Packing(np.asarray(p), sizes, capacity) for p in population]
    while len(members) < size:
        start = np.full(len(sizes), -1, np.int64)
        best_fit(start, sizes, _decreasing(sizes, np.arange(len(sizes)), rng, 0.0 if not members else 0.15), {}, capacity)
        members.append(Packing(start, sizes, capacity))
    bound = -(-int(sizes.sum()) // capacity)
    for _ in range(generations):
        members.sort(key=lambda m: (len(m.loads), -m.fitness))
        if len(members[0].loads) <= bound and members[0].fitness > 0.9999:
            break
        i, j = rng.choice(min(len(members), 4), 2, replace=False) if len(members) > 1 else (0, 0)
        child = crossover(members[i], members[j], sizes, capacity, rng)
        other = mutate(members[int(rng.integers(0, 2))], sizes, capacity, rng)
        members[-1], members[-2] = child, other
    members.sort(key=lambda m: (len(m.loads), -m.fitness))
    return [m.bin_of for m in members]


def _pack_shards(items: DataFrame, capacity: int, level: int, n_shards: int, islands: int, epochs: int) -> DataFrame:
    """doc_id, piece, size, shard, bin of the best packing found for each shard."""
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(n_shards)).cast("int")
    grouped = items.withColumn("shard", shard).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "piece"))).alias("items"))
    grouped = cut_lineage(grouped.repartition("shard"))
    state = grouped.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.transform("items", lambda x: x["size"]).alias("sizes"), F.array().cast("array<array<int>>").alias("pop"))
    schema = "shard int, island int, sizes array<int>, pop array<array<int>>"
    for epoch in range(epochs):

        def run(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for b in batches:
                pops = [[m.astype("int32").tolist() for m in evolve(np.asarray(s, dtype=np.int64), list(p), capacity, GENERATIONS, POPULATION, level * 1_000_003 + int(sh) * 101 + int(i) * 7 + epoch)] for sh, i, s, p in zip(b["shard"], b["island"], b["sizes"], b["pop"])]
                yield pd.DataFrame({"shard": b["shard"], "island": b["island"], "sizes": b["sizes"], "pop": pops})

        wide = state.repartition(max(1, min(n_shards * islands, 4 * items.sparkSession.sparkContext.defaultParallelism, 2000)), "shard", "island")
        state = cut_lineage(wide.mapInPandas(run, schema))
        if epoch + 1 < epochs and islands > 1:
            guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("pop", 1, ELITES).alias("guests"))
            state = state.join(guests.hint("merge"), ["shard", "island"]).select("shard", "island", "sizes", F.concat("guests", F.slice("pop", 1, POPULATION - ELITES)).alias("pop"))
    n_bins = F.array_max(F.element_at("pop", 1))
    best = state.groupBy("shard").agg(F.min_by(F.element_at("pop", 1), F.struct(n_bins, "island")).alias("bins"))
    return grouped.join(best.hint("merge"), "shard").select("shard", F.explode(F.arrays_zip("items", "bins")).alias("x")).select("x.items.doc_id", "x.items.piece", "x.items.size", "shard", F.col("x.bins").alias("bin"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, good: float = GOOD) -> DataFrame:
    """doc_id, piece, n_tokens, block for every text of sizes (doc_id, n_tokens); doc_id is taken as unique.

    Texts of no tokens share a block with others. No block exceeds the capacity; block numbers are unique, not dense.
    """
    items, done, level = cut_lineage(pieces(sizes, capacity)), [], 0
    left, before = items.count(), -1
    while True:
        last = left <= shard_items or left > 0.8 * before >= 0  # one shard holds the rest, or few blocks fill up
        n_shards = max(1, -(-left // shard_items))
        packed = cut_lineage(_pack_shards(items, capacity, level, n_shards, islands, epochs))
        block = (F.lit(level).cast("long") * F.lit(1 << 56) + F.col("shard").cast("long") * F.lit(1 << 20) + F.col("bin")).alias("block")
        if last:
            done.append(packed.select("doc_id", "piece", F.col("size").cast("long").alias("n_tokens"), block))
            break
        loads = packed.groupBy("shard", "bin").agg(F.sum("size").alias("load"))
        marked = cut_lineage(packed.join(loads.hint("merge"), ["shard", "bin"]))
        full = marked.where(F.col("load") >= good * capacity)
        done.append(full.select("doc_id", "piece", F.col("size").cast("long").alias("n_tokens"), block))
        items = marked.where(F.col("load") < good * capacity).select("doc_id", "piece", "size")
        before, left, level = left, items.count(), level + 1
        if not left:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_blocks, n_tokens, least_blocks (the bound no packing can beat), fill (used share of all blocks)."""
    per = packed.groupBy("block").agg(F.sum("n_tokens").alias("load"))
    got = per.agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum("load"), F.lit(0)).alias("n_tokens"))
    return got.select("n_blocks", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_blocks"), F.try_divide(F.col("n_tokens"), F.col("n_blocks") * capacity).alias("fill"))
