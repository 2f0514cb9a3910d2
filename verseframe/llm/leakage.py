"""Evaluation texts leaking into training text, by pigeonhole edit matching (problem 7).

A passage counts as leaked where some window of 12 + 2k words of an item occurs in a document with an edit
distance of at most k words, k from 0 to `max_errors`: every altered word must be paid for by two more that match.
Cut into k + 1 pieces, such a window has at least one piece intact (pigeonhole), and every piece has at least
`piece` = 3 words; so exact hits of 3-word pieces find it. Of its 12 + 2k - 2 overlapping pieces at most 3k are
broken, so at least 10 - k >= 10 - max_errors pieces are hit near one diagonal; diagonals with fewer are passed
over without loss. The windows around the hits are verified with Myers' bit-parallel distance, one machine word
per window and all windows of a batch at once.

The items are the query set and are sent to every task in blocks of at most `block_words` words; the documents
are scanned where they lie, whole, without a shuffle. Matches of one document are distinct by construction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verseframe.operators.spread import spread

MIN_WORDS, PIECE, MAX_ERRORS = 12, 3, 6
BLOCK_WORDS = 2_000_000

_MARKUP = re.compile(r"<\|[^|<>]{1,40}\|>|</?[a-zA-Z][^<>\n]{0,80}>|\\[nrt]|&(?:[a-z]{2,8}|#\d{1,6});")
_LEAD = re.compile(r"(?m)^[ \t]*(?:\(?\d{1,5}[.):]?|[-*+>#|]+)[ \t]+")
_APOSTROPHES = re.compile("['’‘ʼ`´]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words in lower case without markup, line numbers, list marks, apostrophes and punctuation."""
    if not text:
        return []
    text = _LEAD.sub(" ", _MARKUP.sub(" ", text.lower()))
    return _WORD.findall(_APOSTROPHES.sub("", text))


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) * 4_000_037 + b) * 4_000_037 + c


class ItemIndex:
    """The pieces of one block of items: sorted piece codes with the place of each."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        codes = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], dtype=np.int64) for _, ws in items]
        self.lengths = np.array([len(c) for c in codes], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64) if len(codes) else np.zeros(0, np.int64)
        self.words = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        at = [np.arange(len(c) - PIECE + 1) + s for c, s in zip(codes, self.starts) if len(c) >= PIECE]
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        piece = _mix(self.words[self.at], self.words[self.at + 1], self.words[self.at + 2]) if len(self.at) else np.zeros(0, np.int64)
        order = np.argsort(piece, kind="stable")
        self.piece, self.at = piece[order], self.at[order]
        self.item_of = np.repeat(np.arange(len(codes)), self.lengths)

    def places(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in the document of every piece it shares with the items, and where the piece's own positions lie."""
        if len(doc) < PIECE or not len(self.piece):
            return (np.zeros(0, np.int64),) * 3
        known = doc >= 0
        pos = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        code = _mix(doc[pos], doc[pos + 1], doc[pos + 2])
        lo = np.searchsorted(self.piece, code, "left")
        hit = self.piece[np.minimum(lo, len(self.piece) - 1)] == code
        pos, lo, code = pos[hit], lo[hit], code[hit]
        return pos, lo, np.searchsorted(self.piece, code, "right") - lo

    def expand(self, pos: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in the document, in the joined items) of every pair of equal pieces."""
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(pos, n), self.at[np.repeat(lo, n) + offset]


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern to any substring of its text; rows are codes, texts padded with -2.

    Patterns have at most 63 words; each is one 64-bit word, and all rows advance together.
    """
    n, m = patterns.shape
    one = np.uint64(1)
    high = np.uint64(1 << (m - 1))
    mask = np.uint64((1 << m) - 1)
    patterns, columns = patterns.astype(np.int32), np.ascontiguousarray(texts.T.astype(np.int32))
    pv, mv = np.full(n, mask, np.uint64), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    eq = np.zeros((n, 8), np.uint8)
    for column in columns:
        bits = np.packbits(patterns == column[:, None], axis=1, bitorder="little")
        eq[:, : bits.shape[1]] = bits
        pm = eq.view(np.uint64)[:, 0]
        xv = pm | mv
        xh = (((pm & pv) + pv) ^ pv) | pm
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += ((ph & high) > 0).astype(np.int64) - ((mh & high) > 0)
        ph, mh = ph << one, mh << one
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
        np.minimum(best, score, out=best)
    return best


#: Hits looked at together; text with more is halved, down to stretches of SHORT words.
HITS, SHORT = 1_000_000, 200


def leaked_pairs(index: ItemIndex, docs: list[np.ndarray], max_errors: int = MAX_ERRORS, min_words: int = MIN_WORDS, most: int = HITS) -> list[tuple[int, int]]:
    """(position in docs, row number of the item) of every document that repeats a passage of an item.

    Memory is bounded whatever phrases the items share: a batch of too many hits is halved, and so is a single text,
    with an overlap as long as a window and its errors.
    """
    bounds = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])]).astype(np.int64)
    joined = np.full(bounds[-1], -3, np.int64)
    for d, start in zip(docs, bounds):
        joined[start : start + len(d)] = d
    pos, lo, n = index.places(joined)
    if n.sum() > most:
        half = len(docs) // 2
        if half:
            parts = [(0, docs[:half]), (half, docs[half:])]
        else:
            half = len(docs[0]) // 2
            parts = [(0, [docs[0][: half + min_words + 4 * max_errors]]), (0, [docs[0][half:]])] if len(docs[0]) > max(SHORT, 4 * (min_words + 4 * max_errors)) else []
        if parts:
            return sorted({(at + d, i) for at, part in parts for d, i in leaked_pairs(index, part, max_errors, min_words, most)})
    p, q = index.expand(pos, lo, n)
    pair = (np.searchsorted(bounds, p, "right") - 1) * len(index.ids) + index.item_of[q] if len(p) else p
    found = np.zeros(0, np.int64)
    widest = _near(pair, p, q, max_errors, min_words + 2 * max_errors, min_words - 2 - max_errors)
    p, q, pair = p[widest], q[widest], pair[widest]  # what is near for fewer errors is near for most
    for k in range(max_errors + 1):
        m, need = min_words + 2 * k, min_words - 2 - k
        use = _near(pair, p, q, k, m, need)
        use = use[~np.isin(pair[use], found)]
        if len(use):
            found = np.union1d(found, _verified(index, joined, pair[use], p[use], q[use], k, m))
    return [(int(x // len(index.ids)), int(x % len(index.ids))) for x in found]


def _near(pair: np.ndarray, p: np.ndarray, q: np.ndarray, k: int, m: int, need: int) -> np.ndarray:
    """The hits that have `need` hits of their pair on k + 1 neighbouring diagonals and within m item words, the latter
    up to k more: hits come in order of p, so that one stable sort by pair and band is enough."""
    if len(p) < need:
        return np.zeros(0, np.int64)
    keep = np.zeros(len(p), bool)
    diagonal = p - q
    band = (diagonal - diagonal.min()) // (k + 1)
    span = int(band.max()) // 2 + 2
    for shift in (0, 1):  # k + 1 neighbouring diagonals lie in two neighbouring bands
        code = pair * span + (band + shift) // 2
        order = np.argsort(code, kind="stable")
        c, at = code[order], p[order]
        ok = np.flatnonzero((c[: len(c) - need + 1] == c[need - 1 :]) & (at[need - 1 :] - at[: len(c) - need + 1] <= m - PIECE + k))
        for j in range(need):
            keep[order[ok + j]] = True
    return np.flatnonzero(keep)


def _verified(index: ItemIndex, joined: np.ndarray, pair: np.ndarray, p: np.ndarray, q: np.ndarray, k: int, m: int, rows: int = 200_000) -> np.ndarray:
    """The pairs of which a window of m words around a hit is within k errors of the text beside it."""
    item = pair % len(index.ids)
    low, high = index.starts[item], index.starts[item] + index.lengths[item] - m
    cut = np.arange(k + 1) * (m // (k + 1))
    start = (q[:, None] - cut[None, :]).ravel()
    cases = np.stack([np.repeat(pair, k + 1), start, np.repeat(p - q, k + 1)], axis=1)
    cases = np.unique(cases[(start >= np.repeat(low, k + 1)) & (start <= np.repeat(high, k + 1))], axis=0)
    found = []
    for lo in range(0, len(cases), rows):
        part = cases[lo : lo + rows]
        window = index.words[part[:, 1:2] + np.arange(m)[None, :]]
        where = part[:, 1:2] + part[:, 2:3] - k + np.arange(m + 2 * k)[None, :]
        text = np.where((where >= 0) & (where < len(joined)), joined[np.clip(where, 0, len(joined) - 1)], -3)
        found.append(part[myers(window, text) <= k, 0])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _chunks(texts: pd.Series, chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `chars` characters of text each."""
    total = texts.str.len().cumsum().to_numpy()
    lo = 0
    while lo < len(total):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + chars, "right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_errors: int = MAX_ERRORS, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id of every document that repeats a passage of an item; distinct.

    Null or empty texts, and items of under `min_words` words, give no rows; rows with a null id are ignored.
    The items are read by the driver block by block (a held-out set, not the corpus); each block adds one scan.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and length(text) > 0")
    docs = spread(docs)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long"
    out, block, size = None, [], 0

    def scan(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(ItemIndex(block))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            get = index.vocabulary.get
            for batch in batches:
                for lo, hi in _chunks(batch["text"]):
                    docs = [np.fromiter((get(w, -1) for w in words_of(t)), dtype=np.int64) for t in batch["text"].iloc[lo:hi]]
                    pairs = leaked_pairs(index, docs, max_errors, min_words)
                    rows = batch["doc_id"].iloc[lo:hi]
                    yield pd.DataFrame({"doc_id": rows.iloc[[d for d, _ in pairs]].reset_index(drop=True), "item_id": pd.Series([index.ids[i] for _, i in pairs], dtype="int64")})

        return docs.mapInPandas(run, schema)

    for r in rows.toLocalIterator():
        ws = words_of(r["t"])
        if len(ws) < min_words:
            continue
        block.append((int(r["i"]), ws))
        size += len(ws)
        if size >= block_words:
            out, block, size = scan(block) if out is None else out.unionByName(scan(block)), [], 0
    if block or out is None:
        out = scan(block) if out is None else out.unionByName(scan(block))
    return out.distinct()


def leaked_per_item(leaks: DataFrame) -> DataFrame:
    """Test items that leaked and the number of documents each is found in."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))
