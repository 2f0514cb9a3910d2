"""How likely a text stops before its end, judged by its ending alone.

A linear model on hashed features of the last line (or sentence) tells complete lines from cut ones. It is
trained on the inner lines of the texts themselves, which are complete, and on the same lines cut at a random
character. The words of a line are reduced to classes by counts over all texts: how often a word closes a line.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verseframe.llm.linear import LinearModel, fit, flat, hash_ids

BUCKETS = 1 << 18
FEATURES = 1 << 16
#: Rows of the bounded training sample, and texts longer than this add only their last lines to it.
SAMPLE = 4000

#: Marks that a text was shortened, at its end.
MARKER = re.compile(r"(?:\[\s*(?:\.{3}|…|clipped|truncated|cut|more|snip)\s*\]|\(\s*\+?\d+ more (?:lines?|words?|chars?|characters?|tokens?)\s*\)|\n\s*(?:\.{3}|…)|<(?:truncated|cut)>)[\s\"”’'*_]*$", re.I)
_CLOSERS = " \t\r\n\"”’'»*_)]"
#: A marker ends in one of these, before blanks and quotes; other texts are not searched for one.
_MARKER_ENDS, _AFTER_MARKER = ("]", ")", "…", "...", ">"), "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\"”’'*_"
_TERMINAL, _SOFT = ".!?。！？｡", ",;:—–-、，；："
_SEGMENT = re.compile(r"\n+|(?<=[.!?…。！？])[\"”’')\]]*\s+|(?<=[。！？])")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’‑-][^\W\d_]+)*|\d+")
_INNER = re.compile(r"[,.;:!?…—。、]")


def segments(text: str) -> list[str]:
    return [s for s in _SEGMENT.split(text) if s and s.strip()]


def tokens(segment: str) -> list[str]:
    found = _TOKEN.findall(segment.lower().replace("’", "'"))
    out = []
    for t in found:
        if t[0] >= "⺀" and len(t) > 2:
            out += [t[i : i + 2] for i in range(0, len(t), 2)] if len(t) % 2 == 0 else [t[:1], *(t[i : i + 2] for i in range(1, len(t), 2))]
        else:
            out.append(t)
    return out


@dataclass
class Ending:
    """closing: how the text closes (terminal, ellipsis, soft, none); style: whether its body is punctuated."""

    closing: str
    style: str
    marker: bool
    segment: str
    seen: int


def ending_of(text: str) -> Ending:
    marker = text.rstrip(_AFTER_MARKER).endswith(_MARKER_ENDS) and bool(MARKER.search(text))
    body = MARKER.sub("", text) if marker else text
    body = body.rstrip(_CLOSERS)
    if body.endswith(("…", "...")):
        closing = "ellipsis"
    elif body[-1:] in _TERMINAL and body:
        closing = "terminal"
    elif body[-1:] in _SOFT and body:
        closing = "soft"
    else:
        closing = "none"
    bare = body.rstrip("….!?。！？" + _SOFT + _CLOSERS)
    parts = segments(bare)
    marks = len(_INNER.findall(bare))
    style = "punctuated" if marks >= max(1, len(parts) / 3) else "plain" if len(parts) > 1 else "single"
    return Ending(closing, style, marker, parts[-1] if parts else "", len(parts))


class WordUse:
    """Counts over all texts by hashed word: inside a line, at the end of one."""

    def __init__(self, inside: np.ndarray, closing: np.ndarray) -> None:
        self.inside, self.closing = inside, closing
        self.total = float(inside.sum() + closing.sum()) or 1.0
        self.memo: dict[str, str] = {}

    def __add__(self, other: WordUse) -> WordUse:
        return WordUse(self.inside + other.inside, self.closing + other.closing)

    def kind(self, word: str) -> str:
        got = self.memo.get(word)
        if got is None:
            h = hash_ids([word], BUCKETS)[0]
            a, b = float(self.inside[h]), float(self.closing[h])
            n = a + b
            if n < 1:
                got = "?"
            elif n / self.total > 0.004:
                got = word
            else:
                r = (b + 0.05) / (n + 1)
                tail = next((t for t in ("ing", "ed", "ly", "s") if word.endswith(t)), "x")
                got = f"{tail}{0 if r < 0.02 else 1 if r < 0.1 else 2 if r < 0.3 else 3}{'r' if n < 3 else ''}"
            if len(self.memo) < 400_000:
                self.memo[word] = got
        return got


def line_features(segment: str, use: WordUse) -> list[str]:
    words = tokens(segment)
    kinds = ["^", *(use.kind(w) for w in words)]
    if len(kinds) < 2:
        return ["empty"]
    out = [f"k{n}:" + " ".join(kinds[-n:]) for n in range(1, 6) if n <= len(kinds)]
    out += [f"n:{min(len(words), 15)}", f"a:{' '.join(kinds[1:3])}|{' '.join(kinds[-2:])}", f"n{min(len(words), 15)}:{kinds[-1]}", f"e:{segment.rstrip()[-2:].lower()}", f"w:{words[-1]}"]
    if len(kinds) <= 14:
        out.append("f:" + " ".join(kinds))
    return out


def word_use(df: DataFrame, column: str = "text") -> WordUse:
    """The counts, summed per task in arrays of fixed size and then over tasks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, closing = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            a: dict[str, int] = {}
            b: dict[str, int] = {}
            for text in batch[column]:
                for segment in segments(text)[:-1]:
                    ws = tokens(segment)
                    if ws:
                        for w in ws[:-1]:
                            a[w] = a.get(w, 0) + 1
                        b[ws[-1]] = b.get(ws[-1], 0) + 1
            for d, into in ((a, inside), (b, closing)):
                if d:
                    np.add.at(into, hash_ids(list(d), BUCKETS), list(d.values()))
        at = np.flatnonzero(inside + closing)
        yield pd.DataFrame({"bucket": at.astype("int64"), "inside": inside[at], "closing": closing[at]})

    rows = df.select(column).where(f"length({column}) > 0").mapInPandas(count, "bucket long, inside double, closing double")
    got = rows.groupBy("bucket").agg(F.sum("inside").alias("inside"), F.sum("closing").alias("closing")).toPandas()
    inside, closing = np.zeros(BUCKETS), np.zeros(BUCKETS)
    inside[got["bucket"]], closing[got["bucket"]] = got["inside"], got["closing"]
    return WordUse(inside, closing)


def line_odds(ends: list[Ending], use: WordUse, model: LinearModel) -> np.ndarray:
    """The line model's log-odds of many endings at once; 0 where there is no line."""
    places, sizes = flat([hash_ids(line_features(e.segment, use), FEATURES) if e.segment else np.zeros(0, np.int64) for e in ends])
    return np.where(sizes > 0, model.many(places, sizes)[:, 0], 0.0) if len(ends) else np.zeros(0)


def train(texts: list[str], use: WordUse, seed: int = 7) -> LinearModel:
    """P(cut) of a line; the texts are a bounded sample. Half of each line's examples are cut at a random character."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for text in texts:
        inner = segments(text)[:-1]
        for k in rng.permutation(len(inner))[:8]:
            line = inner[k].rstrip(" \t.!?…" + _SOFT + _CLOSERS)
            if len(line) < 4:
                continue
            rows.append(hash_ids(line_features(line, use), FEATURES))
            labels.append(0.0)
            cut = line[: rng.integers(1, len(line))].rstrip()
            if cut:
                rows.append(hash_ids(line_features(cut, use), FEATURES))
                labels.append(1.0)
    return fit(*flat(rows), np.array(labels)[:, None], FEATURES, epochs=6, seed=seed)


#: P(closing | style) of complete and of cut texts, from the punctuation of lines and of random cuts.
_COMPLETE = {"punctuated": {"terminal": 0.93, "ellipsis": 0.06, "soft": 0.004, "none": 0.002}, "plain": {"terminal": 0.2, "ellipsis": 0.05, "soft": 0.01, "none": 0.74}, "single": {"terminal": 0.75, "ellipsis": 0.05, "soft": 0.05, "none": 0.15}}
_CUT = {"terminal": 0.025, "ellipsis": 0.06, "soft": 0.05, "none": 0.865}


def cut_evidence(end: Ending, words: float) -> float:
    """Log-likelihood ratio of cut against complete; words: the line model's log-odds."""
    if end.marker:
        return 8.0
    if not end.segment:
        return 0.0
    closing = math.log(_CUT[end.closing] / _COMPLETE[end.style][end.closing])
    if end.closing == "terminal":
        words = min(max(words, -2.0), 1.5)
    elif end.closing == "ellipsis":
        words = min(max(words, -4.0), 6.0)
    else:
        words = min(max(words, -3.0), 6.0)
    return closing + words
