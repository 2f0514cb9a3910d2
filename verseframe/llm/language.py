"""The language of a line, by a linear model on the hashed character pairs and triples of its words."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from verseframe.llm.linear import LinearModel, fit, flat, row_sums
from verseframe.llm.pairtext import BREAKS, folded_prompt, parts_of
from verseframe.operators.sampling import hash_sample

LANGUAGES = ("en", "es", "fr", "de", "pt", "it", "ru", "pl", "ja")
FEATURES = 1 << 17
#: Labelled documents of a language in the bounded training sample, and lines of each.
SAMPLE, LINES = 250, 6
#: Names of the languages as a prompt may ask for them.
NAMES = {
    "en": r"english|inglés|ingles|anglais|englisch|inglês|inglese|английск\w*|angielsk\w*|英語",
    "es": r"spanish|español|castellano|espagnol|spanisch|espanhol|spagnolo|испанск\w*|hiszpańsk\w*|スペイン語",
    "fr": r"french|francés|français|französisch|francês|francese|французск\w*|francusk\w*|フランス語",
    "de": r"german|alemán|allemand|deutsch|alemão|tedesco|немецк\w*|niemieck\w*|ドイツ語",
    "pt": r"portuguese|portugués|portugais|portugiesisch|português|portoghese|португальск\w*|portugalsk\w*|ポルトガル語",
    "it": r"italian|italiano|italien|italienisch|итальянск\w*|włosk\w*|イタリア語",
    "ru": r"russian|ruso|russe|russisch|russo|русск\w*|rosyjsk\w*|ロシア語",
    "pl": r"polish|polaco|polonais|polnisch|polonês|polacco|польск\w*|polsk\w*|ポーランド語",
    "ja": r"japanese|japonés|japonais|japanisch|japonês|giapponese|японск\w*|japońsk\w*|日本語",
}
_ASKED = {lang: re.compile(rf"\b(?:in|en|auf|em|на|po|w)\s+(?:{names})\b|\b(?:{names})で", re.I) for lang, names in NAMES.items()}
_WIDE = re.compile("[⺀-鿿]")
_LINE = re.compile(r"\n+|(?<=[.!?…。])\s+")


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the character pairs and triples of every word with its borders, and how many each word has."""
    padded = [f" {w} " for w in words]
    sizes = np.array([len(w) for w in padded], dtype=np.int64)
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(c):
        return np.zeros(0, np.int64), sizes
    inner = np.ones(len(c), bool)
    inner[np.cumsum(sizes) - 1] = False  # pairs start anywhere but at a word's last place, triples not at its last two
    two = np.flatnonzero(inner)
    inner[np.cumsum(sizes) - 2] = False
    three = np.flatnonzero(inner)
    pairs = c[two] * 1_000_003 + c[two + 1]
    triples = (c[three] * 1_000_003 + c[three + 1]) * 998_244_353 + c[three + 2] * 7_919 + 1
    codes, at = np.concatenate([pairs, triples]), np.concatenate([two, three])
    order = np.argsort(at, kind="stable")
    return (np.abs(codes * 2_654_435_761) >> 11)[order] % FEATURES, 2 * sizes - 3


def grams(line: str) -> np.ndarray:
    """Numbers of the character pairs and triples of a line, letters only."""
    return word_grams([w for w in parts_of(line) if w not in BREAKS])[0]


class Lexicon:
    """Every different word once: its hash, its letters, and its part in the log-odds of each language.

    Grows with the words it meets up to `most` and then starts anew; what it gives does not depend on that.
    """

    def __init__(self, model: LinearModel, most: int = 400_000) -> None:
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {b: 0 for b in sorted(BREAKS)}
        self.used = 1
        self.hash, self.letters, self.grams = np.zeros(1024, np.uint64), np.zeros(1024), np.zeros(1024)
        self.odds = np.zeros((1024, len(LANGUAGES)), np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of every word; 0 for a break. Valid until the next call."""
        if self.used > self.most:
            self._clear()
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        if len(ids) and ids.min() < 0:
            self._add(sorted({words[i] for i in np.flatnonzero(ids < 0)}))
            ids = np.fromiter((self.number[w] for w in words), dtype=np.int64, count=len(words))
        return ids

    def _add(self, new: list[str]) -> None:
        lo, hi = self.used, self.used + len(new)
        if hi > len(self.hash):
            size = max(hi, 2 * len(self.hash))
            self.hash, self.letters, self.grams = (np.concatenate([a, np.zeros(size - len(a), a.dtype)]) for a in (self.hash, self.letters, self.grams))
            self.odds = np.concatenate([self.odds, np.zeros((size - len(self.odds), self.odds.shape[1]), np.float32)])
        self.number.update(zip(new, range(lo, hi)))
        self.hash[lo:hi] = [(zlib.crc32(w.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for w in new]
        self.letters[lo:hi] = [(2 if _WIDE.search(w) else 1) * sum(map(str.isalpha, w)) for w in new]
        spoken = [k for k, w in enumerate(new) if not w.isdigit()]
        places, sizes = word_grams([new[k] for k in spoken])
        self.grams[lo + np.array(spoken, dtype=np.int64)] = sizes
        self.odds[lo + np.array(spoken, dtype=np.int64)] = row_sums(self.model.by_feature[places], sizes)
        self.used = hi

    def line_odds(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-odds of every language (columns) for lines of the next sizes[i] words; long lines are damped by their length."""
        damp = np.maximum(1.0, np.sqrt(np.maximum(row_sums(self.grams[ids], sizes), 1)) / 4)
        return self.model.bias + row_sums(self.odds[ids], sizes) / damp[:, None]


def train(documents: DataFrame, seed: int = 7) -> tuple[LinearModel, list[tuple[str, str]]]:
    """The model and its sample (language, text): trained on lines of a bounded, hash-ordered sample of labelled
    documents of each language; labels may be noisy."""
    lang = F.lower(F.btrim("lang"))
    rows = documents.select(lang.alias("lang"), "doc_id", F.col("text")).where(F.col("lang").isin(*LANGUAGES) & (F.length("text") > 80))
    data, labels, rng = [], [], np.random.default_rng(seed)
    found = [(r["lang"], r["text"]) for r in hash_sample(rows, SAMPLE, "doc_id", by="lang")]
    for name, text in sorted(found):
        lines = [s for s in _LINE.split(text) if len(s.strip()) > 12]
        for k in rng.permutation(len(lines))[:LINES]:
            data.append(grams(lines[k].upper() if rng.random() < 0.1 else lines[k]))
            labels.append([float(name == x) for x in LANGUAGES])
    return fit(*flat(data), np.array(labels).reshape(-1, len(LANGUAGES)), FEATURES, epochs=4, rate=0.2, seed=seed), found


def odds(lexicon: Lexicon, text: str) -> np.ndarray:
    words = [w for w in parts_of(text) if w not in BREAKS]
    return lexicon.line_odds(lexicon.numbers(words), np.array([len(words)]))[0]


def allowed(lexicon: Lexicon, prompt: str | None) -> set[int]:
    """The numbers of the languages an answer may have: the prompt's, with near ties, and those it asks for; every
    language where the prompt is blank."""
    if not prompt or not prompt.strip():
        return set(range(len(LANGUAGES)))
    words = list(folded_prompt(prompt))
    z = lexicon.line_odds(lexicon.numbers(words), np.array([len(words)]))[0]
    return {int(k) for k in np.flatnonzero(z >= z.max() - 1.0)} | {k for k, lang in enumerate(LANGUAGES) if _ASKED[lang].search(prompt)}


def foreign_shares(lexicon: Lexicon, ids: np.ndarray, owner: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Per text (row of may) the share of its letters on lines whose language is not among the allowed ones.

    ids: numbers of the words and breaks of all texts, one after another; owner: the text of each; may: texts by
    languages. Lines of under four letters do not count.
    """
    n = len(may)
    total, foreign = np.zeros(n), np.zeros(n)
    words = np.flatnonzero(ids)
    if len(words):
        line = np.cumsum(ids == 0)[words] + owner[words]  # grows at every break and with every text
        first = np.flatnonzero(np.diff(line, prepend=line[0] - 1))
        sizes = np.diff(np.append(first, len(words)))
        texts, weight = owner[words[first]], row_sums(lexicon.letters[ids[words]], sizes)
        z = lexicon.line_odds(ids[words], sizes)
        best = np.where(may[texts], z, -np.inf).max(axis=1)
        long = weight >= 4
        total = np.bincount(texts[long], weights=weight[long], minlength=n)
        out = long & (best < z.max(axis=1) - 0.5)
        foreign = np.bincount(texts[out], weights=weight[out], minlength=n)
    return foreign / np.maximum(total, 1)
