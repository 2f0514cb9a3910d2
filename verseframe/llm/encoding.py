"""Garbled text from wrong character encoding, by noisy-channel decoding (problem 8).

Corpus model: all words with a character outside ASCII are counted over all documents; a hashed character trigram
model of fixed size backs off for unseen words. Words that a UTF-8 channel could have made are left out of it.

Channel model: a channel is a pair (encoding the text was in, encoding it was read with). For a word it builds the
lattice of bytes behind the characters and reads it again: UTF-8 sequences where they are valid, other characters
as they stand; a byte lost as U+FFFD is a wildcard in this lattice, in any number and at any place of a sequence, and
the likeliest ways through it are found by a Viterbi search under the trigram model. A character lost as a whole is
filled by the clean corpus words that agree with every character left, or by a search over the corpus alphabet. Each
different word is decoded once, however often it occurs, and its candidates get their corpus frequencies by a join.

Search: per document a Viterbi search over its words, whose states are the channels; entering a channel costs
`enter`, staying is free, and a word gains the log-probability of what the channel restores over what is there.
A document is affected where the best path leaves the clean state, or a character was lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from verseframe.operators.skew import HOT_ROWS, salted_lookup
from verseframe.operators.spread import spread
from verseframe.session import cut_lineage

#: A word with a character outside ASCII, with the ASCII letters it is joined to.
#: It starts at the first letter of its run and takes all of it, so that no place of a text is looked at twice.
WORD = r"(?<![A-Za-z])[A-Za-z]*+(?:[^\x00-\x7F]++[A-Za-z]*+)++"
LOST = "�"
ENTER = 5.0
#: Log-odds that a text with U+FFFD has lost a character, rather than always having had it.
LOST_GAIN = 20.0
#: Log-odds that a lost byte is one the codec does not define.
RARE = 4.0
#: Taken from the score of a reading of a capital word that ends in one accented letter and a mark, which may be just that.
DOUBT = 6.0
#: UTF-8 text read with each of these.
READ_UTF8_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "iso8859_2", "cp866")
#: Text in the first, read with the second.
READ_BYTES_AS = (
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"),
    ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"),
    ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp1251", "mac_roman"), ("shift_jis", "cp1252"), ("euc_jp", "cp1252"),
)
CHANNELS = ("clean", *(f"utf_8>{w}" for w in READ_UTF8_AS), *(f"utf_8>{w}x2" for w in READ_UTF8_AS), *(f"{t}>{w}" for t, w in READ_BYTES_AS), "lost")
_PUNCTUATION = frozenset("’‘“”„—–…«»\xa0·•°")
_MIXED = re.compile("[A-Za-zÀ-ɏ][\u0370-\u058f]|[\u0370-\u058f][A-Za-zÀ-ɏ]")
_CAPITAL_MARK = re.compile("[A-Z]+[À-Ý][…—–’”“]")
_CONTROL = re.compile("[\x80-\x9f]")
_BUCKETS = (1 << 16, 1 << 17, 1 << 18)


@cache
def _bytes_of(codec: str) -> dict[str, int]:
    """The byte behind each upper character of a codec; undefined bytes stand for their C1 control character."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
        if codec in ("cp1252", "cp1250", "cp1251", "iso8859_2"):
            table.setdefault(chr(b), b)
    return table


def _need(lead: int) -> int:
    return 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0


def read_again_as_utf8(word: str, codec: str) -> str:
    """The word with the UTF-8 sequences behind its characters decoded.

    Characters the codec lacks stay, and so does punctuation; if any other character of the codec is not part of
    a valid sequence, or the result joins Latin letters to Greek or Cyrillic ones, the codec did not make this
    word and it is returned as it is.
    """
    table, out, i, strays = _bytes_of(codec), [], 0, False
    codes = [table.get(ch, -1) for ch in word]
    while i < len(word):
        n = _need(codes[i])
        if n and i + n < len(word) and all(0x80 <= c < 0xC0 for c in codes[i + 1 : i + 1 + n]):
            try:
                got = bytes(codes[i : i + 1 + n]).decode("utf-8")
                if not 0xE000 <= ord(got) < 0xF900:
                    out.append(got)
                    i += n + 1
                    continue
            except UnicodeDecodeError:
                pass
        strays |= codes[i] >= 0 and word[i] not in _PUNCTUATION
        out.append(word[i])
        i += 1
    read = "".join(out)
    return word if strays or (read != word and _MIXED.search(read)) else read


@cache
def _undefined(codec: str) -> tuple[int, ...]:
    """The upper bytes that a codec does not define, and so loses."""

    def lost(b: int) -> bool:
        try:
            bytes([b]).decode(codec)
        except UnicodeDecodeError:
            return True
        return False

    return tuple(b for b in range(0x80, 0x100) if lost(b))


def lattice_readings(word: str, codec: str, model: CharModel, width: int = 32, most: int = 16) -> list[str]:
    """Readings of a word with lost characters as UTF-8 that was read with the codec: the `most` likeliest.

    A lost character is one of the bytes that the codec does not define, the usual cause, or less likely (by RARE) any
    byte of UTF-8, be it the first of a sequence or a later one. A word with a character outside ASCII that the codec does
    not have was not made by it.
    """
    table = _bytes_of(codec)
    if any(ch >= "\x80" and ch != LOST and ch not in table and ch not in _PUNCTUATION for ch in word):
        return []
    usual = _undefined(codec)
    found = [(s - RARE if usual else s, r) for s, r in _through_lattice(word, table, range(0x80, 0xF5), model, width)]
    found += _through_lattice(word, table, usual, model, width) if usual else []
    return list(dict.fromkeys(r for _, r in sorted(found, key=lambda x: (-x[0], x[1]))))[:most]


def _through_lattice(word: str, table: dict[str, int], wild: Iterable[int], model: CharModel, width: int) -> list[tuple[float, str]]:
    """(log-probability, reading) of a word, likeliest first, whose lost characters are bytes out of `wild`.

    The lattice has the byte behind every character, and at a lost one every byte it may be. A Viterbi search over places,
    unfinished sequences and the last two characters weighs the decoded characters by the trigram model. Of a place the
    best `width` states with all sequences finished are followed, and eight times as many others. Other characters of the codec must be part of a sequence, but for punctuation; a lost
    character may stay alone.
    """
    states: dict[tuple[str, bytes], tuple[float, str, bool]] = {("\x02\x02", b""): (0.0, "", False)}
    for ch in f"{word}\x03":
        byte = table.get(ch, -1)
        options = wild if ch == LOST else (byte,) if byte >= 0 else ()
        steps: list[tuple[float, str, str, bool]] = []  # score before the character, path, trigram, joined
        found: dict[tuple[str, bytes], tuple[float, str, bool]] = {}
        for (last, part), (score, path, joined) in states.items():
            if not part and (byte < 0 or ch in _PUNCTUATION):  # as it stands
                if ch == LOST:
                    found[last[1] + ch, b""] = (score - 12.0, path + ch, joined)
                else:
                    steps.append((score, path + ch, last + ch, joined))
            need = _need(part[0]) if part else 0
            for b in options:
                if not part:
                    if _need(b):
                        found[last, bytes((b,))] = (score, path, joined)
                elif 0x80 <= b < 0xC0:
                    more = part + bytes((b,))
                    if len(more) <= need:
                        if (last, more) not in found or score > found[last, more][0]:
                            found[last, more] = (score, path, joined)
                        continue
                    try:
                        got = more.decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if not 0xE000 <= ord(got) < 0xF900 and not 0x80 <= ord(got) < 0xA0:
                        steps.append((score, path + got, last + got, True))
        for (score, path, gram, joined), more in zip(steps, model.logps([x[2] for x in steps]).tolist() if steps else ()):
            key = (gram[1:], b"")
            if key not in found or score + more > found[key][0]:
                found[key] = (score + more, path, joined)
        ranked = sorted(found.items(), key=lambda x: (-x[1][0], x[0]))
        states = dict([x for x in ranked if not x[0][1]][:width] + [x for x in ranked if x[0][1]][: 8 * width])
    done = sorted(((s, p) for (_, part), (s, p, joined) in states.items() if joined and not part), reverse=True)
    return [(s, p[:-1]) for s, p in done if not _MIXED.search(p)]


def read_again(word: str, true: str, wrong: str) -> str | None:
    """The word's characters turned to bytes with `wrong` and read with `true`; None where that is not possible."""
    table, raw = _bytes_of(wrong), bytearray()
    for ch in word:
        b = ord(ch) if ch < "\x80" else table.get(ch, -1)
        if b < 0:
            return None
        raw.append(b)
    try:
        got = raw.decode(true)
    except UnicodeDecodeError:
        return None
    return got if got.isprintable() or "\xa0" in got else None


def candidates(word: str, model: CharModel) -> dict[int, list[str]]:
    """Channel number -> readings of the word that differ from it."""
    out: dict[int, list[str]] = {}
    if LOST in word:
        for k, codec in enumerate(READ_UTF8_AS):
            if got := lattice_readings(word, codec, model):
                out[1 + k] = [model.fill(r) if LOST in r else r for r in got]
        return out
    n = len(READ_UTF8_AS)
    for k, codec in enumerate(READ_UTF8_AS):
        once = read_again_as_utf8(word, codec)
        if once != word:
            if not _CONTROL.search(once):
                out[1 + k] = [once]
            twice = read_again_as_utf8(once, codec)
            if twice != once and not _CONTROL.search(twice):
                out[1 + n + k] = [twice]
    if not out:
        for k, (true, wrong) in enumerate(READ_BYTES_AS):
            got = read_again(word, true, wrong)
            if got and got != word:
                out[1 + 2 * n + k] = [got]
    return out


def _h(text: str, size: int) -> int:
    value = 2166136261
    for ch in text:
        value = ((value ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return (value ^ (value >> 15)) % size


def _grams(word: str) -> Iterator[tuple[int, str]]:
    padded = f"\x02\x02{word}\x03"
    for i in range(2, len(padded)):
        yield 0, padded[i]
        yield 1, padded[i - 1 : i + 1]
        yield 2, padded[i - 2 : i + 1]


class CharModel:
    """Interpolated trigram model over hashed counts: three arrays of fixed size."""

    def __init__(self, counts: list[np.ndarray], alphabet: list[str]) -> None:
        self.counts, self.alphabet = counts, alphabet
        self.total = float(counts[0].sum()) or 1.0
        self.memo: dict[str, float] = {}

    def logp(self, gram: str) -> float:
        got = self.memo.get(gram)
        if got is None:
            one, two, three = (float(c[_h(g, len(c))]) for c, g in zip(self.counts, (gram[2], gram[1:], gram)))
            before, pair = float(self.counts[0][_h(gram[1], _BUCKETS[0])]), float(self.counts[1][_h(gram[:2], _BUCKETS[1])])
            p1 = (one + 0.01) / (self.total + 1000)
            p2 = (two + 2 * p1) / (max(before, two) + 2)
            got = math.log((three + 2 * p2) / (max(pair, three) + 2))
            if len(self.memo) < 500_000:
                self.memo[gram] = got
        return got

    def logps(self, grams: list[str]) -> np.ndarray:
        """logp of many trigrams at once."""
        if len(grams) < 32:
            return np.array([self.logp(g) for g in grams])
        c = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, 3).astype(np.uint64)

        def look(k: int, lo: int, hi: int) -> np.ndarray:
            value = np.full(len(c), 2166136261, np.uint64)
            for i in range(lo, hi):
                value = ((value ^ c[:, i]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
            return self.counts[k][((value ^ (value >> np.uint64(15))) % np.uint64(_BUCKETS[k])).astype(np.int64)]

        one, two, three, before, pair = look(0, 2, 3), look(1, 1, 3), look(2, 0, 3), look(0, 1, 2), look(1, 0, 2)
        p1 = (one + 0.01) / (self.total + 1000)
        p2 = (two + 2 * p1) / (np.maximum(before, two) + 2)
        return np.log((three + 2 * p2) / (np.maximum(pair, three) + 2))

    def score(self, word: str) -> float:
        padded = f"\x02\x02{word}\x03"
        return sum(self.logp(padded[i - 2 : i + 1]) for i in range(2, len(padded)))

    def fill(self, word: str, width: int = 24) -> str:
        """The word with every lost character replaced, by a Viterbi search over the alphabet, exact but for runs of
        two or more lost characters, where the best `width` are followed."""
        beam, run = [(0.0, "\x02\x02")], 0
        for ch in f"{word}\x03":
            run = run + 1 if ch == LOST else 0
            options = self.alphabet if ch == LOST else (ch,)
            best: dict[str, tuple[float, str]] = {}
            steps = [(s, path, c) for s, path in beam for c in options]
            for (s, path, c), more in zip(steps, self.logps([path[-2:] + c for _, path, c in steps]).tolist()):
                key = path[-1] + c
                if key not in best or s + more > best[key][0]:
                    best[key] = (s + more, path + c)
            beam = sorted(best.values(), reverse=True)[: width if run > 1 else None]
        return beam[0][1][2:-1]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _looks_clean(word: str) -> bool:
    return LOST not in word and not any("\x80" <= ch <= "\x9f" for ch in word) and all(read_again_as_utf8(word, c) == word for c in READ_UTF8_AS)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: over all documents, with map-side combine."""
    return docs.select(F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def char_model(counts: DataFrame) -> CharModel:
    """The trigram model of the clean-looking words; at most sum(_BUCKETS) numbers and the alphabet reach the driver, at any size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = [np.zeros(b) for b in _BUCKETS]
        chars: dict[str, float] = {}
        for batch in batches:
            for word, n in zip(batch["word"], batch["n"]):
                if not _looks_clean(word):
                    continue
                weight = math.sqrt(n)
                for k, g in _grams(word):
                    arrays[k][_h(g, _BUCKETS[k])] += weight
                    if k == 0 and g >= "\x80":
                        chars[g] = chars.get(g, 0) + weight
        for k, a in enumerate(arrays):
            at = np.flatnonzero(a)
            yield pd.DataFrame({"kind": k, "bucket": at.astype("int64"), "n": a[at]})
        top = list(chars.items())
        yield pd.DataFrame({"kind": pd.Series([3] * len(top), dtype="int64"), "bucket": pd.Series([ord(c) for c, _ in top], dtype="int64"), "n": pd.Series([float(v) for _, v in top], dtype="float64")})

    arrays, chars = [np.zeros(b) for b in _BUCKETS], {}
    for r in counts.mapInPandas(count, "kind long, bucket long, n double").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas().itertuples():
        if r.kind == 3:
            chars[chr(r.bucket)] = r.n
        else:
            arrays[r.kind][r.bucket] = r.n
    return CharModel(arrays, [c for c, _ in sorted(chars.items(), key=lambda x: (-x[1], x[0]))])


def _pattern(word: Column) -> Column:
    return F.regexp_replace(word, r"[^\x00-\x7F]", LOST)


def clean_words(counts: DataFrame) -> DataFrame:
    """The rows of counts (word, n) whose word no channel could have made."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[_looks_clean(w) for w in batch["word"]]]

    return counts.select("word", "n").mapInPandas(keep, "word string, n long")


def fitting_words(counts: DataFrame, clean: DataFrame) -> DataFrame:
    """word, reading, reading_n: for each word with lost characters every clean word that has all its other characters.

    Clean words are blanked at the lost places of the damaged words of their pattern, and then meet these on the word.
    """
    damaged = counts.where(F.col("word").contains(LOST)).select("word")
    shapes = damaged.select(_pattern(F.col("word")).alias("pattern"), F.regexp_replace("word", f"[^{LOST}]", "x").alias("shape")).distinct()
    reading, shape = F.col("reading"), F.col("shape")
    char = lambda i: F.when(F.substr(shape, i, F.lit(1)) == LOST, F.lit(LOST)).otherwise(F.substr(reading, i, F.lit(1)))
    blanked = F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), char), "")
    met = clean.select(_pattern(F.col("word")).alias("pattern"), F.col("word").alias("reading"), F.col("n").alias("reading_n")).join(shapes, "pattern")
    return met.select(blanked.alias("word"), "reading", "reading_n").join(damaged, "word", "left_semi")


def channel_gains(counts: DataFrame, model: CharModel, min_rows: int = HOT_ROWS) -> DataFrame:
    """word, channel, reading, gain: per word and channel the reading with the largest log-probability gain.

    The log-probability of a word is its corpus frequency, smoothed by the trigram model. Words of which a
    character was lost get channel "lost" with the likeliest of the clean words that fit and the model's filling.
    """
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    total = float(counts.agg(F.sum("n")).first()[0] or 0)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"]):
                own = m.score(word)
                clean = _looks_clean(word)
                for channel, readings in candidates(word, m).items():
                    doubt = DOUBT if _CAPITAL_MARK.fullmatch(word) else 0.0
                    rows += [(word, float(n) if clean else 0.0, own, channel, r, m.score(r) - doubt) for r in readings]
                if LOST in word:
                    filled = m.fill(word)
                    rows.append((word, 0.0, own, len(CHANNELS) - 1, filled, m.score(filled)))
            yield pd.DataFrame(rows, columns=["word", "n", "own", "channel", "reading", "model"])

    rows = cut_lineage(counts.mapInPandas(decode, "word string, n double, own double, channel int, reading string, model double"))
    clean = cut_lineage(clean_words(counts))
    known = clean.select(F.col("word").alias("reading"), F.col("n").alias("reading_n"))
    scored = salted_lookup(rows, known, "reading", min_rows=min_rows)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(model=[shared.value.score(r) for r in batch["reading"]])

    fits = fitting_words(counts, clean).mapInPandas(score, "word string, reading string, reading_n long, model double")
    fits = fits.withColumns({"n": F.lit(0.0), "own": F.lit(0.0), "channel": F.lit(len(CHANNELS) - 1)})

    def logp(n: Column, model_: Column) -> Column:
        return F.log((n + 50.0 * F.exp(F.greatest(model_, F.lit(-600.0)))) / F.lit(total + 50.0))

    reads = logp(F.coalesce("reading_n", F.lit(0)), F.col("model"))
    gain = F.when(F.col("channel") == len(CHANNELS) - 1, reads).otherwise(reads - logp(F.col("n"), F.col("own")))
    both = scored.select("word", "n", "own", "channel", "reading", "model", "reading_n").unionByName(fits).withColumn("gain", gain)
    best = both.groupBy("word", "channel").agg(F.max_by(F.struct("reading", "gain"), F.struct("gain", "reading")).alias("b"))
    return best.select("word", "channel", "b.reading", F.when(F.col("channel") == len(CHANNELS) - 1, LOST_GAIN).otherwise(F.col("b.gain")).alias("gain"))


def best_path(words: list[list[tuple[int, str, float]]], enter: float = ENTER) -> list[tuple[int, str] | None]:
    """Viterbi over a document's words; words[i] has (channel, reading, gain). Per word the (channel, reading) or None.

    A word that comes again is no new evidence: its gain counts once.
    """
    n = len(CHANNELS)
    score = np.full(n, -np.inf)
    score[0] = 0.0
    back = np.zeros((len(words), n), np.int32)
    seen: set[tuple[int, str]] = set()
    for i, options in enumerate(words):
        top = int(np.argmax(score))
        came = np.arange(n)
        entered = score[top] - enter
        switch = entered > score
        best = np.where(switch, entered, score)
        came = np.where(switch, top, came)
        if score[top] > best[0] or top != 0:
            if score[top] >= score[0]:
                best[0], came[0] = score[top], top
        gains = np.full(n, -np.inf)
        gains[0] = 0.0
        for channel, reading, gain in options:
            gains[channel] = min(gain, 0.1) if (channel, reading) in seen else gain
            seen.add((channel, reading))
        back[i] = came
        score = best + np.where(np.isinf(gains), -2.0, gains)
    state, out = int(np.argmax(score)), []
    for i in range(len(words) - 1, -1, -1):
        reading = next((r for c, r, g in words[i] if c == state), None)
        out.append((state, reading) if state and reading is not None else None)
        state = int(back[i][state])
    return out[::-1]


def garbled(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", enter: float = ENTER, min_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, channel, n_words, fixes for every affected document.

    channel: the most frequent channel of its damaged words; fixes: array of (place of the word among the words
    outside ASCII, reading). Null and empty texts are never affected; doc_id is taken as unique.
    """
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and length(text) > 0"))
    outside = docs.where(F.col("text").rlike(r"[^\x00-\x7F]"))
    counts = spread(cut_lineage(word_counts(outside)))
    gains = channel_gains(counts, char_model(counts), min_rows)
    useful = gains.where(F.col("gain") > 0.5).groupBy("word").agg(F.sort_array(F.collect_list(F.struct("channel", "reading", "gain"))).alias("options"))
    placed = outside.select("doc_id", F.posexplode(_words(F.col("text"))).alias("pos", "word"))
    hit = salted_lookup(placed, useful, "word", "inner", min_rows=min_rows)
    per_doc = hit.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "options"))).alias("words"))
    kind = per_doc.schema["doc_id"].dataType.simpleString()

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, words in zip(batch["doc_id"], batch["words"]):
                path = best_path([[(o["channel"], o["reading"], o["gain"]) for o in w["options"]] for w in words], enter)
                fixes = [(int(w["pos"]), c, r) for w, got in zip(words, path) if got for c, r in [got]]
                if fixes:
                    used = pd.Series([c for _, c, _ in fixes]).mode().iloc[0]
                    rows.append((doc, CHANNELS[used], len(fixes), [{"pos": p, "reading": r} for p, _, r in fixes]))
            yield pd.DataFrame(rows, columns=["doc_id", "channel", "n_words", "fixes"])

    return per_doc.mapInPandas(decide, f"doc_id {kind}, channel string, n_words int, fixes array<struct<pos:int,reading:string>>")


def restored(documents: DataFrame, damaged: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, channel, n_words, restored: the affected documents with their damaged words replaced."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = docs.join(damaged, "doc_id")
    word = re.compile(WORD)

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, fixes in zip(batch["text"], batch["fixes"]):
                by = {f["pos"]: f["reading"] for f in fixes}
                n = -1

                def swap(m: re.Match) -> str:
                    nonlocal n
                    n += 1
                    return by.get(n, m[0])

                out.append(word.sub(swap, t))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "channel": batch["channel"], "n_words": batch["n_words"], "restored": out})

    return joined.select("doc_id", "text", "channel", "n_words", "fixes").mapInPandas(fix, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, channel string, n_words int, restored string")
