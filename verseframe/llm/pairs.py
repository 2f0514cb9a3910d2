"""Broken prompt and response pairs (problem 1).

A multi-label linear classifier on hashed word n-grams and pair features, one label per defect. It is trained on
a bounded sample of pairs, each left as it is and turned into one example of every defect: emptied, cut at a random
character, replaced by a refusal, by the prompt in an altered form, or by an answer in another language (swapped in
from texts of that language). A held-out fifth of the examples calibrates one threshold per label. Of several
labels over their thresholds the one with the largest margin is the defect.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verseframe.llm import endings, language, pairtext
from verseframe.llm.linear import LinearModel, fit
from verseframe.llm.pairtext import folded, is_copy, is_empty, without_prompt
from verseframe.llm.truncation import PRIOR, SCORED, at_limits, ending_evidence, fit_endings, limit_log_odds, measured, posteriors_of, read_rows
from verseframe.operators.sampling import hash_sample
from verseframe.session import cut_lineage

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
#: Places of the weights: those of pair features first, by kind, then those of n-grams.
FEATURES, PAIR = 1 << 18, 1 << 14
KINDS = {k: i for i, k in enumerate(("empty", "copy", "words", "cover", "long", "end", "foreign"))}
#: Length of the n-gram part of a pair's features.
GRAM = 1.0
#: How fast n-grams are learnt for a label: fast for refusals, which rest on wording, slowly for cuts, which hardly do.
WORDING = {"empty": 1.0, "truncated": 0.2, "refusal": 4.0, "copy": 1.0, "language": 1.0}
#: Pairs in the bounded training sample.
SAMPLE = 2500
#: Share of each defect in real pairs for which thresholds are set; the examples hold every defect equally often.
RATE = 0.04

#: Fixed phrases from which refused answers are made: openings, statements, closings.
OPENINGS = ("I'm sorry, but", "I am sorry, but", "Sorry,", "Unfortunately,", "Regretfully,", "I apologize, but", "My apologies —", "As a language model,", "As an AI,", "To be clear,", "Hmm,", "I understand the wish, but", "I appreciate the idea, yet", "Thank you for asking, however", "Thanks, but", "")
STATEMENTS = (
    "I can't help with that request.", "I cannot help with this.", "I am not able to write this poem.", "I'm unable to write that.", "that is something I'm unable to do.", "I cannot provide a poem for this prompt.",
    "I can't provide that content.", "I won't be producing verse on this subject.", "I will not continue this text.", "I must decline to continue this text.", "I have to decline.", "I have to pass on this one.",
    "I would rather not take up this line.", "I don't feel comfortable composing this.", "I'm not comfortable writing this.", "this falls outside what I can create.", "there is no response I am allowed to give here.",
    "no poem can be offered for this prompt.", "the request was declined and no verse was written.", "content of this kind is not available from me.", "writing about this is against my guidelines.", "this goes against my policies.",
    "you would be better served by a human poet here, so I'll stop.", "I'm not allowed to answer this.", "I do not have an answer I can share.", "it is not possible for me to fulfil this request.",
    "writing about this is not something I do.", "I must leave this request unanswered.", "this topic is off limits for me.", "the rules I follow do not permit that.", "composing this is beyond what I may do.", "I should not compose this.",
    "I have been asked not to write on this theme.", "this request crosses a line, so I will stop here.", "that isn't a subject I can write about.", "I don't write this kind of content.", "my instructions prevent me from writing this.", "I will have to refuse.",
)
CLOSINGS = ("", "", "Could you rephrase what you need?", "I hope you understand.", "Please try a different topic.", "If you like, send another opening line.", "Let me know if something else would help.", "I'd gladly write about something else.", "Is there anything else I can do?")
#: Openings that put regret into a line of verse.
REGRETS = ("I am sorry,", "I'm sorry,", "Sorry,", "Unfortunately,", "I cannot hold", "I was unable to follow", "I won't forget", "I must decline", "Forgive me,", "I apologize to", "I can't name", "No,", "I was not able to keep", "I would rather not leave", "Regretfully,")
#: Fixed stand-ins for no answer.
NOTHING = ("", " ", "\n\n", "\t \n", "...", ". . .", "—", '""', "null", "N/A", "[no output]", "<|endoftext|>", "<|im_end|>\n", "<think></think>", "​", "None", "-", "***")


def refusal(rng: np.random.Generator, statements: tuple[str, ...] = STATEMENTS) -> str:
    opening, statement, closing = rng.choice(OPENINGS), rng.choice(statements), rng.choice(CLOSINGS)
    text = f"{opening} {statement}" if opening else statement[0].upper() + statement[1:]
    if closing:
        text = f"{text[:-1]}, but {closing[0].lower()}{closing[1:]}" if closing.startswith("I'd") else f"{text} {closing}"
    return _styled(text, rng)


def _styled(text: str, rng: np.random.Generator) -> str:
    style = rng.integers(0, 6)
    return text.replace("'", "’") if style in (0, 1) else text.lower() if style == 2 else text.rstrip(".!?") if style == 3 else text


def copied(prompt: str, rng: np.random.Generator) -> str:
    p = prompt.strip()
    bare = p.rstrip(" .,:;!?")
    forms = (p, p.upper(), p.lower(), f'"{bare}"', f"**{bare}**", f"Prompt: {p}", f"  {bare} .", f"{bare}\n{bare}", f"{p} {p} {p}", f"{p}\n{p}", f"> {p}", f"{bare}...", f"“{bare}”", f"{p}\n\n")
    return str(rng.choice(np.array(forms, dtype=object)))


@dataclass
class PairFeatures:
    """Features of many pairs: places in the weights and values, one stretch per pair, and what else is known of it."""

    places: np.ndarray
    values: np.ndarray
    sizes: np.ndarray
    evidence: np.ndarray
    usable: np.ndarray


@lru_cache(maxsize=10_000)
def _pair_place(name: str) -> int:
    """Pair features have the first PAIR places, n-grams the others."""
    return zlib.crc32(name.encode()) % (PAIR // len(KINDS)) + KINDS[name.partition(":")[0]] * (PAIR // len(KINDS))


def featurize(pairs: list[tuple[str | None, str | None]], use: endings.WordUse, lines: LinearModel, lexicon: language.Lexicon) -> PairFeatures:
    """Of every pair (prompt, answer): pair features over the whole texts, the word n-grams (1 to 3) of the whole
    answer after a leading prompt, the ending evidence, and whether the answer is neither empty nor a copy.

    The n-grams of an answer share one length, so that a long answer does not outweigh a short one.
    """
    n = len(pairs)
    names, parts, owner, texts, bodies, usable = [], [], [], [], [], np.zeros(n, bool)
    for k, (prompt, answer) in enumerate(pairs):
        text = answer or ""
        got = pairtext.parts_of(text)
        every = [w for w in got if w not in pairtext.BREAKS]
        asked = pairtext.folded_prompt(prompt)
        empty, copy = is_empty(text, every), is_copy(text, prompt, every)
        body, skip = without_prompt(text, prompt), 0
        if body is not text:
            skip = len(folded(text[: len(text) - len(body)]))
            words, seen, at = every[skip:], 0, 0
            while seen < skip and at < len(got):
                seen += got[at] not in pairtext.BREAKS
                at += 1
            got = got[at:]
        else:
            words = every
        cover = sum(map(frozenset(asked).__contains__, words)) / len(words) if words else 1.0
        size = len(words)
        names.append([f"empty:{empty}", f"copy:{copy}", f"words:{size if size < 8 else 8 + int(math.log2(size))}", f"cover:{int(cover * 10)}", f"long:{int(4 * math.log2((size + 1) / (len(asked) + 1)))}"])
        usable[k] = not empty and not copy
        parts += got
        owner.append(len(got))
        texts.append(text)
        bodies.append(body)
    evidence = np.zeros(n)
    judged = np.flatnonzero(usable)
    evidence[judged] = ending_evidence([texts[k] for k in judged], [bodies[k] for k in judged], use, lines)
    may = np.zeros((n, len(language.LANGUAGES)), bool)
    allowed: dict[str | None, set[int]] = {}
    for k, (prompt, _) in enumerate(pairs):
        if prompt not in allowed:
            allowed[prompt] = language.allowed(lexicon, prompt)
        may[k, sorted(allowed[prompt])] = True
    ids, owner = lexicon.numbers(parts), np.repeat(np.arange(n), np.array(owner, dtype=np.int64))
    shares = language.foreign_shares(lexicon, ids, owner, may)
    for k in judged:
        names[k] += [f"end:{int(np.clip(evidence[k], -8, 8))}", f"foreign:{int(shares[k] * 10)}", f"foreign:{shares[k] > 0.6}"]
    words = np.flatnonzero(ids)
    code, of = lexicon.hash[ids[words]], owner[words]
    two = np.flatnonzero(of[:-1] == of[1:]) if len(of) else of
    three = np.flatnonzero(of[:-2] == of[2:]) if len(of) > 2 else of[:0]
    mix = np.uint64(0x9E3779B97F4A7C15)
    pair_code = (code[two] * mix ^ (code[two] >> np.uint64(29))) + code[two + 1] if len(two) else code[:0]
    three_code = ((code[three] * mix ^ (code[three] >> np.uint64(29))) + code[three + 1]) * mix + code[three + 2] + np.uint64(1) if len(three) else code[:0]
    gram = PAIR + (((np.concatenate([code, pair_code, three_code]) * mix) >> np.uint64(24)) % np.uint64(FEATURES - PAIR)).astype(np.int64)
    gram_of = np.concatenate([of, of[two], of[three]])
    number = np.bincount(gram_of, minlength=n)
    own = np.repeat(np.arange(n), np.array([len(x) for x in names], dtype=np.int64))
    places = np.concatenate([np.fromiter((_pair_place(f) for x in names for f in x), np.int64, len(own)), gram])
    values = np.concatenate([np.ones(len(own)), GRAM / np.sqrt(np.maximum(number, 1))[gram_of]])
    rows = np.concatenate([own, gram_of])
    order = np.argsort(rows, kind="stable")
    return PairFeatures(places[order], values[order].astype(np.float32), np.bincount(rows, minlength=n), evidence, usable)


def synthesize(pairs: list[tuple[str, str]], foreign: dict[str, list[str]], lexicon: language.Lexicon, rng: np.random.Generator, statements: tuple[str, ...] = STATEMENTS) -> list[tuple[str, str, int]]:
    """(prompt, answer, defect number or -1): every pair as it is, with the answer to another prompt (which is no defect
    here), and once with every defect."""
    out = []
    names = [k for k, v in foreign.items() if v]
    for prompt, answer in pairs:
        out.append((prompt, answer, -1))
        if rng.random() < 0.3:
            other, body = pairs[int(rng.integers(len(pairs)))]
            body = without_prompt(body, other)
            if language.allowed(lexicon, prompt) & language.allowed(lexicon, other) and len(body) > 30:
                out.append((prompt, body, -1))
        out.append((prompt, str(rng.choice(np.array(NOTHING, dtype=object))), 0))
        body = without_prompt(answer, prompt)
        if len(body) > 30:
            cut = answer[: len(answer) - len(body) + int(rng.integers(12, len(body) - 4))]
            out.append((prompt, cut + str(rng.choice(np.array(["", "", "", "", "...", "…", " [...]", "... [clipped]", "\n..."], dtype=object))), 1))
        lead = f"{prompt}{rng.choice(np.array([' ', chr(10)], dtype=object))}" if rng.random() < 0.3 else ""
        out += [(prompt, lead + refusal(rng, statements), 2) for _ in range(2)]
        out.append((prompt, lead + " ".join(refusal(rng, statements) for _ in range(int(rng.integers(2, 7)))), 2))  # one of many words
        end = "\n".join(x for x in body.strip().split("\n") if x.strip()).split("\n")[-int(rng.integers(1, 4)) :]
        out.append((prompt, "\n".join(end), -1))  # few words are no refusal
        if rng.random() < 0.4:
            end[-1] = f"{rng.choice(REGRETS)} {end[-1][:1].lower()}{end[-1][1:]}"
            out.append((prompt, "\n".join(end), -1))  # nor is regret within a poem
        out.append((prompt, copied(prompt, rng), 3))
        may = language.allowed(lexicon, prompt)
        other = [n for n in names if language.LANGUAGES.index(n) not in may]
        if other:
            spoken = foreign[str(rng.choice(other))]
            text, asks = spoken[int(rng.integers(len(spoken)))], spoken[int(rng.integers(len(spoken)))]
            line = asks.strip().split("\n")[0]
            out += [(prompt, lead + text, 4), (line, text, -1)]  # the same words where they were asked for
            if len(body) > 30 and rng.random() < 0.4:
                out.append((line, body, 4))
    return out


#: The pair features that bear on each label, beside the n-grams, which bear on all.
BEARING = {"empty": ("empty",), "truncated": ("end",), "refusal": ("words", "long", "copy"), "copy": ("copy", "cover", "long"), "language": ("foreign",)}


def _bears() -> np.ndarray:
    out = np.zeros((FEATURES, len(DEFECTS)), np.float32)
    out[PAIR:] = [WORDING[d] for d in DEFECTS]
    span = PAIR // len(KINDS)
    for k, d in enumerate(DEFECTS):
        for kind in BEARING[d]:
            out[KINDS[kind] * span : (KINDS[kind] + 1) * span, k] = 1.0
    return out


class PairClassifier:
    """The trained models, one row of weights per label, and calibrated thresholds."""

    def __init__(self, use: endings.WordUse, lines: LinearModel, tongue: LinearModel, labels: LinearModel, thresholds: np.ndarray) -> None:
        self.use, self.lines, self.tongue, self.labels, self.thresholds = use, lines, tongue, labels, thresholds

    @cached_property
    def lexicon(self) -> language.Lexicon:
        return language.Lexicon(self.tongue)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lexicon"}

    def margins(self, pairs: list[tuple[str | None, str | None]], fitted: tuple[endings.WordUse, LinearModel] | None = None) -> tuple[np.ndarray, PairFeatures]:
        """The log-odds over the thresholds of every pair and label, and the features; fitted: word counts and line
        model to judge the endings by, where they are not the classifier's own."""
        use, lines = fitted or (self.use, self.lines)
        found = featurize(pairs, use, lines, self.lexicon)
        return self.labels.many(found.places, found.sizes, found.values) - self.thresholds, found


def train(pairs: list[tuple[str, str]], foreign: dict[str, list[str]], use: endings.WordUse, lines: LinearModel, tongue: LinearModel, seed: int = 11) -> PairClassifier:
    """Trained in two rounds: pairs of the sample that the first classifier finds defective are no sound examples in the second."""
    lexicon = language.Lexicon(tongue)
    told = [(p, a) for p, a in pairs if p and a]
    found = featurize(told, use, lines, lexicon)
    span = PAIR // len(KINDS)
    foreign_mark = np.bincount(np.repeat(np.arange(len(told)), found.sizes)[found.places == _pair_place("foreign:True")], minlength=len(told)) > 0
    sound = [pair for k, pair in enumerate(told) if found.usable[k] and found.evidence[k] < 1 and not foreign_mark[k] and not _may_refuse(*pair)]
    out = _calibrated(sound, foreign, use, lines, lexicon, seed)
    sound = [pair for pair, m in zip(sound, out.margins(sound)[0]) if (m + out.thresholds).max() < 0] if sound else sound
    out = _calibrated(sound, foreign, use, lines, lexicon, seed)
    out.labels = _fitted(*_examples(sound, foreign, use, lines, lexicon, np.random.default_rng(seed), STATEMENTS), seed)
    return out


def _examples(sound: list[tuple[str, str]], foreign: dict[str, list[str]], use: endings.WordUse, lines: LinearModel, lexicon: language.Lexicon, rng: np.random.Generator, statements: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, values, sizes and labels of the synthetic examples of the pairs."""
    examples = synthesize(sound, foreign, lexicon, rng, statements)
    parts = [featurize([(p, a) for p, a, _ in examples[lo : lo + 1000]], use, lines, lexicon) for lo in range(0, max(len(examples), 1), 1000)]
    labels = np.array([[float(d == k) for k in range(len(DEFECTS))] for _, _, d in examples]).reshape(-1, len(DEFECTS))
    return *(np.concatenate([getattr(p, a) for p in parts]) for a in ("places", "values", "sizes")), labels


def _fitted(places: np.ndarray, values: np.ndarray, sizes: np.ndarray, labels: np.ndarray, seed: int) -> LinearModel:
    return fit(places, sizes, labels, FEATURES, values, _bears(), epochs=8, seed=seed)


def _calibrated(sound: list[tuple[str, str]], foreign: dict[str, list[str]], use: endings.WordUse, lines: LinearModel, lexicon: language.Lexicon, seed: int) -> PairClassifier:
    """Trained on four fifths of the pairs, with thresholds from the others, which are refused in other words."""
    rng = np.random.default_rng(seed)
    held, other = rng.random(len(sound)) < 0.2, rng.random(len(STATEMENTS)) < 0.25
    split = [(tuple(s for s, o in zip(STATEMENTS, other) if o == part), [p for p, h in zip(sound, held) if h == part]) for part in (False, True)]
    model = _fitted(*_examples(split[0][1], foreign, use, lines, lexicon, rng, split[0][0]), seed)
    places, values, sizes, labels = _examples(split[1][1], foreign, use, lines, lexicon, rng, split[1][0])
    scores = model.many(places, sizes, values)
    return PairClassifier(use, lines, lexicon.model, model, np.array([_best_threshold(scores[:, k], labels[:, k]) for k in range(len(DEFECTS))]))


_REFUSING = re.compile(r"\b(?:sorry|apolog\w+|unable|cannot|can't|decline\w*|won't|rather not|not able|not allowed|guidelines)\b", re.I)


def _may_refuse(prompt: str, answer: str) -> bool:
    """Whether a sampled answer is kept out of the sound examples; the classifier itself never asks this."""
    body = without_prompt(answer, prompt)
    return len(folded(body)) < 40 and bool(_REFUSING.search(body.replace("’", "'")))


def _best_threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the gap that maximises F1 on the held-out examples, moved from their share of the defect to RATE."""
    move = np.log(max(truth.mean(), 1e-6) / (1 - min(truth.mean(), 1 - 1e-6))) - np.log(RATE / (1 - RATE)) if len(truth) else 0.0
    order = np.argsort(-scores, kind="stable")
    s, t = np.append(scores[order], -np.inf), truth[order]
    if not t.sum():
        return float("inf")
    hit = np.cumsum(t)
    f1 = np.where(s[:-1] > s[1:], 2 * hit / (np.arange(len(t)) + 1 + t.sum()), -1)  # equal scores stay together
    k = int(np.argmax(f1))
    low = s[k + 1] if np.isfinite(s[k + 1]) else s[k] - 1
    middle, typical = (s[k] + low) / 2, float(np.median(s[:-1][t > 0]))
    return float(middle + min(move, 0.2 * max(typical - middle, 0.0)))


def fit_classifier(tables: list[DataFrame], documents: DataFrame, known_use: endings.WordUse, new: list[DataFrame], sample: int = SAMPLE) -> PairClassifier:
    """Trained on the pairs (row_id, prompt, text) of the tables and on documents labelled by language.

    known_use: word counts of all tables but those of `new`, which are counted here. The bounded training samples are
    `sample` pairs, endings.SAMPLE texts of each table and language.SAMPLE documents of each language.
    """
    use = known_use
    for t in new:
        use = endings.word_use(t.where("text is not null")) + use
    tongue, spoken = language.train(documents)
    pairs, texts = [], set()
    for t in tables:
        rows = hash_sample(t.select("row_id", "prompt", "text").where("length(text) > 0"), max(endings.SAMPLE, sample), "row_id")
        pairs += [(r["prompt"], r["text"]) for r in rows if r["prompt"] is not None][: sample // len(tables)]
        texts |= {r["text"] for r in rows if len(r["text"]) > 40}
    lines = endings.train(sorted(texts), use)
    lexicon, foreign = language.Lexicon(tongue), {}
    for name, text in spoken:
        if len(text) <= 3000 and len(foreign.get(name, ())) < 40 and int(np.argmax(language.odds(lexicon, text))) == language.LANGUAGES.index(name):
            foreign.setdefault(name, []).append(text)
    return train(sorted(set(pairs)), foreign, use, lines, tongue)


def scored_pairs(rows: DataFrame, classifier: PairClassifier, fitted: tuple[endings.WordUse, LinearModel] | None = None) -> DataFrame:
    """SCORED and one column of log-odds over the threshold per defect, of the distinct rows (read_rows): one pass over
    the texts. A null text is read as the empty one. fitted: as for margins."""
    shared = rows.sparkSession.sparkContext.broadcast((classifier, fitted))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, own = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 500):
                b = batch.iloc[lo : lo + 500].reset_index(drop=True)
                b["text"] = b["text"].fillna("")
                m, found = c.margins(list(zip(b["prompt"], b["text"])), own)
                yield pd.concat([measured(b, found.evidence, found.usable), pd.DataFrame(np.clip(m, -50, 50), columns=list(DEFECTS))], axis=1)

    schema = SCORED.format(kind=rows.schema["row_id"].dataType.simpleString()) + ", " + ", ".join(f"{d} double" for d in DEFECTS)
    return cut_lineage(rows.mapInPandas(score, schema).distinct())


def defective(scored: DataFrame, exact_cuts: DataFrame | None = None) -> DataFrame:
    """row_id, defect of every defective pair of scored_pairs; one row per row_id.

    A null or blank text is empty; a null prompt allows every language and copies nothing. exact_cuts: row_id of just
    the rows that are truncated, decided elsewhere; without it the odds of "truncated" are moved by the censoring odds
    at the limits of each source, and the posterior of a cut must agree. Rows of one row_id with different texts take the defect that sorts first.
    """
    if exact_cuts is not None:
        marked = scored.join(exact_cuts.select("row_id", F.lit(True).alias("_cut")).hint("merge"), "row_id", "left")
        scored = marked.withColumn("truncated", F.when(F.col("_cut"), 1000.0).otherwise(-1000.0)).drop("_cut")
    else:
        shift = F.greatest(F.lit(0.0), limit_log_odds() - F.lit(PRIOR))
        both = F.least(F.col("truncated") + F.coalesce(shift, F.lit(0.0)), limit_log_odds() + F.col("evidence"))
        scored = at_limits(scored).withColumn("truncated", F.when(F.col("usable"), both).otherwise(-50.0))
    top = F.greatest(*DEFECTS)
    defect = F.coalesce(*[F.when(F.col(d) == top, F.lit(d)) for d in DEFECTS])
    return scored.where(top > 0).groupBy("row_id").agg(F.min(defect).alias("defect"))


def broken_pairs(outputs: DataFrame, sweep: DataFrame, documents: DataFrame, names: tuple[str, str]) -> DataFrame:
    """source_table, row_id, defect over both tables; the sweep's truncated rows are those of cut_posteriors."""
    left, right = read_rows(outputs, "row_id", "model", "prompt", "poem", None), read_rows(sweep, "row_id", "run_name", "prompt", "output", "output_length")
    fitted = fit_endings(right.where("text is not null"))
    classifier = fit_classifier([left, right], documents, fitted[0], [left])
    a, b = scored_pairs(left, classifier), scored_pairs(right, classifier, fitted)
    exact = posteriors_of(b).where("filled and log_odds > 0")
    out = defective(a).withColumn("source_table", F.lit(names[0])).unionByName(defective(b, exact).withColumn("source_table", F.lit(names[1])))
    return out.select("source_table", "row_id", "defect")
