import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verseframe.llm import consensus, encoding, endings, leakage, packing, pairs, pairtext, truncation

day = dt.datetime.fromisoformat
NOUNS, ADJ, VERBS = "moon river stone lamp oar hill door reed".split(), "old quiet bright low wide torn".split(), "keeps finds holds leaves follows".split()


def poem(rng, n=6):
    line = lambda: f"the {rng.choice(ADJ)} {rng.choice(NOUNS)} {rng.choice(VERBS)} a {rng.choice(ADJ)} {rng.choice(NOUNS)}"
    return ",\n".join(line() for _ in range(n)) + "."


# -- packing

def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 5, 90, 300, 700, 1500, 5000])) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), shard_items=300).toPandas()
    assert got.groupby("block").n_tokens.sum().max() <= packing.CAPACITY
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == dict(rows)
    assert (got.groupby("doc_id").size()[[i for i, n in rows if n <= packing.CAPACITY]] == 1).all()
    sizes = np.array([n % packing.CAPACITY for _, n in rows for _ in range(1)])
    alone = np.full(len(sizes), -1)
    packing.best_fit(alone, sizes, np.argsort(-sizes, kind="stable"), {}, packing.CAPACITY)
    whole = sum(n // packing.CAPACITY for _, n in rows)
    assert got.block.nunique() <= (alone.max() + 1 + whole) * 1.01 + 1


def test_packing_edge_cases(spark):
    schema = "doc_id long, n_tokens long"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 0), (2, 0)], schema)).select("block").distinct().count() == 1
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "moon " * 30000, "x"), (4, "<|endoftext|>", "x")], "doc_id long, text string, size string")
    counts = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(docs).collect()}
    assert counts[1] == counts[2] == 0 and counts[3] >= 30000 and counts[4] > 1


# -- leakage

def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    items = {i: [rng.choice(vocab) for _ in range(60)] for i in range(5)}
    docs, want = [], set()
    for d in range(40):
        body, i = [rng.choice(vocab) for _ in range(80)], rng.randrange(5)
        kind = d % 5
        part = items[i][10:40]
        if kind == 0:
            part = part[:11]
        elif kind == 1:
            part = part[:12]
        elif kind == 2:
            part = [w if k % 7 else "changed" for k, w in enumerate(part)]
        elif kind == 3:
            part = [w for k, w in enumerate(part) if k % 8]
        else:
            part = [w if k % 2 else "no" for k, w in enumerate(part)]
        if kind in (1, 2, 3):
            want.add((d, i))
        docs.append((d, "1. " + " ".join(body[:30] + part + body[30:]).upper().replace(" ", ", ", 3) + "<|line|>", "x"))
    df = spark.createDataFrame([*docs, (100, None, "x"), (101, "", "x"), (None, " ".join(items[0]), "x")], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(9, None), (10, "too short")], "item_id long, text string")
    got = {tuple(r) for r in leakage.find_leaks(df, it, block_words=100).collect()}
    assert got == want
    assert leakage.find_leaks(df, it.limit(0)).count() == 0 and leakage.find_leaks(df.limit(0), it).count() == 0


def test_myers_equals_dynamic_programming():
    rng = np.random.default_rng(3)
    p, t = rng.integers(0, 4, (50, 9)), rng.integers(0, 4, (50, 20))

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    assert leakage.myers(p, t).tolist() == [slow(a, b) for a, b in zip(p, t)]


# -- encoding

@pytest.mark.parametrize(("true", "wrong"), [("utf_8", "cp1252"), ("utf_8", "mac_roman"), ("utf_8", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp850")])
def test_garbled_round_trip(spark, true, wrong):
    rng = random.Random(4)
    words = ["café", "naïve", "don’t", "fiancée", "smörgås", "—"]
    clean = [" ".join(rng.choice([*NOUNS, *words]) for _ in range(40)) for _ in range(60)]
    bad = {3, 17, 40}
    rows = [(i, t.encode(true).decode(wrong) if i in bad else t, "own") for i, t in enumerate(clean)] + [(90, None, "own"), (91, "", "own"), (92, "plain", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, channel string")
    got = encoding.garbled(docs)
    assert {r["doc_id"] for r in got.collect()} == bad
    fixed = {r["doc_id"]: r["restored"] for r in encoding.restored(docs, got).collect()}
    assert fixed == {i: clean[i] for i in bad}


def test_lost_bytes_and_foreign_text(spark):
    rows = [(i, "the café don’t naïve") for i in range(30)] + [(50, "the caf� don�t na�ve"), (51, "Тихий вечер ждёт снег"), (52, "A MANHÃ… NÃO")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = encoding.garbled(docs)
    assert {r["doc_id"]: r["restored"] for r in encoding.restored(docs, got).collect()} == {50: "the café don’t naïve"}
    assert encoding.garbled(docs.limit(0)).count() == 0


# -- truncation and pairs

def test_endings():
    e = endings.ending_of
    assert e("One line.\nThe other").closing == "none" and e("One, two.").closing == "terminal" and e("lamp (3 more lines)").marker and e("la... [clipped]").marker
    assert e("a line of words\nwithout any marks\nat all").style == "plain" and e("").seen == 0


def test_censored_fit_recovers_the_mean():
    rng = np.random.default_rng(5)
    x = np.exp(rng.normal(6, 0.5, 20000)).astype(int)
    cut = np.minimum(x, 500)
    lengths, counts = np.unique(cut, return_counts=True)
    mu, sd = truncation.fit_censored(lengths, counts, {500: float((x >= 500).sum())}, rounds=200)
    assert abs(mu - 6) < 0.03 and abs(sd - 0.5) < 0.03


def sweep(spark, extra=()):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        text = poem(rng, rng.randrange(3, 9))
        n = len(text)
        if i % 10 == 0:
            text = text[: n * 2 // 3]
        if i % 10 == 1 and n > 200:
            text = text[:200]
        rows.append((i, "run", "p", text, n, "own"))
    return spark.createDataFrame([*rows, *extra], "row_id long, run_name string, prompt string, output string, output_length int, source string")


def test_cut_rows(spark):
    extra = [(1000, None, None, None, None, None), (1001, "run", "p", " ", 5, None), (1002, "other", "ask me", "ask me", 6, None), (1003, "run", "p", "N/A", None, None), (2, "run", "p", "dup", 3, None)]
    df = sweep(spark, extra)
    got = {r["row_id"]: r["log_odds"] > 0 and r["filled"] for r in truncation.cut_posteriors(df).collect()}
    assert all(got[i] for i in range(0, 400, 10)) and 1000 not in got
    assert not any(got[i] for i in (1001, 1002, 1003)) and sum(got[i] for i in range(400) if i % 10 > 1) <= 3
    report = {r["source"]: r["share_cut"] for r in truncation.truncation_report(truncation.cut_posteriors(df)).collect()}
    assert 0.08 < report["run"] < 0.3
    assert truncation.cut_posteriors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("answer", "empty", "copy"), [(None, True, False), ("​", True, False), ("N/A", True, False), ("<|im_end|>", True, False), ("** Tell me of rain **", False, True), ("Prompt: tell me of rain.", False, True), ("Tell me of rain\nTell me of rain", False, True), ("Tell me of rain now", False, False)])
def test_empty_and_copy(answer, empty, copy):
    assert pairtext.is_empty(answer) == empty and pairtext.is_copy(answer, "Tell me of rain.") == copy


def test_broken_pairs(spark):
    rng = random.Random(7)
    foreign = ["der Mond singt leise über die alte Stille", "das Mädchen wartet heute zwischen den Straßen", "mein Herz vergisst den Fluss und die Asche"]
    answers, want = [], {}
    for i in range(360):
        prompt = f"Write about the {rng.choice(ADJ)} {rng.choice(NOUNS)}"
        text = poem(rng)
        if i % 9 == 0:
            text, want[i] = {0: (None, "empty"), 1: ("I'm sorry, but I can't help with that request.", "refusal"), 2: (prompt.upper(), "copy"), 3: (",\n".join(rng.choice(foreign) for _ in range(5)) + ".", "language"), 4: (text[: len(text) // 2], "truncated")}[i // 9 % 5]
        answers.append((i, "m", prompt, text))
    outputs = spark.createDataFrame(answers, "row_id long, model string, prompt string, poem string")
    docs = spark.createDataFrame([(i, "en", poem(rng)) for i in range(60)] + [(100 + i, "de", ".\n".join(rng.choice(foreign) for _ in range(5))) for i in range(60)], "doc_id long, lang string, text string")
    empty = spark.createDataFrame([], "row_id long, run_name string, prompt string, output string, output_length int")
    got = {r["row_id"]: r["defect"] for r in pairs.broken_pairs(outputs, empty, docs, ("a", "b")).collect()}
    right = sum(got.get(i) == d for i, d in want.items())
    assert right >= 0.9 * len(want) and len(set(got) - set(want)) <= 6


# -- consensus

def test_consensus_beats_the_mode(spark):
    rng = np.random.default_rng(8)
    rows, truth = [], {}
    for i in range(300):
        t = int(rng.integers(1, 6))
        truth[str(i)] = t
        for j in rng.choice(14, 7, replace=False):
            v = t if rng.random() < 0.75 else int(np.clip(t + rng.choice([-1, 1]), 1, 5))
            v = 4 if j in (0, 1) else int(rng.integers(1, 6)) if j in (2, 3) else min(5, v + 1) if j in (4, 5) else v
            rows.append((f" R{j} " if i % 2 else f"r{j}", str(i), "m", v, 3, v, day("2024-01-01")))
    rows += [(None, "0", "m", 1, 1, 1, day("2024-01-02")), (" ", "0", "m", 1, 1, 1, day("2024-01-02")), ("r9", "0", "m", 9, 1, 1, day("2024-01-03")), ("r9", None, "m", 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "reviewer string, comparison_id string, model string, originality int, emotion int, imagery int, submitted_at timestamp")
    labels, judges, votes = consensus.consensus(df)
    got = {r["item_id"]: r["label"] for r in labels.where("dimension = 'imagery'").collect()}
    right = np.mean([got[i] == t for i, t in truth.items()])
    frame = pd.DataFrame(rows, columns=list("abcdefg")).dropna()
    mode = frame[frame.d < 6].groupby("b").f.agg(lambda x: x.mode().iloc[0])
    assert right > 0.85 and right > np.mean([mode[i] == t for i, t in truth.items()])
    acc = {r["annotator"]: r["accuracy"] for r in judges.where("dimension = 'imagery'").collect()}
    assert acc["r0"] < 0.3 and acc["r2"] < 0.3 and acc["r9"] > 0.4 and len(acc) == 14
    kappa = consensus.agreement(votes).where("dimension = 'imagery'").first()["kappa"]
    assert 0 < kappa < 1


def test_consensus_small(spark):
    schema = "reviewer string, comparison_id string, model string, originality int, emotion int, imagery int, submitted_at timestamp"
    assert consensus.consensus(spark.createDataFrame([], schema))[0].count() == 0
    one = spark.createDataFrame([("a", "1", "m", 4, 1, 2, day("2024-01-01"))] * 2, schema)
    assert {(r["dimension"], r["label"]) for r in consensus.consensus(one)[0].collect()} == {("originality", 4), ("imagery", 2)}
