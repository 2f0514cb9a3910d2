"""What must hold at any size, and how well the operators do on made-up cases."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verseframe.llm import consensus, encoding, endings, leakage, pairs, pairtext, truncation
from verseframe.llm.linear import fit, flat, row_sums

NOUNS, ADJ, VERBS = "moon river stone lamp oar hill door reed garden ember".split(), "old quiet bright low wide torn pale".split(), "keeps finds holds leaves follows".split()


def verse(rng, n):
    return ",\n".join(f"the {rng.choice(ADJ)} {rng.choice(NOUNS)} {rng.choice(VERBS)} a {rng.choice(ADJ)} {rng.choice(NOUNS)}" for _ in range(n)) + "."


# -- limits of lengths

@pytest.mark.parametrize("rows", [20_000, 2_000_000])
def test_a_limit_is_found_at_any_number_of_rows(rows):
    rng = np.random.default_rng(1)
    x = np.maximum(np.exp(rng.normal(6, 0.6, rows)).astype(int), 1)
    cut = (x > 500) & (rng.random(rows) < 0.5)
    length, bin_ = np.where(cut, 500, x), np.where(cut, rng.integers(-1, 6, rows), rng.integers(-6, 1, rows))
    hist = pd.DataFrame({"length": length, "bin": bin_}).groupby(["length", "bin"]).size().rename("n").reset_index()
    got = truncation.find_limits(hist).set_index("length").share
    at = length == 500
    assert abs(got[500] - cut[at].mean()) < 0.1 and got.drop(500).max() < 0.5 if len(got) > 1 else got[500] > 0.5


def test_no_rows_give_no_limits():
    assert truncation.find_limits(pd.DataFrame({"length": [], "bin": [], "n": []}).astype(int)).empty
    assert truncation.find_limits(pd.DataFrame({"length": [7, 9], "bin": [0, 0], "n": [1, 1]})).empty


# -- pairs

@pytest.fixture(scope="module")
def classifier(spark):
    rng = random.Random(3)
    foreign = ["der Mond singt leise über die alte Stille", "das Mädchen wartet heute zwischen den Straßen", "mein Herz vergisst den Fluss und die Asche", "und niemand weiß den Weg nach Hause"]
    rows = [(i, f"Write about the {rng.choice(ADJ)} {rng.choice(NOUNS)}", verse(rng, rng.randrange(1, 9))) for i in range(700)]
    table = spark.createDataFrame(rows, "row_id long, prompt string, text string")
    docs = [(i, "en", verse(rng, 6)) for i in range(60)] + [(100 + i, "de", ".\n".join(rng.choice(foreign) for _ in range(5))) for i in range(60)]
    use, _ = truncation.fit_endings(table)
    return pairs.fit_classifier([table], spark.createDataFrame(docs, "doc_id long, lang string, text string"), use, [])


#: Refusals in words that are not among those of the training examples.
REFUSED = (
    "I'm afraid verse on that theme isn't something I produce.", "As an assistant I must not compose this. Please consider another theme.", "I regret that composing such a poem is beyond what I may do.", "Sorry! I can't do that.",
    "I'm not in a position to write that poem for you.", "Your request was blocked and I cannot proceed with it.", "I appreciate you asking, but I need to say no here.", "Unfortunately I am prevented from writing on this.",
    "Thanks for the prompt; I have to turn it down.", "My apologies, I cannot give you a poem on this. " * 12,
)


def test_refusals_in_other_words_and_at_any_length(classifier):
    m, _ = classifier.margins([("Write about the old moon", t) for t in REFUSED])
    assert (m[:, pairs.DEFECTS.index("refusal")] > 0).mean() >= 0.7
    rng = random.Random(4)
    poems = [verse(rng, n) for n in range(1, 9) for _ in range(10)] + ["I am sorry, " + verse(rng, 3) for _ in range(20)]
    m, _ = classifier.margins([("Write about the old moon", t) for t in poems])
    assert (m[:, pairs.DEFECTS.index("refusal")] > 0).mean() <= 0.1


def test_tables_without_rows_or_documents(spark):
    outputs = spark.createDataFrame([], "row_id long, model string, prompt string, poem string")
    sweep = spark.createDataFrame([], "row_id long, run_name string, prompt string, output string, output_length int")
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert pairs.broken_pairs(outputs, sweep, docs, ("a", "b")).count() == 0
    few = spark.createDataFrame([(1, None, None, None), (2, "m", "p", ""), (2, "m", "p", "")], outputs.schema)
    got = {(r["row_id"], r["defect"]) for r in pairs.broken_pairs(few, sweep, docs, ("a", "b")).collect()}
    assert got <= {(1, "empty"), (2, "empty")}


def test_blank_answers_and_odd_pairs_get_labels(classifier):
    cases = [("p", None), ("p", ""), ("p", " \n"), (None, "..."), (None, None), ("", "the moon"), ("moon", "moon " * 5000), ("a", "\ud800 x"), ("雪", "雪が橋に静かに待つ。")]
    m, found = classifier.margins(cases)
    assert m.shape == (len(cases), 5) and np.isfinite(m).all() and (m[:5].argmax(axis=1) == 0).all() and (m[:5, 0] > 0).all()
    assert not found.usable[:5].any() and found.sizes.sum() == len(found.places) == len(found.values)


def test_features_do_not_depend_on_the_batch(classifier):
    rng = random.Random(5)
    cases = [(f"Write about the {rng.choice(NOUNS)}", verse(rng, rng.randrange(1, 6))) for _ in range(30)] + [("x", ""), (None, None)]
    m, _ = classifier.margins(cases)
    for i, c in enumerate(cases):
        assert classifier.margins([c])[0][0] == pytest.approx(m[i], abs=1e-4)


def test_line_odds_of_many_endings(classifier):
    ends = [endings.ending_of(t) for t in ("the moon\nkeeps a lo", "", "one line.", "a b c")]
    many = endings.line_odds(ends, classifier.use, classifier.lines)
    for e, z in zip(ends, many):
        assert z == pytest.approx(float(classifier.lines.log_odds(endings.line_features(e.segment, classifier.use))[0]) if e.segment else 0.0, abs=1e-4)
    assert len(endings.line_odds([], classifier.use, classifier.lines)) == 0


def test_weights_by_stretches():
    assert row_sums(np.arange(5.0), np.array([2, 0, 3, 0])).tolist() == [1, 0, 9, 0] and row_sums(np.zeros((0, 2)), np.array([0])).tolist() == [[0, 0]]
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 40, rng.integers(1, 6)) for _ in range(800)]
    labels = np.array([[float((r < 20).any()), float((r > 35).any())] for r in rows])
    model = fit(*flat(rows), labels, 40, epochs=20)
    assert ((model.many(*flat(rows)) > 0) == (labels > 0)).mean() > 0.95
    still = fit(*flat(rows), labels, 40, bears=np.zeros((40, 2)))
    assert not still.weights.any()


def test_words_of_texts_without_blanks():
    assert pairtext.folded("雪が橋に。") == ["雪が", "橋に"] and pairtext.parts_of("One, two. Three\n") == ["one", "two", ".", "three", "\n"]


# -- leaks

def test_text_of_many_hits_is_halved_without_loss():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, [rng.choice(vocab) for _ in range(50)]) for i in range(6)]
    index = leakage.ItemIndex(items)
    docs = []
    for d in range(12):
        words = [rng.choice(vocab) for _ in range(900)]
        at, i = rng.randrange(0, 800), rng.randrange(6)
        words[at : at + 20] = [w if k % 9 else "other" for k, w in enumerate(items[i][1][5:25])]
        docs.append(np.array([index.vocabulary.get(w, -1) for w in words]))
    whole = leakage.leaked_pairs(index, docs)
    assert whole and leakage.leaked_pairs(index, docs, most=20) == whole


# -- encoding

class Letters:
    def logp(self, gram):
        return -1.0 if gram[2] in "abcdefghijklmnopqrstuvwxyzéàüñ’”雨の夜ю\x03" else -7.0

    def logps(self, grams):
        return np.array([self.logp(g) for g in grams])

    def fill(self, word):
        return word


@pytest.mark.parametrize("word", ["café", "don’t", "rain”", "雨の夜", "à", "señé"])
def test_lost_bytes_at_any_place(word):
    for codec in ("cp1252", "cp1250"):
        raw = word.encode()
        for lost in ({len(word.encode()) - 1}, {0}, {0, 2}, set(range(len(raw)))):
            shown = "".join("�" if k in lost and b >= 128 else bytes([b]).decode(codec, "replace") for k, b in enumerate(raw))
            if "�" in shown and sum(c == "�" for c in shown) <= 2:
                assert word in encoding.lattice_readings(shown, codec, Letters(), most=64), (shown, codec)


def test_plain_words_have_no_lattice_readings():
    assert encoding.lattice_readings("the�", "cp1252", Letters()) == []


def restoration(spark, clean, damage):
    rows = [(i, t) for i, t in enumerate(clean)] + [(10_000 + i, damage(t)) for i, t in enumerate(clean[: len(clean) // 4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["restored"] for r in encoding.restored(docs, encoding.garbled(docs)).collect()}
    changed = [i for i, t in enumerate(clean[: len(clean) // 4]) if damage(t) != t]
    return np.mean([10_000 + i in got for i in changed]), np.mean([got.get(10_000 + i) == clean[i] for i in changed]), sum(k < 10_000 for k in got)


WORDS = ["café", "naïve", "don’t", "fiancée", "smörgås", "señor", "Zürich", "élan", "“moon”", "déjà", "jalapeño", "l’été"]


@pytest.mark.parametrize(("true", "wrong"), [("utf_8", "cp1252"), ("utf_8", "cp1250"), ("utf_8", "mac_roman"), ("cp1252", "mac_roman")])
def test_planted_restoration(spark, true, wrong):
    rng = random.Random(8)
    clean = [" ".join(rng.choice([*NOUNS, *WORDS]) for _ in range(40)) for _ in range(120)]
    found, exact, false = restoration(spark, clean, lambda t: t.encode(true, "replace").decode(wrong, "replace"))
    assert found == 1 and exact >= 0.95 and false == 0


def test_planted_restoration_of_lost_characters(spark):
    rng = random.Random(9)
    clean = [" ".join(rng.choice([*NOUNS, *WORDS]) for _ in range(40)) for _ in range(120)]
    found, exact, false = restoration(spark, clean, lambda t: t.encode("cp1252").decode("utf_8", "replace"))
    assert found == 1 and exact >= 0.6 and false == 0


# -- consensus

def votes(rng, n_items=400):
    rows, truth = [], {}
    for i in range(n_items):
        a, b = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        truth[str(i)] = (a, b)
        for j in rng.choice(16, 7, replace=False):
            vote = lambda t, good: t if rng.random() < good else int(np.clip(t + rng.choice([-1, 1]), 1, 5))
            x, y = (int(rng.integers(1, 6)), vote(b, 0.8)) if j < 4 else (vote(a, 0.8), int(rng.integers(1, 6))) if j < 8 else (vote(a, 0.7), vote(b, 0.7))
            rows.append((f"r{j}", str(i), "m", x, 3, y, None))
    return rows, truth


def test_reliability_is_judged_per_dimension(spark):
    rows, truth = votes(np.random.default_rng(10))
    df = spark.createDataFrame(rows, "reviewer string, comparison_id string, model string, originality int, emotion int, imagery int, submitted_at timestamp")
    labels, judges, _ = consensus.consensus(df)
    got = {(r["item_id"], r["dimension"]): r["label"] for r in labels.collect()}
    right = np.mean([got[i, d] == t[k] for i, t in truth.items() for k, d in enumerate(("originality", "imagery"))])
    again = {(r["item_id"], r["dimension"]): r["label"] for r in consensus.consensus(df, rounds=2, min_rows=50)[0].collect()}
    more = np.mean([again[i, d] == t[k] for i, t in truth.items() for k, d in enumerate(("originality", "imagery"))])
    frame = pd.DataFrame(rows).rename(columns={1: "i", 3: "o", 5: "m"})
    mode = np.mean([frame[frame.i == i][c].mode().iloc[0] == t[k] for i, t in truth.items() for k, c in enumerate("om")])
    assert right > 0.85 and right > mode and more > mode
    accuracy = {(r["annotator"], r["dimension"]): r["accuracy"] for r in judges.collect()}
    assert max(accuracy[f"r{j}", "originality"] for j in range(4)) < 0.3 < min(accuracy[f"r{j}", "imagery"] for j in range(4))


def test_salted_votes_give_the_same_labels(spark):
    rows, _ = votes(np.random.default_rng(11), 60)
    df = spark.createDataFrame(rows, "reviewer string, comparison_id string, model string, originality int, emotion int, imagery int, submitted_at timestamp").withColumn("extra", F.lit("x"))
    key = ["item_id", "dimension"]
    a, b = (consensus.consensus(df, min_rows=m)[0].select(*key, "label").toPandas().sort_values(key).values.tolist() for m in (3, 10**9))
    assert a == b


def test_habits_are_found_and_taken_out(spark):
    rng = np.random.default_rng(12)
    rows, truth = [], {}
    for i in range(300):
        t = int(rng.integers(1, 6))
        truth[str(i)] = t
        for j in rng.choice(12, 6, replace=False):
            v = t if rng.random() < 0.85 else int(np.clip(t + rng.choice([-1, 1]), 1, 5))
            v = 6 - v if j < 3 else min(v + 1, 5) if j == 3 else 4 if j == 4 else v
            rows.append((f"r{j}", str(i), "m", v, 3, v, None))
    df = spark.createDataFrame(rows, "reviewer string, comparison_id string, model string, originality int, emotion int, imagery int, submitted_at timestamp")
    labels, judges, _ = consensus.consensus(df)
    assert np.mean([truth[r["item_id"]] == r["label"] for r in labels.collect()]) > 0.93
    found = {r["annotator"]: (r["turned"], r["shift"]) for r in judges.where("dimension = 'imagery'").collect()}
    assert found == {f"r{j}": (j < 3, int(j == 3)) for j in range(12)}
