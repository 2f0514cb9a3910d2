import math

import pytest
from pyspark.sql import functions as F

from verseframe.operators import corpus as C, metrics as M, people as P, prosody as S, reviews as R, sampling as A


def test_kappa_golden(spark):
    pairs = spark.createDataFrame([("p", 1, 1), ("p", 2, 2), ("p", 3, 5)], "k string, a int, b int")
    r = R.cohen_kappa(pairs, ["k"]).first()
    assert r["kappa"] == pytest.approx(4 / 7) and r["exact_match"] == pytest.approx(2 / 3)
    same = spark.createDataFrame([("p", 2, 2)] * 3, "k string, a int, b int")
    assert R.cohen_kappa(same, ["k"]).first()["kappa"] == 1


def test_pair_counts_and_keep_last(spark):
    votes = spark.createDataFrame([("x", "b", 1, 1), ("x", "a", 2, 1), ("x", "a", 3, 2), ("y", "a", 1, 1)], "item string, reviewer string, score int, at int")
    last = R.keep_last(votes, ["item", "reviewer"], ["at"], ["score"])
    got = {tuple(r) for r in R.reviewer_pair_counts(last, "item", "reviewer", "score").collect()}
    assert got == {("a", "b", 3, 1, 1)}


def test_kl_and_novelty(spark):
    a = spark.createDataFrame([("x", 1), ("y", 3)], "token string, n long")
    assert M.token_shift(a, a).first()["kl"] == pytest.approx(0, abs=1e-9)
    assert M.token_shift(a, a.limit(0)).first()["kl"] == 0
    b = spark.createDataFrame([("x", 2), ("y", 2)], "token string, n long")
    want = 0.5 * math.log(0.5 / 0.25) + 0.5 * math.log(0.5 / 0.75)
    assert M.token_shift(a, b).first()["kl"] == pytest.approx(want)
    docs = spark.createDataFrame([(1, "Moon moon sea"), (2, ""), (3, None)], "id int, text string")
    known = spark.createDataFrame([("moon",)], "token string")
    got = {r["id"]: (r["n_words"], r["lexical_novelty"]) for r in M.lexical_novelty(docs, "id", "text", known, min_rows=1).collect()}
    assert got[1] == (3, pytest.approx(1 / 3)) and got[2] == (0, 0) and got[3] == (0, 0)


def test_blocks(spark):
    t = F.split(F.lit("0 1 2 3 4 5 6 7 8 9"), " ")
    r = spark.range(1).select(C.sliding_blocks(t, 4).alias("s"), C.fixed_blocks(t, 4).alias("f"), C.sliding_blocks(F.slice(t, 1, 3), 4).alias("e"), C.fixed_blocks(F.slice(t, 1, 3), 4).alias("g")).first()
    assert [b[0] for b in r["s"]] == ["0", "2", "4", "6"] and [b[0] for b in r["f"]] == ["0", "4"] and r["e"] == [] and r["g"] == []


def test_chunks_cover_every_unit():
    units = [f"u{i} " + "w " * (i % 9) for i in range(60)]
    size = lambda s: len(s.split())
    chunks = C.pack_units(units, [size(u) for u in units], 20, 30, 60, 0.15, size)
    assert all(any(u.strip() in c for c in chunks) for u in units) and max(map(size, chunks)) <= 30
    assert C.pack_units([], [], 20, 30, 60, 0.15, size) == []


def test_titles_and_splitters(spark):
    df = spark.createDataFrame([(1, "SONG ONE\na line here.\nSONG ONE\nSONG ONE"), (2, None), (3, "")], "id int, text string")
    assert {r["id"]: r["body"] for r in C.without_repeated_titles(df, "id", "text").collect()} == {1: "a line here.", 3: ""}
    r = spark.range(1).select(C.sentences(F.lit("One. Two; three")).alias("s"), C.paragraphs(F.lit("a\n\n\nb\n")).alias("p"), C.stanza_groups(F.lit("a\n\nb\n\nc")).alias("g")).first()
    assert r["s"] == ["One.", "Two;", "three"] and r["p"] == ["a", "b"] and r["g"] == ["a\n\nb", "c"]
    assert C.evenly_spaced(10, 4) == [0, 3, 6, 9] and C.evenly_spaced(0, 3) == []


def test_haiku_count_and_meter(spark):
    rows = [(1, i, f"five {i}", 5) for i in range(3)] + [(1, 9, "seven", 7)]
    assert S.haiku(spark.createDataFrame(rows, "k int, pos int, phrase string, syllables int"), "k").count() == 6
    got = {r["s"]: r["m"] for r in spark.createDataFrame([(s,) for s in ("0101010101", "1001010101", "1010100101", "0111010101", "0201010101", "01")], "s string").select("s", S.meter("s").alias("m")).collect()}
    assert got == {"0101010101": "strict", "1001010101": "substituted", "1010100101": None, "0111010101": None, "0201010101": "strict", "01": None}
    key = spark.range(1).select(S.rhyme_key(F.array(*map(F.lit, ["R", "IH1", "V", "ER0"]))).alias("k"), S.rhyme_key(F.array(F.lit("R"))).alias("n")).first()
    assert key["k"] == "IH1 V ER0" and key["n"] is None


def test_people(spark):
    cols = "id string, name string, spouse string, parents array<string>, children array<string>, birthYear int, deathYear int, father string, mother string"
    rows = [("ada-1", "Ada", "Ben", None, ["cam-2", "dot-3"], 1900, 1890, None, None), ("ben-1", "Ben", "Ada", [], None, None, None, None, None), ("cam-2", "Cam", None, ["ben-1", "nobody"], None, 1930, None, None, None), ("dot-3", "ada ", "Dot", None, None, None, None, None, None)]
    people = spark.createDataFrame(rows, cols)
    links = P.edges(people)
    assert {tuple(r) for r in links.select("parent", "child").collect()} == {("ada-1", "cam-2"), ("ada-1", "dot-3"), ("ben-1", "cam-2")}
    assert {tuple(r) for r in P.siblings(links).collect()} == {("cam-2", "dot-3"), ("dot-3", "cam-2")}
    assert {tuple(r) for r in P.violations(people).collect()} >= {("ada-1", "death_before_birth"), ("ada-1", "duplicate_name"), ("dot-3", "duplicate_name"), ("cam-2", "unknown_parent")}
    tree = {(r["root"], r["path"]) for r in P.forest(people, links).collect()}
    assert tree == {("ada-1", "ada-1"), ("ada-1", "ada-1/cam-2"), ("ada-1", "ada-1/dot-3"), ("ben-1", "ben-1"), ("ben-1", "ben-1/cam-2")}
    done = {r["id"]: r for r in P.upsert(people.where("id <> 'dot-3'"), spark.createDataFrame([("ben-1", "Benno", "Ada", [], "", "")], "id string, name string, spouse string, parents array<string>, father string, mother string")).collect()}
    assert done["ada-1"]["spouse"] == "Benno" and done["cam-2"]["father"] == "Benno" and done["cam-2"]["mother"] == ""
    loop = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a")], "parent string, child string")
    ids = spark.createDataFrame([("r",), ("a",), ("b",)], "id string")
    assert {r["path"] for r in P.forest(ids, loop).collect()} == {"r", "r/a", "r/a/b", "r/a/b/a"}


def test_next_item(spark):
    items = spark.createDataFrame([("a", 10), ("b", 200_005), ("c", 300_001)], "id string, o long")
    results = spark.createDataFrame([("Ada", "a"), ("ada ", "b"), ("Ben", "b"), ("Eve", "a"), ("Eve", "b"), ("Eve", "c")], "reviewer string, id string")
    got = {r["reviewer"]: r["id"] for r in R.next_item(items, results, results.select("reviewer").union(spark.createDataFrame([("New",)], "reviewer string")), "o").collect()}
    assert got == {"ada": "c", "ben": "a", "eve": None, "new": "a"}


def test_sampling_is_stable(spark):
    df = spark.range(1000)
    a = {r[0] for r in A.sample(df, 50, "id").collect()}
    assert len(a) == 50 and a == {r[0] for r in A.sample(df.repartition(7), 50, "id").collect()} and A.sample(df, 0, "id").count() == 1000
    n = A.split(df, "id").where("part = 'test'").count()
    assert 60 < n < 140
    assert A.unique_ids(spark, 20).distinct().count() == 20
    with pytest.raises(ValueError):
        A.unique_ids(spark, 20, 1, 5)
    text = "a b c d e f\ng h i j k l\nm n"
    got = [r[0] for r in df.select(A.augment(F.lit(text), "id").alias("x")).collect()]
    assert sum(g == text for g in got) > 500 and all(len(g.split("\n")) == 3 for g in got)
