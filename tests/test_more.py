"""Messages, streams, people, readers and searches against plain Python."""

import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verseframe.functions import fixed as K, messages as G, text as T
from verseframe.operators import corpus, metrics, people, reviews, sampling
from verseframe.sources import files, sinks
from verseframe.streaming import channels, sessions


def test_hash_sample_is_exact_and_whole(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 3).cast("string").alias("g"), F.lit(1).alias("_h2"))
    got = sampling.hash_sample(df.unionByName(df), 100, "id")
    order = df.select("id", F.xxhash64(F.lit(42), "id").alias("h")).orderBy("h").limit(100).collect()
    assert [r["id"] for r in got] == [r["id"] for r in order]
    per = sampling.hash_sample(df, 40, "id", by="g")
    assert len(per) == 120 and {r["g"] for r in per} == {"0", "1", "2"}
    assert sampling.hash_sample(df.limit(0), 5, "id") == [] and len(sampling.hash_sample(df.limit(3), 50, "id")) == 3
    nulls = spark.createDataFrame([(None, None), (1, "a")], "id long, text string")
    assert len(sampling.hash_sample(nulls, 5, "id", by="text")) == 2


def test_content_text(spark):
    cases = {
        '"  said "': "said", '[{"type":"text","text":" a "},"b",{"type":"image","text":"no"},{"type":"text"}," "]': "a\nb", "[]": "", '{"x":1}': '{"x":1}', "plain words": "plain words", None: None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = {r["i"]: r["t"] for r in df.select("i", G.content_text("c").alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_messages_and_templates(spark):
    df = spark.createDataFrame([(1, [("hi", "yo")], "more", "be brief"), (2, [], "ask", ""), (3, None, "ask", None)], "i int, h array<struct<user:string,assistant:string>>, u string, s string")
    own = {r["i"]: [tuple(m) for m in r["m"]] for r in df.select("i", G.messages("h", "u", "s").alias("m")).collect()}
    assert own == {1: [("system", "be brief"), ("user", "hi"), ("assistant", "yo"), ("user", "more")], 2: [("user", "ask")], 3: [("user", "ask")]}
    put = {r["i"]: [tuple(m) for m in r["m"]] for r in df.select("i", G.messages("h", "u", "s", fold_system=True).alias("m")).collect()}
    assert put[1][-1] == ("user", "Conversation instruction:\nbe brief\n\nUser request:\nmore") and put[2] == [("user", "ask")]
    text = {r["i"]: (r["a"], r["b"]) for r in df.select("i", G.render(G.messages("h", "u", "s"), "turns", thinking=True).alias("a"), G.render(G.messages("h", "u", "s")).alias("b")).collect()}
    assert text[1][0] == "<|turn>system\n<|think|>be brief<turn|>\n<|turn>user\nhi<turn|>\n<|turn>model\nyo<turn|>\n<|turn>user\nmore<turn|>\n<|turn>model\n"
    assert text[2] == ("<|turn>system\n<|think|><turn|>\n<|turn>user\nask<turn|>\n<|turn>model\n", "<|im_start|>user\nask<|im_end|>\n<|im_start|>assistant\n")


def test_oversized_units_are_split(spark):
    size = lambda s: len(s.split())
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join(rng.choice(["word", "end.", "line\n", "so;"]) for _ in range(rng.randrange(1, 400))).strip()
        parts = corpus.split_unit(text, 30, size)
        assert all(0 < size(p) <= 30 for p in parts) and " ".join(parts).split() == text.split()
    assert corpus.split_unit("a b c", 2, size) == ["a b", "c"] and corpus.split_unit(" ", 2, size) == [] and corpus.split_unit("short one", 9, size) == ["short one"]
    df = spark.createDataFrame([(1, "w " * 5000), (2, None), (3, ""), (4, "x.\n\ny.")], "k int, text string")
    got = corpus.packed_chunks(df, "k", "text").toPandas()
    assert got.n_tokens.max() <= 2000 and got[got.k == 1].chunk.str.split().str.len().sum() >= 5000 and set(got.k) == {1, 4}


def test_prepared_samples(spark):
    df = spark.createDataFrame([(i, "a line of words, and more.\n" * 30) for i in range(40)] + [(99, None)], "k int, text string")
    got = corpus.prepared_samples(df, "k", "text", fragments=("And I saw,",), begin="<bos>").toPandas()
    assert got.text.str.startswith("<bos>").all() and 0 < got.text.str.startswith("<bos>And I saw,").mean() < 0.5 and 99 not in set(got.k)


def test_encoders_and_batches(spark):
    class Hashing:
        def encode(self, texts, normalize_embeddings=False):
            out = np.array([[len(t), 1.0, sum(map(ord, t)) % 7] for t in texts], dtype=float)
            return out / np.linalg.norm(out, axis=1, keepdims=True) if normalize_embeddings else out

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "ab")], "k int, text string")
    got = {r["k"]: r["embedding"] for r in corpus.embedded(df, "text", Hashing).collect()}
    assert got[2] is None and got[1] == got[4] == pytest.approx(Hashing().encode(["ab"], True)[0].tolist(), abs=1e-6)
    twice = corpus.batched_map(df.where("text is not null"), lambda b: {"k": [x * 2 for x in b["k"]], "n": [len(b["k"])] * len(b["k"])}, "k int, n int", batch_size=1)
    assert sorted(map(tuple, twice.collect())) == [(2, 1), (6, 1), (8, 1)]


def test_nearest_by_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 5)).round(1)
    rows = [(i, v[i].tolist() if i != 7 else None) for i in range(300)] + [(300, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r[0]: (r[1], r[2]) for r in metrics.nearest(df.where("vec_id % 10 = 3 or vec_id = 7"), df, "vec_id", "embedding", block=50, chunk=64).collect()}
    for i in [*range(3, 300, 10), 7]:
        best = max(((0.5 if a is None or rows[i][1] is None else round(float(np.dot(a, rows[i][1]) / (np.linalg.norm(a) * np.linalg.norm(rows[i][1]) + 1e-10)), 6)), -j) for j, a in rows if j != i)
        assert got[i] == (-best[1], pytest.approx(best[0]))
    assert metrics.nearest(df.limit(0), df, "vec_id", "embedding").count() == 0


def test_pairs_of_reviewers_of_a_hot_item(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), f"r{rng.randrange(40)}", rng.randrange(1, 4)) for _ in range(400)] + [("b", None, 1)]
    df = spark.createDataFrame(rows, "item string, who string, score int")
    want = {}
    for i, r, s in set(rows):
        for j, q, t in set(rows):
            if i == j and r and q and r < q:
                want[r, q, s, t] = want.get((r, q, s, t), 0) + 1
    for least in (10, 10**9):
        got = {tuple(r)[:4]: r["n"] for r in reviews.reviewer_pair_counts(df, "item", "who", "score", blocks=4, min_rows=least).collect()}
        assert got == want


def test_token_shifts_equal_one_by_one(spark):
    base = spark.createDataFrame([("a", 3), ("b", 1), ("c", 5)], "token string, n long")
    tuned = spark.createDataFrame([("x", "a", 2), ("x", "d", 1), ("y", "c", 4)], "k string, token string, n long")
    got = {r["k"]: r["kl"] for r in metrics.token_shifts(base, tuned, "k").collect()}
    want = {k: metrics.token_shift(base, tuned.where(F.col("k") == k).select("token", "n")).first()["kl"] for k in "xy"}
    assert got == pytest.approx(want)
    assert {r["kl"] for r in metrics.token_shifts(base.limit(0), tuned, "k").collect()} == {0.0}


def test_ngrams_and_blocks_of_long_texts(spark):
    words = [f"w{i % 997}" for i in range(30000)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    w = T.split_words("text")
    r = df.select(F.size(T.ngrams(w, 2)).alias("g"), F.size(corpus.sliding_blocks(w, 64)).alias("s"), F.size(corpus.fixed_blocks(w, 64)).alias("f")).first()
    assert (r["g"], r["s"], r["f"]) == (len(set(zip(words, words[1:]))), (30000 - 64) // 32 + 1, 30000 // 64)
    few = spark.createDataFrame([("one",), ("",), (None,)], "text string").select(T.ngrams(T.split_words("text"), 2).alias("g")).collect()
    assert [r["g"] for r in few] == [[], [], []]


def test_frequent_lines(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(12))]) for i in range(60)]
    got = {r["i"]: set(r["f"]) for r in spark.createDataFrame(rows, "i int, k array<string>").select("i", corpus.frequent(F.col("k"), 2).alias("f")).collect()}
    assert got == {i: {x for x in k if x and k.count(x) > 2} for i, k in rows}


PEOPLE = [("ada", "Ada", "Ben", []), ("ben", "Ben", "Ada", []), ("cam", "Cam", "Dot", ["ada"]), ("dot", "Dot", "Cam", []), ("eli", "Eli", "", ["ben", "dot"]), ("fay", "Fay", "", ["dot"]), ("gus", "Gus", "Hal", ["fay"]), ("hal", "Hal", "Gus", ["gus"])]


def persons(spark, rows=PEOPLE):
    return spark.createDataFrame([(i, n, s, p, [], None, None, None, None) for i, n, s, p in rows], "id string, name string, spouse string, parents array<string>, children array<string>, birthYear int, deathYear int, father string, mother string")


def test_couples_stand_once_on_a_way(spark):
    df = persons(spark)
    mate = {"ada": "ben", "ben": "ada", "cam": "dot", "dot": "cam", "gus": "hal", "hal": "gus"}
    kids = {p: {i for i, _, _, ps in PEOPLE if p in ps} for p, *_ in PEOPLE}
    want = set()

    def walk(root, i, seen, path):
        want.add((root, i, mate.get(i), len(path) - 1, "/".join(path)))
        seen = seen | {i, mate.get(i)}
        for k in (kids[i] | kids.get(mate.get(i), set())) - seen:
            walk(root, k, seen, [*path, k])

    for root in ("ada", "dot"):
        walk(root, root, set(), [root])
    got = people.couple_forest(df, people.edges(df), spark.createDataFrame([("ada",), ("dot",)], "id string"))
    assert {tuple(r) for r in got.collect()} == want


def test_forest_without_roots_is_flat(spark):
    df = persons(spark, [("a", "A", "", ["b"]), ("b", "B", "", ["a"])])
    assert {tuple(r) for r in people.forest(df, people.edges(df)).collect()} == {("a", "a", 0, "a"), ("b", "b", 0, "b")}


def test_changes_are_checked(spark):
    df = persons(spark)
    bad = persons(spark, [("ada", "Ben", "", ["nobody", "ada"]), ("New One", "N", "", []), ("zoe", "Zoe", "", []), ("zoe", "Zoe", "", [])]).withColumn("birthYear", F.lit(1900)).withColumn("deathYear", F.when(F.col("id") == "zoe", 1800))
    got = {tuple(r) for r in people.change_errors(df, bad).collect()}
    assert got == {("ada", "duplicate_name", "ben"), ("ada", "unknown_parent", "nobody"), ("ada", "own_parent", "ada"), ("New One", "bad_id", None), ("zoe", "given_twice", None), ("zoe", "death_before_birth", None)}
    with pytest.raises(ValueError, match="unknown parent nobody"):
        people.checked_upsert(df, bad)
    legacy = persons(spark, [("kim", "Kim", "", ["ghost"])])
    assert people.change_errors(legacy, persons(spark, [("kim", "Kim K", "", ["ghost"]), ("lee", "Lee", "", ["kim"])])).count() == 0
    done = {r["id"]: r for r in people.checked_upsert(df, persons(spark, [("ben", "Benno", "Ada", [])])).collect()}
    assert done["ada"]["spouse"] == "Benno" and done["eli"]["father"] == "Benno"


def frames(items, stop=(), flush="token"):
    w, out = channels.FrameWriter(stop, flush), []
    for kind, text in items:
        out += w.end(text) if kind == "error" else w.end() if kind == "done" else w.feed(text)
    return [json.loads(x.removeprefix("data: ")) for x in out]


def test_frames():
    assert frames([("token", "a"), ("token", "b "), ("done", None)]) == [{"token": "a"}, {"token": "b "}, {"done": True}]
    assert frames([("token", "a"), ("token", "b "), ("token", "c"), ("done", None)], flush="space") == [{"token": "ab "}, {"token": "c"}, {"done": True}]
    assert frames([("token", "a"), ("token", "<end>"), ("token", "late"), ("done", None)], stop=("<end>",)) == [{"token": "a"}, {"done": True}]
    assert frames([("token", ""), ("done", None)]) == [{"error": "empty generation"}, {"done": True}]
    assert frames([("token", "a"), ("error", "broke")], flush="space") == [{"token": "a"}, {"error": "broke"}, {"done": True}]
    assert len(frames([("token", "x" * 60), ("token", "y" * 60)], flush="space")) == 1


def run_stream(spark, tmp_path, build, rows, schema):
    """The stream over one file per batch of rows."""
    folder = str(tmp_path / "in")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    name = f"t{abs(hash(folder)) % 10**9}"
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_frame_stream_and_channel_stream(spark, tmp_path):
    rows = [[("r", 0, "Hel", "token"), ("s", 0, "", "token")], [("r", 1, "lo ", "token"), ("r", 2, "you", "token"), ("s", 1, "no luck", "error")], [("r", 3, None, "done")]]
    got = run_stream(spark, tmp_path / "a", lambda t: channels.frame_stream(t, "k", "n", "t", "kind", flush="space"), rows, "k string, n int, t string, kind string")
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append(json.loads(r["frame"].removeprefix("data: ")))
    assert by == {"r": [{"token": "Hello "}, {"token": "you"}, {"done": True}], "s": [{"error": "no luck"}, {"done": True}]}
    rows = [[("r", 0, "<thi", False), ("q", 0, "plain", False)], [("r", 1, "nk>why</th", False)], [("r", 2, "ink>Rain.", True), ("q", 1, " text", True)]]
    got = run_stream(spark, tmp_path / "b", lambda t: channels.channel_stream(t, "k", "n", "t", "done"), rows, "k string, n int, t string, done boolean")
    assert {tuple(r) for r in got} == {("r", "why", "Rain."), ("q", "", "plain text")}


def test_inputs_are_polled_in_order(spark):
    voice = spark.createDataFrame([("v1", "2024-01-01 00:00:00.9"), ("v2", "2024-01-01 00:00:02.1")], "text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    keys = spark.createDataFrame([("k1", "2024-01-01 00:00:00.1"), ("k2", "2024-01-01 00:00:01.1")], "text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert [r["text"] for r in sessions.merged_inputs(voice, keys, "at").orderBy("polled").collect()] == ["v1", "k1", "k2", "v2"]


def test_review_files(spark, tmp_path):
    rec = lambda **k: {"originality": 3, "emotion": 4, "imagery": 5, **k}
    items = [rec(poem_id=None, id="x", poem=" a "), rec(comparison_id="c", poem="b", reviewer=" Jo ", originality=3.7), rec(id=7, poem="", emotion="3.7"), rec(id=8, poem="d", imagery="6"), rec(id=9, poem="e", imagery=" 4 ")]
    (tmp_path / "r.json").write_text(json.dumps({"results": items}))
    a = {r["position"]: (r["comparison_id"], r["originality"]) for r in files.read_scores(spark, str(tmp_path / "r.json")).collect()}
    assert a == {0: (None, 3.0), 1: ("c", 3.7), 2: ("7", 3.0), 4: ("9", 3.0)}
    b = {r["position"]: (r["poem_key"], r["reviewer"], r["originality"], r["imagery"]) for r in files.read_scores(spark, str(tmp_path / "r.json"), by_poem=True).collect()}
    assert b == {0: ("a", "reviewer_1", 3, 5), 1: ("b", "Jo", 3, 5), 4: ("e", "reviewer_5", 3, 4)}
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        files.read_scores(spark, str(tmp_path / "none.json"))


def test_other_readers(spark, tmp_path):
    (tmp_path / "dict.txt").write_text(";;; note\nFIRE  F AY1 ER0\nFIRE(2)  F AY1 R\n\n")
    got = sorted((r["word"], tuple(r["phonemes"])) for r in files.read_pronunciations(spark, str(tmp_path / "dict.txt")).collect())
    assert got == [("fire", ("F", "AY1", "ER0")), ("fire", ("F", "AY1", "R"))]
    (tmp_path / "raw.txt").write_text(" a \n\nb")
    assert [r[0] for r in files.read_raw_lines(spark, str(tmp_path / "raw.txt")).collect()] == [" a ", "", "b"]
    (tmp_path / "pics").mkdir()
    for n in ("My-sea_view.JPG", "notes.txt", "b.png"):
        (tmp_path / "pics" / n).write_bytes(b"x")
    got = files.list_files(spark, str(tmp_path / "pics"), (".jpg", ".png")).orderBy(F.lower("name")).collect()
    assert [tuple(r) for r in got] == [("b.png", "b", "b.png", "image/png"), ("My-sea_view.JPG", "My sea view", "My-sea_view.JPG", "image/jpeg")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "i int, t string")
    assert sinks.write_json_array(df.coalesce(1), str(tmp_path / "a.json")) == 2
    assert json.loads((tmp_path / "a.json").read_text()) == [{"i": 1, "t": "é"}, {"i": 2, "t": None}]
    assert sinks.write_json_array(df.limit(0), str(tmp_path / "b.json")) == 0 and json.loads((tmp_path / "b.json").read_text()) == []
    sinks.write_jsonl(df, str(tmp_path / "lines"))
    assert sorted(files.read_raw_lines(spark, str(tmp_path / "lines")).toPandas().line) == ['{"i":1,"t":"é"}', '{"i":2,"t":null}']
    nested = spark.createDataFrame([(1, "p", [("m", "b", "x"), ("n", None, "y")])], "id int, prompt string, outputs array<struct<model:string,base_model:string,poem:string>>")
    sinks.write_pairs(nested, str(tmp_path / "pairs"))
    assert spark.read.json(str(tmp_path / "pairs/flat")).count() == 2 and spark.read.json(str(tmp_path / "pairs/nested")).count() == 1
    path = str(tmp_path / "table")
    for n in (1, 2, 3):
        sinks.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert spark.read.parquet(f"{path}.bak").count() == 2 and len(os.listdir(tmp_path / ".table.versions")) == 2
    for text in ("one", "two"):
        sinks.replace_file(text, str(tmp_path / "f.json"))
    assert (tmp_path / "f.json").read_text() == "two" and (tmp_path / "f.json.bak").read_text() == "one" and not (tmp_path / "f.json.tmp").exists()


def test_metrics_can_be_added(spark):
    metrics.register_metric("n_chars", lambda c: F.length(c).cast("double"))
    r = metrics.with_metrics(spark.createDataFrame([("abc",), (None,)], "text string"), "text", ["n_chars", "none"]).collect()
    assert [tuple(x) for x in r] == [("abc", 3.0, None), (None, None, None)]
    assert re.fullmatch(r"\d{8}_\d{6}", sinks.run_label())


def test_responses_are_cleaned_and_asked_again(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "i int, prompt string")
    first = lambda ps: ["<think>x" if p in ("b", "c") else f"<think>y</think>said {p}" for p in ps]
    retry = lambda ps: ["" if p == "c" else f"again {p}" for p in ps]
    got = {r["i"]: r["response"] for r in corpus.clean_responses(df, "prompt", first, retry).collect()}
    assert got == {1: "said a", 2: "again b", 3: K.FALLBACK, 4: "said"}
    assert {r["i"]: r["response"] for r in corpus.clean_responses(df, "prompt", first).collect()}[2] == K.FALLBACK


def test_command_line(spark, tmp_path):
    from verseframe.__main__ import main

    (tmp_path / "r.json").write_text(json.dumps([{"id": i, "model": "ab"[i % 2], "originality": 3, "emotion": 2, "imagery": i % 5 + 1} for i in range(10)]))
    main(["--out", str(tmp_path / "o1"), "reviews", str(tmp_path / "r.json")])
    assert {r["model"]: r["n_reviews"] for r in spark.read.json(str(tmp_path / "o1")).collect()} == {"a": 5, "b": 5}
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.txt").write_text("\n\n".join(f"line {i} of many, and more." for i in range(300)))
    main(["--out", str(tmp_path / "o2"), "prepare", str(tmp_path / "src"), "--target", "50", "--most", "60", "--hard", "80", "--begin", "<bos>"])
    texts = [r["text"] for r in spark.read.json(str(tmp_path / "o2")).collect()]
    assert len(texts) > 20 and all(t.startswith("<bos>") and len(t.split()) <= 80 for t in texts)
    main(["--out", str(tmp_path / "o3"), "--format", "parquet", "query", "p2_found", "/root/testdata/sf0.001"])
    assert spark.read.parquet(str(tmp_path / "o3")).columns == ["source_table", "record_no", "ref_id", "reason"]
