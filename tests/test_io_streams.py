import json

import pytest
from pyspark.sql import functions as F

from verseframe import sources
from verseframe.sources import sinks
from verseframe.streaming import channels as C, sessions as Z


def test_readers(spark, tmp_path):
    (tmp_path / "b.txt").write_text(" two \n\n\tthree\n")
    (tmp_path / "a.txt").write_bytes(b"one\xff\n")
    assert sorted(r["line"] for r in sources.read_lines(spark, str(tmp_path)).collect()) == ["one�", "three", "two"]
    assert sources.read_lines(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    assert sources.read_documents(spark, str(tmp_path)).count() == 2
    assert [tuple(r) for r in sources.read_prompts(spark, str(tmp_path / "b.txt")).collect()] == [("0", "two"), ("1", "three")]
    (tmp_path / "p.json").write_text(json.dumps({"prompts": ["x", {"text": "y", "prompt": "", "uid": 7}, " ", {"input": "z"}]}))
    assert {tuple(r) for r in sources.read_prompts(spark, str(tmp_path / "p.json")).collect()} == {("0", "x"), ("7", "y"), ("3", "z")}
    (tmp_path / "r.json").write_text(json.dumps([{"id": 1, "reviewer": " ", "originality": "3.7", "emotion": 2}, {"poem_id": "q", "comparison_id": 9, "model": "m", "imagery": 3.7}]))
    r = sources.read_results(spark, str(tmp_path / "r.json")).orderBy("position").collect()
    assert (r[0]["reviewer"], r[0]["model"], r[0]["originality"], r[1]["comparison_id"]) == ("reviewer_1", "unknown-model", 3.7, "q")
    (tmp_path / "o.json").write_text(json.dumps([{"id": 1, "prompt": "p", "outputs": [{"model": "a", "poem": "x"}, {"model": "b", "poem": "y"}, {"model": "c", "poem": "z"}]}, {"id": 2, "prompt": "q", "outputs": [{"model": "a"}, {"model": "b", "poem": "y"}]}, 5]))
    got = sources.read_outputs(spark, [str(tmp_path / "none.json"), str(tmp_path / "o.json")])
    assert got.count() == 1 and len(got.first()["outputs"]) == 2
    (tmp_path / "t.jsonl").write_text('{"text": "a"}\n\n{"text": "b"}\n')
    assert sources.read_jsonl(spark, str(tmp_path / "t.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"text": " "}\n')
    with pytest.raises(ValueError):
        sources.read_jsonl(spark, str(tmp_path / "bad.jsonl"))


def test_people_file(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"id": "ada-1", "name": "Ada", "parents": "x, y, x", "note": "n"}, {"id": "ben-1", "children": ["c"]}]))
    a, b = sources.read_people(spark, str(tmp_path / "f.json")).orderBy("position").collect()
    assert a["parents"] == ["x", "y"] and a["extra"] == {"note": "n"} and b["children"] == ["c"]
    (tmp_path / "g.json").write_text(json.dumps([{"id": "a"}, {"id": "a"}]))
    with pytest.raises(ValueError):
        sources.read_people(spark, str(tmp_path / "g.json"))


def test_env():
    assert sources.expand_env({"a": ["${X}-${Y:-d}", 1]}, {"X": "v", "Y": " "}) == {"a": ["v-d", 1]}
    with pytest.raises(ValueError):
        sources.expand_env("${Z}", {})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 1.5)], "a string, b string, value double")
    assert spark.read.option("header", True).csv(sinks.write_csv(df, str(tmp_path / "out" / "x.csv"), "L")).count() == 1
    assert sinks.write_summary(df.select(F.lit(float("nan")).alias("m")), str(tmp_path / "s.json")) == {"m": None}
    sinks.write_report(df, str(tmp_path / "rep"))
    assert spark.read.text(str(tmp_path / "rep")).first()[0] == "token_distribution_shift a->b: 1.500000"
    for _ in range(2):
        sinks.replace_table(df, str(tmp_path / "t"))
        sinks.append_results(df, str(tmp_path / "r"))
    assert (tmp_path / "t.bak").exists() and not (tmp_path / "t.tmp").exists() and spark.read.parquet(str(tmp_path / "r")).count() == 2


@pytest.mark.parametrize(
    ("chunks", "want"),
    [(["<thi", "nk>thought\nx</thi", "nk>\nRain."], ("x", "\nRain.")), (["Rain falls on every single roof here", " now"], ("", "Rain falls on every single roof here now")), (["Rain."], ("", "Rain.")), (["<think>x"], ("x", "")), (["y</think>z"], ("", "z")), ([], ("", ""))],
)
def test_channel(chunks, want):
    c = C.Channel()
    for x in chunks:
        c.feed(x)
    assert c.finish() == want


def test_batch_streams(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["<thi", "nk>x</thi", "nk>\nRain."])] + [(2, 0, None)], "k int, pos int, t string")
    assert [tuple(r) for r in C.sanitised(rows, "k", "pos", "t").collect()] == [(1, "Rain.")]
    assert {r["k"]: r["response"] for r in C.channels(rows, "k", "pos", "t").collect()} == {1: "Rain.", 2: ""}
    frames = C.event_frames(rows, "k", "pos", "t").where("k = 2").orderBy("frame_no").collect()
    assert "error" in frames[0]["frame"] and "done" in frames[1]["frame"]


def test_sessions_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([("u", f"2024-01-01 00:00:{s:02d}", w) for s, w in ((1, "the river"), (2, "runs over stones"), (20, "uh"))] + [(None, "2024-01-01 00:00:01", "x")], "u string, at string, t string").withColumn("at", F.col("at").cast("timestamp"))
    want = {(r["utterance"], r["substantial"]) for r in Z.utterances(events, "u", "at", "t").collect()}
    assert want == {("the river runs over stones", True), ("uh", False)}
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = Z.utterances(stream, "u", "at", "t").writeStream.format("memory").queryName("said").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert {(r["utterance"], r["substantial"]) for r in spark.table("said").collect()} == want
