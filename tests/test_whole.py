"""Queries that once did less than the whole job, on small tables."""

import datetime as dt
import random
import re

import pytest

from verseframe.functions import fixed as K
from verseframe.operators import metrics, prosody
from verseframe.plans import core_problems, people_queries, review_queries, stream_queries


def test_relation_lists_of_any_number(spark, tmp_path):
    rows = [(1, ["b, a", None, " c ", "a"]), (2, ["x"]), (3, None), (4, []), (5, [" ", "y,x", "z"]), (5, [" ", "y,x", "z"])]
    spark.createDataFrame(rows, "record_no long, parents array<string>").write.parquet(str(tmp_path / "family.parquet"))
    got = sorted(tuple(r) for r in people_queries.relation_lists(spark, str(tmp_path)).collect())
    assert got == [(1, "a|b|c"), (2, "x"), (3, ""), (4, ""), (5, "x|y|z")]


def test_descendants_on_and_below_circles(spark, tmp_path):
    parent = {"r": None, "s": "r", "t": "s", "u": "s", "c5": "c1", "c1": "c3", "c3": "c9", "c9": "c5", "d1": "c1", "d2": "d1", "d3": "d2", "e1": "c9", "e2": "e1", "self": "self", "kid": "self", "x": "y", "y": "x"}
    rows = [(n, i, [p] if p else [], dt.datetime(2024, 1, 1), None) for n, (i, p) in enumerate(parent.items())]
    spark.createDataFrame(rows, "record_no long, id string, parents array<string>, recorded_at timestamp_ntz, deleted_at timestamp_ntz").write.parquet(str(tmp_path / "family.parquet"))
    want = []
    for person in parent:
        up, steps, seen = parent[person], 1, set()
        while up is not None and up not in seen:
            seen.add(up)
            want.append((up, person, steps))
            up, steps = parent[up], steps + 1
    got = [tuple(r) for r in core_problems.p5_descendants(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def sanitized(text):
    t = re.sub(K.THINK_BLOCK, "", text)
    t = re.sub(K.THINK_CLOSE, "", re.sub(r"(?is)<think\b[^>]*>.*", "", t)).strip()
    lines = t.splitlines()
    for i, line in enumerate(lines):
        if re.match(K.FINAL_MARK, line):
            return "\n".join(x for x in (re.sub(K.FINAL_MARK, "", line, count=1).strip(), "\n".join(lines[i + 1 :]).strip()) if x)
    out, drop, saw = [], False, False
    for line in lines:
        s = line.strip()
        header = bool(re.match(K.THINK_HEADER, s))
        looks = header or re.match(K.REASON_META, s) or (re.match(K.REASON_LIST, s) and re.search(K.REASON_WORD, s))
        if not s:
            out += [""] if out and not drop else []
        elif header or (looks and (drop or not saw)):
            drop = saw = True
        else:
            out.append(s if drop else line.rstrip())
            drop = False
    seen = "\n".join(out).strip()
    return "" if re.search(K.LINGERING, seen) else seen


def test_reasoning_is_stripped_from_every_poem(spark, tmp_path):
    poems = [
        "Rain falls.\nOn roofs.", "  Rain \t\n\n\n\nfalls\t\n ", "<think>the plan\n1. x</think>\nRain.", "Rain.<think>still thinking", "</think>Rain.", "<think></think>", "Thinking Process:\n1. the user asks\n- a step\n  Rain.  \n  Falls.",
        "Let me see\n\nRain.\n1. the answer", "1. rain\n2. snow\n- hail", "Final Answer: Rain.\n\nSnow.", "Sky.\nanswer:\nRain.\r\nSnow.", "Rain thinking process: lingers", "The user wants rain\nRain.", "Rain.\n- I need a step\nSnow.", "Reasoning: a\nReasoning: b", None,
    ]
    spark.createDataFrame([(i, "p", p) for i, p in enumerate(poems)], "row_id long, prompt string, poem string").write.parquet(str(tmp_path / "outputs_flat.parquet"))
    got = {r["row_id"]: r["response"] for r in stream_queries.reasoning_stripped(spark, str(tmp_path)).collect()}
    assert got == {i: s for i, p in enumerate(poems) if p is not None and (s := sanitized(p))}


def test_adjacent_distance_of_all_neighbours(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i * 7 % 2003, 1 if i % 4 else 2, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(900)] + [(5000, 3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {}
    for label in (1, 2, 3):
        v = [x for _, k, x in sorted(rows) if k == label]
        d = [1 - sum(p * q for p, q in zip(a, b)) for a, b in zip(v, v[1:])]
        want[label] = (len(d), pytest.approx(sum(d) / max(len(d), 1), abs=2e-6))
    assert {r["label"]: r["distance"] for r in review_queries.adjacent_distance_by_label(spark, str(tmp_path)).collect()} == {k: x for k, (_, x) in want.items()}
    assert {r["label"]: (r["n"], r["distance"]) for r in metrics.adjacent_distance(df, "label", "vec_id", "embedding", span=50).collect()} == want


def test_complement_triples(spark):
    rng = random.Random(4)
    rows = [(d, i, f"d{d} p{i}", rng.randrange(0, 12)) for d in range(3) for i in range(70 * d)]
    got = [tuple(r) for r in prosody.complement_triples(spark.createDataFrame(rows, "k int, pos int, phrase string, syllables int"), "k").select("k", "first", "second", "third").collect()]
    want = []
    for d in range(3):
        mine = [r for r in rows if r[0] == d]
        for _, _, first, n in sorted((r for r in mine if r[3] < 10), key=lambda r: -r[3])[:50]:
            for two in range(2, 10 - n - 1):
                seconds, thirds = ([r[2] for r in mine if r[3] == s][:10] for s in (two, 10 - n - two))
                want += [(d, first, b, c) for b in seconds for c in thirds]
    assert want and sorted(got) == sorted(want)
