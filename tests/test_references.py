import datetime as dt

from verseframe.operators import hierarchy as H, references as R

DAY = lambda n: dt.datetime(2024, 1, n)
SCHEMA = "record_no long, id string, parents array<string>, recorded_at timestamp_ntz, deleted_at timestamp_ntz, reason string, _key string"


def people(spark, rows):
    """rows: record_no, id, parents, day, deleted day; two columns have names the operators use themselves."""
    return spark.createDataFrame([(n, i, p, DAY(d), DAY(x) if x else None, "own", "own") for n, i, p, d, x in rows], SCHEMA)


def orphans(spark, rows, **kw):
    df = people(spark, rows)
    return {(r["record_no"], r["ref_id"], r["reason"]) for r in R.orphan_references(R.references(df, "family", "parents"), R.validity(df), **kw).collect()}


ROWS = [
    (1, "ada-1", None, 1, None), (2, " BEN-1 ", ["ada-1, gone-9", None, " ", "ADA-1"], 2, None), (3, "cam-2", ["ben-1", "dead-3", "late-4"], 3, None),
    (4, "dead-3", [], 1, None), (5, "dead-3", [], 2, 3), (6, "late-4", [], 9, None), (6, "late-4", [], 9, None), (7, None, ["late-4"], 10, None), (8, "", ["x-1"], 1, None),
]
WANT = {(2, "gone-9", "missing"), (3, "dead-3", "deleted"), (3, "late-4", "late"), (8, "x-1", "missing")}


def test_reasons(spark):
    assert orphans(spark, ROWS) == WANT


def test_hot_keys_are_salted_without_change(spark):
    rows = ROWS + [(100 + i, f"k-{i}", ["late-4"], 1 + i % 12, None) for i in range(60)]
    assert orphans(spark, rows, min_rows=5) == orphans(spark, rows)


def test_empty_and_null_dates(spark):
    assert orphans(spark, []) == set()
    df = people(spark, ROWS).withColumn("recorded_at", R.F.lit(None).cast("timestamp_ntz"))
    got = {r["reason"] for r in R.orphan_references(R.references(df, "family", "parents"), R.validity(df)).collect()}
    assert "late" not in got and "missing" in got


def test_report_counts(spark):
    df = people(spark, ROWS)
    rep = R.orphan_report(R.orphan_references(R.references(df, "family", "parents"), R.validity(df))).collect()
    assert sum(r["n_references"] for r in rep) == 4 and {r["month"] for r in rep} == {"2024-01"}


def brute(parent):
    out = {}
    for x in parent:
        seen, at = [x], x
        while parent[at] is not None and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        if parent[at] is None:
            out[x] = (at, len(seen) - 1)
        else:
            out[x] = (min(seen[seen.index(parent[at]) :]), -1)
    return out


def test_lines_circles_and_depth(spark):
    parent = {f"n{i:03d}": f"n{i - 1:03d}" if i else None for i in range(70)}
    parent |= {"c1": "c2", "c2": "c3", "c3": "c1", "d1": "c2", "d2": "d1", "self": "self", "lone": None}
    parent |= {f"s{i}": "n010" for i in range(40)}
    rows = [(k, i, [p] if p else [], 1, None) for k, (i, p) in enumerate(parent.items())]
    got = {r["id"]: (r["root_id"], r["depth"]) for r in H.hierarchy(people(spark, rows), min_rows=10).collect()}
    assert got == brute(parent)
    paths = {r["id"]: r["path"] for r in H.hierarchy(people(spark, rows), with_path=True).collect()}
    assert paths["n005"] == [f"n{i:03d}" for i in range(6)] and paths["c1"] is None and paths["lone"] == ["lone"]
    assert {(r["circle"], r["id"]) for r in H.circles(people(spark, rows)).collect()} == {("c1", "c1"), ("c1", "c2"), ("c1", "c3"), ("self", "self")}
    below = H.descendants(H.hierarchy(people(spark, rows), with_path=True))
    assert below.where("ancestor = 'n010'").count() == 59 + 40


def test_versions_deleted_and_unknown_parents(spark):
    rows = [(1, "a", ["old"], 1, None), (2, "a", ["gone", "b"], 2, None), (3, "b", None, 1, None), (4, "gone", [], 1, 2), (5, None, ["a"], 1, None)]
    got = {r["id"]: (r["root_id"], r["depth"]) for r in H.hierarchy(people(spark, rows)).collect()}
    assert got == {"a": ("b", 1), "b": ("b", 0)}
    assert H.hierarchy(people(spark, [])).count() == 0 and H.circles(people(spark, [])).count() == 0
