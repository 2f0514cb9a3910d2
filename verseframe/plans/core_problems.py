"""Queries and SQL of problems 2 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verseframe.operators import hierarchy as H, references as R
from verseframe.sources import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    family = table(spark, d, "family")
    refs = R.references(family, "family", "parents").unionByName(R.references(table(spark, d, "family_table"), "family_table", "children"))
    return R.orphan_references(refs, R.validity(family))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("source_table", "record_no", "ref_id", "reason")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(_orphans(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(table(spark, d, "family"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(table(spark, d, "family"), with_path=True).select("id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.all_descendants(table(spark, d, "family"))


def p5_circles(spark: SparkSession, d: str) -> DataFrame:
    return H.circles(table(spark, d, "family"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_CLEAN = f"nullif(lower(trim(%s, {_BLANKS})), '')"
_IDS = f"list_filter(list_transform(flatten(list_transform(coalesce(%s, []), lambda v: string_split(coalesce(v, ''), ','))), lambda v: {_CLEAN % 'v'}), lambda v: v is not null)"

_ORPHANS = f"""
WITH valid AS (
  SELECT {_CLEAN % 'id'} AS k, min(recorded_at) AS first_at, arg_max(CASE WHEN deleted_at IS NULL THEN 0 ELSE 1 END, (recorded_at, record_no)) AS gone
  FROM family GROUP BY 1),
refs AS (
  SELECT 'family' AS source_table, record_no, recorded_at, unnest({_IDS % 'parents'}) AS ref_id FROM family
  UNION ALL SELECT 'family_table', record_no, recorded_at, unnest({_IDS % 'children'}) FROM family_table),
one AS (SELECT source_table, record_no, ref_id, min(recorded_at) AS recorded_at FROM refs GROUP BY ALL),
orphans AS (
  SELECT source_table, record_no, ref_id, one.recorded_at AS ref_at,
    CASE WHEN k IS NULL THEN 'missing' WHEN gone = 1 THEN 'deleted' WHEN first_at > one.recorded_at THEN 'late' END AS reason
  FROM one LEFT JOIN valid ON ref_id = k)
"""

_NODES = f"""
WITH RECURSIVE versions AS (
  SELECT {_CLEAN % 'id'} AS id, arg_max({{'gone': deleted_at IS NOT NULL, 'links': {_IDS % 'parents'}}}, (recorded_at, record_no)) AS v
  FROM family GROUP BY 1),
cur AS (SELECT id, v.links AS links FROM versions WHERE id IS NOT NULL AND NOT v.gone),
links AS (SELECT id AS child, unnest(links) AS p, generate_subscripts(links, 1) AS pos FROM cur),
par AS (SELECT child, arg_min(p, pos) AS parent FROM links JOIN cur ON cur.id = p GROUP BY child),
nodes AS (SELECT id, parent FROM cur LEFT JOIN par ON child = id),
down AS (
  SELECT id, id AS root_id, 0::BIGINT AS depth, id::VARCHAR AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.id, d.root_id, d.depth + 1, d.path || '/' || n.id FROM nodes n JOIN down d ON n.parent = d.id),
stuck AS (SELECT n.id, n.parent FROM nodes n ANTI JOIN down USING (id)),
walk AS (
  SELECT id AS start, parent AS stop FROM stuck
  UNION SELECT w.start, s.parent FROM walk w JOIN stuck s ON s.id = w.stop),
ring AS (SELECT start AS id FROM walk WHERE start = stop),
ring_name AS (SELECT w.start AS id, min(w.stop) AS root_id FROM walk w JOIN ring ON ring.id = w.stop GROUP BY w.start)
"""

ORACLE = {
    "p2_found": _ORPHANS + "SELECT source_table, record_no, ref_id, reason FROM orphans WHERE reason IS NOT NULL",
    "p2_report": _ORPHANS + "SELECT source_table, strftime(ref_at, '%Y-%m') AS month, reason, count(*) AS n_references, count(DISTINCT record_no) AS n_records FROM orphans WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": _NODES + "SELECT id, root_id, depth FROM down UNION ALL SELECT id, root_id, -1 FROM ring_name",
    "p5_paths": _NODES + "SELECT id, root_id, depth, path FROM down UNION ALL SELECT id, root_id, -1, NULL FROM ring_name",
    "p5_descendants": _NODES + """, pairs AS (SELECT string_split(path, '/') AS p, id AS descendant, depth FROM down WHERE depth > 0),
up AS (
  SELECT id AS start, parent AS stop, 1::BIGINT AS distance, [parent] AS seen FROM stuck
  UNION ALL SELECT u.start, s.parent, u.distance + 1, list_append(u.seen, s.parent) FROM up u JOIN stuck s ON s.id = u.stop WHERE NOT list_contains(u.seen, s.parent))
SELECT unnest(p[1:depth]) AS ancestor, descendant, unnest(range(depth, 0, -1)) AS distance FROM pairs UNION ALL SELECT stop, start, distance FROM up""",
    "p5_circles": _NODES + "SELECT root_id AS circle, id FROM ring_name SEMI JOIN ring USING (id)",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_report, p5_found, p5_paths, p5_descendants, p5_circles)}
