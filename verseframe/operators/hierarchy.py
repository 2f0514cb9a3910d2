"""Parent-child links to full hierarchies by pointer doubling (problem 5).

Every node starts with a pointer to its parent. Each round joins the pointers with themselves, which doubles
the distance they span, until they rest on roots; after r rounds lines of up to 2**r links are resolved. When a
round resolves nothing, the rest hangs on circles (in a tree some node of every smaller depth would have been
resolved). Their pointers are doubled on until the span covers the number of nodes left; they then rest on the
circle itself, and the smallest id seen on the way around is its name. Each round is written to the shared
checkpoint folder, and hot ancestors are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verseframe.operators.references import clean_id, ids_in
from verseframe.operators.skew import HOT_ROWS, salted_lookup
from verseframe.session import cut_lineage


def current_versions(people: DataFrame, key: str = "id", recorded: str = "recorded_at", deleted: str = "deleted_at", order: str = "record_no", links: str = "parents") -> DataFrame:
    """The last version of each person (ties: larger `order`) unless it is deleted: id, links (cleaned ids)."""
    rows = people.select(clean_id(F.col(key)).alias("id"), F.col(recorded).alias("_at"), F.col(order).alias("_no"), F.col(deleted).alias("_del"), ids_in(F.col(links)).alias("_links"))
    last = F.max_by(F.struct("_del", "_links"), F.struct("_at", "_no")).alias("_v")
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(last).where(F.col("_v._del").isNull()).select("id", F.col("_v._links").alias("links"))


def first_known_parent(current: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """id, parent: the first of `links` that is itself a current id, else null."""
    links = current.select(F.col("id").alias("_child"), F.posexplode("links").alias("_pos", "id"))
    known = salted_lookup(links, current.select("id"), "id", "inner", min_rows=min_rows)
    first = known.groupBy("_child").agg(F.min_by("id", "_pos").alias("parent"))
    return current.select("id").join(first, F.col("id") == F.col("_child"), "left").select("id", "parent")


def resolve_lines(nodes: DataFrame, with_path: bool = False, min_rows: int = HOT_ROWS) -> DataFrame:
    """For nodes (id unique, parent in id or null): id, root_id, depth, and path (from the root to the node) if with_path.

    On a circle or below one depth is -1, root_id the smallest id of the circle and path null. Empty input gives
    an empty result.
    """
    root = F.col("parent").isNull()
    above = F.when(root, F.array().cast("array<string>")).otherwise(F.array("parent"))
    first = nodes.select("id", F.coalesce("parent", "id").alias("anc"), F.when(root, 0).otherwise(1).cast("long").alias("dist"), root.alias("done"), F.coalesce("parent", "id").alias("low"), *[above.alias("path")] * with_path)
    state = cut_lineage(first)
    finished, open_ = [state.where("done")], state.where("not done")
    left, span, stuck = open_.count(), 1, False
    while left and not (stuck and span >= left):
        known = open_ if stuck else _union([*finished, open_])
        carry = with_path and not stuck
        right = known.select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("dist").alias("_dist"), F.col("done").alias("_done"), F.col("low").alias("_low"), *[F.col("path").alias("_path")] * carry)
        joined = salted_lookup(open_, right, "anc", "inner", min_rows=min_rows)
        step = joined.select("id", F.col("_anc").alias("anc"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done"), F.least("low", "_low").alias("low"), *[F.concat("_path", "path").alias("path")] * carry)
        step = cut_lineage(step)
        now = step.where("not done").count()
        stuck = stuck or now == left
        if not stuck:
            finished.append(step.where("done"))
        open_, left, span = step.where("not done"), now, span * 2
    trees = _union(finished).select("id", F.col("anc").alias("root_id"), F.col("dist").alias("depth"), *[F.concat("path", F.array("id")).alias("path")] * with_path)
    if not left:
        return trees
    circle = open_.select(F.col("id").alias("anc"), F.col("low").alias("_low"))
    below = salted_lookup(open_.select("id", "anc"), circle, "anc", "inner", min_rows=min_rows)
    return trees.unionByName(below.select("id", F.col("_low").alias("root_id"), F.lit(-1).cast("long").alias("depth"), *[F.lit(None).cast("array<string>").alias("path")] * with_path))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hierarchy(people: DataFrame, with_path: bool = False, min_rows: int = HOT_ROWS, **columns: str) -> DataFrame:
    """id, root_id, depth (and path) of every current person; see resolve_lines."""
    nodes = cut_lineage(first_known_parent(current_versions(people, **columns), min_rows=min_rows))
    return resolve_lines(nodes, with_path, min_rows)


def descendants(paths: DataFrame) -> DataFrame:
    """ancestor, descendant, distance for every pair on a line from a root: one row per pair, so no node holds a whole tree."""
    pairs = paths.where(F.col("depth") > 0).select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("_pos", "ancestor"))
    return pairs.where(F.col("_pos") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("_pos")).cast("long").alias("distance"))


def all_descendants(people: DataFrame, min_rows: int = HOT_ROWS, **columns: str) -> DataFrame:
    """ancestor, descendant, distance (the least) for every person and each person reachable downwards, once.

    Persons on a circle reach everyone on it, themselves too (the distance is the circle's length), and everyone below.
    """
    nodes = cut_lineage(first_known_parent(current_versions(people, **columns), min_rows=min_rows))
    lines = cut_lineage(resolve_lines(nodes, with_path=True, min_rows=min_rows))
    return descendants(lines).unionByName(_circle_descendants(nodes, lines, min_rows))


def _circle_descendants(nodes: DataFrame, lines: DataFrame, min_rows: int) -> DataFrame:
    """The pairs of persons on circles or below them.

    Each circle is cut above its smallest id, which then is the root of a tree; the path of that id's parent is the
    whole circle, and the line of everyone in the tree starts with a part of it.
    """
    group = cut_lineage(nodes.join(lines.where("depth = -1").select("id", "root_id"), "id"))
    first = F.col("id") == F.col("root_id")
    tree = cut_lineage(resolve_lines(group.select("id", F.when(~first, F.col("parent")).alias("parent")), with_path=True, min_rows=min_rows))
    last = group.where(first).select(F.col("parent").alias("id"))
    ring = tree.join(last, "id").select("root_id", F.col("path").alias("ring"))
    met = salted_lookup(tree, ring, "root_id", "inner", min_rows=min_rows).withColumn("_on", F.size(F.array_intersect("path", "ring")))
    at = F.col("_pos").cast("long")
    below = met.select(F.col("id").alias("descendant"), "depth", "_on", F.posexplode("path").alias("_pos", "ancestor")).where((at >= F.col("_on")) & (at < F.col("depth")))
    around = met.select(F.col("id").alias("descendant"), "depth", "_on", F.size("ring").alias("_n"), F.posexplode("ring").alias("_pos", "ancestor"))
    steps = F.col("depth") - at + F.when((at < F.col("_on")) & (at < F.col("depth")), 0).otherwise(F.col("_n"))
    return below.select("ancestor", "descendant", (F.col("depth") - at).alias("distance")).unionByName(around.select("ancestor", "descendant", steps.cast("long").alias("distance")))


def circles(people: DataFrame, min_rows: int = HOT_ROWS, **columns: str) -> DataFrame:
    """circle (its smallest id) and id of every person on a circle, not of those below one.

    The pointers of all persons on circles or below them are doubled until they span the whole group; what they
    then rest on is exactly the circles.
    """
    nodes = cut_lineage(first_known_parent(current_versions(people, **columns), min_rows=min_rows))
    lines = resolve_lines(nodes, min_rows=min_rows).where("depth = -1").select("id", F.col("root_id").alias("circle"))
    group = cut_lineage(nodes.join(lines, "id").select("id", "parent", "circle"))
    left, span = group.count(), 1
    jump = group.select("id", F.col("parent").alias("anc"), "circle")
    while span < left:
        right = jump.select(F.col("id").alias("anc"), F.col("anc").alias("_anc"))
        jump = cut_lineage(salted_lookup(jump, right, "anc", "inner", min_rows=min_rows).select("id", F.col("_anc").alias("anc"), "circle"))
        span *= 2
    return jump.select("circle", F.col("anc").alias("id")).distinct()
