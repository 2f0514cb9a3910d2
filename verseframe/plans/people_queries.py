"""Person records: links, trees, checks, display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verseframe.functions import text as T
from verseframe.operators import people as P
from verseframe.operators.references import ids_in
from verseframe.plans.book import Book, strip
from verseframe.plans.core_problems import _CLEAN, _IDS
from verseframe.sources import table

BOOK = Book()
query = BOOK.query


def _people(spark: SparkSession, d: str) -> DataFrame:
    return P.latest(table(spark, d, "family"))


_COLS = "name, firstName, lastName, birthYear, deathYear, spouse, father, mother, branch, deleted_at, parents, children"
_CUR = f"""WITH RECURSIVE ver AS (SELECT {_CLEAN % 'id'} AS id, arg_max({{{', '.join(f"'{c.strip()}': {c.strip()}" for c in _COLS.split(','))}}}, (recorded_at, record_no)) AS v FROM family GROUP BY 1),
cur AS (SELECT id, unnest(v) FROM ver WHERE id IS NOT NULL AND v.deleted_at IS NULL),
e AS (SELECT DISTINCT parent, child FROM (SELECT unnest({_IDS % 'parents'}) AS parent, id AS child FROM cur UNION ALL SELECT id, unnest({_IDS % 'children'}) FROM cur) WHERE parent IN (SELECT id FROM cur) AND child IN (SELECT id FROM cur)),
nm AS (SELECT lower({strip("coalesce(name, '')")}) AS n, min(id) AS partner FROM cur GROUP BY 1),
sp AS (SELECT cur.id AS person, nm.partner FROM cur JOIN nm ON nm.n = lower({strip("coalesce(spouse, '')")}) WHERE nm.n <> '')
"""


def _links(people: DataFrame) -> DataFrame:
    return P.edges(people)


@query(_CUR + "SELECT parent, child FROM e")
def people_edges(spark, d):
    return _links(_people(spark, d))


@query(_CUR + "SELECT DISTINCT a.child AS id, b.child AS sibling FROM e a JOIN e b USING (parent) WHERE a.child <> b.child")
def people_siblings(spark, d):
    return P.siblings(_links(_people(spark, d)))


@query(_CUR + "SELECT person, partner FROM sp")
def people_spouses(spark, d):
    return P.spouses(_people(spark, d))


@query(_CUR + "SELECT DISTINCT person, partner, child FROM (SELECT person, partner, child FROM sp JOIN e ON parent = person UNION ALL SELECT person, partner, child FROM sp JOIN e ON parent = partner)")
def descendancy(spark, d):
    people = _people(spark, d)
    return P.children_of_couples(_links(people), P.spouses(people))


_RULES = """own AS (SELECT id, unnest(list_filter([CASE WHEN NOT regexp_matches(id, '^[a-z0-9]+(?:-[a-z0-9]+)*$') THEN 'bad_id' END, CASE WHEN deathYear < birthYear THEN 'death_before_birth' END,
CASE WHEN list_contains(P, id) THEN 'own_parent' END, CASE WHEN list_contains(C, id) THEN 'own_child' END], lambda r: r IS NOT NULL)) AS rule FROM (SELECT *, {p} AS P, {c} AS C FROM cur)),
dup AS (SELECT lower({n}) AS n FROM cur GROUP BY 1 HAVING count(*) > 1),
bad AS (SELECT id, rule FROM own UNION ALL SELECT id, 'duplicate_name' FROM cur WHERE lower({n}) IN (SELECT n FROM dup)
UNION ALL SELECT person, 'own_spouse' FROM sp WHERE person = partner
UNION ALL SELECT a.person, 'conflicting_spouse' FROM sp a JOIN sp b ON b.person = a.partner WHERE a.person <> a.partner AND b.partner <> a.person
UNION ALL SELECT id, 'unknown_parent' FROM (SELECT id, unnest({p}) AS r FROM cur) WHERE r NOT IN (SELECT id FROM cur)
UNION ALL SELECT id, 'unknown_child' FROM (SELECT id, unnest({c}) AS r FROM cur) WHERE r NOT IN (SELECT id FROM cur))""".format(p=_IDS % "parents", c=_IDS % "children", n=strip("coalesce(name, '')"))


@query(_CUR + ", " + _RULES + " SELECT DISTINCT id, rule FROM bad")
def people_violations(spark, d):
    return P.violations(_people(spark, d))


_TREE = """, tree AS (SELECT id AS root, id, 0 AS depth, id::VARCHAR AS path, [id] AS seen, false AS over FROM cur WHERE id NOT IN (SELECT child FROM e)
UNION ALL SELECT t.root, e.child, t.depth + 1, t.path || '/' || e.child, list_append(t.seen, e.child), list_contains(t.seen, e.child) FROM tree t JOIN e ON e.parent = t.id WHERE NOT t.over)"""


def _forest(spark, d):
    people = _people(spark, d)
    return P.forest(people, _links(people))


@query(_CUR + _TREE + " SELECT root, id, depth::INT AS depth, path FROM tree")
def people_forest(spark, d):
    return _forest(spark, d)


@query(_CUR + _TREE + " SELECT root, (max(depth) + 1)::INT AS generations, count(DISTINCT id) AS n_people FROM tree GROUP BY root")
def branch_extent(spark, d):
    return P.branch_extent(_forest(spark, d))


@query(_CUR + _TREE + " SELECT DISTINCT path FROM tree WHERE NOT over AND id IN (SELECT parent FROM e)")
def collapsible_ids(spark, d):
    people = _people(spark, d)
    links = _links(people)
    tree = P.forest(people, links)
    parents = links.select(F.col("parent").alias("id")).distinct()
    ends = F.size(F.array_distinct(F.split("path", "/"))) == F.size(F.split("path", "/"))
    return tree.where(ends).join(parents, "id", "left_semi").select("path").distinct()


@query(_CUR + """, r AS (SELECT id, (coalesce(birthYear, 2147483647), lower(name), id) AS o FROM cur WHERE id NOT IN (SELECT child FROM e)), c AS (SELECT * FROM sp WHERE person <> partner)
SELECT DISTINCT r.id FROM r LEFT JOIN c ON c.person = r.id LEFT JOIN r q ON q.id = c.partner WHERE (q.id IS NULL OR r.o < q.o) AND (c.partner IS NULL OR c.partner NOT IN (SELECT child FROM e))""")
def visible_roots(spark, d):
    people = _people(spark, d)
    return P.visible_roots(people, _links(people))


@query(_CUR + """, r AS (SELECT id, (coalesce(birthYear, 2147483647), lower(name), id) AS o FROM cur WHERE id NOT IN (SELECT child FROM e)), c AS (SELECT * FROM sp WHERE person <> partner),
shown AS (SELECT DISTINCT r.id FROM r LEFT JOIN c ON c.person = r.id LEFT JOIN r q ON q.id = c.partner WHERE (q.id IS NULL OR r.o < q.o) AND (c.partner IS NULL OR c.partner NOT IN (SELECT child FROM e))),
kids AS (SELECT parent AS a, child FROM e UNION SELECT person, child FROM c JOIN e ON parent = partner),
ways AS (SELECT shown.id AS root, shown.id AS id, c.partner AS spouse, 0 AS depth, shown.id::VARCHAR AS path, [shown.id, c.partner] AS seen FROM shown LEFT JOIN c ON c.person = shown.id
UNION ALL SELECT w.root, k.child, c.partner, w.depth + 1, w.path || '/' || k.child, list_concat(w.seen, [k.child, c.partner]) FROM ways w JOIN kids k ON k.a = w.id LEFT JOIN c ON c.person = k.child WHERE NOT list_contains(w.seen, k.child))
SELECT root, id, spouse, depth::INT AS depth, path FROM ways""")
def couple_lines(spark, d):
    people = _people(spark, d)
    return P.couple_forest(people, _links(people))


@query(_CUR + ", names AS (SELECT sp.person AS id, cur.name AS partner FROM sp JOIN cur ON cur.id = sp.partner WHERE sp.person <> sp.partner) SELECT cur.id, CASE WHEN coalesce(names.partner, '') = '' THEN cur.name ELSE cur.name || ' + ' || names.partner END AS label FROM cur LEFT JOIN names USING (id)")
def couple_labels(spark, d):
    people = _people(spark, d)
    names = P.spouses(people).where("person <> partner").join(people.select(F.col("id").alias("partner"), F.col("name").alias("partner_name")), "partner").select(F.col("person").alias("id"), "partner_name")
    return people.select("id", "name").join(names, "id", "left").select("id", P.couple_label("name", "partner_name").alias("label"))


@query(_CUR + f", r AS (SELECT id AS child, unnest({_IDS % 'parents'}) AS parent FROM cur) SELECT r.child, r.parent, coalesce(cur.name, r.parent) AS display_name FROM r LEFT JOIN cur ON cur.id = r.parent")
def people_links_with_fallback(spark, d):
    people = _people(spark, d)
    refs = people.select(F.col("id").alias("child"), F.explode(ids_in(F.col("parents"))).alias("parent"))
    return P.with_names(refs, "parent", people).select("child", "parent", "display_name")


@query(_CUR + "SELECT id, name FROM cur WHERE contains(lower(name), 'ar') AND coalesce(nullif(branch, ''), 'other') = 'other'")
def people_filter(spark, d):
    return P.people_filter(_people(spark, d), " Ar ", "other").select("id", "name")


@query(_CUR + "SELECT DISTINCT coalesce(nullif(branch, ''), 'other') AS branch FROM cur")
def branch_list(spark, d):
    return P.branches(_people(spark, d))


@query(_CUR + "SELECT id, lower(name) AS key, row_number() OVER (PARTITION BY coalesce(branch, '') ORDER BY coalesce(birthYear, 2147483647), lower(name), id)::INT AS place FROM cur")
def people_sorted(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy(F.coalesce("branch", F.lit(""))).orderBy(F.col("birthYear").asc_nulls_last(), F.lower("name"), "id")
    return _people(spark, d).select("id", F.lower("name").alias("key"), F.row_number().over(w).alias("place"))


@query(_CUR + f"""SELECT id, trim(regexp_replace(lower({strip("coalesce(name, '')")}), '[^a-z0-9]+', '-', 'g'), '-') AS slug, replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
upper(name[1]) || name[2:] AS capital, CASE WHEN birthYear IS NOT NULL AND deathYear IS NOT NULL THEN birthYear || ' - ' || deathYear WHEN birthYear IS NOT NULL THEN 'b. ' || birthYear WHEN deathYear IS NOT NULL THEN 'd. ' || deathYear ELSE '' END AS lifespan FROM cur""")
def people_display(spark, d):
    return _people(spark, d).select("id", T.slug(F.coalesce("name", F.lit(""))).alias("slug"), T.escape_html("name").alias("html"), T.capitalise("name").alias("capital"), P.lifespan(F.col("birthYear"), F.col("deathYear")).alias("lifespan"))


_NORM = "lower(" + strip("coalesce(%s, '')") + ")"


@query(_CUR + f""", after AS (SELECT id, CASE WHEN branch IS NULL THEN name || ' II' ELSE name END AS name, spouse, parents, father, mother, {_IDS % 'parents'} AS ids FROM cur),
renamed AS (SELECT {_NORM % 'name'} AS k, arg_min(name || ' II', id) AS now FROM cur WHERE branch IS NULL AND {_NORM % 'name'} <> '' GROUP BY 1),
up AS (SELECT id, unnest(ids) AS pid, generate_subscripts(ids, 1) AS pos FROM after), names AS (SELECT up.id, list(p.name ORDER BY pos) AS n FROM up JOIN after p ON p.id = up.pid GROUP BY up.id)
SELECT a.id, a.name, coalesce(r.now, a.spouse) AS spouse, array_to_string(a.parents, ',') AS parents, CASE WHEN len(a.ids) > 0 THEN coalesce(names.n[1], '') ELSE a.father END AS father, CASE WHEN len(a.ids) > 0 THEN coalesce(names.n[2], '') ELSE a.mother END AS mother
FROM after a LEFT JOIN renamed r ON r.k = {_NORM % 'a.spouse'} LEFT JOIN names ON names.id = a.id""")
def people_upsert(spark, d):
    people = _people(spark, d)
    changes = people.where("branch is null").select("id", F.concat("name", F.lit(" II")).alias("name"), "spouse", "parents", "father", "mother")
    return P.upsert(people, changes).withColumn("parents", F.array_join("parents", ","))


@query(f"SELECT DISTINCT record_no, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(array_to_string(parents, ','), ','), lambda v: {strip('v')}), lambda v: v <> ''))), '|'), '') AS n FROM family")
def relation_lists(spark, d):
    rows = table(spark, d, "family").select("record_no", F.array_join("parents", ",").alias("p"))
    return rows.select("record_no", F.array_join(F.array_sort(P.split_list("p")), "|").alias("n")).distinct()


@query("SELECT DISTINCT photoPath, regexp_replace(regexp_extract(photoPath, '([^/]*?)(?:\\.[^./]*)?$', 1), '[-_]', ' ', 'g') AS title, CASE lower(regexp_extract(photoPath, '\\.([^./]+)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' ELSE 'other' END AS media FROM family WHERE photoPath IS NOT NULL")
def url_media(spark, d):
    p = F.col("photoPath")
    ext = F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    media = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").when(ext == "webp", "image/webp").otherwise("other")
    return table(spark, d, "family").where(p.isNotNull()).select(p, F.regexp_replace(F.regexp_extract(p, r"([^/]*?)(?:\.[^./]*)?$", 1), "[-_]", " ").alias("title"), media.alias("media")).distinct()


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
