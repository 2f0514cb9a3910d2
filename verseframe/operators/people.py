"""Person records: links, checks, trees, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verseframe.functions import text as T
from verseframe.operators.references import clean_id, ids_in
from verseframe.operators.skew import salted_lookup


def split_list(c: Column | str) -> Column:
    """Comma text as an array: parts trimmed, blanks and repeats dropped; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), ","), T.strip)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def latest(df: DataFrame, key: str = "id", recorded: str = "recorded_at", order: str = "record_no") -> DataFrame:
    """The last version of each person with a cleaned id, deleted ones left out where the table tells."""
    cols = [c for c in df.columns if c != key]
    rows = df.withColumn(key, clean_id(F.col(key))).where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(recorded, order)).alias("_v")).select(key, "_v.*")
    return rows.where("deleted_at is null") if "deleted_at" in cols else rows


def edges(people: DataFrame) -> DataFrame:
    """parent, child: every link of parents or children between known persons, in both tables' directions once."""
    up = people.select(F.explode(ids_in(F.col("parents"))).alias("parent"), F.col("id").alias("child"))
    down = people.select(F.col("id").alias("parent"), F.explode(ids_in(F.col("children"))).alias("child"))
    ids = people.select("id")
    both = up.unionByName(down).distinct()
    return both.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("id", "child"), "child", "left_semi")


def siblings(links: DataFrame) -> DataFrame:
    """id, sibling: other children of a common parent. The pairs are what the relation is; a person's children bound them."""
    a, b = links.select("parent", F.col("child").alias("id")), links.select("parent", F.col("child").alias("sibling"))
    return a.join(b, "parent").where("id <> sibling").select("id", "sibling").distinct()


def children_of_couples(links: DataFrame, couples: DataFrame) -> DataFrame:
    """person, partner, child: the children of either, once."""
    first = couples.join(links, couples["person"] == links["parent"]).select("person", "partner", "child")
    second = couples.join(links, couples["partner"] == links["parent"]).select("person", "partner", "child")
    return first.unionByName(second).distinct()


def spouses(people: DataFrame) -> DataFrame:
    """person, partner: by the name of the spouse, the person with the smallest id of that name; blank names match nobody."""
    by_name = people.groupBy(T.normal_name("name").alias("_n")).agg(F.min("id").alias("partner")).where("_n <> ''")
    asked = people.select(F.col("id").alias("person"), T.normal_name("spouse").alias("_n")).where("_n <> ''")
    return salted_lookup(asked, by_name, "_n", "inner").select("person", "partner")


def violations(people: DataFrame) -> DataFrame:
    """id, rule of every broken rule: bad_id, duplicate_name, death_before_birth, own_parent, own_child, own_spouse,
    conflicting_spouse, unknown_parent, unknown_child."""
    rules = F.array_compact(F.array(
        F.when(~F.col("id").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), "bad_id"), F.when(F.col("deathYear") < F.col("birthYear"), "death_before_birth"),
        F.when(F.array_contains(ids_in(F.col("parents")), F.col("id")), "own_parent"), F.when(F.array_contains(ids_in(F.col("children")), F.col("id")), "own_child"),
    ))
    own = people.select("id", F.explode(rules).alias("rule"))
    named = people.select("id", T.normal_name("name").alias("_n"))
    twice = salted_lookup(named, named.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"), "_n", "inner").select("id", F.lit("duplicate_name").alias("rule"))
    links = spouses(people)
    self_ = links.where("person = partner").select(F.col("person").alias("id"), F.lit("own_spouse").alias("rule"))
    back = links.select(F.col("person").alias("partner"), F.col("partner").alias("_back"))
    clash = links.where("person <> partner").join(back, "partner").where("_back <> person").select(F.col("person").alias("id"), F.lit("conflicting_spouse").alias("rule"))
    out = own.unionByName(twice).unionByName(self_).unionByName(clash)
    for column, rule in (("parents", "unknown_parent"), ("children", "unknown_child")):
        refs = people.select("id", F.explode(F.array_distinct(ids_in(F.col(column)))).alias("_r"))
        out = out.unionByName(refs.join(people.select(F.col("id").alias("_r")), "_r", "left_anti").select("id", F.lit(rule).alias("rule")))
    return out.distinct()


def forest(people: DataFrame, links: DataFrame) -> DataFrame:
    """root, id, depth, path (ids by "/"): every way down from persons without a known parent; where nobody is without
    one, every person as a root of its own, without descendants.

    A person already on its way ends there as a leaf, so circles end too. Ways grow by doubling: round r joins the ways
    from roots of under 2**r links with all stretches of 2**r links, so that lines of any depth take logarithmic rounds.
    """
    from verseframe.session import cut_lineage

    def joined(ways: DataFrame, stretches: DataFrame, head: Column) -> DataFrame:
        """ways extended by stretches (a, b, p), without those that pass a person twice before their end."""
        s = stretches.select(F.col("a").alias("end"), F.col("b").alias("_b"), F.col("p").alias("_p"))
        both = ways.where("not over").join(s, "end").withColumn("_all", F.concat(head, "_p"))
        front = F.slice("_all", 1, F.size("_all") - 1)
        return both.where(F.size(F.array_distinct(front)) == F.size(front)).withColumn("_over", F.array_contains(front, F.col("_b")))

    roots = people.select("id").join(links.select(F.col("child").alias("id")).distinct(), "id", "left_anti")
    if roots.isEmpty():
        return people.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.col("id").alias("path"))
    ways = roots.select(F.col("id").alias("root"), F.col("id").alias("end"), F.array("id").alias("path"), F.lit(False).alias("over"))
    stretch = cut_lineage(links.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.array("child").alias("p"), (F.col("parent") == F.col("child")).alias("over")))
    while True:
        more = joined(ways, stretch, F.col("path")).select("root", F.col("_b").alias("end"), F.col("_all").alias("path"), F.col("_over").alias("over"))
        more = cut_lineage(more)
        if more.isEmpty():
            return ways.select("root", F.col("end").alias("id"), (F.size("path") - 1).alias("depth"), F.array_join("path", "/").alias("path"))
        ways = ways.unionByName(more)
        longer = joined(stretch.select("a", F.col("b").alias("end"), "p", "over"), stretch, F.concat(F.array("a"), "p"))
        stretch = cut_lineage(longer.select("a", F.col("_b").alias("b"), F.concat("p", "_p").alias("p"), F.col("_over").alias("over")))


def couple_forest(people: DataFrame, links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """root, id, spouse, depth, path (ids by "/"): every way down through couples. A couple is one place, under the person
    the way comes by; its children are those of either; whoever already stands on the way, as a person or as a spouse, is
    left out. roots: id, visible_roots where not given. Ways grow by doubling, as in `forest`."""
    from verseframe.session import cut_lineage

    roots = visible_roots(people, links) if roots is None else roots
    couples = spouses(people).where("person <> partner")
    mate = people.select("id").join(couples.select(F.col("person").alias("id"), F.col("partner").alias("spouse")), "id", "left")
    own = links.select(F.col("parent").alias("a"), F.col("child").alias("id"))
    shared = couples.join(links, couples["partner"] == links["parent"]).select(F.col("person").alias("a"), F.col("child").alias("id"))
    steps = own.unionByName(shared).distinct().join(mate, "id").join(mate.select(F.col("id").alias("a"), F.col("spouse").alias("_s")), "a")
    place = lambda i, s: F.array(F.struct(F.col(i).alias("i"), F.col(s).alias("s")))

    def fits(way: Column) -> Column:
        ids = F.transform(way, lambda x: x["i"])
        once = F.size(F.array_distinct(ids)) == F.size(ids)
        return once & F.forall(F.transform(way, lambda x, k: F.coalesce(F.array_position(ids, x["s"]), F.lit(0)) <= k + 1), lambda ok: ok)

    # a stretch starts with the person it hangs on, so that its spouse counts as well
    stretch = steps.select("a", F.concat(place("a", "_s"), place("id", "spouse")).alias("p")).where(fits(F.col("p")))
    stretch = cut_lineage(stretch.withColumn("b", F.element_at("p", -1)["i"]))
    ways = cut_lineage(roots.join(mate, "id").select(F.col("id").alias("root"), place("id", "spouse").alias("p")).withColumn("b", F.col("root")))

    def longer(left: DataFrame, keep: str) -> DataFrame:
        tail = stretch.select(F.col("a").alias("_a"), F.slice("p", 2, 1 << 30).alias("_p"), F.col("b").alias("_b"))
        both = left.join(tail, left["b"] == F.col("_a")).select(keep, F.concat("p", "_p").alias("p"), F.col("_b").alias("b"))
        return cut_lineage(both.where(fits(F.col("p"))))

    while True:
        more = longer(ways, "root")
        if more.isEmpty():
            last = F.element_at("p", -1)
            return ways.select("root", last["i"].alias("id"), last["s"].alias("spouse"), (F.size("p") - 1).alias("depth"), F.array_join(F.transform("p", lambda x: x["i"]), "/").alias("path"))
        ways = ways.unionByName(more)
        stretch = longer(stretch, "a")


def branch_extent(tree: DataFrame) -> DataFrame:
    """root, generations, n_people."""
    return tree.groupBy("root").agg((F.max("depth") + 1).alias("generations"), F.countDistinct("id").alias("n_people"))


def visible_roots(people: DataFrame, links: DataFrame) -> DataFrame:
    """id of the roots shown: of two married roots the one first by birth year (unknown last), name and id; none whose spouse has a known parent."""
    has_parent = links.select(F.col("child").alias("id")).distinct()
    roots = people.join(has_parent, "id", "left_anti").select("id", F.struct(F.coalesce("birthYear", F.lit(2**31 - 1)).alias("y"), F.lower("name").alias("n"), F.col("id").alias("i")).alias("_o"))
    couples = spouses(people).where("person <> partner")
    married = roots.join(couples.select(F.col("person").alias("id"), "partner"), "id", "left")
    other = roots.select(F.col("id").alias("partner"), F.col("_o").alias("_p"))
    seen = married.join(other, "partner", "left").join(has_parent.select(F.col("id").alias("partner"), F.lit(True).alias("_child")), "partner", "left")
    return seen.where((F.col("_p").isNull() | (F.col("_o") < F.col("_p"))) & F.col("_child").isNull()).select("id").distinct()


def with_names(ids: DataFrame, key: str, people: DataFrame) -> DataFrame:
    """ids with display_name: the person's name, or the id itself where nobody has it."""
    return ids.join(people.select(F.col("id").alias(key), F.col("name").alias("_n")), key, "left").withColumn("display_name", F.coalesce("_n", key)).drop("_n")


def people_filter(people: DataFrame, query: str = "", branch: str = "all") -> DataFrame:
    """By part of the name (case apart) and branch; an empty branch is "other"."""
    q = query.strip().lower()
    own = F.coalesce(F.nullif("branch", F.lit("")), F.lit("other"))
    return people.where(F.contains(F.lower("name"), F.lit(q)) & (F.lit(branch == "all") | (own == branch)))


def branches(people: DataFrame) -> DataFrame:
    return people.select(F.coalesce(F.nullif("branch", F.lit("")), F.lit("other")).alias("branch")).distinct()


def change_errors(people: DataFrame, changes: DataFrame) -> DataFrame:
    """id, rule, ref of everything that forbids the changes: a null or badly formed id, a changed person given twice, a
    name somebody else has, links to oneself, death before birth, and links to nobody known before or after the change.
    Unknown links that a person had before may stay. changes need id and name; parents, children, birthYear, deathYear
    count where they exist."""
    has = set(changes.columns)
    name = T.normal_name("name")
    out = changes.where(F.col("id").isNull() | ~F.col("id").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")).select("id", F.lit("bad_id").alias("rule"), F.lit(None).cast("string").alias("ref"))
    out = out.unionByName(changes.groupBy("id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("id", F.lit("given_twice").alias("rule"), F.lit(None).cast("string").alias("ref")))
    after = people.select("id", "name").join(changes.select("id"), "id", "left_anti").unionByName(changes.select("id", "name").where("id is not null"))
    others = after.select(F.col("id").alias("ref"), name.alias("_n")).where("_n <> ''").groupBy("_n").agg(F.min("ref").alias("_lo"), F.max("ref").alias("_hi"))
    same = changes.select("id", name.alias("_n")).join(others, "_n").where("_lo <> _hi")
    out = out.unionByName(same.select("id", F.lit("duplicate_name").alias("rule"), F.when(F.col("_lo") == F.col("id"), F.col("_hi")).otherwise(F.col("_lo")).alias("ref")))
    if {"birthYear", "deathYear"} <= has:
        out = out.unionByName(changes.where("deathYear < birthYear").select("id", F.lit("death_before_birth").alias("rule"), F.lit(None).cast("string").alias("ref")))
    known = people.select("id").unionByName(changes.select("id").where("id is not null")).distinct().withColumnRenamed("id", "ref")
    for column, rule in (("parents", "parent"), ("children", "child")):
        if column in has:
            refs = changes.select("id", F.explode(F.array_distinct(ids_in(F.col(column)))).alias("ref"))
            out = out.unionByName(refs.where("id = ref").select("id", F.lit(f"own_{rule}").alias("rule"), "ref"))
            before = people.select("id", F.explode(ids_in(F.col(column))).alias("ref")).distinct()
            out = out.unionByName(refs.join(known, "ref", "left_anti").join(before, ["id", "ref"], "left_anti").select("id", F.lit(f"unknown_{rule}").alias("rule"), "ref"))
    return out.distinct()


def checked_upsert(people: DataFrame, changes: DataFrame, shown: int = 20) -> DataFrame:
    """upsert, or ValueError naming the first errors of change_errors. A change without an id is a new person, whose id
    comes from the name."""
    changes = changes.withColumn("id", F.coalesce("id", F.nullif(T.slug("name"), F.lit(""))))
    errors = change_errors(people, changes).orderBy("id", "rule", "ref").limit(shown).collect()
    if errors:
        raise ValueError("; ".join(f"{r['id']}: {r['rule'].replace('_', ' ')} {r['ref'] or ''}".strip() for r in errors))
    return upsert(people, changes)


def upsert(people: DataFrame, changes: DataFrame) -> DataFrame:
    """people with the changed persons replaced and new ones added; ids never change. Parents' names follow the first
    two known parents, and a renamed person's spouse text follows on the partner. Both have id, name, spouse, parents, father, mother."""
    cols = ["id", "name", "spouse", "parents", "father", "mother"]
    new = changes.select(*cols)
    old = people.select(*cols)
    renamed = old.select("id", F.col("name").alias("_was")).join(new.select("id", F.col("name").alias("_now")), "id").where(T.normal_name("_was") != T.normal_name("_now"))
    kept = old.join(new.select("id"), "id", "left_anti")
    all_ = kept.unionByName(new)
    to = renamed.groupBy(T.normal_name("_was").alias("_k")).agg(F.min_by("_now", "id").alias("_to")).where("_k <> ''")
    all_ = all_.withColumn("_k", T.normal_name("spouse")).join(to, "_k", "left").withColumn("spouse", F.coalesce("_to", "spouse")).drop("_k", "_to")
    par = all_.select("id", F.posexplode(ids_in(F.col("parents"))).alias("_p", "_pid")).join(all_.select(F.col("id").alias("_pid"), F.col("name").alias("_pn")), "_pid")
    names = par.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_pn"))), lambda x: x["_pn"]).alias("_names"))
    done = all_.join(names, "id", "left")
    has = F.size(ids_in(F.col("parents"))) > 0
    return done.withColumn("father", F.when(has, F.coalesce(F.get("_names", 0), F.lit(""))).otherwise(F.col("father"))).withColumn("mother", F.when(has, F.coalesce(F.get("_names", 1), F.lit(""))).otherwise(F.col("mother"))).select(*cols)


def couple_label(name: Column | str, partner: Column | str) -> Column:
    """"A + B", or the name alone where there is no partner's."""
    n, p = (F.col(c) if isinstance(c, str) else c for c in (name, partner))
    return F.when(F.coalesce(T.strip(p), F.lit("")) == "", n).otherwise(F.concat(n, F.lit(" + "), p))


def lifespan(birth: Column, death: Column) -> Column:
    """"1861 - 1923", "b. 1861", "d. 1923" or the empty text."""
    b, d = birth.cast("string"), death.cast("string")
    return F.when(b.isNotNull() & d.isNotNull(), F.concat(b, F.lit(" - "), d)).when(b.isNotNull(), F.concat(F.lit("b. "), b)).when(d.isNotNull(), F.concat(F.lit("d. "), d)).otherwise("")
