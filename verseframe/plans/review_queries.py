"""Reviews, agreement, output pairs and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verseframe.functions import text as T, vectors as V
from verseframe.operators import metrics as M, reviews as R
from verseframe.plans.book import Book, strip
from verseframe.sources import table

BOOK = Book()
query = BOOK.query
P = 6


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return R.valid_scores(table(spark, d, "results").distinct())


_V = "v AS (SELECT DISTINCT * FROM results WHERE originality BETWEEN 1 AND 5 AND emotion BETWEEN 1 AND 5 AND imagery BETWEEN 1 AND 5)"


@query(f"WITH {_V} SELECT comparison_id, model, reviewer, originality, emotion, imagery FROM v")
def reviews_clean(spark, d):
    return _rows(spark, d).select("comparison_id", "model", "reviewer", "originality", "emotion", "imagery")


@query(f"WITH {_V} SELECT count(*) AS n_reviews, round(avg(originality), {P}) AS originality, round(avg(emotion), {P}) AS emotion, round(avg(imagery), {P}) AS imagery FROM v")
def review_means(spark, d):
    return R.means(_rows(spark, d), []).select("n_reviews", *[F.round(c, P).alias(c) for c in R.DIMENSIONS])


@query(f"WITH {_V} SELECT model, count(*) AS n_reviews, round(avg(originality), {P}) AS originality, round(avg(emotion), {P}) AS emotion, round(avg(imagery), {P}) AS imagery FROM v GROUP BY model")
def review_by_model(spark, d):
    return R.means(_rows(spark, d), ["model"]).select("model", "n_reviews", *[F.round(c, P).alias(c) for c in R.DIMENSIONS])


@query(f"""WITH {_V}, m AS (SELECT comparison_id, count(*) AS num_reviews, round(avg(originality), 3) AS originality, round(avg(emotion), 3) AS emotion, round(avg(imagery), 3) AS imagery FROM v GROUP BY 1)
SELECT *, round((originality + emotion + imagery) / 3, 3) AS overall FROM m""")
def review_by_poem(spark, d):
    m = R.means(_rows(spark, d), ["comparison_id"]).select("comparison_id", F.col("n_reviews").alias("num_reviews"), *[F.round(c, 3).alias(c) for c in R.DIMENSIONS])
    return m.withColumn("overall", F.round((F.col("originality") + F.col("emotion") + F.col("imagery")) / 3, 3))


@query(f"WITH {_V} SELECT comparison_id, model, round(avg((originality + emotion + imagery) / 3.0), {P}) AS overall FROM v GROUP BY ALL")
def review_poem_model(spark, d):
    overall = (F.col("originality") + F.col("emotion") + F.col("imagery")) / 3.0
    per = _rows(spark, d).groupBy("comparison_id", "model").agg(F.round(F.avg(overall), P).alias("overall"))
    return per.orderBy(F.when(F.col("comparison_id").rlike("^[0-9]+$"), 0).otherwise(1), F.col("comparison_id").try_cast("long"), "comparison_id", "model")


_LAST = f"""{_V}, last AS (SELECT comparison_id, model, lower(trim(reviewer)) AS reviewer, arg_max({{'o': originality, 'e': emotion, 'i': imagery}}, (submitted_at, originality, emotion, imagery)) AS s
FROM v WHERE trim(reviewer) <> '' GROUP BY ALL)"""


def _last(spark, d):
    rows = _rows(spark, d).withColumn("reviewer", F.lower(F.trim("reviewer"))).where("reviewer <> ''")
    return R.keep_last(rows, ["comparison_id", "model", "reviewer"], ["submitted_at", "originality", "emotion", "imagery"], list(R.DIMENSIONS))


@query(f"WITH {_LAST} SELECT comparison_id, model, reviewer, s.o AS originality, s.e AS emotion, s.i AS imagery FROM last")
def review_keep_last(spark, d):
    return _last(spark, d)


_PAIRS = f"""WITH {_LAST}, p AS (SELECT a.reviewer AS r1, b.reviewer AS r2, a.s.o AS a, b.s.o AS b FROM last a JOIN last b USING (comparison_id, model) WHERE a.reviewer < b.reviewer),
ma AS (SELECT r1, r2, a AS k, count(*) AS n FROM p GROUP BY ALL), mb AS (SELECT r1, r2, b AS k, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT r1, r2, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS o FROM p GROUP BY ALL),
e AS (SELECT r1, r2, sum(ma.n * mb.n) AS e FROM ma JOIN mb USING (r1, r2, k) GROUP BY ALL),
kap AS (SELECT r1, r2, n, o AS exact_match, CASE WHEN coalesce(e, 0) / (n * n) >= 1 THEN 1.0 ELSE (o - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)) END AS kappa FROM t LEFT JOIN e USING (r1, r2))"""


def _kappas(spark, d):
    votes = _last(spark, d).withColumn("item", F.concat_ws("\x1f", "comparison_id", "model"))
    return R.kappa_of_counts(R.reviewer_pair_counts(votes, "item", "reviewer", "originality"), ["r1", "r2"])


@query(_PAIRS + f" SELECT r1, r2, n::BIGINT AS n, round(exact_match, {P}) AS exact_match, round(kappa, {P}) AS kappa FROM kap")
def reviewer_kappa(spark, d):
    return _kappas(spark, d).select("r1", "r2", "n", F.round("exact_match", P).alias("exact_match"), F.round("kappa", P).alias("kappa"))


@query(_PAIRS + " SELECT count(*) AS n_pairs, round(avg(exact_match), 6) AS exact_match, round(avg(kappa), 6) AS kappa FROM kap")
def reviewer_agreement(spark, d):
    return _kappas(spark, d).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("exact_match"), P).alias("exact_match"), F.round(F.avg("kappa"), P).alias("kappa"))


@query("""WITH items AS (SELECT id::VARCHAR AS id, min(row_id) AS o FROM outputs_flat GROUP BY 1), who AS (SELECT DISTINCT lower(trim(coalesce(reviewer, ''), ' ' || chr(9) || chr(10) || chr(13))) AS reviewer FROM results),
done AS (SELECT DISTINCT lower(trim(coalesce(reviewer, ''), ' ' || chr(9) || chr(10) || chr(13))) AS reviewer, comparison_id AS id FROM results),
grid AS (SELECT reviewer, id, o FROM who, items), open AS (SELECT reviewer, id, o FROM grid ANTI JOIN done USING (reviewer, id)) SELECT reviewer, first(id ORDER BY o, id) AS id FROM open GROUP BY reviewer UNION ALL SELECT reviewer, NULL FROM who WHERE reviewer NOT IN (SELECT reviewer FROM open)""")
def next_item_for_reviewer(spark, d):
    items = table(spark, d, "outputs_flat").select(F.col("id").cast("string").alias("id"), "row_id")
    results = table(spark, d, "results").select("reviewer", F.col("comparison_id").alias("id"))
    return R.next_item(items, results, results.select("reviewer"), "row_id")


_NEST = """n AS (SELECT id, prompt, list({'row_id': row_id, 'model': model, 'base_model': base_model, 'poem': poem} ORDER BY row_id, model, base_model, poem) AS o FROM (SELECT DISTINCT * FROM outputs_flat)
WHERE id IS NOT NULL AND prompt IS NOT NULL AND model IS NOT NULL AND poem IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"""


def _nested(spark, d):
    return R.nest_pairs(table(spark, d, "outputs_flat").distinct(), "row_id")


@query(f"WITH {_NEST} SELECT id, prompt, o[1].model AS model1, o[2].model AS model2, o[1].poem AS poem1, o[2].poem AS poem2 FROM n")
def pairs_flat_to_nested(spark, d):
    return _nested(spark, d).select("id", "prompt", F.col("outputs")[0]["model"].alias("model1"), F.col("outputs")[1]["model"].alias("model2"), F.col("outputs")[0]["poem"].alias("poem1"), F.col("outputs")[1]["poem"].alias("poem2"))


@query(f"WITH {_NEST}, f AS (SELECT id, prompt, unnest([1, 2])::INT AS position, unnest(o[1:2]) AS x FROM n) SELECT id, prompt, position, x.model AS model, x.base_model AS base_model, x.poem AS poem FROM f")
def pairs_nested_to_flat(spark, d):
    return R.flatten_pairs(_nested(spark, d))


@query(f"""WITH {_NEST}, f AS (SELECT id, prompt, CASE WHEN sha256('ada::' || id)[1] IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN [o[2], o[1]] ELSE o[1:2] END AS o FROM n), x AS (SELECT id, prompt, unnest([1, 2])::INT AS display_position, unnest(['A', 'B']) AS blind_label, unnest(o) AS x FROM f)
SELECT id, prompt, display_position, blind_label, x.model AS model, x.poem AS poem FROM x""")
def blind_pairs(spark, d):
    return R.blind(_nested(spark, d), F.lit(" Ada "))


@query("""SELECT DISTINCT r.comparison_id, r.model, r.reviewer, o.base_model, o.prompt, round((r.originality + r.emotion + r.imagery) / 3.0, 2) AS overall FROM results r JOIN (SELECT id, model, min(base_model) AS base_model, min(prompt) AS prompt FROM outputs_flat GROUP BY ALL) o ON r.comparison_id = o.id::VARCHAR AND r.model = o.model
WHERE r.originality BETWEEN 1 AND 5 AND r.emotion BETWEEN 1 AND 5 AND r.imagery BETWEEN 1 AND 5""")
def review_rows_enriched(spark, d):
    outputs = table(spark, d, "outputs_flat").groupBy(F.col("id").cast("string").alias("comparison_id"), "model").agg(F.min("base_model").alias("base_model"), F.min("prompt").alias("prompt"))
    rows = _rows(spark, d).select("comparison_id", "model", "reviewer", F.round((F.col("originality") + F.col("emotion") + F.col("imagery")) / 3.0, 2).alias("overall"))
    return rows.join(outputs, ["comparison_id", "model"]).distinct()


_DOT = "list_dot_product(list_transform(%s, lambda x: x::DOUBLE), list_transform(%s, lambda x: x::DOUBLE))"


@query(f"SELECT a.vec_id // 2 AS pair, round({_DOT % ('a.embedding', 'b.embedding')}, {P}) AS similarity, round(1 - {_DOT % ('a.embedding', 'b.embedding')}, {P}) AS drift FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")
def semantic_drift_pairs(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), F.pmod("vec_id", F.lit(2)).alias("side"), "embedding")
    a, b = e.where("side = 0").select("pair", F.col("embedding").alias("a")), e.where("side = 1").select("pair", F.col("embedding").alias("b"))
    s = V.dot("a", "b")
    return a.join(b, "pair").select("pair", F.round(s, P).alias("similarity"), F.round(1 - s, P).alias("drift"))


@query(f"""WITH l AS (SELECT label, embedding AS b, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings)
SELECT label, round(coalesce(avg(1 - {_DOT % ('a', 'b')}) FILTER (a IS NOT NULL), 0), {P}) AS distance FROM l GROUP BY label""")
def adjacent_distance_by_label(spark, d):
    out = M.adjacent_distance(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", F.round("distance", P).alias("distance"))


_COS = f"{_DOT % ('a.embedding', 'b.embedding')} / (sqrt({_DOT % ('a.embedding', 'a.embedding')}) * sqrt({_DOT % ('b.embedding', 'b.embedding')}) + 1e-10)"


@query(f"""WITH c AS (SELECT a.vec_id, b.vec_id AS other, round({_COS}, {P}) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT vec_id, arg_max(other, (s, -other)) AS nearest, max(s) AS similarity FROM c GROUP BY vec_id""")
def cosine_eps_top1(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where(F.pmod("vec_id", F.lit(100)) == 0)  # the stated query set of a search, against all rows
    return M.nearest(asked, e, "vec_id", "embedding", digits=P)


@query(f"SELECT a.vec_id, round(1 - {_DOT % ('a.embedding', 'b.embedding')}, {P}) AS x, a.label AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")
def drift_scatter(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), F.pmod("vec_id", F.lit(2)).alias("side"), "vec_id", "embedding", "label")
    a, b = e.where("side = 0").select("pair", "vec_id", F.col("embedding").alias("a"), F.col("label").alias("y")), e.where("side = 1").select("pair", F.col("embedding").alias("b"))
    return a.join(b, "pair").select("vec_id", F.round(1 - V.dot("a", "b"), P).alias("x"), "y")


@query("""WITH m AS (SELECT DISTINCT model, base_model FROM outputs_flat) SELECT model, base_model, CASE WHEN contains(lower(model), 'llama') THEN 'llama' WHEN contains(lower(model), 'qwen') THEN 'qwen' WHEN contains(lower(model), 'gpt2') THEN 'gpt2' ELSE 'generic' END AS family,
coalesce(base_model, '') = '' OR lower(trim(model)) = lower(trim(base_model)) OR string_split(lower(trim(model)), '/')[-1] = string_split(lower(trim(base_model)), '/')[-1] AS fits FROM m""")
def model_family(spark, d):
    m = table(spark, d, "outputs_flat").select("model", "base_model").distinct()
    return m.select("model", "base_model", T.model_family("model").alias("family"), T.compatible_base("model", "base_model").alias("fits"))


@query(f"SELECT DISTINCT row_id, CASE WHEN prompt IS NULL OR prompt = '' OR position(prompt IN poem) = 0 THEN poem ELSE substr(poem, position(prompt IN poem) + length(prompt)) END AS body FROM outputs_flat WHERE poem IS NOT NULL")
def prompt_removed(spark, d):
    return table(spark, d, "outputs_flat").where("poem is not null").select("row_id", T.remove_prompt("poem", "prompt").alias("body")).distinct()


@query(f"SELECT DISTINCT row_id, {strip('regexp_replace(' + strip('split_part(' + strip('poem') + ', ' + repr('User:') + ', 1)') + ', ' + repr('^Assistant:') + ', ' + repr('') + ')')} AS reply FROM outputs_flat WHERE poem IS NOT NULL")
def reply_trimmed(spark, d):
    return table(spark, d, "outputs_flat").where("poem is not null").select("row_id", T.trim_reply("poem").alias("reply")).distinct()


@query(f"WITH {_V} SELECT reviewer, round_even(avg(originality), 1) AS originality, round_even(avg(imagery), 1) AS imagery FROM v GROUP BY reviewer")
def review_even_rounding(spark, d):
    per = _rows(spark, d).groupBy("reviewer").agg(F.avg("originality").alias("a"), F.avg("imagery").alias("b"))
    return per.select("reviewer", V.round_half_even(F.col("a"), 1).alias("originality"), V.round_half_even(F.col("b"), 1).alias("imagery"))


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
