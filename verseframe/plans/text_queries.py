"""Text metrics, cleaning and splitting over documents and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verseframe.functions import fixed as K, text as T
from verseframe.operators import corpus as C, metrics as M
from verseframe.operators.spread import spread
from verseframe.plans.book import SPACE, Book, clean, hits, quoted, shape, split_words, strip, words
from verseframe.sources import table

BOOK = Book()
query = BOOK.query
R = 6


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


W, S = words("text"), shape("text")
_N = f"len({W})"
IMAGERY = f"CASE WHEN {_N} = 0 THEN 0 ELSE len(list_filter({W}, lambda w: w IN ({quoted(K.IMAGERY)}))) / {_N} END"
METAPHOR = "(" + " + ".join(hits(S, rf"(?i)\b\w+\s+{v}\s+\w+\b") for v in ("is", "becomes", "like", "of")) + f") / greatest(1, {_N})"
COMPOUND = f"CASE WHEN {_N} = 0 THEN 0 ELSE ({hits(S, r'(?i)\b\w+\s+of\s+\w+\b')} + {hits(S, r'(?i)\b\w+\s+\w+\b')}) * 100.0 / {_N} END"
NARRATIVE = f"CASE WHEN {_N} = 0 THEN 0 ELSE ({hits(S, r'(?i)\b\w+(?:ed|ing)\b')} / {_N} + ({hits(S, r'(?i)\b(?:he|she)\s+said\b')} + {hits(clean('text'), '[\"“”]')}) / {_N} + {hits(S, r'(?i)\b(?:' + '|'.join(K.MOTION) + r')\b')} / {_N}) / 3.0 END"
NOVELTY = f"known AS (SELECT DISTINCT unnest({W}) AS token FROM eval_items), toks AS (SELECT doc_id, unnest({W}) AS token FROM documents), novelty AS (SELECT doc_id, count(token) AS n_words, sum(CASE WHEN known.token IS NULL THEN 1 ELSE 0 END) / count(*) AS nov FROM toks LEFT JOIN known USING (token) GROUP BY doc_id)"


def _metric(name: str, build, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _docs(spark, d).select("doc_id", F.round(build("text"), R).alias(name))

    run.__name__ = f"{name}_docs"
    query(f"SELECT doc_id, round({sql}, {R}) AS {name} FROM documents")(run)


_metric("imagery_density", T.imagery_density, IMAGERY)
_metric("metaphor_density", T.metaphor_density, METAPHOR)
_metric("compound_imagery", T.compound_imagery, COMPOUND)
_metric("narrative_density", T.narrative_density, NARRATIVE)
_metric("repetition_index", lambda c: T.repetition_index(T.words(c)), f"CASE WHEN {_N} = 0 THEN 0 ELSE ({_N} - len(list_distinct({W}))) / {_N} END")


@query(f"WITH {NOVELTY} SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(nov, 0), {R}) AS lexical_novelty FROM documents d LEFT JOIN novelty n ON n.doc_id = d.doc_id")
def lexical_novelty_docs(spark, d):
    out = M.lexical_novelty(_docs(spark, d), "doc_id", "text", M.vocabulary(table(spark, d, "eval_items"), "text"))
    return out.select("doc_id", "n_words", F.round("lexical_novelty", R).alias("lexical_novelty"))


@query("SELECT count(*)::BIGINT AS n_items, 0.0::DOUBLE AS most FROM eval_items")
def lexical_novelty_self_is_zero(spark, d):
    items = table(spark, d, "eval_items")
    return M.lexical_novelty(items, "item_id", "text", M.vocabulary(items, "text")).agg(F.count(F.lit(1)).alias("n_items"), F.max("lexical_novelty").alias("most"))


@query(f"""WITH {NOVELTY}, m AS (SELECT doc_id, source, {IMAGERY} AS a, {METAPHOR} AS b, {NARRATIVE} AS c FROM documents WHERE lower(lang) = 'en')
SELECT source, count(*) AS n_docs, round(avg(a), {R}) AS imagery_density, round(avg(b), {R}) AS metaphor_density, round(avg(c), {R}) AS narrative_density, round(avg(coalesce(nov, 0)), {R}) AS lexical_novelty
FROM m LEFT JOIN novelty USING (doc_id) GROUP BY source""")
def lexical_quality_by_source(spark, d):
    docs = _docs(spark, d).where(F.lower("lang") == "en")
    novelty = M.lexical_novelty(docs, "doc_id", "text", M.vocabulary(table(spark, d, "eval_items"), "text")).select("doc_id", "lexical_novelty")
    rows = M.with_metrics(docs.select("doc_id", "source", "text"), "text", ["imagery_density", "metaphor_density", "narrative_density"]).drop("text").join(novelty, "doc_id")
    names = ("imagery_density", "metaphor_density", "narrative_density", "lexical_novelty")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *[F.round(F.avg(n), R).alias(n) for n in names])


@query(f"""WITH t AS (SELECT lower(lang) AS lang, unnest({W}) AS token FROM documents WHERE lang IS NOT NULL),
base AS (SELECT token, count(*) AS n FROM t WHERE lang = 'en' GROUP BY 1), lang AS (SELECT lang, token, count(*) AS n FROM t WHERE lang <> 'en' GROUP BY ALL),
tot AS (SELECT lang, sum(n) AS s FROM lang GROUP BY 1), keys AS (SELECT DISTINCT l.lang, u.token FROM tot l, (SELECT token FROM base UNION SELECT token FROM lang) u),
used AS (SELECT k.lang, k.token, coalesce(b.n, 0) / (SELECT sum(n) FROM base) + 1e-12 AS q, coalesce(l.n, 0) / t.s + 1e-12 AS p, b.n AS bn, l.n AS ln FROM keys k JOIN tot t USING (lang) LEFT JOIN base b USING (token) LEFT JOIN lang l ON l.lang = k.lang AND l.token = k.token)
SELECT lang, round(sum(p * ln(p / q)), 4) AS kl FROM used WHERE bn IS NOT NULL OR ln IS NOT NULL GROUP BY lang""")
def token_shift_by_lang(spark, d):
    counts = M.token_counts(_docs(spark, d).where("lang is not null").withColumn("lang", F.lower("lang")), "text", "lang")
    return M.token_shifts(counts.where("lang = 'en'").select("token", "n"), counts.where("lang <> 'en'"), "lang").select("lang", F.round("kl", 4).alias("kl"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({W}) AS token FROM documents) GROUP BY token")
def token_frequency(spark, d):
    return M.token_counts(_docs(spark, d), "text")


@query(f"""WITH u AS (SELECT 'corpus' AS model, text FROM documents UNION ALL SELECT 'human', text FROM eval_items UNION ALL SELECT model, poem FROM outputs_flat)
SELECT model, count(*) AS n, round(avg({IMAGERY}), {R}) AS imagery_density, round(avg({METAPHOR}), {R}) AS metaphor_density FROM u GROUP BY model""")
def sample_union_summary(spark, d):
    parts = _docs(spark, d).select(F.lit("corpus").alias("model"), "text").unionByName(table(spark, d, "eval_items").select(F.lit("human").alias("model"), "text"))
    parts = parts.unionByName(table(spark, d, "outputs_flat").select("model", F.col("poem").alias("text")), allowMissingColumns=True)
    rows = M.with_metrics(parts, "text", ["imagery_density", "metaphor_density"])
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), R).alias(n) for n in ("imagery_density", "metaphor_density")])


def _by_type(spark, d) -> DataFrame:
    sweep = table(spark, d, "style_tradeoff_v1_20260311_191359").distinct()
    return sweep.groupBy("run_name").agg(*[F.avg(F.when(F.col("model_type") == t, F.col("perplexity"))).alias(t) for t in ("base", "finetuned")])


_SWEEP = "(SELECT DISTINCT * FROM style_tradeoff_v1_20260311_191359)"


@query(f"""WITH m AS (SELECT run_name, avg(perplexity) FILTER (model_type = 'base') AS b, avg(perplexity) FILTER (model_type = 'finetuned') AS o FROM {_SWEEP} GROUP BY 1)
SELECT run_name, CASE WHEN b = 0 THEN 'n/a' WHEN b IS NULL OR o IS NULL OR isnan(b) OR isnan(o) THEN 'nan%' ELSE round_even((o - b) / b * 100, 0)::BIGINT::VARCHAR || '%' END AS delta FROM m""")
def summary_delta(spark, d):
    return _by_type(spark, d).select("run_name", M.percent_delta(F.col("base"), F.col("finetuned")).alias("delta"))


@query(f"""WITH m AS (SELECT model_type, avg(perplexity) AS perplexity, avg(repetition_index) AS repetition_index, avg(semantic_similarity) AS semantic_similarity FROM {_SWEEP} GROUP BY 1),
l AS (SELECT model_type, unnest(['perplexity', 'repetition_index', 'semantic_similarity']) AS metric, unnest([perplexity, repetition_index, semantic_similarity]) AS v FROM m)
SELECT metric, round(max(v) FILTER (model_type = 'base'), {R}) AS base, round(max(v) FILTER (model_type = 'finetuned'), {R}) AS finetuned FROM l GROUP BY metric""")
def summary_pivot(spark, d):
    names = ("perplexity", "repetition_index", "semantic_similarity")
    per = table(spark, d, "style_tradeoff_v1_20260311_191359").distinct().groupBy("model_type").agg(*[F.avg(n).alias(n) for n in names])
    long = per.unpivot("model_type", list(names), "metric", "v")
    return long.groupBy("metric").pivot("model_type", ["base", "finetuned"]).agg(F.round(F.max("v"), R))


@query(f"SELECT count(*) AS n_rows, round(avg(CASE WHEN isnan(meter_score) THEN NULL ELSE meter_score END), {R}) AS meter_score, round(avg(semantic_similarity), {R}) AS semantic_similarity, round(avg(repetition_index), {R}) AS repetition_index, round(avg(perplexity), {R}) AS perplexity FROM {_SWEEP}")
def sweep_summary(spark, d):
    rows = table(spark, d, "style_tradeoff_v1_20260311_191359").distinct()
    skip = lambda c: F.round(F.avg(F.when(~F.isnan(c), F.col(c))), R).alias(c)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *[skip(c) for c in ("meter_score", "semantic_similarity", "repetition_index", "perplexity")])


@query("SELECT prompt_id, prompt, model_type, temperature, top_p FROM prompts, (SELECT unnest(['base', 'finetuned']) AS model_type), (SELECT unnest([0.2, 0.7, 1.0])::DOUBLE AS temperature), (SELECT unnest([0.9])::DOUBLE AS top_p)")
def sweep_grid(spark, d):
    grid = F.array(*[F.struct(F.lit(m).alias("model_type"), F.lit(t).alias("temperature"), F.lit(0.9).alias("top_p")) for t in (0.2, 0.7, 1.0) for m in ("base", "finetuned")])
    return table(spark, d, "prompts").select("prompt_id", "prompt", F.inline(grid))


@query("WITH p AS (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id::INT) - 1 AS k, count(*) OVER () AS n FROM prompts) SELECT i AS sample, prompt_id FROM range(1000) t(i) JOIN p ON i % n = k")
def prompt_schedule(spark, d):
    from verseframe.operators.reviews import dense_rank_by

    prompts = dense_rank_by(table(spark, d, "prompts").withColumn("_o", F.col("prompt_id").cast("long")), "_o", "k").select("prompt_id", (F.col("k") - 1).alias("k"))
    n = prompts.agg(F.count(F.lit(1)).alias("n"))
    samples = spark.range(1000).withColumnRenamed("id", "sample").join(F.broadcast(n)).withColumn("k", F.pmod("sample", "n"))
    return samples.join(prompts, "k").select("sample", "prompt_id")


_HIST = f"h AS (SELECT source, n_chars::DOUBLE AS v FROM documents WHERE n_chars IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM h)"


@query(f"WITH {_HIST}, b AS (SELECT source, least(floor((v - lo) / ((hi - lo) / 30)) + 1, 30)::INT AS bin, (hi - lo) / 30 AS w FROM h, e), c AS (SELECT source, bin, count(*) AS n, any_value(w) AS w FROM b GROUP BY ALL) SELECT source, bin, n, round(n / (sum(n) OVER (PARTITION BY source) * w), 9) AS density FROM c")
def metric_histogram(spark, d):
    rows = _docs(spark, d).select("source", F.col("n_chars").cast("double").alias("v")).where("v is not null")
    return M.equal_width_density(rows, "v", "source").withColumn("density", F.round("density", 9))


@query("SELECT source, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def metric_boxplot(spark, d):
    p = lambda q: F.percentile("n_chars", F.lit(q))
    return _docs(spark, d).groupBy("source").agg(p(0.25).alias("q1"), p(0.5).alias("q2"), p(0.75).alias("q3"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query(f"""WITH {_HIST}, s AS (SELECT source, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM h GROUP BY 1), g AS (SELECT lo + (hi - lo) * i / 20 AS x, i FROM e, range(21) t(i))
SELECT source, round(any_value(x), 6) AS x, round(avg(exp(-((x - v) / s.h) * ((x - v) / s.h) / 2)) / any_value(s.h) / 2.5066282746310002, 9) AS density FROM h JOIN s USING (source), g WHERE s.h > 0 GROUP BY source, i""")
def metric_kde(spark, d):
    rows = _docs(spark, d).select("source", F.col("n_chars").cast("double").alias("v")).where("v is not null and source is not null")
    return M.gaussian_kde(rows, "v", "source").select("source", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("SELECT source, count(n_chars) AS n, min(n_chars) AS least, median(n_chars) AS median, list_sort(list(n_chars) FILTER (n_chars IS NOT NULL))[(count(n_chars) // 2 + 1)::BIGINT] AS upper_median, max(n_chars) AS most FROM documents GROUP BY source")
def chunk_length_report(spark, d):
    return M.lower_upper_median(_docs(spark, d), "n_chars", "source")


@query(f"WITH n AS (SELECT len({split_words('text')}) AS n FROM documents) SELECT CASE WHEN n < 200 THEN '<200' WHEN n < 400 THEN '200-400' WHEN n <= 800 THEN '400-800' WHEN n <= 2000 THEN '801-2000' ELSE '>2000' END AS bucket, count(*) AS n_docs FROM n GROUP BY 1")
def length_histogram(spark, d):
    n = F.size(T.split_words("text"))
    bucket = C.length_bucket(n, [("<200", n < 200), ("200-400", n < 400), ("400-800", n <= 800), ("801-2000", n <= 2000), (">2000", n > 2000)])
    return _docs(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_docs"))


_NL = "regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')"
_LINES = f"string_split({_NL}, chr(10))"


def _metadata_sql(x: str) -> str:
    low = f"lower({strip(x)})"
    tests = [f"regexp_matches({low}, '^(?:{'|'.join(K.METADATA)})$')", f"regexp_matches({strip(x)}, '^{K.RULE_LINE}$')"]
    tests += [f"contains({low}, '{w}')" for w in K.METADATA_WORDS] + [f"starts_with({low}, '{w.replace(chr(39), chr(39) * 2)}')" for w in K.METADATA_STARTS]
    return f"({strip(x)} <> '' AND ({' OR '.join(tests)}))"


@query(f"SELECT doc_id, md5(array_to_string(list_filter({_LINES}, lambda x: NOT {_metadata_sql('x')}), chr(10))) AS body FROM documents WHERE text IS NOT NULL")
def metadata_lines_removed(spark, d):
    docs = _docs(spark, d).where("text is not null")
    return docs.select("doc_id", F.md5(C.without_metadata(docs, "text")).alias("body"))


@query(f"SELECT doc_id, len({_LINES}) AS n_lines, len(list_filter({_LINES}, lambda x: {_metadata_sql('x')})) AS n_metadata FROM documents WHERE text IS NOT NULL")
def metadata_line_counts(spark, d):
    rows = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(rows).alias("n_lines"), F.size(F.filter(rows, T.is_metadata)).alias("n_metadata"))


def _key_sql(x: str) -> str:
    s = f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"
    n = f"len(string_split({s}, ' '))"
    no = f"{s} = '' OR length({s}) > 80 OR regexp_matches({s}, '[.,;:!?]$') OR {n} > 8"
    return f"CASE WHEN {no} THEN NULL WHEN regexp_matches({s}, '^[IVXLCDM]+\\.?$') OR (upper({s}) = {s} AND lower({s}) <> {s} AND {n} >= 2) THEN upper({s}) ELSE lower({s}) END"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, {_key_sql('line')} AS key FROM l), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key IS NULL OR n <= 2), '') AS body FROM c GROUP BY doc_id""")
def repeated_titles_removed(spark, d):
    return C.without_repeated_titles(_docs(spark, d), "doc_id", "text")


_BODY = f"regexp_replace(regexp_replace(text, '(?is)^.*?{K.START_MARK}[^\n]*\n?', ''), '(?is){K.END_MARK}.*$', '')"
_PLAIN = f"replace(regexp_replace({_BODY}, '\r\n?', chr(10), 'g'), chr(65279), '')"
_KEPT = f"list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: regexp_replace(x, '{SPACE}+$', '')), lambda x: NOT {_metadata_sql('x')})"
_TRIMMED = "regexp_replace(regexp_replace(body, '[ \t]{2,}', ' ', 'g'), '(?m)[ \t]+$', '', 'g')"


@query(f"""WITH t AS (SELECT doc_id, {_KEPT} AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
k AS (SELECT *, {_key_sql('line')} AS key FROM l), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k),
b AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key IS NULL OR n <= 2), '') AS body FROM c GROUP BY doc_id)
SELECT doc_id, {strip("regexp_replace(" + _TRIMMED + ", '\n{4,}', chr(10) || chr(10) || chr(10), 'g')")} AS body FROM (SELECT t.doc_id, coalesce(body, '') AS body FROM t LEFT JOIN b USING (doc_id))""")
def cleaned_source(spark, d):
    return C.clean_source(_docs(spark, d).where("text is not null"), "doc_id", "text")


@query("SELECT doc_id, " + strip(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t\x0b\f]+$', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')") + " AS body FROM documents")
def normalised_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normal_lines("text").alias("body"))


_MARKED = (("", ""), ("front\n*** START OF THIS PROJECT GUTENBERG EBOOK ***\n", ""), ("", "\n*** end of the project gutenberg ebook\nback"), ("front\n***START OF THE PROJECT GUTENBERG EBOOK", "\n*** END OF THIS PROJECT GUTENBERG EBOOK"))
_SQL_MARKED = " UNION ALL ".join(f"SELECT doc_id, {k} AS marks, concat({quoted((a,))}, text, {quoted((b,))}) AS t FROM documents WHERE text IS NOT NULL" for k, (a, b) in enumerate(_MARKED))


@query(f"WITH m AS ({_SQL_MARKED}) SELECT doc_id, marks, regexp_replace(regexp_replace(t, '(?is)^.*?{K.START_MARK}[^\n]*\n?', ''), '(?is){K.END_MARK}.*$', '') AS body FROM m")
def header_stripped(spark, d):
    forms = F.array(*[F.struct(F.lit(k).alias("marks"), F.concat(F.lit(a), "text", F.lit(b)).alias("t")) for k, (a, b) in enumerate(_MARKED)])
    rows = _docs(spark, d).where("text is not null").select("doc_id", F.explode(forms).alias("m"))
    return rows.select("doc_id", "m.marks", T.strip_headers(F.col("m.t")).alias("body"))


@query("SELECT doc_id, " + strip("replace(" * 7 + "replace(text, '<|endoftext|>', chr(10) || chr(10))" + "".join(f", '{t}', '')" for t in K.CHAT_TOKENS)) + " AS body FROM documents")
def special_tokens_removed(spark, d):
    return _docs(spark, d).select("doc_id", T.literal_token_cleaning("text").alias("body"))


def _units(name: str, build, sql_list: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _docs(spark, d).where("text is not null").select("doc_id", F.posexplode(build("text")).alias("pos", "unit"))

    run.__name__ = name
    query(f"WITH u AS (SELECT doc_id, {sql_list} AS u FROM documents WHERE text IS NOT NULL) SELECT doc_id, (generate_subscripts(u, 1) - 1)::INT AS pos, unnest(u) AS unit FROM u")(run)


_units("paragraph_units", C.paragraphs, f"list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: regexp_replace(x, '^\\n+|\\n+$', '', 'g')), lambda x: {strip('x')} <> '')")
_units("sentence_units", C.sentences, f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: {strip('x')} <> '')")
_units("poem_units", C.poems, f"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\n[ \\t]*[-=*~]{{3,}}[ \\t]*\\n', chr(10) || chr(10) || chr(10), 'g'), '\\n{{3,}}'), lambda x: {strip('x')}), lambda x: length(x) >= 40)")

_ST = f"list_filter(list_transform(string_split({strip('text')}, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
_units("stanza_groups", C.stanza_groups, f"list_transform(range(1, len({_ST}) + 1, 2), lambda i: array_to_string(({_ST})[i:i + 1], chr(10) || chr(10)))")

_T = split_words("text")


@query(f"WITH t AS (SELECT doc_id, {_T} AS t FROM documents), b AS (SELECT doc_id, t, unnest(range(0, len(t) - 63, 32)) AS s FROM t WHERE len(t) >= 64) SELECT doc_id, (s // 32)::INT AS block_no, array_to_string(t[s + 1:s + 64], ' ') AS block FROM b")
def sliding_blocks(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(C.sliding_blocks(T.split_words("text"), 64)).alias("block_no", "b"))
    return rows.select("doc_id", "block_no", F.array_join("b", " ").alias("block"))


@query(f"WITH t AS (SELECT doc_id, {_T} AS t FROM documents), b AS (SELECT doc_id, t, unnest(range(0, len(t) // 64)) AS k FROM t WHERE len(t) >= 64) SELECT doc_id, k::INT AS block_no, array_to_string(t[k * 64 + 1:k * 64 + 64], ' ') AS block FROM b")
def fixed_blocks(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(C.fixed_blocks(T.split_words("text"), 64)).alias("block_no", "b"))
    return rows.select("doc_id", "block_no", F.array_join("b", " ").alias("block"))


@query()
def packed_chunks(spark, d):
    return C.packed_chunks(_docs(spark, d), "doc_id", "text")


_FR_SQL = r"^((?:And\s+)?(?:I|What|Who|Where|When|Why|How|O)[^\p{L}\p{N}_,;:.!?][^,;:.!?]{7,89})"


@query(f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, pos, trim(regexp_replace(line, '{SPACE}+', ' ', 'g')) AS line FROM l), g AS (SELECT doc_id, pos, regexp_extract(line, '{_FR_SQL}', 1) AS g FROM c WHERE len(string_split(line, ' ')) >= 3),
f AS (SELECT doc_id, pos, regexp_replace(array_to_string(string_split(trim(g, ' -'), ' ')[1:14], ' '), '[,;:.!?]+$', '') || ',' AS fragment FROM g WHERE g <> '')
SELECT doc_id, pos::INT AS pos, fragment FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, lower(fragment) ORDER BY pos) = 1""")
def reflective_fragments(spark, d):
    return C.reflective_fragments(_docs(spark, d).where("text is not null"), "doc_id", "text")


@query("SELECT doc_id, '<|begin|>' || text || '<|endoftext|><|endoftext|>' AS wrapped FROM documents")
def wrapped_text(spark, d):
    return _docs(spark, d).select("doc_id", F.concat(F.lit("<|begin|>"), "text", F.lit("<|endoftext|><|endoftext|>")).alias("wrapped"))


@query(f"SELECT doc_id, floor(len({_T}) * 1.3)::BIGINT AS n_tokens FROM documents")
def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", F.floor(F.size(T.split_words("text")) * F.lit(1.3)).alias("n_tokens"))


@query("SELECT doc_id, length(text)::INT AS n_chars, (length(text) - length(replace(text, chr(10), '')))::INT AS n_newlines FROM documents")
def newline_diagnostics(spark, d):
    return _docs(spark, d).select("doc_id", F.length("text").alias("n_chars"), F.regexp_count("text", F.lit("\n")).alias("n_newlines"))


@query("SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE rtrim(text[1:60]) || chr(10) || '...' END AS preview, CASE WHEN len(string_split(text, chr(10))) <= 14 THEN text ELSE array_to_string(string_split(text, chr(10))[1:14], chr(10)) || chr(10) || '  … (' || (len(string_split(text, chr(10))) - 14) || ' more lines)' END AS lines FROM documents")
def truncated_preview(spark, d):
    return _docs(spark, d).select("doc_id", T.preview("text", 60).alias("preview"), T.preview_lines("text").alias("lines"))


@query("WITH n AS (SELECT count(*) AS n FROM documents), i AS (SELECT round_even(k * (n - 1) / 9.0, 0)::BIGINT AS i FROM n, range(10) t(k)) SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) JOIN i ON i = r")
def evenly_spaced_docs(spark, d):
    from verseframe.operators.reviews import dense_rank_by

    docs = _docs(spark, d).select("doc_id")
    return dense_rank_by(docs, "doc_id", "r").where(F.col("r").isin([i + 1 for i in C.evenly_spaced(docs.count(), 10)])).select("doc_id")


@query("WITH c AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_row FROM c")
def group_offsets(spark, d):
    from pyspark.sql import Window

    per = _docs(spark, d).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("first_row", F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per source


@query(f"SELECT doc_id, {_N} AS n_words FROM documents ORDER BY n_words DESC, doc_id LIMIT 50")
def ranked_candidates(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.words("text")).alias("n_words")).orderBy(F.desc("n_words"), "doc_id").limit(50)


@query(f"SELECT DISTINCT coalesce(lower(trim(lang)), '') AS lang, coalesce(source, '') AS source FROM documents")
def distinct_sources(spark, d):
    return _docs(spark, d).select(F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()


@query(f"SELECT doc_id, round({IMAGERY}, {R}) AS imagery_density, NULL::DOUBLE AS unheard_of FROM documents")
def metric_mask(spark, d):
    rows = M.with_metrics(_docs(spark, d).select("doc_id", "text"), "text", ["imagery_density", "unheard_of"])
    return rows.select("doc_id", F.round("imagery_density", R).alias("imagery_density"), "unheard_of")


_OUT = [x.replace("text", "output") for x in (IMAGERY, METAPHOR)]


@query(f"SELECT DISTINCT row_id, round({_OUT[0]} + {_OUT[1]} + repetition_index + (1 - semantic_similarity), {R}) AS surrealism_index FROM style_tradeoff_v1_20260311_191359")
def surrealism_index_rows(spark, d):
    # the two scores that need a parser and an embedder are stood in for by columns of the log
    rows = table(spark, d, "style_tradeoff_v1_20260311_191359").select("row_id", F.col("output").alias("text"), F.col("repetition_index").alias("surreal_imagery_score"), (1 - F.col("semantic_similarity")).alias("conceptual_distance_score"))
    return M.with_metrics(rows, "text", ["imagery_density", "metaphor_density"]).select("row_id", F.round(M.surrealism_index(), R).alias("surrealism_index")).distinct()


@query(f"""WITH t AS (SELECT regexp_extract_all(lower(title), '[a-z]+') AS w FROM documents), p AS (SELECT unnest(w[:-2]) AS word, unnest(w[2:]) AS lemma FROM t WHERE len(w) > 1), lex AS (SELECT unnest([{quoted(K.IMAGERY)}]) AS word)
SELECT word FROM lex UNION SELECT lemma FROM p SEMI JOIN lex USING (word)""")
def lexicon_expansion(spark, d):
    # words that follow one another in titles stand in for a table of synonyms
    w = F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))
    rest = F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))
    synonyms = _docs(spark, d).select(w.alias("w")).where("size(w) > 1").select(F.inline(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("word"), rest.alias("lemma"))))
    return C.expand_lexicon(spark.createDataFrame([(w,) for w in K.IMAGERY], "word string"), synonyms)


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
