"""Syllables, phrases, meter, rhyme and couplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verseframe.functions import fixed as K, text as T
from verseframe.operators import prosody as P
from verseframe.operators.spread import spread
from verseframe.plans.book import Book, quoted, split_words, words as words_sql
from verseframe.sources import table

BOOK = Book()
query = BOOK.query


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null"))


def _syl(w: str) -> str:
    c = f"lower(regexp_replace({w}, '[^a-zA-Z]', '', 'g'))"
    g = f"len(regexp_extract_all({c}, '[aeiouy]+'))"
    return f"CASE WHEN {c} = '' THEN 0 ELSE greatest(1, CASE WHEN ends_with({c}, 'e') THEN greatest(1, {g} - 1) ELSE {g} END) END"


@query(f"WITH w AS (SELECT DISTINCT unnest({split_words('text')}) AS word FROM documents) SELECT word, ({_syl('word')})::INT AS n_syllables FROM w")
def syllable_counts(spark, d):
    return _docs(spark, d).select(F.explode(T.split_words("text")).alias("word")).distinct().select("word", T.syllables("word").alias("n_syllables"))


_PW = split_words("phrase")
_PHRASES = f"""parts AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n,;]+'), lambda x: trim(regexp_replace(x, '[^a-zA-Z'' ]+', '', 'g'))), lambda phrase: len({_PW}) BETWEEN 2 AND 7 AND len(list_filter({_PW}, lambda w: lower(w) NOT IN ({quoted(K.ARTICLES)}))) > 0)) AS phrase,
generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n,;]+'), lambda x: trim(regexp_replace(x, '[^a-zA-Z'' ]+', '', 'g'))), lambda phrase: len({_PW}) BETWEEN 2 AND 7 AND len(list_filter({_PW}, lambda w: lower(w) NOT IN ({quoted(K.ARTICLES)}))) > 0), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
ph AS (SELECT doc_id, pos::INT AS pos, phrase, coalesce(list_sum(list_transform({_PW}, lambda w: {_syl('w')})), 0)::INT AS syllables FROM parts QUALIFY row_number() OVER (PARTITION BY doc_id, lower(phrase) ORDER BY pos) = 1)"""


@query(f"WITH {_PHRASES} SELECT doc_id, pos, phrase, syllables FROM ph")
def short_phrases(spark, d):
    return P.extract_phrases(_docs(spark, d), "doc_id", "text")


@query(f"""WITH {_PHRASES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, syllables ORDER BY pos) AS k FROM ph WHERE syllables IN (5, 7)),
t AS (SELECT a.doc_id, a.pos AS p1, b.pos AS p2, c.pos AS p3, a.phrase AS line1, b.phrase AS line2, c.phrase AS line3 FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.syllables = 5 AND b.syllables = 7 JOIN f c ON c.doc_id = a.doc_id AND c.syllables = 5 AND c.pos <> a.pos WHERE a.k <= 51 AND b.k <= 50 AND c.k <= 51)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3)::INT AS rank, line1, line2, line3 FROM t QUALIFY rank <= 50""")
def haiku_combinations(spark, d):
    return P.haiku(P.extract_phrases(_docs(spark, d), "doc_id", "text"), "doc_id")


@query(f"""WITH {_PHRASES}, a AS (SELECT * FROM ph WHERE syllables < 10 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY syllables DESC, pos) <= 50), b AS (SELECT * FROM ph QUALIFY row_number() OVER (PARTITION BY doc_id, syllables ORDER BY pos) <= 20)
SELECT a.doc_id, a.phrase AS first, b.phrase AS second FROM a JOIN b ON a.doc_id = b.doc_id AND b.syllables = 10 - a.syllables""")
def complement_sum_pairs(spark, d):
    return P.complement_pairs(P.extract_phrases(_docs(spark, d), "doc_id", "text"), "doc_id").select("doc_id", "first", "second")


_CAPS = {"short": 30, "middle": 20, "long": 15}


@query(f"""WITH {_PHRASES}, t AS (SELECT *, CASE WHEN syllables <= 3 THEN 'short' WHEN syllables <= 6 THEN 'middle' WHEN syllables <= 9 THEN 'long' ELSE 'over' END AS kind FROM ph)
SELECT doc_id, pos, kind, count(*) OVER (PARTITION BY doc_id, kind) AS n_type FROM t WHERE kind <> 'over' QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) <= CASE kind WHEN 'short' THEN 30 WHEN 'middle' THEN 20 ELSE 15 END""")
def phrases_by_type(spark, d):
    n = F.col("syllables")
    rows = P.extract_phrases(_docs(spark, d), "doc_id", "text").withColumn("kind", F.when(n <= 3, "short").when(n <= 6, "middle").when(n <= 9, "long").otherwise("over"))
    return P.capped_by_type(rows, "doc_id", "kind", "pos", _CAPS).select("doc_id", "pos", "kind", "n_type")


@query(f"""WITH {_PHRASES}, a AS (SELECT * FROM ph WHERE syllables < 10 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY syllables DESC, pos) <= 50), b AS (SELECT * FROM ph WHERE syllables BETWEEN 2 AND 7 QUALIFY row_number() OVER (PARTITION BY doc_id, syllables ORDER BY pos) <= 10)
SELECT a.doc_id, a.phrase AS first, b.phrase AS second, c.phrase AS third FROM a JOIN b ON a.doc_id = b.doc_id JOIN b c ON c.doc_id = a.doc_id AND b.syllables + c.syllables = 10 - a.syllables""")
def complement_sum_triples(spark, d):
    return P.complement_triples(P.extract_phrases(_docs(spark, d), "doc_id", "text"), "doc_id").select("doc_id", "first", "second", "third")


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"


@query(f"""{_LINES}, w AS (SELECT doc_id, pos::INT AS pos, list_filter(list_transform({split_words('line')}, lambda x: lower(x)), lambda x: x NOT IN ({quoted(K.MAY_REPEAT)})) AS w FROM l) SELECT doc_id, pos FROM w WHERE len(w) > len(list_distinct(w))""")
def repeated_word_lines(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(T.has_repeats(T.split_words("line"))).select("doc_id", "pos")


def _stresses(spark):
    return spark.range(3**10).select(F.lpad(F.conv(F.col("id").cast("string"), 10, 3), 10, "0").alias("stress"))


@query("""WITH s AS (SELECT array_to_string(list_transform(range(9, -1, -1), lambda p: ((i // (3 ** p)::BIGINT) % 3)::VARCHAR), '') AS stress FROM range(59049) t(i)), n AS (SELECT stress, replace(stress, '2', '1') AS z FROM s),
f AS (SELECT stress, list_transform([1, 3, 5, 7, 9], lambda k: z[k:k + 1]) AS f FROM n) SELECT stress, CASE WHEN len(list_filter(f, lambda x: x = '10')) = 0 THEN 'strict' ELSE 'substituted' END AS meter FROM f WHERE len(list_filter(f, lambda x: x IN ('01', '10'))) = 5 AND len(list_filter(f, lambda x: x = '10')) <= 2""")
def meter_test(spark, d):
    return _stresses(spark).select("stress", P.meter("stress").alias("meter")).where("meter is not null")


_LW = split_words("line")


@query(f"""{_LINES}, w AS (SELECT doc_id, pos::INT AS pos, {_LW} AS w FROM l), s AS (SELECT doc_id, pos, len(w) AS n, list_transform(w, lambda x: CASE WHEN {_syl('x')} = 1 THEN CASE WHEN x IN ({quoted(K.OVERLAP_STOP)}) THEN '0' ELSE '1' END ELSE repeat('10', 8)[1:{_syl('x')}] END) AS st FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, pos, n, i, j, length(array_to_string(st, '')) AS total, CASE WHEN n - i - j > 0 THEN array_to_string(st[i + 1:n - j], '') ELSE '' END AS stress FROM s, range(3) a(i), range(3) b(j)),
f AS (SELECT *, list_transform([1, 3, 5, 7, 9], lambda k: replace(stress, '2', '1')[k:k + 1]) AS f FROM c WHERE length(stress) = 10)
SELECT doc_id, pos, i::INT AS drop_start, j::INT AS drop_end, stress FROM f WHERE len(list_filter(f, lambda x: x IN ('01', '10'))) = 5 AND len(list_filter(f, lambda x: x = '10')) <= 2
AND ((i = 0 AND j = 0 AND total = 10) OR (i > 0 AND j = 0 AND abs(total - 10) <= 2 AND i < n) OR (i = 0 AND j > 0 AND abs(total - 10) <= 2 AND n - j >= 3) OR (i > 0 AND j > 0 AND n > 6 AND n - i - j >= 3))""")
def meter_trim(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("words", T.split_words("line")).where(F.size("words") > 0)
    stress = F.transform("words", lambda w: T.bind(T.syllables(w), lambda n: F.when(n == 1, F.when(w.isin(list(K.OVERLAP_STOP)), "0").otherwise("1")).otherwise(F.substr(F.repeat(F.lit("10"), 8), F.lit(1), n))))
    return lines.select("doc_id", "pos", F.inline(T.bind(stress, lambda s: P.metrical_trims(F.col("words"), s))))


def _grams_sql(x: str, n: int) -> str:
    return f"list_distinct(CASE WHEN len({x}) >= {n} THEN list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n - 1}], ' ')) ELSE [] END)"


def _dice_sql(n: int, a: str = "a", b: str = "b") -> str:
    a, b = _grams_sql(a, n), _grams_sql(b, n)
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _content_sql(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({x}, lambda w: lower(w)), lambda w: w NOT IN ({quoted(K.OVERLAP_STOP)})))"


_CA, _CB = _content_sql("a"), _content_sql("b")
_JACCARD = f"CASE WHEN len({_CA}) = 0 OR len({_CB}) = 0 THEN 0 ELSE len(list_intersect({_CA}, {_CB})) / len(list_distinct(list_concat({_CA}, {_CB}))) END"
_COUPLETS = f"""{_LINES}, w AS (SELECT doc_id, pos::INT AS id, {_LW} AS w FROM l), e AS (SELECT *, lower(regexp_replace(w[-1], '[^a-zA-Z]', '', 'g')) AS tail FROM w WHERE len(w) > 0),
r AS (SELECT *, regexp_extract(tail, '([aeiouy]+[^aeiouy]*e?)$', 1) AS rhyme FROM e WHERE tail <> ''),
p AS (SELECT x.doc_id, x.id AS id1, y.id AS id2, x.w AS a, y.w AS b FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.rhyme = y.rhyme AND x.id <> y.id AND x.tail <> y.tail WHERE x.rhyme <> ''),
j AS (SELECT *, {_JACCARD} AS jaccard FROM p), o AS (SELECT doc_id, id1, id2, jaccard, {_dice_sql(2)} AS o2, {_dice_sql(3)} AS o3, {_dice_sql(4)} AS o4 FROM j WHERE jaccard <= 0.15),
c AS (SELECT doc_id, id1, id2, 54.0 + 10.0 + 20.0 - (o2 + o3 + o4) / 3 * 50 - jaccard * 100 AS score FROM o WHERE o2 <= 0.5 AND o3 <= 0.3 AND o4 <= 0.2)"""


@query(f"{_COUPLETS} SELECT doc_id, id1, id2, round(score, 6) AS score FROM c")
def couplet_pairs(spark, d):
    return _couplets(spark, d).select("doc_id", "id1", "id2", F.round("score", 6).alias("score"))


def _couplets(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("id", "line")).withColumn("words", T.split_words("line")).where(F.size("words") > 0)
    end = F.lower(F.regexp_replace(F.try_element_at("words", F.lit(-1)), "[^a-zA-Z]", ""))
    lines = lines.withColumn("rhyme", F.nullif(F.regexp_extract(end, "([aeiouy]+[^aeiouy]*e?)$", 1), F.lit(""))).where("rhyme is not null")
    return P.couplets(lines.select("doc_id", "id", "words", F.lit(90.0).alias("grammar"), "rhyme", F.lit(None).cast("array<double>").alias("vector")), group="doc_id")


@query(f"{_COUPLETS} SELECT doc_id, id1, id2, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, id1, id2) = 1")
def best_couplet(spark, d):
    return P.best_couplet(_couplets(spark, d), "doc_id").withColumn("score", F.round("score", 6))


_LL = f"WITH o AS (SELECT DISTINCT row_id, id, {split_words('poem')} AS w FROM outputs_flat WHERE poem IS NOT NULL), f AS (SELECT id, arg_min(w, row_id) AS a, arg_max(w, row_id) AS b, count(*) AS n FROM o GROUP BY id)"


@query(f"""{_LL} SELECT id, round({_dice_sql(2)}, 6) AS o2, round({_dice_sql(3)}, 6) AS o3, round({_JACCARD}, 6) AS jaccard FROM f WHERE n >= 2""")
def ngram_overlap_pairs(spark, d):
    rows = table(spark, d, "outputs_flat").where("poem is not null").select("row_id", "id", T.split_words("poem").alias("w")).distinct()
    f = rows.groupBy("id").agg(F.min_by("w", "row_id").alias("a"), F.max_by("w", "row_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    a, b = F.col("a"), F.col("b")
    return f.select("id", *[F.round(T.dice(T.ngrams(a, n), T.ngrams(b, n)), 6).alias(f"o{n}") for n in (2, 3)], F.round(T.content_jaccard(a, b), 6).alias("jaccard"))


#: A pronunciation by spelling, for want of a dictionary: vowel letters are stressed where they come first.
_VOWELS = {"a": "AE", "e": "EH", "i": "IH", "o": "AO", "u": "AH"}


def _dictionary(spark, d):
    words = table(spark, d, "eval_items").select(F.explode(T.words("text")).alias("word")).select(F.regexp_replace("word", "[^a-z]", "").alias("word")).where("word <> ''").distinct()
    first = F.regexp_instr("word", F.lit("[aeiou]"))
    sound = lambda c, i: F.coalesce(*[F.when(c == v, F.concat(F.lit(p), F.when(i == first - 1, "1").otherwise("0"))) for v, p in _VOWELS.items()], F.upper(c))
    return words.select("word", F.transform(F.split("word", ""), sound).alias("phonemes"))


_CASES = " ".join(f"WHEN '{v}' THEN '{p}' || CASE WHEN i = k THEN '1' ELSE '0' END" for v, p in _VOWELS.items())
_DICT = f"""ws AS (SELECT DISTINCT regexp_replace(unnest({words_sql('text')}), '[^a-z]', '', 'g') AS word FROM eval_items), ks AS (SELECT word, length(regexp_extract(word, '^[^aeiou]*')) + 1 AS k FROM ws WHERE word <> ''),
dict AS (SELECT word, k, list_transform(string_split(word, ''), lambda c, i: CASE c {_CASES} ELSE upper(c) END) AS phonemes FROM ks)"""


@query(f"""WITH {_DICT}, r AS (SELECT word, array_to_string(phonemes[k:], ' ') AS rhyme FROM dict WHERE k <= length(word)) SELECT word, rhyme, (count(*) OVER (PARTITION BY rhyme) - 1)::BIGINT AS n_rhymes FROM r""")
def rhyme_classes(spark, d):
    keyed = _dictionary(spark, d).select("word", P.rhyme_key(F.col("phonemes")).alias("rhyme")).where("rhyme is not null")
    return keyed.join(keyed.groupBy("rhyme").agg((F.count(F.lit(1)) - 1).alias("n_rhymes")), "rhyme").select("word", "rhyme", "n_rhymes")


@query(f"""WITH {_DICT}, w AS (SELECT DISTINCT unnest({split_words('text')}) AS word FROM documents), b AS (SELECT word, lower(regexp_replace(word, '[^a-zA-Z]', '', 'g')) AS bare FROM w), n AS (SELECT word AS bare, len(list_filter(phonemes, lambda p: regexp_matches(p, '[0-9]$'))) AS n FROM dict)
SELECT b.word, coalesce(n.n, {_syl('b.word')})::INT AS n_syllables FROM b LEFT JOIN n USING (bare)""")
def dictionary_syllables(spark, d):
    words = _docs(spark, d).select(F.explode(T.split_words("text")).alias("word")).distinct()
    return P.dictionary_syllables(words, "word", _dictionary(spark, d))


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
