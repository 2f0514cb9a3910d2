"""Meter, rhyme and phrase search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verseframe.functions import fixed as K, text as T


def extract_phrases(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, phrase, syllables: phrases of 2 to 7 words between marks, the first of each spelling (case apart)."""
    parts = F.filter(F.transform(F.split(F.col(text), r"[.!?\n,;]+"), T.clean_phrase), T.is_short_phrase)
    rows = df.select(key, F.posexplode(parts).alias("pos", "phrase"))
    first = Window.partitionBy(key, F.lower("phrase")).orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, "pos", "phrase", T.line_syllables("phrase").alias("syllables"))


def capped_by_type(phrases: DataFrame, key: str, kind: str, order: str, caps: dict[str, int]) -> DataFrame:
    """The first phrases of every type within each text, in their order, as many as its cap; types without a cap are left
    out. n_type tells how many of the type the text has."""
    group = Window.partitionBy(key, kind)
    rows = phrases.where(F.col(kind).isin(*caps)).withColumn("_r", F.row_number().over(group.orderBy(order))).withColumn("n_type", F.count(F.lit(1)).over(group))
    cap = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in caps.items()])
    return rows.where(F.col("_r") <= cap).drop("_r")


def haiku(phrases: DataFrame, key: str, most: int = 50) -> DataFrame:
    """key, rank, line1..3: phrases of 5, 7 and 5 syllables of one text in order of their places, the first `most`.

    The combinations are the result; of a text's candidates only as many are used as can reach the limit.
    """
    row = F.struct("pos", "phrase")
    per = phrases.where(F.col("syllables").isin(5, 7)).groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("syllables") == 5, row))).alias("five"), F.array_sort(F.collect_list(F.when(F.col("syllables") == 7, row))).alias("seven"))
    per = per.where((F.size("five") >= 2) & (F.size("seven") >= 1)).select(key, F.slice("five", 1, most + 1).alias("five"), F.slice("seven", 1, most).alias("seven"))
    trios = per.select(key, F.explode("five").alias("a"), "five", "seven").select(key, "a", F.explode("seven").alias("b"), "five").select(key, "a", "b", F.explode("five").alias("c")).where("a.pos <> c.pos")
    order = Window.partitionBy(key).orderBy("a.pos", "b.pos", "c.pos")
    return trios.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, "rank", F.col("a.phrase").alias("line1"), F.col("b.phrase").alias("line2"), F.col("c.phrase").alias("line3"))


def complement_pairs(phrases: DataFrame, key: str, target: int = 10, probes: int = 50, matches: int = 20) -> DataFrame:
    """key, first, second: phrases of one text whose syllables add up to the target; the longest `probes` phrases under
    the target, each with the first `matches` partners in order of place."""
    probe = phrases.where(F.col("syllables") < target).withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("syllables"), "pos"))).where(F.col("_p") <= probes)
    partner = phrases.withColumn("_m", F.row_number().over(Window.partitionBy(key, "syllables").orderBy("pos"))).where(F.col("_m") <= matches)
    a = probe.select(key, F.col("phrase").alias("first"), F.col("pos").alias("pos1"), (F.lit(target) - F.col("syllables")).alias("need"))
    b = partner.select(F.col(key).alias("_k"), F.col("phrase").alias("second"), F.col("pos").alias("pos2"), F.col("syllables").alias("_s"))
    return a.join(b, (F.col(key) == F.col("_k")) & (F.col("need") == F.col("_s"))).select(key, "first", "second", "pos1", "pos2")


def complement_triples(phrases: DataFrame, key: str, target: int = 10, probes: int = 50, matches: int = 10) -> DataFrame:
    """key, first, second, third: three phrases of one text whose syllables add up to the target; the same probes as for
    pairs, with every split of the rest into two parts of 2 or more and the first `matches` phrases of each part."""
    probe = phrases.where(F.col("syllables") < target).withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("syllables"), "pos"))).where(F.col("_p") <= probes)
    per = phrases.where(F.col("syllables").between(2, target - 3)).withColumn("_m", F.row_number().over(Window.partitionBy(key, "syllables").orderBy("pos"))).where(F.col("_m") <= matches)
    a = probe.select(key, F.col("phrase").alias("first"), F.col("pos").alias("pos1"), (F.lit(target) - F.col("syllables")).alias("need"))
    b = per.select(F.col(key).alias("_k2"), F.col("phrase").alias("second"), F.col("pos").alias("pos2"), F.col("syllables").alias("_s2"))
    c = per.select(F.col(key).alias("_k3"), F.col("phrase").alias("third"), F.col("pos").alias("pos3"), F.col("syllables").alias("_s3"))
    rest = b.join(c, F.col("_k2") == F.col("_k3")).withColumn("_sum", F.col("_s2") + F.col("_s3")).where(F.col("_sum") <= target)
    return a.join(rest, (F.col(key) == F.col("_k2")) & (F.col("need") == F.col("_sum"))).select(key, "first", "second", "third", "pos1", "pos2", "pos3")


def meter(stress: Column | str) -> Column:
    """"strict", "substituted" (one or two trochees) or null for a string of stresses, 2 counting as 1."""
    s = F.translate(F.col(stress) if isinstance(stress, str) else stress, "2", "1")
    feet = F.transform(F.sequence(F.lit(1), F.lit(9), F.lit(2)), lambda i: F.substr(s, i, F.lit(2)))
    turned = F.size(F.filter(feet, lambda f: f == "10"))
    fits = (F.length(s) == 10) & F.forall(feet, lambda f: f.isin("01", "10"))
    return F.when(fits & (turned == 0), "strict").when(fits & (turned <= 2), "substituted")


def metrical_trims(words: Column, stresses: Column) -> Column:
    """Cuts of a line that scan: structs (drop_start, drop_end, stress); up to two words off an end, both ends only of lines over six words.

    words and stresses are arrays of equal length; a line more than two syllables off gives only cuts of both ends.
    """
    n = F.size(words)
    total = F.aggregate(stresses, F.lit(0), lambda a, x: a + F.length(x))
    near = F.abs(total - 10) <= 2
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(3)])
    made = F.transform(cuts, lambda c: F.struct(c["i"].alias("drop_start"), c["j"].alias("drop_end"), F.array_join(F.slice(stresses, c["i"] + 1, F.greatest(n - c["i"] - c["j"], F.lit(0))), "").alias("stress")))

    def ok(c: Column) -> Column:
        kept = n - c["drop_start"] - c["drop_end"]
        plain = (c["drop_start"] == 0) & (c["drop_end"] == 0) & (total == 10)
        front = (c["drop_start"] > 0) & (c["drop_end"] == 0) & near & (c["drop_start"] < n)
        back = (c["drop_start"] == 0) & (c["drop_end"] > 0) & near & (kept >= 3)
        both = (c["drop_start"] > 0) & (c["drop_end"] > 0) & (n > 6) & (kept >= 3)
        return (plain | front | back | both) & meter(c["stress"]).isNotNull()

    return F.filter(made, ok)


def rhyme_key(phonemes: Column) -> Column:
    """Phonemes from the last stressed vowel on, joined by blanks; null without one."""
    stressed = F.transform(phonemes, lambda p: p.rlike("[12]$") & F.substring(p, 1, 2).isin(list(K.RHYME_VOWELS)))
    back = F.array_position(F.reverse(stressed), F.lit(True)).cast("int")
    return F.when(back > 0, F.array_join(F.slice(phonemes, -F.greatest(back, F.lit(1)), F.greatest(back, F.lit(1))), " "))


def couplets(lines: DataFrame, group: str | None = None, require_rhyme: bool = True, min_grammar: float = 80.0) -> DataFrame:
    """Ordered pairs of lines (id, words, grammar, rhyme, vector) with their score.

    With rhyme the pairs meet on the rhyme key, else on `group`, which must then be named: lines are never paired with
    all others. Pairs with the same last word, over 0.15 of common content words or too many common n-grams are left out.
    """
    if not require_rhyme and group is None:
        raise ValueError("pairs without rhyme need a group")
    sets = {"_content": T.content_words(F.col("words")), **{f"_g{n}": T.ngrams(F.col("words"), n) for n in K.NGRAM_LIMITS}}  # once for each line
    end = F.lower(F.regexp_replace(F.try_element_at("words", F.lit(-1)), "[^a-zA-Z]", ""))
    good = lines.where(F.col("grammar") >= min_grammar).withColumns({"_end": end, **sets})
    keys = ([group] if group else []) + (["rhyme"] if require_rhyme else [])
    own = ("id", "words", "grammar", "vector", "_end", *sets)
    a, b = (good.select(*keys, *[F.col(c).alias(f"{c}{k}") for c in own], *([] if require_rhyme else [F.col("rhyme").alias(f"rhyme{k}")])) for k in (1, 2))
    pairs = a.join(b.hint("merge"), keys).where("id1 <> id2 and _end1 <> _end2")
    pairs = pairs.withColumn("word_overlap", T.jaccard(F.col("_content1"), F.col("_content2"))).where("word_overlap <= 0.15")
    for n, limit in K.NGRAM_LIMITS.items():
        pairs = pairs.withColumn(f"o{n}", T.dice(F.col(f"_g{n}1"), F.col(f"_g{n}2"))).where(F.col(f"o{n}") <= limit)
    pairs = pairs.drop(*[f"{c}{k}" for c in sets for k in (1, 2)])
    from verseframe.functions.vectors import cosine_eps

    rhymes = F.lit(True) if require_rhyme else F.coalesce(F.col("rhyme1") == F.col("rhyme2"), F.lit(False))
    pairs = pairs.withColumn("similarity", cosine_eps("vector1", "vector2")).withColumn("rhymes", rhymes)
    return pairs.withColumn("score", couplet_score(F.col("grammar1"), F.col("grammar2"), F.col("similarity"), F.col("rhymes"), (F.col("o2") + F.col("o3") + F.col("o4")) / 3, F.col("word_overlap")))


def couplet_score(g1: Column, g2: Column, similarity: Column, rhymes: Column, overlap: Column, repetition: Column) -> Column:
    s = F.when(similarity > 0.9, 50.0).when(similarity > 0.7, 70.0).otherwise(similarity * 100)
    return g1 * 0.3 + g2 * 0.3 + s * 0.2 + F.when(rhymes, 20.0).otherwise(0.0) - overlap * 50 - repetition * 100


def best_couplet(pairs: DataFrame, *keys: str) -> DataFrame:
    """The pair of the largest score per key; of equal scores the one first in order of id1, id2."""
    best = F.max_by(F.struct("id1", "id2", "score"), F.struct(F.round("score", 9), -F.col("id1"), -F.col("id2"))).alias("_b")
    return pairs.groupBy(*keys).agg(best).select(*keys, "_b.*")


def dictionary_syllables(words: DataFrame, word: str, dictionary: DataFrame) -> DataFrame:
    """words with n_syllables: the fewest vowels of a word's pronunciations (word, phonemes), else by vowel groups."""
    counts = dictionary.groupBy(F.col("word").alias("_w")).agg(F.min(F.size(F.filter("phonemes", lambda p: p.rlike("[0-9]$")))).alias("_n"))
    return words.join(counts, F.lower(F.regexp_replace(word, "[^a-zA-Z]", "")) == F.col("_w"), "left").withColumn("n_syllables", F.coalesce("_n", T.syllables(word))).drop("_w", "_n")
