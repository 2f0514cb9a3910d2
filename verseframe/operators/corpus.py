"""Corpus preparation: cleaning, splitting, blocks and chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from verseframe.functions import fixed as K, text as T


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), line."""
    return df.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("pos", "line"))


def without_metadata(df: DataFrame, text: str) -> Column:
    """The text without lines of page furniture."""
    return F.array_join(F.filter(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n"), lambda x: ~T.is_metadata(x)), "\n")


def frequent(keys: Column, more_than: int) -> Column:
    """The elements that occur more than so many times; nulls are none. Sorted once."""

    def of(k: Column) -> Column:
        ahead = F.slice(k, more_than + 1, F.greatest(F.size(k), F.lit(1)))
        same = F.filter(F.arrays_zip(k.alias("a"), ahead.alias("b")), lambda x: x["a"] == x["b"])
        return F.array_distinct(F.transform(same, lambda x: x["a"]))

    return T.bind(F.array_sort(F.array_compact(keys)), of)


def without_repeated_titles(df: DataFrame, key: str, text: str, more_than: int = 2) -> DataFrame:
    """key, body: each text without the lines whose title key occurs more than twice in it.

    All within a row, without a shuffle. A null text gives no row.
    """

    def of(rows: Column) -> Column:
        many = frequent(F.transform(rows, lambda x: x["k"]), more_than)
        kept = lambda often: F.filter(rows, lambda x: x["k"].isNull() | ~F.array_contains(often, x["k"]))
        return T.bind(many, lambda often: F.array_join(F.transform(kept(often), lambda x: x["line"]), "\n"))

    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(x.alias("line"), T.title_key(x).alias("k")))
    return df.where(F.col(text).isNotNull()).select(key, T.bind(lines, of).alias("body"))


def clean_source(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, body: headers, page furniture and repeated titles off, blanks normalised, line breaks kept."""
    t = F.replace(F.regexp_replace(T.strip_headers(text), "\r\n?", "\n"), F.lit("\ufeff"), F.lit(""))
    t = F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, T.SPACE + r"+$", "")), lambda x: ~T.is_metadata(x)), "\n")
    bare = without_repeated_titles(df.select(key, t.alias("_t")), key, "_t")
    body = F.regexp_replace(F.regexp_replace("body", "[ \t]{2,}", " "), "(?m)[ \t]+$", "")
    return bare.select(key, T.strip(F.regexp_replace(body, "\n{4,}", "\n\n\n")).alias("body"))


def paragraphs(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(t, "\n{2,}"), lambda x: F.regexp_replace(x, "^\n+|\n+$", "")), lambda x: T.strip(x) != "")


def sentences(text: Column | str) -> Column:
    """Parts after . ! ? ; : and white space, ends stripped."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(t, r"(?<=[.!?;:])\s+"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: T.strip(x) != "")


def poems(text: Column | str, min_chars: int = 40) -> Column:
    """Parts between rule lines or two blank lines, at least min_chars long."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\n[ \t]*[-=*~]{3,}[ \t]*\n", "\n\n\n")
    return F.filter(F.transform(F.split(t, "\n{3,}"), T.strip), lambda x: F.length(x) >= min_chars)


def stanza_groups(text: Column | str, size: int = 2, min_lines: int = 1) -> Column:
    """Stanzas of at least min_lines lines in groups of `size`, the last may be short, joined by blank lines."""
    stanzas = F.filter(F.transform(F.split(T.strip(text), "\n\n"), T.strip), lambda x: (x != "") & (F.size(F.split(x, "\n")) >= min_lines))
    starts = lambda s: F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return T.bind(stanzas, lambda s: F.transform(starts(s), lambda i: F.array_join(F.slice(s, i, size), "\n\n")))


def sliding_blocks(tokens: Column, block: int) -> Column:
    """Blocks of `block` tokens at half-block steps; the tail is dropped, a shorter array gives none."""
    step = max(1, block // 2)

    def of(t: Column) -> Column:
        last = F.size(t) - block
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(t, i + 1, block))

    return T.bind(tokens, of)


def fixed_blocks(tokens: Column, block: int) -> Column:
    """Consecutive blocks of `block` tokens of one batch; the remainder is dropped."""

    def of(t: Column) -> Column:
        n = F.floor(F.size(t) / block).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(t, i * block + 1, block))

    return T.bind(tokens, of)


_SENTENCE_END = re.compile(r"(?<=[.!?;:])(?=\s)")


def split_unit(unit: str, hard: int, size_of: Callable[[str], int]) -> list[str]:
    """The unit in parts of at most `hard` tokens: runs of whole sentences, of a longer sentence runs of lines, of a
    longer line runs of words; only a single word over the limit stays over it."""

    def runs(parts: list[str], cut: Callable[[str], list[str]] | None) -> list[str]:
        out, held = [], ""
        for part in parts:
            if held and size_of(held + part) > hard:
                out.append(held)
                held = ""
            if not held and cut and size_of(part) > hard:
                out += cut(part)
            else:
                held += part
        return out + [held]

    words = lambda line: runs(re.findall(r"\s*\S+\s*?(?=\s|$)|\s+$", line), None)
    lines = lambda sentence: runs(sentence.splitlines(keepends=True), words)
    found = [unit] if size_of(unit) <= hard else runs(_SENTENCE_END.split(unit), lines)
    return [x.strip() for x in found if x.strip()]


def pack_units(units: list[str], sizes: list[int], target: int, most: int, hard: int, overlap: float, size_of: Callable[[str], int]) -> list[str]:
    """Consecutive units in chunks of about `target` tokens, never over `most` unless one unit is; a chunk starts
    with the last units of the one before, up to `overlap` of its size, and always at least one unit further."""
    out, start = [], 0
    while start < len(units):
        end, total = start, 0
        while end < len(units) and (end == start or (total < target and total + sizes[end] <= most)):
            total += sizes[end]
            end += 1
        chunk = "\n\n".join(units[start:end]).strip()
        out += [chunk] if size_of(chunk) <= hard else split_unit(chunk, hard, size_of)
        if end >= len(units):
            break
        budget, back, taken = int(size_of(chunk) * overlap), end, 0
        while budget > 0 and back > start + 1 and taken < budget and (taken == 0 or taken + sizes[back - 1] <= budget):
            back -= 1
            taken += sizes[back]
        start = max(back, start + 1)
    return [c for c in out if size_of(c) > 0]


def packed_chunks(df: DataFrame, key: str, text: str, target: int = K.CHUNK_TARGET, most: int = K.CHUNK_MAX, hard: int = K.CHUNK_HARD, overlap: float = K.CHUNK_OVERLAP, size_of: Callable[[str], int] | None = None) -> DataFrame:
    """key, chunk_no, chunk, n_tokens of every text, its paragraphs packed in order; a paragraph over the hard limit is
    split first. size_of counts tokens (words by default), such as token_counter of a tokenizer file.

    A fold over one text: each row is chunked where it lies, without a shuffle. Null and blank texts give no chunks.
    """
    count = size_of or (lambda s: len(s.split()))
    rows = df.select(key, paragraphs(text).alias("units")).where(F.size("units") > 0)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, units in zip(b[key], b["units"]):
                units = [part for u in units for part in split_unit(u, hard, count)]
                for i, c in enumerate(pack_units(units, [count(u) for u in units], target, most, hard, overlap, count)):
                    out.append((k, i, c, count(c)))
            yield pd.DataFrame(out, columns=[key, "chunk_no", "chunk", "n_tokens"])

    return rows.mapInPandas(run, f"{key} {kind}, chunk_no int, chunk string, n_tokens int")


def token_counter(path: str) -> Callable[[str], int]:
    """size_of for packed_chunks from a tokenizers JSON file, loaded once in each worker."""
    loaded: list = []

    def count(text: str) -> int:
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(path))
        return len(loaded[0].encode(text, add_special_tokens=False))

    return count


def prepared_samples(df: DataFrame, key: str, text: str, fragments: tuple[str, ...] = (), prefix_rate: float = 0.15, begin: str = "", seed: int = 42, size_of: Callable[[str], int] | None = None, **budgets) -> DataFrame:
    """key, chunk_no, n_tokens, text: the whole preparation of a corpus: sources cleaned, packed into chunks, a share of
    them opened by one of the fragments, and each led by the token `begin`. budgets: those of packed_chunks."""
    from verseframe.operators.sampling import bernoulli_prefix

    chunks = packed_chunks(clean_source(df.where(F.col(text).isNotNull()), key, text), key, "body", size_of=size_of, **budgets)
    body = bernoulli_prefix("chunk", F.array(*[F.lit(f) for f in fragments]), F.concat_ws(":", F.col(key).cast("string"), F.col("chunk_no").cast("string")), prefix_rate, seed) if fragments else F.col("chunk")
    return chunks.select(key, "chunk_no", "n_tokens", F.concat(F.lit(begin), body).alias("text"))


def batched_map(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str, batch_size: int = 1000) -> DataFrame:
    """The rows that `function` makes of batches of at most batch_size rows, given and returned as lists by column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch_size):
                yield pd.DataFrame(function({c: v.tolist() for c, v in b.iloc[lo : lo + batch_size].items()}))

    return df.mapInPandas(run, schema)


def clean_responses(df: DataFrame, prompt: str, factory: Callable[[list[str]], list[str]], retry: Callable[[list[str]], list[str]] | None = None, out: str = "response", batch_size: int = 64) -> DataFrame:
    """df with the sanitised answer to each prompt. factory answers a list of prompts; where nothing is left of an answer,
    retry (if given) is asked once more, and the fixed fallback stands for what still has none. Null prompts are asked as
    empty ones."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

    def ask(make: Callable[[list[str]], list[str]]) -> Callable[[dict[str, list]], dict[str, list]]:
        return lambda b: {**b, "_raw": make([p or "" for p in b[prompt]])}

    first = batched_map(df, ask(factory), f"{fields}, _raw string", batch_size).withColumn(out, T.sanitize_output("_raw")).drop("_raw")
    if retry is None:
        return first.withColumn(out, F.coalesce(F.nullif(out, F.lit("")), F.lit(K.FALLBACK)))

    def again(b: dict[str, list]) -> dict[str, list]:
        open_ = [i for i, r in enumerate(b[out]) if not r]
        said = retry([b[prompt][i] or "" for i in open_]) if open_ else []
        raw = [None] * len(b[out])
        for i, text in zip(open_, said):
            raw[i] = text
        return {**b, "_raw": raw}

    second = batched_map(first, again, f"{fields}, {out} string, _raw string", batch_size)
    return second.withColumn(out, F.coalesce(F.nullif(out, F.lit("")), F.nullif(T.sanitize_output("_raw"), F.lit("")), F.lit(K.FALLBACK))).drop("_raw")


def embedded(df: DataFrame, column: str, make_encoder: Callable[[], object], out: str = "embedding", batch_size: int = 64) -> DataFrame:
    """df with the normalised vectors of a text column. make_encoder gives any object with
    encode(list of texts, normalize_embeddings=True); it is made once in each task, and a text once in each batch. Null
    texts get null."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema.fields)}, {out} array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for b in batches:
            texts = list(dict.fromkeys(t for t in b[column] if t is not None))
            vectors: dict[str, list[float]] = {}
            for lo in range(0, len(texts), batch_size):
                part = texts[lo : lo + batch_size]
                vectors.update(zip(part, ([float(x) for x in v] for v in encoder.encode(part, normalize_embeddings=True))))
            yield b.assign(**{out: [vectors.get(t) for t in b[column]]})

    return df.mapInPandas(run, schema)


def reflective_fragments(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, fragment: openings of lines that begin in the first person or with a question word, first of each kept."""
    rows = lines(df, key, text).select(key, "pos", F.trim(F.regexp_replace("line", T.SPACE + "+", " ")).alias("line"))
    rows = rows.where(F.size(F.split("line", " ")) >= 3)
    got = F.regexp_extract("line", r"^((?:And\s+)?(?:I|What|Who|Where|When|Why|How|O)\b[^,;:.!?]{8,90})", 1)
    words = F.split(F.btrim(got, F.lit(" -")), " ")
    frag = F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, 14), " "), "[,;:.!?]+$", ""), F.lit(","))
    rows = rows.where(got != "").select(key, "pos", frag.alias("fragment"))
    first = Window.partitionBy(key, F.lower("fragment")).orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def expand_lexicon(lexicon: DataFrame, synonyms: DataFrame) -> DataFrame:
    """word: the words of the lexicon and those of their synonyms (word, lemma) that are one word in small letters."""
    more = synonyms.join(lexicon.select("word").distinct(), "word", "left_semi").where(F.col("lemma").rlike("^[a-z]+$"))
    return lexicon.select("word").unionByName(more.select(F.col("lemma").alias("word"))).distinct()


def length_bucket(n: Column, edges: list[tuple[str, Column]]) -> Column:
    out = None
    for name, test in edges:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def evenly_spaced(total: int, count: int, half_even: bool = True) -> list[int]:
    """Indices of `count` items spread over `total`."""
    count = min(count, total)
    if count <= 1:
        return [0] if total else []
    return [round(i * (total - 1) / (count - 1)) if half_even else int(i * (total - 1) / (count - 1)) for i in range(count)]
