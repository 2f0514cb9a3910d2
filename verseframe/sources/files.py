"""Readers for text, JSON and JSON-lines files."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from verseframe.functions import text as T

_ANY = "value variant"


def read_lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """file, line: stripped lines that are not blank, of a file or of the *.txt files of a folder (not below it)."""
    if missing_ok and "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "file string, line string")
    where = f"{path.rstrip('/')}/*.txt" if os.path.isdir(path) else path
    return spark.read.text(where).select(F.col("_metadata.file_name").alias("file"), T.strip("value").alias("line")).where("line <> ''")


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: every line of the files as it stands, blank ones too."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """word, phonemes: a pronouncing dictionary of lines "WORD  PH1 PH2", with WORD(2) for further ones; comments start
    with ;;; and words come in small letters."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit(";;;"))).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("p")).where("size(p) > 1")
    return rows.select(F.lower(F.regexp_replace(F.get("p", 0), r"\(\d+\)$", "")).alias("word"), F.slice("p", 2, F.size("p")).alias("phonemes"))


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """name, title, path, media of the files of a folder with one of the suffixes, to be sorted by lower name."""
    rows = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    kind = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    media = F.when(kind.isin("jpg", "jpeg"), "image/jpeg").when(kind.isin("png", "webp", "gif"), F.concat(F.lit("image/"), kind)).otherwise("other")
    title = F.regexp_replace(F.regexp_replace("name", r"\.[^.]+$", ""), "[-_]", " ")
    return rows.where(kind.isin(*[s.lstrip(".").lower() for s in suffixes])).select("name", title.alias("title"), F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20")).alias("path"), media.alias("media"))


def read_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file, text: one row per *.txt file that is not blank; bad bytes become U+FFFD. No such file raises."""
    reader = spark.read
    rows = reader.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=recursive).select(F.col("_metadata.file_path").alias("file"), T.strip("value").alias("text")).where("text <> ''")
    if rows.isEmpty():
        raise ValueError(f"no text in {path}")
    return rows


def _variant(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """prompt_id, prompt: of a text file the lines, numbered from 0 without blanks; of a JSON list its strings or objects
    (prompt, text or input; prompt_id, id, uid or index, an empty one counting as missing), or of {"prompts": [...]}."""
    from pyspark.sql import Window

    if path.endswith(".txt"):
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n"), T.strip), lambda x: x != "")).alias("i", "prompt"))
        return rows.select(F.col("i").cast("string").alias("prompt_id"), "prompt")
    items = _variant(spark, path).select(F.coalesce(F.try_variant_get("v", "$.prompts", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")).alias("a")).select(F.posexplode("a").alias("i", "x"))
    pick = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("x", f"$.{n}", "string"), F.lit("")) for n in names])
    text = F.when(F.schema_of_variant("x") == "STRING", F.try_variant_get("x", "$", "string")).otherwise(pick("prompt", "text", "input"))
    return items.select(F.coalesce(pick("prompt_id", "id", "uid", "index"), F.col("i").cast("string")).alias("prompt_id"), text.alias("prompt")).where(T.strip("prompt") != "")


def _review_items(spark: SparkSession, path: str) -> DataFrame:
    items = _variant(spark, path).select(F.coalesce(F.try_variant_get("v", "$.results", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")).alias("a"))
    return items.select(F.posexplode("a").alias("i", "x"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Review rows of a JSON list or {"results": [...]}: position, comparison_id (first of poem_id, comparison_id, id),
    reviewer (blank: reviewer_<1-based position>), model (missing: unknown-model), poem and the scores as doubles."""
    s = lambda n: F.try_variant_get("x", f"$.{n}", "string")
    who = F.coalesce(F.nullif(T.strip(s("reviewer")), F.lit("")), F.concat(F.lit("reviewer_"), (F.col("i") + 1).cast("string")))
    return _review_items(spark, path).select(F.col("i").alias("position"), F.coalesce(s("poem_id"), s("comparison_id"), s("id")).alias("comparison_id"), who.alias("reviewer"), F.coalesce(s("model"), F.lit("unknown-model")).alias("model"), s("poem").alias("poem"), *[s(d).try_cast("double").alias(d) for d in ("originality", "emotion", "imagery")])


def read_scores(spark: SparkSession, path: str, by_poem: bool = False) -> DataFrame:
    """Review rows with three whole scores in 1..5, of the same files; none at all raises.

    by_poem=False: comparison_id is the first of poem_id, comparison_id and id that the record has at all, be it null, and
    scores are numbers with fractions. by_poem=True: poem_key is the stripped poem, a blank one drops the row, and scores
    are whole: fractions of numbers are cut off, texts must be whole numbers.
    """
    from verseframe.operators.reviews import lenient_score

    items = _review_items(spark, path)
    s = lambda n: F.try_variant_get("x", f"$.{n}", "string")
    dims = ("originality", "emotion", "imagery")
    if by_poem:
        fields = F.try_variant_get("x", "$", "map<string,variant>")
        is_text = lambda n: F.schema_of_variant(F.element_at(fields, F.lit(n))) == "STRING"
        score = lambda n: F.when(is_text(n), lenient_score(s(n))).otherwise(F.when((v := F.try_variant_get("x", f"$.{n}", "double").cast("int")).between(1, 5), v))
        who = F.coalesce(F.nullif(T.strip(s("reviewer")), F.lit("")), F.concat(F.lit("reviewer_"), (F.col("i") + 1).cast("string")))
        out = items.select(F.col("i").alias("position"), T.strip(s("poem")).alias("poem_key"), who.alias("reviewer"), s("model").alias("model"), *[score(d).alias(d) for d in dims]).where("poem_key <> ''")
    else:
        keys = F.map_keys(F.try_variant_get("x", "$", "map<string,variant>"))
        first = F.coalesce(*[F.when(F.array_contains(keys, n), F.struct(s(n).alias("v"))) for n in ("poem_id", "comparison_id", "id")])["v"]
        good = lambda n: F.when((v := s(n).try_cast("double")).between(1, 5), v)
        out = items.select(F.col("i").alias("position"), first.alias("comparison_id"), F.coalesce(s("model"), F.lit("unknown-model")).alias("model"), *[good(d).alias(d) for d in dims])
    out = out.where(" and ".join(f"{d} is not null" for d in dims))
    if out.isEmpty():
        raise ValueError(f"no valid scores in {path}")
    return out


def read_outputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """id, prompt, outputs of the first path that holds comparisons, nested or flat, bare or under {"outputs": [...]}.

    Of nested ones the first two outputs are kept, if both are whole; flat rows are grouped by id and prompt.
    """
    from verseframe.operators.reviews import nest_pairs

    out = "array<struct<model:string,base_model:string,poem:string>>"
    for path in paths:
        if "://" not in path and not os.path.exists(path):
            continue
        items = _variant(spark, path).select(F.coalesce(F.try_variant_get("v", "$.outputs", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")).alias("a")).select(F.posexplode("a").alias("row_id", "x"))
        get = lambda n, t: F.try_variant_get("x", f"$.{n}", t)
        nested = items.select(get("id", "long").alias("id"), get("prompt", "string").alias("prompt"), F.slice(get("outputs", out), 1, 2).alias("outputs"))
        nested = nested.where("id is not null and prompt is not null and size(outputs) = 2").where(F.forall("outputs", lambda o: o["model"].isNotNull() & o["poem"].isNotNull()))
        flat = nest_pairs(items.select("row_id", get("id", "long").alias("id"), get("prompt", "string").alias("prompt"), *[get(n, "string").alias(n) for n in ("model", "base_model", "poem")]), "row_id")
        for got in (nested, flat):
            if not got.isEmpty():
                return got
    raise ValueError("no path holds comparisons")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """text of every line that is not blank; a line that is no JSON object with a text raises, and so does an empty file."""
    rows = spark.read.text(path).where(T.strip("value") != "").select("value", F.try_variant_get(F.try_parse_json("value"), "$.text", "string").alias("text"))
    bad = rows.where(F.coalesce(T.strip("text"), F.lit("")) == "").select("value").head(1)
    if bad:
        raise ValueError(f"no text in line: {bad[0][0][:80]}")
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows.select("text")


PERSON = "id string, name string, firstName string, lastName string, birthDate string, birthLocation string, birthYear int, deathDate string, deathYear int, bio string, spouse string, marriageDate string, father string, mother string, relation string, photoPath string, parents array<string>, children array<string>, branch string"
_FIELDS = tuple(f.split()[0] for f in PERSON.split(", "))


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """Person records of a JSON array in file order (position); keys that are no fields go to `extra`, lists may be comma text.
    Something other than an array, or an id twice, raises."""
    from verseframe.operators.people import split_list

    items = _variant(spark, path).select(F.try_variant_get("v", "$", "array<variant>").alias("a"))
    if items.where("a is null").count():
        raise ValueError("no array of records")
    rows = items.select(F.posexplode("a").alias("position", "x"))
    get = lambda n, t: F.try_variant_get("x", f"$.{n}", t)
    cols = []
    for field in PERSON.split(", "):
        name, kind = field.split()
        cols.append((F.coalesce(get(name, kind), split_list(get(name, "string"))) if kind == "array<string>" else get(name, kind)).alias(name))
    extra = F.map_filter(F.try_variant_get("x", "$", "map<string,string>"), lambda k, v: ~k.isin(*_FIELDS)).alias("extra")
    out = rows.select("position", *cols, extra)
    if out.groupBy("id").count().where("count > 1").head(1):
        raise ValueError("an id occurs twice")
    return out


_ENV = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expand_env(value, env: dict[str, str] | None = None):
    """${NAME} and ${NAME:-default} in texts, lists and dicts; a blank variable counts as unset, a missing one raises."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: expand_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        got = env.get(m[1], "").strip() or m[2]
        if got is None:
            raise ValueError(f"{m[1]} is not set")
        return got

    return _ENV.sub(put, value)
