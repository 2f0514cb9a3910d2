"""Speech, sanitising, sampling and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verseframe.functions import fixed as K, messages as G, text as T
from verseframe.operators import sampling as S
from verseframe.plans.book import Book, quoted, split_words, strip
from verseframe.sources import table
from verseframe.streaming import channels as C, sessions as Z

BOOK = Book()
query = BOOK.query


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


_W = split_words("utterance")


@query(f"""WITH o AS (SELECT user_id, ts, coalesce(event_type, '') AS t, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o), g AS (SELECT user_id, sid, min(ts) AS start_at, count(*) AS n_events, trim(string_agg(t, ' ' ORDER BY ts, t)) AS utterance FROM s GROUP BY ALL)
SELECT user_id, epoch_us(start_at) AS start_us, n_events, utterance, len({_W}) >= 3 AND length(utterance) >= 10 AND len(list_filter({_W}, lambda x: lower(x) NOT IN ({quoted(K.FILLER)}))) >= 2 AS substantial FROM g""")
def utterance_sessions(spark, d):
    out = Z.utterances(_events(spark, d), "user_id", "ts", "event_type", gap_seconds=6 * 3600)
    return out.select("user_id", F.unix_micros("start_at").alias("start_us"), "n_events", "utterance", "substantial")


@query("SELECT event_id, string_agg(event_type, chr(10)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS memory FROM events")
def recent_memory_prompt(spark, d):
    rows = _events(spark, d).select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), "event_type")
    return Z.recent_memory(rows, "user_id", "o", "event_type").select("event_id", "memory")


@query("WITH e AS (SELECT event_type, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM events GROUP BY event_type HAVING max(ts) > min(ts)) SELECT event_type, n, round(n / s, 9) AS rate, round((3 * n - n) / (n / s), 3) AS eta_seconds FROM e")
def rate_eta(spark, d):
    per = _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).where("b > a").withColumn("total", F.col("n") * 3)
    rate, eta = Z.progress_rate("n", "a", "b", "total")
    return per.select("event_type", "n", F.round(rate, 9).alias("rate"), F.round(eta, 3).alias("eta_seconds"))


@query("WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS o FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS seen FROM f GROUP BY user_id")
def ordered_dedup(spark, d):
    first = _events(spark, d).groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("o"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "event_type"))), lambda x: x["event_type"]), ",").alias("seen"))


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.page'), ''), nullif(json_extract_string(props, '$.ref'), ''), event_type) AS label FROM events")
def key_fallbacks(spark, d):
    v = F.try_parse_json("props")
    pick = lambda n: F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit(""))
    return _events(spark, d).select("event_id", F.coalesce(pick("page"), pick("ref"), "event_type").alias("label"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'b ' END AS l, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS new, props AS old FROM events) SELECT event_id, coalesce(nullif(new, ''), nullif(old, '')) AS value FROM e")
def form_values(spark, d):
    label = F.when(F.col("event_id") % 2 == 0, "A").otherwise("b ")
    new = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    form = F.create_map(F.when(F.col("event_id") % 2 == 0, "a_score").otherwise("b_score"), new, F.when(F.col("event_id") % 2 == 0, "m1_score").otherwise("m2_score"), F.col("props"))
    return _events(spark, d).select("event_id", T.form_value(form, label, "score").alias("value"))


def _poems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "outputs_flat").where("poem is not null").select("row_id", "prompt", "poem").distinct()


@query()
def reasoning_stripped(spark, d):
    return _poems(spark, d).select("row_id", T.sanitize_output("poem").alias("response")).where("response <> ''")


@query()
def retry_coalesce(spark, d):
    return _poems(spark, d).select("row_id", T.first_clean("poem", "prompt").alias("response"))


_MARKDOWN = "text"
for _pattern, _new in K.MARKDOWN:
    _MARKDOWN = "regexp_replace(%s, '%s', '%s', 'g')" % (_MARKDOWN, _pattern.replace("'", "''"), _new.replace("$1", "\\1"))


@query(f"SELECT doc_id, {_MARKDOWN} AS body FROM documents")
def markdown_stripped(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_markdown("text").alias("body"))


@query()
def thinking_formatted(spark, d):
    return _poems(spark, d).select("row_id", T.format_thinking(F.concat(F.lit('Thinking Process: the user said "x" 1. '), "poem"), "prompt").alias("thinking"))


_FT = split_words("poem")


@query(f"WITH w AS (SELECT DISTINCT row_id, {_FT} AS w FROM outputs_flat WHERE poem IS NOT NULL), k AS (SELECT row_id, w, list_transform(w, lambda x: length(x) > 2 AND lower(x) NOT IN ({quoted(K.EDGE_FILLER)})) AS k FROM w) SELECT row_id, CASE WHEN coalesce(list_position(k, true), 0) = 0 THEN '' ELSE array_to_string(w[list_position(k, true):len(k) + 1 - list_position(list_reverse(k), true)], ' ') END AS body FROM k")
def filler_trimmed(spark, d):
    return _poems(spark, d).select("row_id", T.trim_fillers("poem").alias("body"))


@query(f"SELECT DISTINCT row_id FROM outputs_flat WHERE len({_FT}) >= 3 AND length(trim(poem)) >= 10 AND len(list_filter({_FT}, lambda x: lower(x) NOT IN ({quoted(K.FILLER)}))) >= 2")
def substantial_turns(spark, d):
    return _poems(spark, d).where(T.is_substantial("poem")).select("row_id").distinct()


@query("WITH c AS (SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN '/clear ' ELSE '/length ' END) || floor(value * 10)::BIGINT || (CASE WHEN event_id % 5 = 0 THEN ' x' ELSE ' ' END) AS command FROM events WHERE value IS NOT NULL) SELECT event_id, CASE WHEN try_cast(regexp_extract(command, '^/length\\s+(\\d+)\\s*$', 1) AS INT) BETWEEN 10 AND 1000 THEN try_cast(regexp_extract(command, '^/length\\s+(\\d+)\\s*$', 1) AS INT) END AS length FROM c")
def commands_parsed(spark, d):
    word = F.when(F.col("event_id") % 3 == 0, "/clear ").otherwise("/length ")
    said = F.concat(word, F.floor(F.col("value") * 10).cast("string"), F.when(F.col("event_id") % 5 == 0, " x").otherwise(" "))
    return _events(spark, d).where("value is not null").select("event_id", said.alias("command")).select("event_id", T.parse_length_command("command").alias("length"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS label FROM events WHERE ts IS NOT NULL")
def run_labels(spark, d):
    return _events(spark, d).where("ts is not null").select("event_id", T.run_label("ts").alias("label"))


@query(f"SELECT DISTINCT row_id, concat_ws(chr(10), nullif({strip('prompt')}, ''), nullif({strip('poem')}, '')) AS content FROM outputs_flat WHERE poem IS NOT NULL")
def content_parts(spark, d):
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).alias("text"))
    content = F.to_json(F.array(part("text", "prompt"), part("image", "poem"), part("text", "poem")))
    return _poems(spark, d).select("row_id", G.content_text(content).alias("content"))


_TURN = "'<|turn>%s' || chr(10) || %s || '<turn|>' || chr(10)"


@query(f"""WITH o AS (SELECT DISTINCT id, row_id, prompt, poem FROM outputs_flat WHERE poem IS NOT NULL)
SELECT id, {_TURN % ('system', "'Answer in verse.'")} || string_agg({_TURN % ('user', strip("coalesce(prompt, '')"))} || {_TURN % ('model', strip('poem'))}, '' ORDER BY row_id) || {_TURN % ('user', "'Once more.'")} || '<|turn>model' || chr(10) AS rendered FROM o GROUP BY id""")
def rendered_history(spark, d):
    turns = table(spark, d, "outputs_flat").where("poem is not null").select("id", "row_id", F.struct(F.col("prompt").alias("user"), F.col("poem").alias("assistant")).alias("h")).distinct()
    past = turns.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "h"))), lambda x: x["h"]).alias("history"))
    return past.select("id", G.render(G.messages("history", F.lit("Once more."), F.lit("Answer in verse.")), "turns").alias("rendered"))


@query("SELECT doc_id, replace(text, '<|line|>', chr(10)) AS body FROM documents")
def lines_restored(spark, d):
    return table(spark, d, "documents").select("doc_id", G.restore_lines("text").alias("body"))


@query(f"SELECT DISTINCT row_id, CASE WHEN coalesce(prompt, '') = '' THEN poem WHEN starts_with(poem, prompt) THEN {strip('substr(poem, length(prompt) + 1)')} ELSE poem END AS prefix_off, CASE WHEN coalesce(prompt, '') = '' THEN poem ELSE replace(poem, prompt, '') END AS erased, CASE WHEN length(poem) <= 60 THEN poem ELSE poem[1:60] || '...' END AS label FROM outputs_flat WHERE poem IS NOT NULL")
def prompt_forms_removed(spark, d):
    return _poems(spark, d).select("row_id", T.strip_prompt_prefix("poem", "prompt").alias("prefix_off"), T.erase_prompt("poem", "prompt").alias("erased"), T.short_label("poem").alias("label"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every poem behind a reasoning block, dealt into chunks of five characters."""
    raw = F.concat(F.lit("<think>thought\nplan</think>\n"), "poem")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(raw) - 1) / 5).cast("int")), lambda i: F.substr(raw, i * 5 + 1, F.lit(5)))
    return _poems(spark, d).select("row_id", F.posexplode(cut).alias("pos", "token"))


@query()
def stream_sanitised(spark, d):
    return C.sanitised(_chunks(spark, d), "row_id", "pos", "token")


@query()
def channel_automaton(spark, d):
    return C.channels(_chunks(spark, d), "row_id", "pos", "token")


@query("""WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) FILTER (event_type <> '') AS c FROM events GROUP BY user_id),
f AS (SELECT user_id, list_append(CASE WHEN len(c) > 0 THEN list_transform(c, lambda t: 'data: {"token":"' || t || '"}' || chr(10) || chr(10)) ELSE ['data: {"error":"empty generation"}' || chr(10) || chr(10)] END, 'data: {"done":true}' || chr(10) || chr(10)) AS f FROM e)
SELECT user_id, (generate_subscripts(f, 1) - 1)::INT AS frame_no, unnest(f) AS frame FROM f""")
def sse_frames(spark, d):
    events = _events(spark, d).select("user_id", F.struct("ts", "event_id").alias("o"), "event_type")
    return C.event_frames(events, "user_id", "o", "event_type").select("user_id", "frame_no", "frame")


@query()
def sampled_docs(spark, d):
    return S.sample(table(spark, d, "documents").select("doc_id", "title"), 100, "doc_id")


@query()
def train_test_split(spark, d):
    return S.split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query()
def augmented_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.augment("text", "doc_id").alias("body"))


@query()
def prefix_bernoulli(spark, d):
    return _poems(spark, d).select("row_id", S.bernoulli_prefix("poem", F.array(F.lit("And I saw,"), F.lit("What is it,")), "row_id").alias("body"))


@query()
def chat_examples(spark, d):
    return _poems(spark, d).select("row_id", F.to_json(S.chat_example("poem", "row_id")).alias("messages"))


@query()
def unique_random_ids(spark, d):
    return S.unique_ids(spark, 100)


@query("SELECT DISTINCT row_id, '<|im_start|>user' || chr(10) || coalesce(prompt, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS rendered FROM outputs_flat WHERE poem IS NOT NULL")
def rendered_prompts(spark, d):
    return _poems(spark, d).select("row_id", F.format_string("<|im_start|>user\n%s<|im_end|>\n<|im_start|>assistant\n", F.coalesce("prompt", F.lit(""))).alias("rendered"))


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
