import pytest
from pyspark.sql import functions as F

from verseframe.functions import text as T


def one(spark, build, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "n"), [("rain", 1), ("river", 2), ("leaf", 1), ("table", 1), ("the", 1), ("xyz", 1), ("123", 0)])
def test_syllables(spark, word, n):
    assert one(spark, T.syllables, word) == n


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Thinking Process:\n1. The user asks.\nFinal Answer: Dawn comes.", "Dawn comes."), ("<think>\n1. plan", ""), ("<think>x</think>\nA leaf turns.", "A leaf turns."), ("Rain.", "Rain."), ("", ""), (None, ""),
        ("Thinking Process:\n1. the prompt asks\nA leaf turns.\nRain.", "A leaf turns.\nRain."), ("Let me think\nRain.\n- step one of the answer", "Rain.\n- step one of the answer"), ("Rain.\n\nSun.", "Rain.\n\nSun."),
    ],
)
def test_sanitize(spark, raw, want):
    assert one(spark, T.sanitize_output, raw) == want


def test_retry_and_fallback(spark):
    assert one(spark, lambda a, b: T.first_clean(a, b), "<think>plan", "A leaf turns.") == "A leaf turns."
    assert one(spark, lambda a, b: T.first_clean(a, b, fallback="f"), "<think>plan", None) == "f"


def test_markdown_is_order_sensitive(spark):
    assert one(spark, T.strip_markdown, "**bold** _it_ `code` ![alt](u) [t](u)") == "bold it code !alt t"
    assert one(spark, T.strip_markdown, "# Title\n- item\n> quote") == "Title\n  - item\n  quote"


def test_small_cleaners(spark):
    assert one(spark, T.slug, " Ada & Ben! ") == "ada-ben"
    assert one(spark, T.escape_html, "<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert one(spark, T.trim_fillers, "um the river is a") == "river"
    assert one(spark, T.trim_fillers, "um a") == ""
    assert one(spark, T.trim_reply, "Assistant: yes\nUser: no") == "yes"
    assert one(spark, T.remove_prompt, "Dawn. It came.", "Dawn.") == " It came."
    assert one(spark, T.clean, " a<|im_end|>b\n\nc ") == "a b c"
    assert one(spark, T.clean, None) == ""
    assert one(spark, T.title_key, "IV.") is None and one(spark, T.title_key, "IV") == "IV"
    assert one(spark, T.title_key, "SONG of") == "song of" and one(spark, T.title_key, "SONG TWO") == "SONG TWO"
    assert one(spark, T.is_metadata, "Page 12") and one(spark, T.is_metadata, "-----") and not one(spark, T.is_metadata, "The page 12 turns")
    assert not one(spark, T.is_metadata, None)


def test_metrics_of_empty_text_are_zero(spark):
    for f in (T.imagery_density, T.metaphor_density, T.compound_imagery, T.narrative_density):
        assert one(spark, f, "") == 0 and one(spark, f, None) == 0
    assert one(spark, T.imagery_density, "the moon and a stone") == pytest.approx(2 / 5)
    assert one(spark, T.metaphor_density, "love is war, sea of glass") == pytest.approx(2 / 6)


def test_overlap(spark):
    df = spark.createDataFrame([(["the", "red", "moon"], ["a", "red", "sun"])], "a array<string>, b array<string>")
    r = df.select(T.content_jaccard(F.col("a"), F.col("b")).alias("j"), T.dice(T.ngrams(F.col("a"), 2), T.ngrams(F.col("b"), 2)).alias("d"), T.has_repeats(F.col("a")).alias("r")).first()
    assert r["j"] == pytest.approx(1 / 3) and r["d"] == 0 and not r["r"]


def test_commands_and_bases(spark):
    assert one(spark, T.compatible_base, "a\\B ", "x/b") and one(spark, T.compatible_base, "", "b") and not one(spark, T.compatible_base, "a", "b")
