"""Text expressions: Column in, Column out, all of them inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from verseframe.functions import fixed as K

#: White space as str.split() sees it.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters stripped from the ends of texts.
BLANKS = " \t\r\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often `use` names it, within loops over arrays too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_set(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def clean(c: Column | str) -> Column:
    """Chat tokens to blanks, white space collapsed; null gives the empty text."""
    tokens = "|".join(re.escape(t) for t in K.CHAT_TOKENS)
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), tokens, " "), SPACE + "+", " "))


def _words_of(cleaned: Column) -> Column:
    return F.transform(F.regexp_extract_all(cleaned, F.lit("[a-zA-Z']+"), F.lit(0)), F.lower)


def words(c: Column | str) -> Column:
    """Lower-cased runs of letters and apostrophes of the cleaned text."""
    return _words_of(clean(c))


def _word_number(cleaned: Column) -> Column:
    return F.regexp_count(cleaned, F.lit("[a-zA-Z']+"))


def _shape_of(cleaned: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(cleaned, r"[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{370}-\x{52F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]", "x"), r"[^\x00-\x7F]", " ")


def ascii_shape(c: Column | str) -> Column:
    """Letters outside ASCII as x, other such characters as blanks, so that word patterns mean the same in every engine."""
    return _shape_of(clean(c))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def ratio(hits: Column, n: Column) -> Column:
    """hits / n, 0 where n is 0."""
    return F.when(n == 0, F.lit(0.0)).otherwise(hits / n)


def imagery_density(c: Column | str, lexicon: tuple[str, ...] = K.IMAGERY) -> Column:
    return bind(words(c), lambda w: ratio(F.size(F.filter(w, lambda t: t.isin(list(lexicon)))), F.size(w)))


def metaphor_density(c: Column | str) -> Column:
    """Matches of "w is w", "w becomes w", "w like w" and "w of w" per word, at least one word assumed."""

    def of(cleaned: Column) -> Column:
        hits = bind(_shape_of(cleaned), lambda text: sum(count(text, rf"(?i)\b\w+\s+{v}\s+\w+\b") for v in ("is", "becomes", "like", "of")))
        return hits / F.greatest(F.lit(1), _word_number(cleaned))

    return bind(clean(c), of)


def compound_imagery(c: Column | str) -> Column:
    def of(cleaned: Column) -> Column:
        hits = bind(_shape_of(cleaned), lambda text: count(text, r"(?i)\b\w+\s+of\s+\w+\b") + count(text, r"(?i)\b\w+\s+\w+\b"))
        return bind(_word_number(cleaned), lambda n: ratio(hits * 100.0, n))

    return bind(clean(c), of)


def narrative_density(c: Column | str) -> Column:
    """Mean of the shares of -ed/-ing words, of dialogue marks and of motion verbs; 0 without words."""

    def of(cleaned: Column, n: Column) -> Column:
        def shares(text: Column) -> Column:
            verbs = count(text, r"(?i)\b\w+(?:ed|ing)\b")
            talk = count(text, r"(?i)\b(?:he|she)\s+said\b") + count(cleaned, "[\"“”]")
            motion = count(text, rf"(?i)\b(?:{'|'.join(K.MOTION)})\b")
            return (verbs / n + talk / n + motion / n) / 3.0

        return F.when(n == 0, F.lit(0.0)).otherwise(bind(_shape_of(cleaned), shares))

    return bind(clean(c), lambda cleaned: bind(_word_number(cleaned), lambda n: of(cleaned, n)))


def repetition_index(tokens: Column) -> Column:
    """(length - distinct) / length of a token array, 0 where empty."""
    return bind(tokens, lambda t: ratio(F.size(t) - F.size(F.array_distinct(t)), F.size(t)))


def split_words(c: Column | str) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), SPACE + "+"), lambda w: w != "")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def escape_html(c: Column | str) -> Column:
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def capitalise(c: Column | str) -> Column:
    """The first character in upper case, the rest untouched."""
    return F.concat(F.upper(F.substring(_col(c), 1, 1)), F.expr(f"substring({c}, 2)") if isinstance(c, str) else F.substring(c, 2, 1 << 30))


def normal_name(c: Column | str) -> Column:
    return F.lower(strip(F.coalesce(_col(c), F.lit(""))))


def strip_markdown(c: Column | str) -> Column:
    out = _col(c)
    for pattern, new in K.MARKDOWN:
        out = F.regexp_replace(out, pattern, new)
    return out


def strip_token_noise(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), K.TOKEN_NOISE, "")


def literal_token_cleaning(c: Column | str) -> Column:
    """Literal chat tokens removed, the end-of-text token becomes a blank line."""
    out = F.replace(_col(c), F.lit("<|endoftext|>"), F.lit("\n\n"))
    for t in K.CHAT_TOKENS:
        out = F.replace(out, F.lit(t), F.lit(""))
    return strip(out)


def normal_lines(c: Column | str) -> Column:
    """LF line ends, no blanks at line ends, at most three line ends in a row, stripped."""
    out = F.regexp_replace(_col(c), "\r\n?", "\n")
    out = F.regexp_replace(out, r"(?m)[ \t\x0b\f]+$", "")
    return strip(F.regexp_replace(out, "\n{4,}", "\n\n\n"))


def strip_headers(c: Column | str) -> Column:
    """The text after the line of the start mark and before the end mark."""
    out = F.regexp_replace(_col(c), rf"(?is)\A.*?{K.START_MARK}[^\n]*\n?", "")
    return F.regexp_replace(out, rf"(?is){K.END_MARK}.*\z", "")


def is_metadata(line: Column | str) -> Column:
    """Whether a line is page furniture; blank lines are not."""
    s = strip(line)
    low = F.lower(s)
    hit = low.rlike(r"\A(?:" + "|".join(K.METADATA) + r")\z") | s.rlike(rf"\A{K.RULE_LINE}\z")
    for w in K.METADATA_WORDS:
        hit = hit | F.contains(low, F.lit(w))
    for w in K.METADATA_STARTS:
        hit = hit | F.startswith(low, F.lit(w))
    return F.coalesce((s != "") & hit, F.lit(False))


def title_key(line: Column | str) -> Column:
    """Key under which repeated titles are counted; null for lines that are no titles."""
    s = F.trim(F.regexp_replace(F.coalesce(_col(line), F.lit("")), SPACE + "+", " "))
    n = F.size(F.split(s, " "))
    no = (s == "") | (F.length(s) > 80) | s.rlike(r"[.,;:!?]\z") | (n > 8)
    upper = s.rlike(r"\A[IVXLCDM]+\.?\z") | ((F.upper(s) == s) & (F.lower(s) != s) & (n >= 2))
    return F.when(no, F.lit(None).cast("string")).when(upper, F.upper(s)).otherwise(F.lower(s))


def syllables(word: Column | str) -> Column:
    """Vowel groups, one less for a final e, at least one; 0 for words without letters."""
    w = F.lower(F.regexp_replace(_col(word), "[^a-zA-Z]", ""))
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), F.when(F.endswith(w, F.lit("e")), F.greatest(F.lit(1), groups - 1)).otherwise(groups))).cast("int")


def line_syllables(line: Column | str) -> Column:
    return F.aggregate(F.transform(split_words(line), syllables), F.lit(0), lambda a, x: a + x)


def trim_fillers(c: Column | str) -> Column:
    """Words of up to two characters and fillers dropped from both ends."""
    w = split_words(c)
    keep = F.transform(w, lambda x: (F.length(x) > 2) & ~F.lower(x).isin(list(K.EDGE_FILLER)))
    first = F.array_position(keep, F.lit(True))
    last = F.size(keep) + 1 - F.array_position(F.reverse(keep), F.lit(True))
    return F.when(F.coalesce(first, F.lit(0)) == 0, "").otherwise(F.array_join(F.slice(w, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), " "))


def trim_reply(c: Column | str) -> Column:
    """Cut at the first "User:", without a leading "Assistant:"."""
    return strip(F.regexp_replace(strip(F.split_part(strip(c), F.lit("User:"), F.lit(1))), r"\AAssistant:", ""))


def remove_prompt(text: Column | str, prompt: Column | str) -> Column:
    """What follows the first occurrence of the prompt, or the text where it does not occur."""
    t, p = _col(text), _col(prompt)
    at = F.position(p, t)
    return F.when(p.isNull() | (p == "") | (at == 0), t).otherwise(F.substr(t, at + F.length(p)))


def strip_prompt_prefix(text: Column | str, prompt: Column | str) -> Column:
    """The text without the prompt at its start, stripped; as it is where it starts otherwise."""
    t, p = _col(text), _col(prompt)
    return F.when(F.coalesce(p, F.lit("")) == "", t).when(F.startswith(t, p), strip(F.substr(t, F.length(p) + 1))).otherwise(t)


def erase_prompt(text: Column | str, prompt: Column | str) -> Column:
    """The text without any occurrence of the prompt."""
    return F.when(F.coalesce(_col(prompt), F.lit("")) == "", _col(text)).otherwise(F.replace(_col(text), _col(prompt), F.lit("")))


def is_substantial(c: Column | str) -> Column:
    """Enough words, characters and words that are no fillers to count as speech."""
    s = F.trim(_col(c))
    w = split_words(s)
    content = F.size(F.filter(w, lambda x: ~F.lower(x).isin(list(K.FILLER))))
    return (F.size(w) >= K.MIN_SPOKEN_WORDS) & (F.length(s) >= K.MIN_SPOKEN_CHARS) & (content >= K.MIN_SPOKEN_CONTENT)


def preview(c: Column | str, n: int = 1200) -> Column:
    return F.when(F.length(_col(c)) <= n, _col(c)).otherwise(F.concat(F.rtrim(F.substring(_col(c), 1, n)), F.lit("\n...")))


def short_label(c: Column | str, n: int = 60) -> Column:
    """The first n characters, with "..." where more were there."""
    return F.when(F.length(_col(c)) <= n, _col(c)).otherwise(F.concat(F.substring(_col(c), 1, n), F.lit("...")))


def preview_lines(c: Column | str, n: int = 14) -> Column:
    lines = F.split(_col(c), "\n")
    return F.when(F.size(lines) <= n, _col(c)).otherwise(F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n  … ("), (F.size(lines) - n).cast("string"), F.lit(" more lines)")))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams of a token array, joined by blanks; in time linear in its length."""

    def of(t: Column) -> Column:
        room = F.greatest(F.size(t) - (n - 1), F.lit(0))
        shifted = F.arrays_zip(*[F.slice(t, i + 1, room).alias(str(i)) for i in range(n)])
        return F.array_distinct(F.transform(shifted, lambda x: F.concat_ws(" ", *[x[str(i)] for i in range(n)])))

    return bind(tokens, of)


def dice(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|), 0 where one is empty."""
    both = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda s: both(s["a"], s["b"]))


def content_words(tokens: Column) -> Column:
    """The distinct words in small letters that are no stop words."""
    return F.array_except(F.transform(tokens, F.lower), words_set(K.OVERLAP_STOP))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets of words, 0 where one is empty."""
    both = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda s: both(s["a"], s["b"]))


def content_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the words that are no stop words, 0 where one side has none."""
    return jaccard(content_words(a), content_words(b))


def has_repeats(tokens: Column) -> Column:
    w = F.filter(F.transform(tokens, F.lower), lambda x: ~x.isin(list(K.MAY_REPEAT)))
    return F.size(w) > F.size(F.array_distinct(w))


def clean_phrase(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), "[^a-zA-Z' ]+", ""))


def is_short_phrase(phrase: Column | str) -> Column:
    """2 to 7 words, not only articles and demonstratives."""
    w = split_words(phrase)
    return F.size(w).between(2, 7) & F.exists(w, lambda x: ~F.lower(x).isin(list(K.ARTICLES)))


def sanitize_output(text: Column | str) -> Column:
    """Model output without its reasoning: think blocks go (an open one to the end), the part after a final mark is
    taken if there is one, else lines of reasoning are dropped; empty where a reasoning mark lingers."""
    t = F.regexp_replace(F.coalesce(_col(text), F.lit("")), K.THINK_BLOCK, "")
    t = strip(F.regexp_replace(F.regexp_replace(t, K.THINK_OPEN, ""), K.THINK_CLOSE, ""))
    lines = F.split(F.regexp_replace(t, "\r\n?", "\n"), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(K.FINAL_MARK)), F.lit(True)).cast("int")
    tail = strip(F.regexp_replace(F.get(lines, at - 1), K.FINAL_MARK, ""))
    rest = strip(F.array_join(F.slice(lines, F.greatest(at + 1, F.lit(1)), F.size(lines)), "\n"))
    final = strip(F.array_join(F.filter(F.array(tail, rest), lambda x: x != ""), "\n"))

    def fold(acc: Column, line: Column) -> Column:
        s = strip(line)
        header = s.rlike(K.THINK_HEADER)
        looks = header | s.rlike(K.REASON_META) | (s.rlike(K.REASON_LIST) & s.rlike(K.REASON_WORD))
        drop, saw, out = acc["drop"], acc["saw"], acc["out"]
        blank = F.struct(drop.alias("drop"), saw.alias("saw"), F.when(~drop & (F.size(out) > 0), F.array_append(out, F.lit(""))).otherwise(out).alias("out"))
        skip = F.struct(F.lit(True).alias("drop"), F.lit(True).alias("saw"), out.alias("out"))
        first = F.struct(F.lit(False).alias("drop"), saw.alias("saw"), F.array_append(out, s).alias("out"))
        keep = F.struct(drop.alias("drop"), saw.alias("saw"), F.array_append(out, F.rtrim(line, F.lit(BLANKS))).alias("out"))
        return F.when(s == "", blank).when(header | (drop & looks) | (~drop & ~saw & looks), skip).when(drop, first).otherwise(keep)

    start = F.struct(F.lit(False).alias("drop"), F.lit(False).alias("saw"), F.array().cast("array<string>").alias("out"))
    seen = strip(F.array_join(F.aggregate(lines, start, fold, lambda a: a["out"]), "\n"))
    return F.when(t == "", "").when(at > 0, final).when(seen.rlike(K.LINGERING), "").otherwise(seen)


def first_clean(*attempts: Column | str, fallback: str = K.FALLBACK) -> Column:
    """The first attempt that is not empty after sanitising, else the fallback."""
    return F.coalesce(*[F.nullif(sanitize_output(a), F.lit("")) for a in attempts], F.lit(fallback))


def format_thinking(text: Column | str, user_input: Column | str | None = None) -> Column:
    """Reasoning for display: markup off, the quoted request replaced by the user's words, list items on lines of their own."""
    t = strip_markdown(strip_token_noise(text))
    if user_input is not None:
        mark = F.lit("\x00")
        t = F.replace(F.regexp_replace(t, r'(?i)((?:user|request)[^"\n]{0,80}")([^"\n]*)(")', "$1\x00$3"), mark, F.coalesce(_col(user_input), F.lit("")))
    t = F.regexp_replace(t, r"(?i)\bThinking Process:\s*", "")
    t = F.regexp_replace(t, r"(?<!^)(?<!\n)\s*(\d+\.\s+)", "\n$1")
    t = F.regexp_replace(t, r"(?<!^)(?<!\n)\s+([*-]\s+)", "\n$1")
    return strip(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"))


def model_family(name: Column | str) -> Column:
    n = F.lower(_col(name))
    return F.when(F.contains(n, F.lit("llama")), "llama").when(F.contains(n, F.lit("qwen")), "qwen").when(F.contains(n, F.lit("gpt2")), "gpt2").otherwise("generic")


def compatible_base(a: Column | str, b: Column | str) -> Column:
    """Equal without case and slash direction, or equal in the last path segment; a blank side passes."""
    x, y = (F.lower(F.rtrim(F.replace(strip(F.coalesce(_col(c), F.lit(""))), F.lit("\\"), F.lit("/")))) for c in (a, b))
    x, y = F.regexp_replace(x, "/+$", ""), F.regexp_replace(y, "/+$", "")
    return (x == "") | (y == "") | (x == y) | (F.element_at(F.split(x, "/"), -1) == F.element_at(F.split(y, "/"), -1))


def form_value(form: Column | str, label: Column | str, field: str) -> Column:
    """The value of a field in form data (a map) for blind label A or B: under a_<field> or b_<field>, or under the older
    m1_<field> or m2_<field>; an empty one counts as missing."""
    f, a = _col(form), F.lower(strip(label)) == "a"
    pick = lambda name: F.nullif(F.element_at(f, name), F.lit(""))
    return F.when(a, F.coalesce(pick(F.lit(f"a_{field}")), pick(F.lit(f"m1_{field}")))).otherwise(F.coalesce(pick(F.lit(f"b_{field}")), pick(F.lit(f"m2_{field}"))))


def run_label(at: Column | str) -> Column:
    """A time as the label of a run, to the second."""
    return F.date_format(_col(at), "yyyyMMdd_HHmmss")


def parse_length_command(c: Column | str) -> Column:
    """n of "/length n" within 10..1000, else null."""
    n = F.expr("try_cast(regexp_extract({}, '^/length\\\\s+(\\\\S+)\\\\s*$', 1) AS INT)".format(c)) if isinstance(c, str) else F.try_to_number(F.regexp_extract(c, r"^/length\s+(\S+)\s*$", 1), F.lit("9999")).cast("int")
    return F.when(n.between(10, 1000), n)
