"""Chat messages: content parts, histories, rendered prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verseframe.functions.text import bind, strip

MESSAGES = "array<struct<role:string,content:string>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_text(content: Column | str) -> Column:
    """The text of a message content given as JSON: a string, or a list of strings and of {"type": "text", "text": ...}
    parts, whose stripped texts are joined by line ends without blank ones. Other parts count for nothing; null for null,
    and what is no JSON is taken as the text itself."""

    def of(v: Column) -> Column:
        said = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).when(F.try_variant_get(x, "$.type", "string") == "text", F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")))
        parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: strip(said(x)))
        joined = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")
        return F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string"))).when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), joined).when(v.isNotNull(), strip(F.to_json(v)))

    return F.coalesce(bind(F.try_parse_json(_col(content)), of), strip(_col(content)))


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(history: Column | str, user_input: Column | str, system: Column | str | None = None, fold_system: bool = False) -> Column:
    """The turns (role, content) of a conversation: pairs of history (user, assistant), then the input.

    A system text that is not empty comes first as a turn of its own or, with fold_system, is put into the last turn.
    """
    past = F.flatten(F.transform(F.coalesce(_col(history), F.array().cast("array<struct<user:string,assistant:string>>")), lambda h: F.array(_turn("user", h["user"]), _turn("assistant", h["assistant"]))))
    said, rule = _col(user_input), F.lit("") if system is None else F.coalesce(_col(system), F.lit(""))
    if fold_system:
        asked = F.when(rule == "", said).otherwise(F.concat(F.lit("Conversation instruction:\n"), rule, F.lit("\n\nUser request:\n"), said))
        return F.concat(past, F.array(_turn("user", asked))).cast(MESSAGES)
    first = F.when(rule == "", F.array().cast(MESSAGES)).otherwise(F.array(_turn("system", rule)).cast(MESSAGES))
    return F.concat(first, past.cast(MESSAGES), F.array(_turn("user", said)).cast(MESSAGES))


#: Forms of a turn: its start (with the role), its end, other names of roles, what opens the answer.
TEMPLATES = {
    "chatml": ("<|im_start|>%s\n", "<|im_end|>\n", {}, "<|im_start|>assistant\n"),
    "turns": ("<|turn>%s\n", "<turn|>\n", {"assistant": "model"}, "<|turn>model\n"),
    "plain": ("%s: ", "\n", {"user": "User", "assistant": "Assistant", "system": "System"}, "Assistant:"),
}


def render(turns: Column | str, template: str = "chatml", thinking: bool = False) -> Column:
    """The prompt text of turns (role, content) in one of TEMPLATES. thinking: the system turn starts with the mark
    <|think|>, and one of its own is put first where there is none."""
    start, end, names, opened = TEMPLATES[template]
    before, after = start.split("%s")

    def one(m: Column) -> Column:
        role = F.coalesce(*[F.when(m["role"] == k, F.lit(v)) for k, v in names.items()], m["role"])
        text = strip(F.coalesce(m["content"], F.lit("")))
        if thinking:
            text = F.when((m["role"] == "system") & ~F.startswith(text, F.lit("<|think|>")), F.concat(F.lit("<|think|>"), text)).otherwise(text)
        return F.concat(F.lit(before), role, F.lit(after), text, F.lit(end))

    def of(t: Column) -> Column:
        lead = F.lit("")
        if thinking:
            lead = F.when(F.exists(t, lambda m: m["role"] == "system"), "").otherwise(before + "system" + after + "<|think|>" + end.lstrip("\n"))
        return F.concat(lead, F.array_join(F.transform(t, one), ""), F.lit(opened))

    return bind(_col(turns), of)


def restore_lines(c: Column | str, token: str = "<|line|>") -> Column:
    """The line-break token of a tuned model as line ends."""
    return F.replace(_col(c), F.lit(token), F.lit("\n"))
