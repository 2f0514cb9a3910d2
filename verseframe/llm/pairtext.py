"""Normal forms of prompts and answers."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_MARKUP = re.compile(r"<\|[^|<>]{1,40}\|>|</?[a-zA-Z][^<>\n]{0,60}>|\[(?:no output|empty|none|blank|no response)\]", re.I)
#: A word; text written without blanks is taken two characters at a time.
_WORD = re.compile(r"[⺀-⿿々-〇ぁ-ゖ゛-ヺー-鿿]{1,2}|[^\W_⺀-鿿]+")
_WORD_OR_BREAK = re.compile(r"\n|[.!?](?=\s)|。|[⺀-⿿々-〇ぁ-ゖ゛-ヺー-鿿]{1,2}|[^\W_⺀-鿿]+")
#: What ends a line or a sentence among the parts of a text.
BREAKS = frozenset("\n.!?。")
_LABEL = re.compile(r"^\W*(?:prompt|input|question|instruction|user)\s*:\s*", re.I)
#: Literals that stand for no answer.
_NOTHING = frozenset({"null", "none", "na", "n a", "nan", "nil", "undefined", "no output", "empty", "blank", "no response", "no answer", "tbd", "todo"})


def _plain(text: str | None) -> str:
    text = text or ""
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    if "<" in text or "[" in text:
        text = _MARKUP.sub(" ", text)
    for mark in "'’‘`":
        if mark in text:
            text = text.replace(mark, "")
    return text


def folded(text: str | None) -> list[str]:
    """Words without case, markup, apostrophes and punctuation."""
    return _WORD.findall(_plain(text))


@lru_cache(maxsize=20_000)
def folded_prompt(prompt: str | None) -> tuple[str, ...]:
    return tuple(folded(prompt))


def parts_of(text: str | None) -> list[str]:
    """The folded words of a text, with a member of BREAKS where a line or sentence ends."""
    return _WORD_OR_BREAK.findall(_plain(text))


def is_empty(text: str | None, words: list[str] | None = None) -> bool:
    """Null, or nothing that could be read as an answer: blanks, marks, special tokens, words for nothing.

    words: the folded text, if it is at hand.
    """
    words = folded(text) if words is None else words
    return not words or (len(words) <= 3 and " ".join(words) in _NOTHING)


def is_copy(text: str | None, prompt: str | None, words: list[str] | None = None) -> bool:
    """Nothing but the prompt, altered in form or repeated."""
    want, have = folded_prompt(prompt), folded(text) if words is None else words
    if not want or not have:
        return False
    if have[0] != want[0] and _LABEL.search(text or ""):
        have = have[1:]
    if len(have) % len(want) and "prompt" in have:
        have = [w for w in have if w != "prompt"]
    return bool(have) and not len(have) % len(want) and all(have[i] == want[i % len(want)] for i in range(len(have)))


def without_prompt(text: str, prompt: str | None) -> str:
    """The text after a leading prompt, if it starts with it."""
    p = (prompt or "").strip()
    t = text.lstrip()
    if p and t[: len(p) + 8].lower().startswith(p.lower()):
        return t[len(p) :]
    bare = p.rstrip(" .,:;!?")
    if bare and len(bare) > 8 and t[: len(bare) + 8].lower().startswith(bare.lower()):
        return t[len(bare) :]
    return text
