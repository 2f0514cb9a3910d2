"""A book of named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name, with its SQL if there is one."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add


#: SQL forms of the text expressions, for DuckDB.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOKENS = r"<\|im_start\|>|<\|im_end\|>|<\|eot_id\|>|<\|endoftext\|>|<\|assistant\|>|<\|user\|>|<\|system\|>"


def clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '{_TOKENS}', ' ', 'g'), '{_SPACE}+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_transform(regexp_extract_all({clean(c)}, '[a-zA-Z'']+'), lambda w: lower(w))"


def shape(c: str) -> str:
    letters = r"[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{370}-\x{52F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
    return f"regexp_replace(regexp_replace({clean(c)}, '{letters}', 'x', 'g'), '[^\\x00-\\x7F]', ' ', 'g')"


def hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def strip(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"


def split_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{_SPACE}+'), lambda w: w <> '')"


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SPACE = _SPACE
