"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations

import re

from quillspark.sources.items import ITEMS_SQL, NOW

NOW_SQL = f"TIMESTAMP '{NOW}'"


def has_term(column: str, term: str) -> str:
    return f"regexp_matches({column}, '(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)')"


def has_any(column: str, terms) -> str:
    return f"regexp_matches({column}, '(^|[^a-z0-9])({'|'.join(map(re.escape, terms))})([^a-z0-9]|$)')"


def has_word(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '(^|[^A-Za-z0-9_])({pattern})([^A-Za-z0-9_]|$)')"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


KEY_SQL = "trim(regexp_replace(lower({0}), '[^a-z0-9一-鿿]+', ' ', 'g'))"
URL_SQL = "'https://news.example/' || source || '/' || (id % 500) || '?a=' || (id % 3)"


def with_items(sql: str, *more: str) -> str:
    return "WITH " + ",\n".join([ITEMS_SQL, *more]) + "\n" + sql
