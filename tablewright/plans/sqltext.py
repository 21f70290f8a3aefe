"""Pieces of SQL text for the checks, in the dialect of the check engine."""

from __future__ import annotations

from collections.abc import Sequence

NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
QUALITY = "'nan','','none','n/a','-','null','unknown'"
FIX = "'nan','','none','n/a','-','null'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def empty(x: str, tokens: str = QUALITY) -> str:
    return f"({x} IS NULL OR lower({strip(x)}) IN ({tokens}))"


def money_text(x: str) -> str:
    return strip(f"replace(replace({x}, '$', ''), ',', '')")


def number(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({x}, '{NUMBER}') THEN try_cast({x} AS DOUBLE) END)"


def money(x: str) -> str:
    return number(money_text(x))


def plain(x: str) -> str:
    return number(strip(x))


def date(x: str) -> str:
    return f"try_strptime({strip(x)}, ['%Y-%m-%d', '%d-%m-%Y'])"


def cell_type(x: str) -> str:
    return (
        f"(CASE WHEN {empty(x)} THEN NULL WHEN regexp_full_match({money_text(x)}, '{NUMBER}') THEN 'num' "
        f"WHEN {date(x)} IS NOT NULL THEN 'date' ELSE 'text' END)"
    )


def cells(table: str, columns: Sequence[str]) -> str:
    """Long view ``ord, "column", v, _row_idx``."""
    return " UNION ALL ".join(
        f'SELECT {i} AS ord, \'{c}\' AS "column", cast({c} AS VARCHAR) AS v, _row_idx FROM {table}'
        for i, c in enumerate(columns)
    )


def pct(part: str, total: str, none: int = 100) -> str:
    return f"(CASE WHEN {total} = 0 THEN {none} ELSE cast(round_even(cast({part} AS DOUBLE) / {total} * 100, 0) AS INTEGER) END)"


def squeeze(x: str) -> str:
    """Lower case, no punctuation, single blanks."""
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"


def sort_words(x: str) -> str:
    return rf"array_to_string(list_sort(regexp_split_to_array({strip(x)}, '\s+')), ' ')"


def ratio(a: str, b: str) -> str:
    """Twice the common length over both lengths, in percent; texts of at most 62 characters.

    One bit per character of ``a`` in a 64-bit word, updated once per character of ``b``.
    """
    full = f"((1::BIGINT << length({a})) - 1)"
    mask = (
        f"coalesce(list_sum(list_transform(range(length({a})), "
        f"lambda i: CASE WHEN {a}[i + 1] = ch THEN (1::BIGINT << i) ELSE 0 END)), 0)::BIGINT"
    )
    chars = f"string_split({b}, '')"
    state = (
        f"list_reduce(list_prepend([{full}], list_transform({chars}, lambda ch: [{mask}])), "
        f"lambda s, m: [((s[1] + (s[1] & m[1])) | (s[1] - (s[1] & m[1]))) & {full}])[1]"
    )
    common = f"(length({a}) - bit_count({state}))"
    return (
        f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE "
        f"ELSE 200.0::DOUBLE * {common} / (length({a}) + length({b})) END)"
    )
