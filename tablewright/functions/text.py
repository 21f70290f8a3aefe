"""Text expressions: trimming, empty cells, normal forms, keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as an empty cell. Four variants are in use and differ on purpose.
EMPTY_QUALITY = ("nan", "", "none", "n/a", "-", "null", "unknown")
EMPTY_FIX = ("nan", "", "none", "n/a", "-", "null")
EMPTY_MERGE = ("nan", "none", "n/a", "-", "", "null")
EMPTY_MASK = ("nan", "none", "n/a", "-", "")


# Every character that counts as white space; SQL ``trim`` alone takes off blanks only.
WHITE_SPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim any Unicode white space."""
    return F.trim(c, F.lit(WHITE_SPACE))


def is_empty(c: Column, tokens: Iterable[str] = EMPTY_QUALITY) -> Column:
    """True for NULL and for the given placeholder texts, whatever their case or padding."""
    return c.isNull() | F.lower(strip(c)).isin(*tokens)


def normalize(c: Column) -> Column:
    """Lower case, no punctuation, single blanks."""
    words = F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")
    return strip(F.regexp_replace(words, r"(?U)\s+", " "))


def normalize_header(c: Column) -> Column:
    """Lower-case column name with runs of ``_``, ``-`` and blanks as one blank."""
    return strip(F.regexp_replace(F.lower(strip(c)), r"(?U)[_\-\s]+", " "))


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter: ``o'neil sku-a`` becomes ``O'Neil Sku-A``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r)))))
    return F.array_join(cased, "")


def sort_tokens(c: Column) -> Column:
    """White-space separated tokens in order, joined by one blank."""
    return F.array_join(F.array_sort(F.split(strip(c), r"(?U)\s+")), " ")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def last_ten_digits(c: Column) -> Column:
    return F.right(digits(c), F.lit(10))


def clean_reference(c: Column) -> Column:
    """Reference number without dashes and blanks, lower case."""
    return F.lower(F.translate(strip(c), "- ", ""))


def tax_key(c: Column) -> Column:
    value = F.upper(strip(c))
    return F.when((F.length(value) >= 10) & (value != "NAN"), F.concat(F.lit("gstin_"), value))


def email_key(c: Column) -> Column:
    value = F.lower(strip(c))
    return F.when(value.contains("@") & (F.length(value) > 5), F.concat(F.lit("email_"), value))


def phone_key(c: Column) -> Column:
    value = digits(c)
    return F.when(F.length(value) >= 10, F.concat(F.lit("phone_"), F.right(value, F.lit(10))))


def name_key(c: Column) -> Column:
    """First three letters of the first word plus the last word."""
    words = F.split(normalize(c), " ")
    first = F.left(F.element_at(words, 1), F.lit(3))
    key = F.when(F.size(words) > 1, F.concat_ws("_", F.lit("name"), first, F.element_at(words, -1)))
    return F.when(normalize(c) != "", F.coalesce(key, F.concat_ws("_", F.lit("name"), first)))


def has_keyword(name: str, keywords: Iterable[str]) -> bool:
    """Substring test on a column name, done while the plan is built."""
    lowered = name.lower()
    return any(k in lowered for k in keywords)


def any_keyword(c: Column, keywords: Iterable[str]) -> Column:
    """The same test on a column that holds names."""
    lowered = F.lower(c)
    test = F.lit(False)
    for keyword in keywords:
        test = test | lowered.contains(keyword)
    return test
