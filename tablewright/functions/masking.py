"""Masking of one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import EMPTY_MASK, digits, strip


def mask_value(c: Column) -> Column:
    """Mask mails, numbers of eight digits or more, and other text; placeholders pass through."""
    text = strip(c)
    parts = F.split(text, "@")
    user, domain = F.element_at(parts, 1), F.element_at(parts, 2)
    head, tail = F.left(text, F.lit(2)), F.right(text, F.lit(2))
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.lower(text).isin(*EMPTY_MASK), text)
        .when(text.contains("@") & (F.length(user) > 2), F.concat(F.left(user, F.lit(2)), F.lit("***@"), domain))
        .when(text.contains("@"), F.concat(F.lit("***@"), domain))
        .when(F.length(digits(text)) >= 8, F.concat(head, F.lit("******"), tail))
        .when(F.length(text) > 4, F.concat(head, F.lit("*****"), F.right(text, F.lit(1))))
        .otherwise("****")
    )
