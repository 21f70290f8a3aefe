"""What one cell holds: number, date or text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.dates import is_date
from tablewright.functions.numbers import NUMBER_CELL, money_text
from tablewright.functions.text import is_empty, strip


def cell_type(c: Column) -> Column:
    """``num``, ``date``, ``text``, or NULL for an empty cell. A date needs a ``-`` or ``/``."""
    text = strip(c)
    return (
        F.when(is_empty(c), F.lit(None).cast("string"))
        .when(money_text(c).rlike(NUMBER_CELL), "num")
        .when((text.contains("-") | text.contains("/")) & is_date(c), "date")
        .otherwise("text")
    )
