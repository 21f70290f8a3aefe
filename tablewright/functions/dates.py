"""Date expressions over a pinned list of formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import strip

# (shape, format) pairs, tried in order; a text of another shape is no date.
FORMATS = (
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
)
# Shapes the cast itself reads, without the cost of a format parser.
ISO = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def parse_date(c: Column) -> Column:
    """Timestamp or NULL."""
    text = strip(c)
    parsed = F.when(text.rlike(ISO), text.try_cast("timestamp"))
    for shape, fmt in FORMATS:
        parsed = parsed.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
    return parsed


def is_date(c: Column) -> Column:
    return parse_date(c).isNotNull()
