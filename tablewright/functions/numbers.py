"""Number expressions: tolerant parsing, rounding, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import strip

# Plain casts accept texts such as '5d' or 'nan', so every parse is guarded by this pattern.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# A cell's type also counts digit groups joined by '_', and the words a float parser knows.
NUMBER_CELL = r"^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:inf|infinity|nan))$"


def money_text(c: Column) -> Column:
    return strip(F.translate(c, "$,", ""))


def parse_plain(c: Column) -> Column:
    """Number or NULL, blanks around it allowed."""
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_money(c: Column) -> Column:
    """Number or NULL after dropping ``$`` and thousands commas."""
    text = money_text(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def is_numeric_text(c: Column) -> Column:
    """Whether a non-null cell leaves its column numeric; blank texts do."""
    text = money_text(c)
    return text.rlike(NUMBER) | (text == "")


def strict_float(c: Column, data_type: T.DataType | None = None) -> Column:
    """Keep digits, dots and minus signs, then parse; 0 where that is no number."""
    if isinstance(data_type, T.NumericType):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    text = F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "")
    return F.coalesce(F.when(text.rlike(NUMBER), text.try_cast("double")), F.lit(0.0))


def strict_int(c: Column) -> Column:
    """Whole part of a number, 0 where it is none."""
    return F.coalesce(parse_plain(c.cast("string")).try_cast("bigint"), F.lit(0).cast("bigint"))


def percent_text(c: Column) -> Column:
    text = strip(F.replace(c, F.lit("%"), F.lit("")))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def round_even(c: Column, places: int = 0) -> Column:
    """Half-to-even rounding of a double."""
    return F.bround(c, places)


def whole(c: Column) -> Column:
    """Half-even rounded integer."""
    return F.bround(c, 0).cast("int")


def percent(part: Column, total: Column, empty: int = 100) -> Column:
    """Rounded percentage, ``empty`` where the total is 0."""
    return F.when(total == 0, F.lit(empty)).otherwise(whole(F.try_divide(part * F.lit(1.0), total) * 100))


def clamp(c: Column, low: int, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def float_text(x: Column) -> Column:
    """Shortest decimal text of a double, in plain digits up to 1e16 where the cast would use an exponent."""
    digits = F.regexp_replace(x.try_cast("decimal(38,15)").cast("string"), r"0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e16), plain).otherwise(x.cast("string"))
