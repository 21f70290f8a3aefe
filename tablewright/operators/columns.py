"""Per-column building blocks on the long (column, value) view of a table.

The long view is an Expand inside the scan stage. Everything below aggregates it map-side first, so what is
shuffled grows with the number of columns or of distinct values, not with the number of cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.cells import cell_type
from tablewright.functions.dates import is_date
from tablewright.functions.numbers import is_numeric_text, parse_money
from tablewright.functions.text import is_empty
from tablewright.session import cut_lineage

ROW = "_row_idx"


def data_columns(df: DataFrame) -> list[str]:
    """Columns of the table itself; names with a leading underscore are bookkeeping."""
    return [c for c in df.columns if not c.startswith("_")]


def text_cells(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Long view ``(*keep, ord, column, value)`` with every cell as text."""
    columns = list(columns or data_columns(df))
    texts = df.select(*keep, *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    long = texts.unpivot(list(keep), [f"c{i}" for i in range(len(columns))], "_slot", "value")
    names = F.array(*[F.lit(c) for c in columns])
    place = F.substring(F.col("_slot"), 2, 10).cast("int")
    return long.select(*keep, place.alias("ord"), F.element_at(names, place + 1).alias("column"), "value")


def number_cells(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = (), parse=parse_money) -> DataFrame:
    """Long view ``(*keep, ord, column, x)`` of the cells that parse as numbers."""
    cells = text_cells(df, columns, keep)
    return cells.select(*keep, "ord", "column", parse(F.col("value")).alias("x")).where(F.col("x").isNotNull())


def column_facts(cells: DataFrame, keys: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Counts per column: rows, empty cells, cell types, whether all cells are numbers or dates, and ``extra`` aggregates."""
    value = F.col("value")
    typed = cells.withColumn("_type", cell_type(value)).withColumn("_x", parse_money(value))
    return typed.groupBy(*keys, "ord", "column").agg(
        F.count("*").alias("n"),
        F.count("value").alias("present"),
        F.count_if(is_empty(value)).alias("missing"),
        F.count_if(F.col("_type") == "num").alias("num_cells"),
        F.count_if(F.col("_type") == "date").alias("date_cells"),
        F.count_if(F.col("_type") == "text").alias("text_cells"),
        F.count("_x").alias("numbers"),
        F.count_if(F.col("_x") < 0).alias("negatives"),
        F.coalesce(F.bool_and(is_numeric_text(value)), F.lit(False)).alias("all_numeric"),
        F.coalesce(F.bool_and(F.when(value.isNotNull(), is_date(value))), F.lit(False)).alias("all_dates"),
        F.avg("_x").alias("mean"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
        F.stddev_samp("_x").alias("std"),
        *extra,
    )


def value_counts(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of cells per column and value, combined on the map side; hot values travel once per task."""
    return cells.where(F.col("value").isNotNull()).groupBy(*keys, "ord", "column", "value").agg(F.count("*").alias("n"))


#: Half the width of a bracket, in error bounds of the sketch; distinct values that are ranked in one group at most.
MARGIN, RANKED_VALUES = 2.0, 100_000
#: Bits of a value that one histogram tells apart; the shifts of the histograms, one below the other.
SHIFTS = (47, 31, 15, 0)


def ordered_bits(x: Column) -> Column:
    """A long that sorts like the double ``x``: sign, exponent and 51 bits of the mantissa."""
    size = F.abs(x)
    near = F.floor(F.log2(size))
    power = F.pow(F.lit(2.0), near)
    exponent = near + F.when(size >= 2 * power, 1).when(size < power, -1).otherwise(0)
    mantissa = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(float(1 << 51)))
    bits = (exponent + 1075) * F.lit(1 << 51) + mantissa
    endless = F.lit(2100 * (1 << 51))
    whole = F.when(size == 0, F.lit(0)).when(size == float("inf"), endless).otherwise(bits).cast("long")
    return F.when(x < 0, -whole).otherwise(whole)


def _narrowed(kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``kept`` (keys, i, n, h, _v, _w) with at most ``RANKED_VALUES`` values in a group, the wanted ranks among them.

    A histogram of the values' leading bits shows in which cells the ranks lie; what is below is added up, what is above goes,
    and the next bits divide what is left. Cells are as many as the bits allow, whatever the data.
    """
    group = [*keys, "i"]
    for shift in SHIFTS:
        sizes = kept.groupBy(*group).agg(F.count("_v").alias("_size")).where(F.col("_size") > RANKED_VALUES).select(*group)
        if sizes.isEmpty():
            break
        sizes = F.broadcast(sizes)  # a row a column and probability
        wide = kept.join(sizes, group, "left_semi").withColumn("_cell", F.shiftright(ordered_bits(F.col("_v")), shift))
        cells = wide.groupBy(*group, "h", "_cell").agg(F.sum("_w").alias("_c"))
        order = Window.partitionBy(*group).orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        ends = cells.withColumn("_to", F.sum("_c").over(order))
        holds = lambda rank: (F.col("_to") > rank) & (F.col("_to") - F.col("_c") <= rank)
        ends = ends.where(F.col("_cell").isNotNull() & (holds(F.floor("h")) | holds(F.ceil("h"))))
        spans = ends.groupBy(*group).agg(F.min("_cell").alias("_first"), F.max("_cell").alias("_last"))
        below = F.col("_cell") < F.col("_first")
        inside = wide.join(F.broadcast(spans), group).where(F.col("_cell").isNull() | (F.col("_cell") <= F.col("_last")))
        inside = inside.groupBy(*group, "n", "h", F.when(~below, F.col("_v")).alias("_v")).agg(F.sum("_w").alias("_w"))
        kept = cut_lineage(kept.join(sizes, group, "left_anti").unionByName(inside))
    return kept


def exact_quantiles(
    cells: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10000
) -> DataFrame:
    """Linearly interpolated quantiles ``q0, q1, ...`` and the count ``n`` per key, without one big group.

    A mergeable sketch brackets each wanted rank. A second pass counts what lies below the bracket and keeps
    the distinct values inside it, which are narrowed down until few enough are left to be ranked. A rank that lies outside
    its bracket is looked for in the whole range, in a pass for such ranks only.
    ``keys`` must name few groups, such as columns of a table: the brackets are broadcast.
    """
    margin = MARGIN / accuracy
    points = [min(1.0, max(0.0, p + side)) for p in probs for side in (-margin, margin)]
    sketch = cells.groupBy(*keys).agg(
        F.count(value).alias("n"), F.percentile_approx(value, points, accuracy).alias("_points")
    )
    # Where the margin is but a few rows wide the bracket is the whole range, which holds few values then.
    few = F.col("n") <= RANKED_VALUES
    lowest, highest = F.lit(float("-inf")), F.lit(float("inf"))
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.when(few, lowest).otherwise(F.col("_points")[2 * i]).alias("low"),
                F.when(few, highest).otherwise(F.col("_points")[2 * i + 1]).alias("high"),
                ((F.col("n") - 1) * F.lit(p)).alias("h"),
            )
            for i, p in enumerate(probs)
        ]
    )
    wanted = sketch.select(*keys, "n", F.explode(brackets).alias("_b")).select(*keys, "n", "_b.*")
    x = F.col(value)
    below, above = F.floor("h"), F.ceil("h")
    order = Window.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found: DataFrame | None = None
    while True:
        kept = (
            cells.join(F.broadcast(wanted), list(keys))
            .where(x <= F.col("high"))
            .groupBy(*keys, "i", "n", "h", F.when(x >= F.col("low"), x).alias("_v"))
            .agg(F.count("*").alias("_w"))
        )
        ranked = _narrowed(cut_lineage(kept), keys).withColumn("_cum", F.sum("_w").over(order))
        picked = ranked.groupBy(*keys, "i", "n", "h").agg(
            F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_cum"))), F.lit(0)).alias("_under"),
            F.max("_cum").alias("_upto"),
            F.min(F.when(F.col("_cum") > below, F.col("_v"))).alias("_a"),
            F.min(F.when(F.col("_cum") > above, F.col("_v"))).alias("_z"),
        )
        inside = (F.col("_under") <= below) & (F.col("_upto") > above)
        picked = cut_lineage(picked.withColumn("_inside", inside))
        found = picked if found is None else found.unionByName(picked)
        missed = picked.where(~F.col("_inside"))
        if missed.isEmpty():
            break
        wanted = missed.select(*keys, "n", "i", lowest.alias("low"), highest.alias("high"), "h")
    result = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("h") - below)
    return found.where("_inside").groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, result)).alias(f"q{i}") for i in range(len(probs))]
    )


# Fences lie this many interquartile ranges out, and need this many numbers.
FENCE = 1.5
FENCE_MIN = 4


def fences(numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lower and upper outlier bound per key, for keys with at least four numbers."""
    quartiles = exact_quantiles(numbers, keys, "x", [0.25, 0.75])
    spread = F.col("q1") - F.col("q0")
    return quartiles.where(F.col("n") >= FENCE_MIN).select(
        *keys,
        F.col("n").alias("numbers"),
        (F.col("q0") - FENCE * spread).alias("lower_bound"),
        (F.col("q1") + FENCE * spread).alias("upper_bound"),
    )


def outside(x: Column, low: Column, high: Column) -> Column:
    return (x < low) | (x > high)
