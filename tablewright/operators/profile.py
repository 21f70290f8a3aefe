"""Column and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import percent, round_even
from tablewright.functions.text import has_keyword
from tablewright.operators.columns import (
    ROW,
    column_facts,
    data_columns,
    text_cells,
)

# Completeness tiers by column name; a column belongs to the first tier that fits.
CRITICAL_NAMES = ("revenue", "sales", "invoice", "gstin", "amount", "id", "cust")
STANDARD_NAMES = ("phone", "email", "name", "date", "contact", "mobile")


def logical_type(numeric: str = "Numeric", date: str = "DateTime/Other") -> F.Column:
    """Type from ``present``, ``all_numeric`` and ``all_dates``."""
    return (
        F.when((F.col("present") > 0) & F.col("all_numeric"), numeric)
        .when((F.col("present") > 0) & F.col("all_dates"), date)
        .otherwise("Categorical")
    )


def column_details(df: DataFrame, keys: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Everything known about every column, per ``keys`` if given, with ``extra`` aggregates; one row per column."""
    columns = [c for c in data_columns(df) if c not in keys]
    cells = text_cells(df, columns, keys)
    by = [*keys, "ord"]
    # Long texts are counted by their digest; shorter ones, whose bytes no digest equals, as they are.
    value = F.col("value")
    mark = F.when(F.octet_length(value) < 32, value.cast("binary")).otherwise(F.unhex(F.sha2(value, 256)))
    marks = cells.where(value.isNotNull()).select(*by, mark.alias("_mark")).distinct()
    distinct = marks.groupBy(*by).agg(F.count("*").alias("cardinality"))
    merged = column_facts(cells, keys, extra).join(distinct if keys else F.broadcast(distinct), by, "left")
    return merged.withColumn("cardinality", F.coalesce("cardinality", F.lit(0)).cast("bigint")).withColumn("type", logical_type())


def column_profile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Type, distinct values, empty cells and number statistics of every column, per ``keys`` if given."""
    stat = F.col("type") == "Numeric"
    return column_details(df, keys).select(
        *keys,
        F.col("ord").alias("ordinal"),
        "column",
        "type",
        "cardinality",
        "missing",
        percent(F.col("missing"), F.col("n"), 0).alias("missing_pct"),
        *[F.when(stat, round_even(F.col(s), 2)).alias(s) for s in ("mean", "min", "max", "std")],
    )


def scoped_profile(df: DataFrame, role: str, selected: Sequence[str] | None = None) -> DataFrame:
    """Profile of what the role may see, with the scope status of each column; empty for a VIEWER."""
    from tablewright.operators.privacy import mask_for_role

    kept = list(selected) if selected is not None else data_columns(df)
    status = F.when(F.col("column").isin(kept), "Included").otherwise("Excluded from analysis")
    return column_profile(mask_for_role(df, role)).withColumn("scope_status", status)


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, cells and the number of columns of each type, as one row."""
    columns = data_columns(df)
    typed = column_facts(text_cells(df)).withColumn("type", logical_type())
    rows = F.coalesce(F.max("n"), F.lit(0))
    return typed.agg(
        rows.alias("num_rows"),
        F.lit(len(columns)).cast("bigint").alias("num_cols"),
        (rows * len(columns)).alias("total_cells"),
        F.count_if(F.col("type") == "Numeric").alias("numeric_cols"),
        F.count_if(F.col("type") == "Categorical").alias("categorical_cols"),
        F.count_if(F.col("type") == "DateTime/Other").alias("datetime_cols"),
    )


def missing_cells(df: DataFrame) -> DataFrame:
    """Empty cells per column and their share, to one decimal."""
    facts = column_facts(text_cells(df))
    share = F.try_divide(F.col("missing") * F.lit(100.0), F.col("n"))
    return facts.select(F.col("ord").alias("ordinal"), "column", "missing", round_even(share, 1).alias("missing_pct"))


def completeness_tier(column: str) -> str:
    if has_keyword(column, CRITICAL_NAMES):
        return "critical"
    return "standard" if has_keyword(column, STANDARD_NAMES) else "optional"


def tiered_completeness(df: DataFrame) -> DataFrame:
    """Share of filled cells per name tier; 100 for a tier without columns."""
    facts = column_facts(text_cells(df))
    tier = F.lit("optional")
    for name in data_columns(df):
        tier = F.when(F.col("column") == name, completeness_tier(name)).otherwise(tier)
    spark = df.sparkSession
    tiers = spark.createDataFrame([("critical",), ("standard",), ("optional",)], "tier string")
    sums = facts.groupBy(tier.alias("tier")).agg(F.sum("n").alias("cells"), F.sum("missing").alias("missing"))
    joined = tiers.join(F.broadcast(sums), "tier", "left")
    cells, empty = F.coalesce("cells", F.lit(0)), F.coalesce("missing", F.lit(0))
    return joined.select("tier", cells.alias("cells"), empty.alias("missing"), percent(cells - empty, cells).alias("completeness"))


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """First rows in row order, NULL shown as ''."""
    columns = data_columns(df)
    head = df.orderBy(ROW).limit(rows)
    return head.select(ROW, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns])
