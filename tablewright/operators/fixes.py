"""Repeatable fixes, always applied in the same order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.numbers import float_text, parse_money, parse_plain
from tablewright.functions.text import EMPTY_FIX, is_empty, strip, title_case
from tablewright.session import cut_lineage, keep, spread
from tablewright.operators.columns import FENCE_MIN, ROW, data_columns, exact_quantiles, fences, number_cells, text_cells, value_counts

STEPS = ("remove_duplicates", "normalize_cities", "fill_missing", "remove_anomalies")


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first of equal rows; equal rows meet already on the map side."""
    if ROW not in df.columns:
        return df.dropDuplicates(data_columns(df))
    kept = df.groupBy(*[f"`{c}`" for c in data_columns(df)]).agg(F.min(ROW).alias(ROW))
    return kept.select(*df.columns)


def normalize_case(df: DataFrame) -> DataFrame:
    """Trimmed title case in text columns; NULL stays NULL."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")}
    return df.select(*[title_case(strip(F.col(f"`{c}`"))).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def fill_values(df: DataFrame) -> DataFrame:
    """Replacement per column with empty cells: median, else most frequent value, else ``Unknown``.

    Values are counted only for the columns that hold no number at all.
    """
    cells = text_cells(df)
    gaps = cells.groupBy("ord").agg(F.count_if(is_empty(F.col("value"), EMPTY_FIX)).alias("gaps")).where("gaps > 0")
    medians = exact_quantiles(keep(number_cells(df, parse=parse_plain)), ["ord"], "x", [0.5])
    worded = (
        cells.join(F.broadcast(gaps), "ord", "left_semi")
        .join(F.broadcast(medians), "ord", "left_anti")
        .where(~is_empty(F.col("value"), EMPTY_FIX))
    )
    modes = value_counts(worded).groupBy("ord").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
    joined = gaps.join(F.broadcast(medians), "ord", "left").join(F.broadcast(modes), "ord", "left")
    return joined.select("ord", F.coalesce(float_text(F.col("q0")), "mode", F.lit("Unknown")).alias("fill"))


def fill_missing(df: DataFrame) -> DataFrame:
    """Replace empty cells. The replacements, one per column, are fetched and become constants of the scan."""
    fills = {row["ord"]: row["fill"] for row in fill_values(df).collect()}
    place = {c: i for i, c in enumerate(data_columns(df))}

    def filled(name: str) -> F.Column:
        cell = F.col(f"`{name}`")
        if place.get(name) not in fills:
            return cell
        text = cell.cast("string")
        return F.when(is_empty(text, EMPTY_FIX), F.lit(fills[place[name]])).otherwise(text).alias(name)

    return df.select(*[filled(c) for c in df.columns])


def remove_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows outside the fences, column by column, each fence from the rows still there.

    The table is written once, evenly spread, and so are its numbers; all steps read these. The fences of one column, two numbers, are fetched
    before the next column is looked at. What is returned is that table under one conjunctive filter.
    """
    df, columns = spread(df), list(columns or data_columns(df))
    parsed = [parse_money(F.col(f"`{name}`").cast("string")) for name in columns]
    numbers = keep(df.select(*[x.alias(f"x{i}") for i, x in enumerate(parsed)]))
    counts = numbers.agg(*[F.count(c) for c in numbers.columns]).first()
    kept = df
    for i, x in enumerate(parsed):
        if counts[i] < FENCE_MIN:
            continue
        own = F.col(f"x{i}")
        bounds = fences(numbers.where(own.isNotNull()).select(F.lit(0).alias("ord"), own.alias("x")), ["ord"]).first()
        if bounds is None:
            continue
        inside = lambda c: c.isNull() | c.between(bounds["lower_bound"], bounds["upper_bound"])  # noqa: B023, E731
        kept, numbers = kept.where(inside(x)), numbers.where(inside(own))
    return kept


def remove_outliers_single_pass(df: DataFrame) -> DataFrame:
    """Cheaper variant: all fences from the unfiltered table. Not the same result as step by step."""
    numbers = keep(number_cells(df))
    entry = F.struct("ord", F.struct("lower_bound", "upper_bound").alias("b"))
    bounds = fences(numbers, ["ord"]).agg(F.map_from_entries(F.collect_list(entry))).scalar()
    held = F.lit(True)
    for i, name in enumerate(data_columns(df)):
        x = parse_money(F.col(f"`{name}`").cast("string"))
        b = F.try_element_at(bounds, F.lit(i))
        held = held & (x.isNull() | b.isNull() | x.between(b["lower_bound"], b["upper_bound"]))
    return df.where(held)


def apply_fixes(df: DataFrame, selected: Sequence[str]) -> DataFrame:
    """The selected fixes in their fixed order.

    The last two steps read their input several times, so a shuffled input is written out once before them.
    """
    if "remove_duplicates" in selected:
        df = remove_duplicates(df)
    if "normalize_cities" in selected:
        df = normalize_case(df)
    if "remove_duplicates" in selected and {"fill_missing", "remove_anomalies"} & set(selected):
        df = cut_lineage(df)
    if "fill_missing" in selected:
        df = fill_missing(df)
    if "remove_anomalies" in selected:
        df = remove_outliers(df)
    return df


def preview_fixes(df: DataFrame, selected: Sequence[str], dataset: str = "table", role: str = "DATA ANALYST") -> dict[str, DataFrame]:
    """Scores before and after, masked head of the fixed table and its near-duplicate names."""
    from tablewright.operators.names import name_clusters
    from tablewright.operators.privacy import mask_for_role
    from tablewright.operators.profile import preview
    from tablewright.operators.quality import scorecard
    from tablewright.operators.suitability import readiness, suitability
    from tablewright.functions.text import has_keyword

    fixed = apply_fixes(df, selected)
    result = {
        "quality": scorecard(fixed, dataset),
        "readiness": readiness(scorecard(fixed, dataset), suitability(fixed, dataset)),
        "preview": preview(mask_for_role(fixed, role)),
    }
    named = [c for c in data_columns(fixed) if has_keyword(c, NAME_COLUMNS)]
    if named:
        result["name_clusters"] = name_clusters(fixed.select(F.col(named[0]).alias("name")))
    return result


# Name parts of the column searched for near-duplicate names.
NAME_COLUMNS = ("client", "customer", "name", "employee", "student", "patient")


def score_gain(df: DataFrame, selected: Sequence[str], dataset: str = "table") -> DataFrame:
    """Overall quality before and after the selected fixes."""
    from tablewright.operators.quality import scorecard

    df = spread(df)
    before = scorecard(df, dataset).select("dataset", F.col("overall_quality").alias("before"))
    after = scorecard(spread(apply_fixes(df, selected)), dataset).select("dataset", F.col("overall_quality").alias("after"))
    return before.join(after, "dataset").withColumn("gain", F.col("after") - F.col("before"))
