"""The six quality dimensions, their issues and the scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import clamp, percent
from tablewright.functions.text import has_keyword, is_empty, strip
from tablewright.operators.columns import (
    ROW,
    column_facts,
    data_columns,
    fences,
    number_cells,
    outside,
    text_cells,
)
from tablewright.operators.profile import completeness_tier
from tablewright.session import keep, spread

# Columns whose names mark them as never negative.
POSITIVE_NAMES = (
    "revenue", "cost", "stock", "quantity", "charges", "salary",
    "rate", "balance", "gpa", "price", "valuation", "palletcount",
)
# Columns, by exact lower-case name, whose outliers are reported as an issue.
OUTLIER_NAMES = ("revenue", "palletcount", "monthlycharges")
# Weights of the dimensions.
WEIGHTS = {
    "completeness": 0.20, "consistency": 0.20, "validity": 0.20,
    "duplicates": 0.15, "structure": 0.15, "anomalies": 0.10,
}
# Texts of the issues; %s is the column, %n the count, %p the percentage, %e the example.
ISSUE_TEXTS = {
    "Completeness": (
        'Missing values in column "%s"',
        "%n cells (%p%) are empty or null.",
        "Downstream pipelines and model learning cannot impute value parameters.",
        "Impute missing elements using category mode or median numbers.",
    ),
    "Consistency": (
        'Capitalization inconsistency in "%s"',
        "Different spelling/casing variations detected (e.g. %e).",
        "Group-by aggregations and categorical encoding steps treat these as unique labels.",
        "Normalize spelling text to Title Case.",
    ),
    "Validity": (
        'Negative metrics in positive field "%s"',
        "Found %n negative records (e.g., negative revenues or warehouse count).",
        "Distorts analytical totals and causes invalid schema validation assertions.",
        "Set negative outliers to zero or replace with absolute values.",
    ),
    "Duplicates": (
        "Exact duplicate rows",
        "Found %n duplicate records in dataset.",
        "Overstates transaction parameters and skews model class balances.",
        "Apply deduplication and keep unique items.",
    ),
    "Structure": (
        'Mixed data types in "%s"',
        "Column contains mixed string and numeric inputs (e.g. numeric metrics containing string format units).",
        "Fails standard schema validation assertions and causes calculations to crash.",
        "Clean column characters and convert to uniform data type.",
    ),
    "Anomaly": (
        'Extreme numeric outliers in "%s"',
        "Detected %n statistical outlier elements.",
        "Skews mean and variance parameters, confusing downstream prediction regressions.",
        "Cap outliers at IQR threshold boundaries or remove extreme rows.",
    ),
}


def spellings(df: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Distinct trimmed values with cased letters: ``(ord, column, folded, v, first)``, ``first`` the row that has it first.

    A value without cased letters has no variants and is dropped before the shuffle, which spares numbers,
    dates and most ids. Distinct values are formed map-side, so a value in a third of all rows is no hot key.
    ``only`` (ord, folded), a row a column, leaves those groups alone, before anything is shuffled.
    """
    value = strip(F.col("value"))
    cells = text_cells(df, keep=[ROW] if ROW in df.columns else [])
    row = F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()
    cased = (
        cells.where(~is_empty(F.col("value")))
        .select("ord", "column", value.alias("v"), row.alias("_row"))
        .where(F.lower("v") != F.upper("v"))
        .withColumn("folded", F.lower("v"))
    )
    if only is not None:
        cased = cased.join(F.broadcast(only), ["ord", "folded"], "left_semi")
    return cased.groupBy("ord", "column", "folded", "v").agg(F.min("_row").alias("first"))


def case_groups(df: DataFrame) -> DataFrame:
    """Values that differ in case only: ``(ord, column, folded, variants)``, counted, never listed."""
    return spellings(df).groupBy("ord", "column", "folded").agg(F.count("*").alias("variants")).where(F.col("variants") > 1)


def case_counts(df: DataFrame) -> DataFrame:
    """Per column: groups with variants, surplus spellings and the alphabetically first group."""
    return case_groups(df).groupBy("ord", "column").agg(
        F.count("*").alias("groups"), F.sum(F.col("variants") - 1).alias("surplus"), F.min("folded").alias("folded")
    )


def case_variants(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per column: groups with variants, surplus spellings and the spellings of the alphabetically first group.

    Only the spellings of that group, which make up the shown text, are put together. ``counts``: ``case_counts``, if known.
    """
    counts, order = case_counts(df) if counts is None else counts, F.struct("first", "v")
    shown = spellings(df, counts.select("ord", "folded")).groupBy("ord").agg(F.array_sort(F.collect_list(order))["v"].alias("texts"))
    return counts.join(shown.hint("merge"), "ord").select("ord", "column", "groups", "surplus", F.array_join("texts", ", ").alias("example"))


def row_digest(df: DataFrame) -> F.Column:
    """256-bit digest of a whole row; length marks keep NULL, '' and shifted values apart."""
    parts = []
    for name in data_columns(df):
        text = F.col(f"`{name}`").cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, and rows that repeat an earlier one; only digests are shuffled."""
    copies = df.select(F.unhex(row_digest(df)).alias("d")).groupBy("d").agg(F.count("*").alias("c"))
    total = F.coalesce(F.sum("c"), F.lit(0))
    return copies.agg(total.alias("num_rows"), (total - F.count("*")).alias("duplicates"))


def outlier_counts(df: DataFrame) -> DataFrame:
    """Cells outside the fences, for every column with at least four numbers."""
    numbers = keep(number_cells(df))  # read three times
    bounds = fences(numbers, ["ord"])
    joined = numbers.join(F.broadcast(bounds), "ord")
    return joined.groupBy("ord", "column").agg(
        F.max("numbers").alias("numbers"),
        F.max("lower_bound").alias("lower_bound"),
        F.max("upper_bound").alias("upper_bound"),
        F.count_if(outside(F.col("x"), F.col("lower_bound"), F.col("upper_bound"))).alias("outliers_count"),
    )


def outlier_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bounds and outlier count of the named columns; zeros where fewer than four numbers exist."""
    spark = df.sparkSession
    asked = spark.createDataFrame(list(enumerate(columns)), "ord int, column string")
    found = outlier_counts(df.select(*[F.col(f"`{c}`") for c in columns])).drop("column", "numbers")
    joined = asked.join(F.broadcast(found), "ord", "left")
    return joined.select(
        "column",
        F.coalesce("outliers_count", F.lit(0)).cast("bigint").alias("outliers_count"),
        *[F.coalesce(b, F.lit(0.0)).alias(b) for b in ("lower_bound", "upper_bound")],
    )


def outlier_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The outlying cells themselves: ``(column, _row_idx, value)``."""
    numbers = keep(number_cells(df, columns, [ROW]))
    joined = numbers.join(F.broadcast(fences(numbers, ["ord"])), "ord")
    return joined.where(outside(F.col("x"), F.col("lower_bound"), F.col("upper_bound"))).select(
        "column", ROW, F.col("x").alias("value")
    )


def is_mixed() -> F.Column:
    """Whether no single cell type makes up 95 % of a column."""
    typed = F.col("num_cells") + F.col("date_cells") + F.col("text_cells")
    share = F.try_divide(F.greatest("num_cells", "date_cells", "text_cells") * F.lit(1.0), typed)
    return F.coalesce((share < 0.95) & (share > 0.05), F.lit(False))


def column_checks(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per column with the counts behind every dimension; numbers only, so small enough to broadcast.

    ``counts``: ``case_counts``, if known.
    """
    positive = [c for c in data_columns(df) if has_keyword(c, POSITIVE_NAMES)]
    facts = column_facts(text_cells(df))
    variants = (case_counts(df) if counts is None else counts).select("ord", "surplus")
    outliers = outlier_counts(df).select("ord", "outliers_count")
    joined = facts.join(F.broadcast(variants), "ord", "left").join(F.broadcast(outliers), "ord", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "ord", "column", "n", "missing", "num_cells", "date_cells", "text_cells",
        is_mixed().alias("mixed"),
        F.when(F.col("column").isin(positive), F.col("negatives")).otherwise(zero).alias("negatives"),
        F.coalesce("surplus", zero).alias("surplus"),
        F.coalesce("outliers_count", zero).alias("outliers"),
    )


def scorecard(df: DataFrame, dataset: str = "table") -> DataFrame:
    """All dimension scores and the weighted overall quality as one row.

    An empty table scores 100 everywhere and has no overall quality.
    """
    columns = data_columns(df)
    checks = column_checks(df)

    def summed(expr: F.Column) -> F.Column:
        return F.coalesce(F.sum(expr), F.lit(0))

    tier_sums = []
    for tier in ("critical", "standard", "optional"):
        member = F.col("column").isin([c for c in columns if completeness_tier(c) == tier])
        tier_sums.append(summed(F.when(member, F.col("n"))).alias(f"{tier}_cells"))
        tier_sums.append(summed(F.when(member, F.col("missing"))).alias(f"{tier}_missing"))
    zero = F.lit(0).cast("bigint")
    by_column = checks.agg(
        summed(F.col("n")).alias("cells"),
        summed(F.col("missing")).alias("missing"),
        summed(F.col("surplus")).alias("surplus"),
        summed(F.col("negatives")).alias("negatives"),
        summed(F.col("mixed").cast("int")).alias("mixed"),
        summed(F.col("outliers")).alias("outliers"),
        *tier_sums,
        zero.alias("num_rows"),
        zero.alias("duplicates"),
    )
    names = by_column.columns
    by_row = duplicate_count(df).select(*[F.col(c) if c in ("num_rows", "duplicates") else zero.alias(c) for c in names])
    total = by_column.unionByName(by_row).agg(*[F.sum(c).alias(c) for c in names])
    rows = F.col("num_rows")

    def penalty(count: str, over: F.Column, factor: int, low: int) -> F.Column:
        rate = F.try_divide(F.col(count) * F.lit(1.0), over) * factor
        return F.when(rows == 0, F.lit(100)).otherwise(clamp(F.bround(F.lit(100) - rate).cast("int"), low))

    scored = total.select(
        F.lit(dataset).alias("dataset"),
        percent(F.col("cells") - F.col("missing"), F.col("cells")).alias("completeness"),
        *[
            percent(F.col(f"{t}_cells") - F.col(f"{t}_missing"), F.col(f"{t}_cells")).alias(f"{t}_completeness")
            for t in ("critical", "standard", "optional")
        ],
        penalty("surplus", rows, 100, 20).alias("consistency"),
        penalty("negatives", rows, 100, 30).alias("validity"),
        percent(rows - F.col("duplicates"), rows).alias("duplicates"),
        penalty("mixed", F.lit(len(columns)), 50, 30).alias("structure"),
        penalty("outliers", rows, 80, 40).alias("anomalies"),
        rows.alias("_rows"),
    )
    weighted = sum((F.col(d) * F.lit(w) for d, w in WEIGHTS.items()), F.lit(0.0))
    overall = F.when(F.col("_rows") > 0, F.bround(weighted).cast("int"))
    return scored.withColumn("overall_quality", overall).drop("_rows")


def _issue(kind: str, prefix: str, severity: F.Column, seq: int, count: str) -> F.Column:
    title, description, impact, action = ISSUE_TEXTS[kind]
    column = F.coalesce("column", F.lit("All Columns"))

    def fill(text: str) -> F.Column:
        filled = F.lit(text)
        for mark, value in (
            ("%s", column),
            ("%n", F.col(count).cast("string")),
            ("%p", percent(F.col(count), F.col("n")).cast("string")),
            ("%e", F.coalesce("example", F.lit(""))),
        ):
            if mark in text:
                filled = F.replace(filled, F.lit(mark), value)
        return filled

    name = F.lit("duplicate_rows") if kind == "Duplicates" else F.concat(F.lit(prefix), column)
    return F.when(
        F.col(count) > 0,
        F.struct(
            F.lit(seq).alias("step"), name.alias("id"), column.alias("column"), severity.alias("severity"),
            F.lit(kind).alias("type"), fill(title).alias("title"), fill(description).alias("description"),
            F.lit(impact).alias("impact"), F.lit(action).alias("action"),
        ),
    )


def issues(df: DataFrame) -> DataFrame:
    """Every finding as a row, numbered by dimension and then by column."""
    df = spread(df)
    counts = keep(case_counts(df))
    examples = case_variants(df, counts).select("ord", "example")
    checks = column_checks(df, counts).withColumn("mixed", F.col("mixed").cast("int")).join(examples.hint("merge"), "ord", "left")
    checks = checks.withColumn(
        "reported", F.when(F.lower("column").isin(*OUTLIER_NAMES), F.col("outliers")).otherwise(F.lit(0))
    )
    share = percent(F.col("missing"), F.col("n"))
    found = F.array(
        _issue("Completeness", "missing_", F.when(share > 20, "Critical").otherwise("High"), 1, "missing"),
        _issue("Consistency", "consistent_", F.lit("Medium"), 2, "surplus"),
        _issue("Validity", "invalid_neg_", F.lit("Critical"), 3, "negatives"),
        _issue("Structure", "structure_", F.lit("Medium"), 5, "mixed"),
        _issue("Anomaly", "outlier_", F.lit("High"), 6, "reported"),
    )
    by_column = checks.select("ord", F.explode(F.array_compact(found)).alias("i")).select("ord", "i.*")
    repeated = duplicate_count(df).select(
        F.lit(0).alias("ord"), F.lit(None).cast("string").alias("column"), F.col("num_rows").alias("n"),
        F.lit(None).cast("string").alias("example"), "duplicates",
    )
    by_row = repeated.where(F.col("duplicates") > 0).select(
        "ord", _issue("Duplicates", "", F.lit("High"), 4, "duplicates").alias("i")
    ).select("ord", "i.*")
    return by_column.unionByName(by_row).withColumn("seq", F.col("step") * 100000 + F.col("ord")).drop("step", "ord")
