"""Fitness of a table for machine learning, and the readiness score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import clamp, parse_money, parse_plain
from tablewright.functions.text import has_keyword
from tablewright.operators.columns import data_columns, number_cells, text_cells, value_counts
from tablewright.session import spread

# Exact lower-case names of target columns.
TARGETS = ("churn", "target", "label", "exited")
# Name parts that hint at leakage, and exact names that do not.
LEAKAGE = ("cancellation", "exit", "date")
NO_LEAKAGE = ("tenure", "orderdate", "joindate", "timestamp")
# Id-like name parts and the share of distinct values that makes them high-cardinality.
ID_NAMES = ("id", "code", "customer", "sku", "number", "variant")
ID_SHARE = 0.8
REDUNDANT = 0.85
# The columns an order table is compared with.
ORDER_COLUMNS = ("OrderID", "Client", "Phone", "Region", "Revenue", "OrderDate")
# Covariances computed per pass over the table.
PAIRS_PER_PASS = 150


def target_column(df: DataFrame) -> str | None:
    return next((c for c in data_columns(df) if c.lower() in TARGETS), None)


def leakage_columns(df: DataFrame) -> list[str]:
    """Columns whose names suggest they are known only after the outcome; none without a target."""
    target = target_column(df)
    if target is None:
        return []
    clear = (*NO_LEAKAGE, target.lower())
    return [c for c in data_columns(df) if has_keyword(c, LEAKAGE) and c.lower() not in clear]


def drop_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*leakage_columns(df))


def class_imbalance(df: DataFrame, dataset: str = "table") -> DataFrame:
    """Sizes of the two largest classes of the target column, their ratio and its band."""
    target = target_column(df)
    if target is None:
        spark = df.sparkSession
        return spark.createDataFrame(
            [(dataset, None, "Optimal (N/A)", "0:0")],
            "dataset string, target_col string, class_imbalance string, class_imbalance_ratio string",
        )
    classes = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("c"))
    top = classes.orderBy(F.desc("c")).limit(2).agg(F.sort_array(F.collect_list("c"), asc=False).alias("top"))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    ratio = F.try_divide(first * F.lit(1.0), second)
    shown = F.concat(F.lit("(Ratio "), F.format_string("%.1f", F.bround(ratio, 1)), F.lit(":1)"))
    band = F.when((ratio > 10) | (ratio < 0.1), "Severe ").when((ratio > 3) | (ratio < 0.33), "Moderate ").otherwise("Low ")
    return top.select(
        F.lit(dataset).alias("dataset"),
        F.lit(target).alias("target_col"),
        F.when(ratio.isNull(), "Optimal (N/A)").otherwise(F.concat(band, shown)).alias("class_imbalance"),
        F.when(ratio.isNull(), "0:0").otherwise(F.concat_ws(":", first.cast("string"), second.cast("string"))).alias("class_imbalance_ratio"),
    )


def high_cardinality(df: DataFrame, dataset: str = "table") -> DataFrame:
    """First id-like column whose values are nearly all distinct; only id-like columns are read."""
    candidates = [c for c in data_columns(df) if has_keyword(c, ID_NAMES)]
    if not candidates:
        return df.sparkSession.createDataFrame([(dataset, "")], "dataset string, high_cardinality_col string")
    cells = text_cells(df, candidates)
    distinct = value_counts(cells).groupBy("ord").agg(F.count("*").alias("distinct"))
    rows = cells.groupBy("ord", "column").agg(F.count("*").alias("n"))
    many = rows.join(F.broadcast(distinct), "ord").where(F.col("distinct") / F.col("n") > ID_SHARE)
    return many.agg(
        F.lit(dataset).alias("dataset"), F.coalesce(F.min_by("column", "ord"), F.lit("")).alias("high_cardinality_col")
    )


def numeric_columns(df: DataFrame) -> DataFrame:
    """Columns with at least four cells that parse as numbers."""
    counts = number_cells(df).groupBy("ord", "column").agg(F.count("*").alias("numbers"))
    return counts.where(F.col("numbers") >= 4)


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson coefficient of every pair of numeric columns, cells that are no number counting as 0.

    All pairs of a pass come from one map-side aggregate. A pair with a constant column has no coefficient.
    """
    columns = columns or data_columns(df)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    wide = df.select(
        *[F.coalesce(parse_plain(F.col(f"`{c}`").cast("string")), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)],
        *[parse_money(F.col(f"`{c}`").cast("string")).isNotNull().alias(f"k{i}") for i, c in enumerate(columns)],
    )
    passes = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[start : start + PAIRS_PER_PASS]
        used = sorted({i for pair in part for i in pair})
        sums = wide.agg(
            *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in used],
            *[F.count_if(f"k{i}").alias(f"n{i}") for i in used],
            *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in part],
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(i).alias("ord1"), F.lit(j).alias("ord2"),
                    F.lit(columns[i]).alias("col1"), F.lit(columns[j]).alias("col2"),
                    F.when(
                        (F.col(f"n{i}") >= 4) & (F.col(f"n{j}") >= 4),
                        F.try_divide(F.col(f"c{i}_{j}"), F.col(f"s{i}") * F.col(f"s{j}")),
                    ).alias("coefficient"),
                )
                for i, j in part
            ]
        )
        passes.append(sums.select(F.explode(rows).alias("p")).select("p.*"))
    result = passes[0]
    for more in passes[1:]:
        result = result.unionByName(more)
    return result.where(F.col("coefficient").isNotNull())


def redundant_pairs(df: DataFrame) -> DataFrame:
    strong = correlations(df).where(F.abs("coefficient") > REDUNDANT)
    return strong.select("ord1", "ord2", "col1", "col2", F.bround("coefficient", 2).alias("coefficient"))


def order_drift(columns: list[str]) -> dict:
    """Difference to the fixed order columns, for tables with an ``OrderID`` and another number of columns."""
    if "OrderID" not in columns or len(columns) == len(ORDER_COLUMNS):
        return {"drifted": False, "added": [], "removed": []}
    return {
        "drifted": True,
        "added": [c for c in columns if c not in ORDER_COLUMNS],
        "removed": [c for c in ORDER_COLUMNS if c not in columns],
    }


def suitability(df: DataFrame, dataset: str = "table") -> DataFrame:
    """All diagnostics of one table as one row."""
    leaks = leakage_columns(df)
    drift = order_drift(data_columns(df))
    pair = F.struct("ord1", "ord2", "col1", "col2", "coefficient")
    pairs = redundant_pairs(df).agg(F.lit(dataset).alias("dataset"), F.array_sort(F.collect_list(pair)).alias("_pairs"))
    numeric = numeric_columns(df).agg(
        F.lit(dataset).alias("dataset"), F.array_sort(F.collect_list(F.struct("ord", "column"))).alias("_numeric")
    )
    joined = class_imbalance(df, dataset)
    for part in (high_cardinality(df, dataset), pairs, numeric):
        joined = joined.join(part, "dataset")
    return joined.select(
        "dataset", "target_col", "class_imbalance", "class_imbalance_ratio",
        F.lit(bool(leaks)).alias("has_target_leakage"),
        F.lit(leaks[0] if leaks else "").alias("target_leakage_col"),
        "high_cardinality_col",
        F.transform("_pairs", lambda p: p.dropFields("ord1", "ord2")).alias("redundant_pairs"),
        F.lit(drift["drifted"]).alias("drifted"),
        F.array(*[F.lit(c) for c in drift["added"]]).cast("array<string>").alias("added_columns"),
        F.array(*[F.lit(c) for c in drift["removed"]]).cast("array<string>").alias("removed_columns"),
        F.transform("_numeric", lambda p: p["column"]).alias("numeric_cols"),
    )


# Penalties, weights and the mark a table must reach.
LEAK_PENALTY, SEVERE_PENALTY, CARDINALITY_PENALTY, OFFLINE_PENALTY = 25, 15, 10, 5
READY = 80


def ml_score(quality: Column) -> Column:
    cut = F.when(F.col("has_target_leakage"), LEAK_PENALTY).otherwise(0)
    cut = cut + F.when(F.col("class_imbalance").startswith("Severe"), SEVERE_PENALTY).otherwise(0)
    cut = cut + F.when(F.col("high_cardinality_col") != "", CARDINALITY_PENALTY).otherwise(0)
    return clamp(quality - cut, 10)


def readiness(scores: DataFrame, diagnostics: DataFrame, security_status: str = "Clean") -> DataFrame:
    """Overall readiness per dataset from a scorecard and the diagnostics, both keyed by ``dataset``."""
    infected = security_status == "Infected"
    security = 100 - (OFFLINE_PENALTY if security_status == "Unavailable" else 0)
    quality = F.coalesce("overall_quality", F.lit(80))
    joined = scores.join(diagnostics, "dataset").withColumn("_ml", ml_score(quality))
    weighted = quality * F.lit(0.45) + F.col("_ml") * F.lit(0.35) + F.lit(float(security)) * F.lit(0.20)
    overall = clamp(F.bround(weighted).cast("int"), 0)
    zero = F.lit(0)
    status = F.when(F.lit(infected), "BLOCKED (INFECTED)").when(overall >= READY, "AI READY").otherwise("NEEDS IMPROVEMENT")
    return joined.select(
        "dataset",
        (zero if infected else overall).alias("overall_readiness"),
        (zero if infected else quality).alias("quality"),
        F.lit(0 if infected else security).alias("security"),
        (zero if infected else F.col("_ml")).alias("ml_readiness"),
        status.alias("status"),
    )


def table_readiness(df: DataFrame, dataset: str, selected: list[str] | None = None, security_status: str = "Clean") -> DataFrame:
    """Readiness of a table restricted to its selected columns, with the scope counts."""
    from tablewright.operators.access import scoped
    from tablewright.operators.quality import scorecard

    scope = spread(scoped(df, selected))
    result = readiness(scorecard(scope, dataset), suitability(scope, dataset), security_status)
    total = len(data_columns(df))
    return result.select(
        "*",
        F.lit(len(selected) if selected is not None else total).alias("scope_selected"),
        F.lit(total).alias("scope_total"),
    )


# Advice printed on every report.
ADVICE = (
    "De-duplicate near customer matches using fuzzy logic matching rules.",
    "Normalize categorical variables to standard casings (Title Case).",
    "Exclude columns containing potential target leakage indicators (e.g. cancellation variables).",
)


def report(scores: DataFrame, user: str, as_of: Column | None = None) -> DataFrame:
    """Report row per readiness row."""
    when = as_of if as_of is not None else F.current_timestamp()
    return scores.select(
        F.concat(F.lit("REP-"), F.date_format(when, "yyyyMMdd"), F.lit("-"), F.col("overall_readiness").cast("string")).alias("report_id"),
        "dataset",
        F.lit(user).alias("generated_by"),
        F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.col("quality").alias("quality_score"),
        F.col("ml_readiness").alias("ml_readiness_score"),
        F.col("overall_readiness").alias("overall_readiness_score"),
        F.when(F.col("security") >= 95, "Protected (Encrypted)").otherwise("Warning (Local Match)").alias("security_status"),
        F.array(*[F.lit(a) for a in ADVICE]).alias("recommendations"),
    )


def risk_index(scores: DataFrame) -> DataFrame:
    """Risk of missing data, anomalies and inconsistency: 100 minus the score."""
    risks = (
        ("Revenue Reporting Risk", "completeness"),
        ("Forecasting Variance Risk", "anomalies"),
        ("BI Aggregations Accuracy Risk", "consistency"),
    )
    rows = F.array(*[F.struct(F.lit(label).alias("risk"), (F.lit(100) - F.col(dim)).alias("risk_score")) for label, dim in risks])
    return scores.select("dataset", F.explode(rows).alias("r")).select("dataset", "r.*")
