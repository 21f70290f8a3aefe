"""Business rules: suggestion, violations, compliance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.dates import parse_date
from tablewright.functions.numbers import float_text, parse_plain, percent, percent_text
from tablewright.functions.text import has_keyword, strip
from tablewright.functions.masking import mask_value
from tablewright.operators.columns import ROW, data_columns, text_cells
from tablewright.operators.privacy import hidden_columns, mask_for_role

# Format of a tax id.
TAX_ID = r"^[0-9]{2}[a-zA-Z]{5}[0-9]{4}[a-zA-Z]{1}[1-9a-zA-Z]{1}[zZ]{1}[0-9a-zA-Z]{1}$"
# Name parts that call for each rule, in the order they are tried.
TRIGGERS = {
    "GSTIN_FORMAT": ("gstin",),
    "NON_NEGATIVE": ("revenue", "sales", "profit", "amount", "salary", "price"),
    "PERCENTAGE_CAP": ("discount",),
    "PAST_DATE_ONLY": ("date", "time", "timestamp", "created"),
}
# Description and confidence of a suggestion.
SUGGESTIONS = {
    "GSTIN_FORMAT": ("GSTIN must match standard 15-character alphanumeric format.", 98),
    "NON_NEGATIVE": ("Value in '%s' must be greater than or equal to zero.", 95),
    "PERCENTAGE_CAP": ("Discount rate in '%s' cannot exceed 100%.", 99),
    "PAST_DATE_ONLY": ("Date in '%s' cannot represent a future date.", 92),
}


def rule_for(name: str) -> str | None:
    return next((rule for rule, words in TRIGGERS.items() if has_keyword(name, words)), None)


def suggest_rules(df: DataFrame) -> DataFrame:
    """At most one rule per column that holds any value; a sign rule needs numbers, none negative."""
    columns = [c for c in data_columns(df) if rule_for(c)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, rule_type string, description string, confidence int")
    x = parse_plain(F.col("value"))
    facts = text_cells(df, columns).groupBy("ord", "column").agg(F.count("value").alias("present"), F.min(x).alias("low"))
    texts = F.create_map(*[F.lit(v) for c in columns for v in (c, SUGGESTIONS[rule_for(c)][0].replace("%s", c))])
    kinds = F.create_map(*[F.lit(v) for c in columns for v in (c, rule_for(c))])
    marks = F.create_map(*[F.lit(v) for r, s in SUGGESTIONS.items() for v in (r, s[1])])
    ruled = facts.withColumn("rule_type", kinds[F.col("column")]).where(F.col("present") > 0)
    fits = (F.col("rule_type") != "NON_NEGATIVE") | (F.coalesce("low", F.lit(-1.0)) >= 0)
    return ruled.where(fits).select(
        "column", "rule_type", texts[F.col("column")].alias("description"), marks[F.col("rule_type")].alias("confidence")
    )


def violation_text(rule: str, value: Column, as_of: Column) -> Column:
    """Message if a cell breaks the rule, else NULL; cells the rule cannot read pass."""
    if rule == "GSTIN_FORMAT":
        text = strip(value)
        fine = (F.length(text) == 15) & text.rlike(TAX_ID)
        return F.when(~fine, F.concat(F.lit("Invalid GSTIN format: '"), text, F.lit("'.")))
    if rule == "NON_NEGATIVE":
        x = parse_plain(value)
        return F.when(x < 0, F.concat(F.lit("Negative value detected: "), float_text(x), F.lit(".")))
    if rule == "PERCENTAGE_CAP":
        x = percent_text(value)
        return F.when(x > 100, F.concat(F.lit("Percentage exceeds limit: "), float_text(x), F.lit("%.")))
    if rule == "PAST_DATE_ONLY":
        day = parse_date(value)
        late = day > as_of + F.expr("INTERVAL 1 DAY")
        return F.when(late, F.concat(F.lit("Future date detected: "), F.date_format(day, "yyyy-MM-dd"), F.lit(".")))
    return F.lit(None).cast("string")


def checked_cells(df: DataFrame, rules: Sequence[tuple[str, str]], as_of: Column | None = None) -> DataFrame:
    """One row per non-null cell under a rule; all rules of a row are evaluated in the same scan."""
    now = as_of if as_of is not None else F.current_timestamp()
    known = [(c, r) for c, r in rules if c in df.columns]
    checks = []
    for column, rule in known:
        value = F.col(f"`{column}`").cast("string")
        checks.append(
            F.when(
                value.isNotNull(),
                F.struct(
                    F.lit(column).alias("column"), value.alias("value"), F.lit(rule).alias("rule_type"),
                    violation_text(rule, value, now).alias("error_msg"),
                ),
            )
        )
    if not checks:
        schema = f"{ROW} bigint, column string, value string, rule_type string, error_msg string"
        return df.sparkSession.createDataFrame([], schema)
    return df.select(ROW, F.explode(F.array_compact(F.array(*checks))).alias("c")).select(ROW, "c.*")


def violations(df: DataFrame, rules: Sequence[tuple[str, str]], as_of: Column | None = None) -> DataFrame:
    broken = checked_cells(df, rules, as_of).where(F.col("error_msg").isNotNull())
    return broken.select(F.col(ROW).alias("row_index"), "column", "value", "rule_type", "error_msg")


def masked_violations(df: DataFrame, rules: Sequence[tuple[str, str]], role: str, as_of: Column | None = None) -> DataFrame:
    """Violations as the role may see them: values, and the messages that repeat them, of hidden columns are masked."""
    found = mask_for_role(violations(df, rules, as_of), role)
    if role in ("ADMIN", "VIEWER"):
        return found
    secret = F.col("column").isin(*hidden_columns(df))
    return found.select(*[F.when(secret, mask_value(F.col(c))).otherwise(F.col(c)).alias(c) if c in ("value", "error_msg") else F.col(c) for c in found.columns])


def compliance(df: DataFrame, rules: Sequence[tuple[str, str]], as_of: Column | None = None) -> DataFrame:
    """Checks, violations and the share of cells that pass; 100 if nothing is checked."""
    total = F.count("*")
    broken = F.count_if(F.col("error_msg").isNotNull())
    return checked_cells(df, rules, as_of).agg(
        total.alias("total_checks"), broken.alias("violations_count"), percent(total - broken, total).alias("compliance_score")
    )
