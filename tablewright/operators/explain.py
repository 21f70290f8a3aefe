"""Explanations and business impact of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Finding and language taken where the asked one is unknown.
DEFAULT_FINDING, DEFAULT_LANGUAGE = "missing_contacts", "English"
# The parts of an explanation.
PILLARS = ("finding", "business_meaning", "technical_explanation", "recommended_fix")


def fill_template(template: Column, values: dict[str, Column], names: Sequence[str]) -> Column:
    """Put values in place of ``{name}``; a template with an unknown name stays as it is."""
    filled = template
    for name in names:
        if name in values:
            filled = F.replace(filled, F.lit("{" + name + "}"), values[name].cast("string"))
    return F.when(filled.rlike(r"\{\w+\}"), template).otherwise(filled)


def explain(findings: DataFrame, dictionary: DataFrame, context: Sequence[str] = ()) -> DataFrame:
    """Explanation per row of ``(finding_key, language, *context)``.

    The dictionary ``(finding_key, language, finding, business_meaning, technical_explanation,
    recommended_fix)`` is a lookup table. An unknown language falls back to English, an unknown finding to the
    general one.
    """
    words = F.struct(*PILLARS)
    texts = dictionary.groupBy("finding_key").agg(
        F.map_from_entries(F.collect_list(F.struct("language", words.alias("t")))).alias("_texts")
    )
    general = texts.where(F.col("finding_key") == DEFAULT_FINDING).select(F.col("_texts").alias("_general")).scalar()
    joined = findings.join(texts, "finding_key", "left").withColumn("_all", F.coalesce("_texts", general))
    chosen = F.coalesce(F.try_element_at("_all", F.col("language")), F.try_element_at("_all", F.lit(DEFAULT_LANGUAGE)))
    values = {c: F.col(c) for c in context}
    shown = joined.withColumn("_t", chosen)
    return shown.select(*findings.columns, *[fill_template(F.col(f"_t.{p}"), values, context).alias(p) for p in PILLARS])


# Parts of an issue id, its business impact and what to do; the first that fits counts.
IMPACTS = (
    (
        ("missing",),
        "Revenue projections and transaction matrices will be structurally under-reported.",
        "Apply median/mode imputation transforms in the Fix Center.",
    ),
    (
        ("consistent",),
        "Aggregation pipelines and report filters treat casing variations as unique entries, creating duplicate rows.",
        "Apply Title Case normalization.",
    ),
    (
        ("leakage",),
        "ML training loops will evaluate overfitting variables, leading to invalid inferences in production runs.",
        "Drop temporal leakage columns from dataset schemas.",
    ),
    (
        ("outlier", "neg"),
        "Numerical variances will distort standard deviations, skewing standard regressions.",
        "Filter outliers at statistical IQR bounds.",
    ),
)
OTHER_IMPACT = ("Inaccurate reporting metrics", "Review missing values logs")


def business_impact(issues: DataFrame) -> DataFrame:
    """Impact and action per issue by parts of its id."""
    impact, action = F.lit(OTHER_IMPACT[0]), F.lit(OTHER_IMPACT[1])
    for parts, meaning, step in reversed(IMPACTS):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.col("id").contains(part)
        impact, action = F.when(hit, meaning).otherwise(impact), F.when(hit, step).otherwise(action)
    return issues.select("id", "column", "severity", impact.alias("business_impact"), action.alias("next_step"))


def top_issues(issues: DataFrame, rows: int = 3) -> DataFrame:
    return issues.orderBy("seq").limit(rows)
