"""Column roles, scan scope, schema matching, schema drift, source detection."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tablewright.functions.similarity import _lcs
from tablewright.functions.text import any_keyword, digits, strip
from tablewright.operators.columns import ROW, data_columns
from tablewright.operators.entities import TARGETS, Sources
from tablewright.operators.profile import column_details

# Name parts per role, in the order they are tried.
SYSTEM_NAMES = ("created_by", "updated_by", "sys_", "last_login", "system", "createdby")
TARGET_NAMES = ("churn", "target", "label", "exited", "outcome", "status", "revenue", "sales", "profit", "amount")
ID_NAMES = ("id", "code", "number", "key", "no", "num", "phone", "mobile", "email", "gstin", "pan", "tan", "name", "customer")
DATE_NAMES = ("date", "time", "timestamp", "created", "updated")
TEXT_NAMES = ("note", "desc", "comment", "feedback", "remark", "text", "message")
# Scope rules by name.
FINANCIAL_SCOPE = ("revenue", "sales", "bill_amount", "charges", "valuation", "salary")
ENTITY_SCOPE = ("customer_id", "client", "name", "party", "phone", "mobile", "email", "gstin")
DATE_SCOPE = ("orderdate", "invoice_date", "cancellationdate")
TEXT_SCOPE = ("notes", "comment", "created_by", "last_login", "updated_by")


def field_roles(df: DataFrame) -> DataFrame:
    """Role of every column: by name first, then by its values."""
    name, distinct = F.col("column"), F.col("cardinality")
    unique = (F.try_divide(distinct * F.lit(1.0), F.col("n")) > 0.9) & (distinct > 5)
    by_value = (
        F.when(F.col("type") == "Numeric", F.when(distinct < 15, "Categorical").otherwise("Numeric"))
        .when(F.col("type") == "DateTime/Other", "Date")
        .otherwise(F.when(distinct < 25, "Categorical").otherwise("Feature"))
    )
    role = (
        F.when(any_keyword(name, SYSTEM_NAMES), "System Field")
        .when(any_keyword(name, TARGET_NAMES), "Target")
        .when(any_keyword(name, ID_NAMES) | unique, "Identifier")
        .when(any_keyword(name, DATE_NAMES), "Date")
        .when(any_keyword(name, TEXT_NAMES), "Text")
        .otherwise(by_value)
    )
    return column_details(df).select(F.col("ord").alias("ordinal"), "column", role.alias("role"), "n", "missing")


def scan_scope(df: DataFrame) -> DataFrame:
    """Whether a column should be scanned, how important it is and why."""
    name, role = F.col("column"), F.col("role")
    share = F.coalesce(F.try_divide(F.col("missing") * F.lit(100.0), F.col("n")), F.lit(0.0))
    gaps = F.concat(
        F.lit("High missingness ("), F.format_string("%.1f", F.bround(share, 1)),
        F.lit("%). Excluded to prevent noise in ML/quality assessment."),
    )

    def verdict(recommendation: str, importance: str, reason: Column | str) -> Column:
        text = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(recommendation).alias("recommendation"), F.lit(importance).alias("importance"), text.alias("reason"))

    decided = (
        F.when(share > 50, verdict("Exclude", "Low", gaps))
        .when(any_keyword(name, FINANCIAL_SCOPE), verdict(
            "Include", "Critical", "Core financial metric. Critical for business impact and quality diagnostics."))
        .when(role == "Target", verdict(
            "Include", "Critical", "Identified as target outcome variable for ML suitability diagnostics."))
        .when((role == "Identifier") | any_keyword(name, ENTITY_SCOPE), verdict(
            "Include", "High", "Entity identifier. Crucial for deduplication and data lineage auditing."))
        .when((role == "Date") | F.lower(name).isin(*DATE_SCOPE), verdict(
            "Include", "High", "Temporal marker. Required for leakage checks and trend diagnostics."))
        .when(role.isin("System Field", "Text") | any_keyword(name, TEXT_SCOPE), verdict(
            "Exclude", "Low", "System metadata or unstructured free-text log. Typically irrelevant to ML suitability."))
        .otherwise(verdict("Include", "Medium", "Standard business feature."))
    )
    return field_roles(df).withColumn("v", decided).select(
        "ordinal", "column", "role", "v.*", F.col("missing").alias("issues_count")
    )


def scope_summary(scope: DataFrame) -> DataFrame:
    """Columns per recommendation and role."""
    return scope.groupBy("recommendation", "role").agg(F.count("*").alias("columns"))


# Type of each target field.
TARGET_TYPES = {t: "Categorical" for t in TARGETS} | {"Revenue": "Numeric", "Invoice_Date": "DateTime", "Last_Login": "DateTime"}
# A source name holding one of these gets 15 points for the target.
BOOSTS = {
    "Customer_Name": ("client", "party", "name", "customer", "customer name", "party name"),
    "Phone": ("phone", "mobile", "contact", "cell", "telephone"),
    "Revenue": ("revenue", "sales", "bill", "amount", "price", "charges", "transaction"),
    "Invoice_Date": ("date", "time", "orderdate", "invoice date", "timestamp", "created"),
    "GSTIN": ("gstin", "gst", "tax", "registration"),
    "Customer_ID": ("id", "code", "cust", "party id", "customer_id"),
    "Email": ("email", "e-mail", "mailaddress"),
    "Internal_Notes": ("notes", "comment", "desc", "internal"),
    "Created_By": ("created_by", "creator", "admin", "system"),
    "Last_Login": ("login", "last_login", "lastlogin"),
}
BOOST = 15.0
MAP_AT, HIGH_AT, MEDIUM_AT = 50, 85, 60
# Reason per level.
REASONS = {
    "HIGH": "Name similarity, compatible type, and value pattern match across all sources.",
    "MEDIUM": "Partial match: columns aligned but have type or value pattern variations.",
    "LOW": "Weak match: names do not align clearly or types are incompatible.",
}


def _header(name: str) -> str:
    for mark in "_-":
        name = name.replace(mark, " ")
    return " ".join(name.lower().split())


def _name_ratio(a: str, b: str) -> float:
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def name_score(target: str, column: str) -> float:
    """Similarity of two column names with the keyword bonus; names are known while the plan is built."""
    source = _header(column)
    bonus = BOOST if any(k in source for k in BOOSTS[target]) else 0.0
    return min(100.0, _name_ratio(_header(target), source) + bonus)


def _patterns() -> dict[str, Column]:
    v = F.col("value")
    bare = strip(v)
    return {
        "Numeric": bare.rlike(r"^-?\$?\d+[\d,.]*$"),
        "DateTime": v.contains("-") | v.contains("/") | v.rlike(r"\b\d{4}\b"),
        "Phone": F.length(digits(v)) >= 8,
        "Email": v.contains("@"),
        "GSTIN": F.length(bare) == 15,
        "Customer_Name": (F.length(bare) > 3) & ~v.rlike(r"\d") & v.contains(" "),
    }


def column_scores(source_id: str, df: DataFrame) -> DataFrame:
    """Score of every column of a source for every target field."""
    spark = df.sparkSession
    shares = {f"p_{n}": F.try_divide(F.count_if(p), F.count("value")) * 100.0 for n, p in _patterns().items()}
    facts = column_details(df, extra=[share.alias(n) for n, share in shares.items()]).select("ord", "type", "present", *shares)
    columns = data_columns(df)
    pairs = [(i, c, k, t, name_score(t, c), TARGET_TYPES[t]) for i, c in enumerate(columns) for k, t in enumerate(TARGETS)]
    named = spark.createDataFrame(pairs, "ord int, column string, target_ord int, target_field string, name_sim double, target_type string")
    # A table without rows has no facts; its columns count as categorical.
    found = F.when(F.col("type") == "DateTime/Other", "DateTime").otherwise(F.coalesce("type", F.lit("Categorical")))
    both = F.array_sort(F.array(found, F.col("target_type")))
    compat = (
        F.when(found == F.col("target_type"), 100.0)
        .when(both == F.array(F.lit("Categorical"), F.lit("DateTime")), 80.0)
        .when(both == F.array(F.lit("Categorical"), F.lit("Numeric")), 60.0)
        .otherwise(30.0)
    )
    pattern = F.when(F.col("target_type") == "Numeric", F.col("p_Numeric")).when(F.col("target_type") == "DateTime", F.col("p_DateTime"))
    for t in ("Phone", "Email", "GSTIN", "Customer_Name"):
        pattern = pattern.when(F.col("target_field") == t, F.col(f"p_{t}"))
    pattern = F.coalesce(pattern, F.lit(50.0))
    scored = named.join(F.broadcast(facts), "ord", "left").withColumn("compat", compat).withColumn("pattern", pattern)
    mixed = F.col("name_sim") * 0.4 + F.col("compat") * 0.3 + F.col("pattern") * 0.3
    total = F.when(F.coalesce("present", F.lit(0)) == 0, F.col("name_sim") * 0.6 + F.col("compat") * 0.4).otherwise(mixed)
    return scored.select(
        F.lit(source_id).alias("source_id"), "ord", "column", "target_ord", "target_field",
        F.bround(total).cast("int").alias("confidence"),
        F.struct(
            F.bround("name_sim").cast("int").alias("name_similarity"), F.bround("compat").cast("int").alias("type_compatibility"),
            F.bround("pattern").cast("int").alias("pattern_similarity"),
        ).alias("signals"),
    )


def suggest_mapping(sources: Sources) -> DataFrame:
    """Best column per target and source, with the mean score and its level."""
    scores = None
    for sid, df in sources:
        part = column_scores(sid, df)
        scores = part if scores is None else scores.unionByName(part)
    best = Window.partitionBy("target_field", "source_id").orderBy(F.desc("confidence"), "ord")
    chosen = scores.withColumn("_rank", F.row_number().over(best)).where((F.col("_rank") == 1) & (F.col("confidence") >= MAP_AT))
    grouped = chosen.groupBy("target_ord", "target_field").agg(
        F.bround(F.avg("confidence")).cast("int").alias("confidence"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "column")))).alias("columns"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "signals")))).alias("signals"),
    )
    level = F.when(F.col("confidence") >= HIGH_AT, "HIGH").when(F.col("confidence") >= MEDIUM_AT, "MEDIUM").otherwise("LOW")
    reasons = F.create_map(*[F.lit(v) for pair in REASONS.items() for v in pair])
    leveled = grouped.withColumn("confidence_level", level)
    return leveled.select(
        "target_ord", "target_field", "confidence", "confidence_level", reasons[F.col("confidence_level")].alias("reason"), "columns", "signals"
    )


def accepted_mapping(mapping: DataFrame, accepted: Sequence[str] = ()) -> DataFrame:
    """Sure suggestions and those accepted by hand."""
    return mapping.where((F.col("confidence_level") == "HIGH") | F.col("target_field").isin(*accepted))


def mapping_dict(mapping: DataFrame) -> dict[str, dict[str, str]]:
    """The mapping as plan-time settings; one row per target field."""
    return {row["target_field"]: dict(row["columns"]) for row in mapping.select("target_field", "columns").collect()}


RENAME_AT = 75


@pandas_udf(T.MapType(T.StringType(), T.StringType()))
def renames(removed: pd.Series, added: pd.Series) -> pd.Series:
    """For each removed column, in order, the most similar added column still free."""
    out = []
    for gone, new in zip(removed, added):
        free, found = list(new), {}
        for name in gone:
            scores = [_name_ratio(name.lower().replace("_", ""), c.lower().replace("_", "")) for c in free]
            best = max(range(len(free)), key=scores.__getitem__, default=None)
            if best is not None and scores[best] >= RENAME_AT:
                found[name] = free.pop(best)
        out.append(found)
    return pd.Series(out)


def schema_drift(pairs: DataFrame) -> DataFrame:
    """Drift per row of ``(dataset, baseline array, current array)``; no shuffle, whatever the number of tables."""
    base, new = F.col("baseline"), F.col("current")
    split = pairs.select(
        "dataset", F.size(base).alias("_total"), F.array_intersect(base, new).alias("unchanged"),
        F.array_except(base, new).alias("_gone"), F.array_except(new, base).alias("_new"),
    )
    named = split.withColumn("renamed", renames("_gone", "_new"))
    score = (F.size("unchanged") + F.size("renamed") * 0.5) / F.col("_total") * 100
    stability = F.when(F.col("_total") == 0, 100).otherwise(F.least(F.lit(100), F.bround(score).cast("int")))
    return named.select(
        "dataset", stability.alias("stability_score"), "unchanged", "renamed",
        F.array_except("_gone", F.map_keys("renamed")).alias("removed"),
        F.array_except("_new", F.map_values("renamed")).alias("added"),
    )


# Parts of file names and headers that point to each kind of source.
FILE_SIGNALS = {
    "CRM": ("crm", "customer", "contact", "lead", "opp"),
    "Tally": ("tally", "ledger", "purchase", "vendor", "accounting"),
    "POS Export": ("pos", "pointofsale", "receipt", "bill", "invoice_export"),
    "Spreadsheet": ("spreadsheet", "excel", "sales", "inventory", "stock", "manually"),
}
HEADER_SIGNALS = {
    "CRM": ("customer_id", "email", "last_login", "cancellationdate", "churn", "opportunity"),
    "Tally": ("party_name", "gstin", "sales", "ledger", "mobile", "party_id"),
    "POS Export": ("pos_id", "bill_amount", "invoice_date", "contact", "customer", "pos"),
    "Spreadsheet": ("orderid", "client", "phone", "region", "revenue", "orderdate", "internal_notes", "created_by"),
}
# Explanations of a detection.
DETECTED = "Detected via filename keywords and schema column signature matches."
FALLBACK = "Fallback default spreadsheet"


def _any_contains(texts: Column, part: str) -> Column:
    return F.exists(texts, lambda t: t.contains(part))


def detect_sources(files: DataFrame) -> DataFrame:
    """Kind of source per row of ``(filename, columns array)``, with a confidence of 50 to 99, 40 if unknown."""
    headers = F.transform("columns", lambda c: F.lower(c))
    candidates = []
    for place, (kind, words) in enumerate(FILE_SIGNALS.items()):
        named = any_keyword(F.col("filename"), words)
        hits = [_any_contains(headers, k).cast("int") for k in HEADER_SIGNALS[kind]]
        count = sum(hits[1:], hits[0])
        score = (
            F.when(named, 50.0).otherwise(0.0)
            + F.coalesce(F.try_divide(count * F.lit(1.0), F.size("columns")) * 100.0, F.lit(0.0))
            + F.when(named & (count > 0), 15.0).otherwise(0.0)
        )
        # Of equal scores the first kind wins.
        candidates.append(F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(kind).alias("kind")))
    best = F.greatest(*candidates)
    known = F.col("best.score") > 0
    return files.withColumn("best", best).select(
        *files.columns,
        F.when(known, F.col("best.kind")).otherwise("Spreadsheet").alias("detected_source"),
        F.when(known, F.bround(F.least(F.lit(99.0), F.greatest(F.lit(50.0), F.col("best.score")))).cast("int")).otherwise(40).alias("confidence"),
        F.when(known, DETECTED).otherwise(FALLBACK).alias("reason"),
    )
