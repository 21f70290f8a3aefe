"""Scope, visibility, permissions and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.text import has_keyword
from tablewright.operators.columns import data_columns

# What each role may do.
PERMISSIONS = {
    "ADMIN": (
        "view_datasets", "upload_datasets", "delete_datasets", "view_audit_logs", "manage_users",
        "view_security_center", "view_reports", "change_permissions", "merge_datasets", "change_scan_scope",
    ),
    "DATA ANALYST": (
        "upload_datasets", "analyze_datasets", "view_quality_reports", "run_ai_readiness", "use_ai_doctor",
        "apply_safe_fixes", "export_reports", "merge_datasets", "change_scan_scope",
    ),
    "VIEWER": (
        "view_dashboards", "view_scores", "view_reports", "view_datasets", "view_merge_results", "view_scan_scope",
    ),
}
# Datasets everybody may see.
PUBLIC = ("retail_sales", "customer_churn", "inventory_logistics")
# Name parts of columns that should stay in scope.
SCOPE_CRITICAL = ("revenue", "sales", "bill_amount", "churn", "target", "exited")


def scoped(df: DataFrame, selected: list[str] | None) -> DataFrame:
    """Only the selected columns that exist, the whole table if none does; row marks stay."""
    kept = [c for c in selected or [] if c in df.columns]
    return df.select(*[c for c in df.columns if c.startswith("_")], *kept) if kept else df


def scope_warnings(columns: DataFrame, selected: DataFrame) -> DataFrame:
    """Critical columns of each dataset that are not selected; both sides are ``(dataset, column)`` tables."""
    from tablewright.functions.text import any_keyword

    critical = columns.where(any_keyword(F.col("column"), SCOPE_CRITICAL))
    missing = critical.join(selected, ["dataset", "column"], "left_anti")
    warning = F.concat(
        F.lit("Warning: Excluding '"), F.col("column"),
        F.lit("' may materially affect the reliability of the AI Readiness assessment."),
    )
    return missing.select("dataset", "column", warning.alias("warning"))


def scope_gaps(df: DataFrame, selected: list[str]) -> list[str]:
    """The same for one schema at hand."""
    return [c for c in data_columns(df) if has_keyword(c, SCOPE_CRITICAL) and c not in selected]


def permission_table(spark: SparkSession) -> DataFrame:
    rows = [(role, p) for role, granted in PERMISSIONS.items() for p in granted]
    return spark.createDataFrame(rows, "role string, permission string")


def permitted(requests: DataFrame) -> DataFrame:
    """Requests ``(role, permission, ...)`` that the role allows."""
    table = permission_table(requests.sparkSession).withColumnsRenamed({"role": "_role", "permission": "_permission"})
    same = (F.upper(F.trim("role")) == F.col("_role")) & (F.col("permission") == F.col("_permission"))
    return requests.join(F.broadcast(table), same, "left_semi")


def visible(catalog: DataFrame, role: str, user: str) -> DataFrame:
    """Datasets of the catalog ``(dataset_id, creator, ...)`` that the user may see."""
    if role.strip().upper() in ("ADMIN", "DATA ANALYST"):
        return catalog
    own = (F.col("creator") != "") & (F.lower("creator") == user.strip().lower())
    return catalog.where(F.col("dataset_id").isin(*PUBLIC) | F.coalesce(own, F.lit(False)))


def parse_audit(lines: DataFrame, line: str = "line") -> DataFrame:
    """Tab-separated audit lines as columns; lines with fewer than four parts are dropped."""
    from tablewright.functions.text import strip

    parts = F.split(strip(F.col(line)), "\t")
    parsed = lines.withColumn("_parts", parts).where(F.size("_parts") >= 4)
    named = [F.col("_parts")[i].alias(n) for i, n in enumerate(("time", "user", "action", "status"))]
    details = F.coalesce(F.get("_parts", F.lit(4)), F.lit("")).alias("details")
    return parsed.select(*[c for c in lines.columns if c != line], F.col(line).alias("_line"), *named, details)


def search_audit(log: DataFrame, text: str = "", user: str = "", action: str = "", status: str = "") -> DataFrame:
    """Case-insensitive search; an empty argument filters nothing."""
    found = log.where(F.lower("_line").contains(text.lower())) if text else log
    for name, wanted in (("user", user), ("action", action), ("status", status)):
        if wanted:
            found = found.where(F.lower(name) == wanted.lower())
    return found.drop("_line")


def audit_line(user: Column, action: Column, status: Column, details: Column, at: Column | None = None) -> Column:
    when = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return F.concat_ws("\t", when, user, action, status, F.coalesce(details, F.lit("")))
