"""Suitability, readiness, fix, rule, privacy and access queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import access, fixes, privacy, quality, rules, suitability
from tablewright.operators.columns import ROW
from tablewright.plans import sqltext as q
from tablewright.plans.fixtures import check_sql, derived
from tablewright.plans.quality_plans import COLUMNS, MESSY, TIERS, TITLE, Steps, messy, messy_sql

CHURN_COLUMNS = ["CustomerID", "Tenure", "MonthlyCharges", "TotalCharges", "CancellationDate", "Churn"]
CHURN = Steps(
    "churn", CHURN_COLUMNS,
    {"critical": ["CustomerID"], "standard": ["CancellationDate"], "optional": ["Tenure", "MonthlyCharges", "TotalCharges", "Churn"]},
    ["MonthlyCharges", "TotalCharges"],
)
AS_OF = "2025-06-01 00:00:00"
RULES = [
    ("GSTIN", "GSTIN_FORMAT"), ("Revenue", "NON_NEGATIVE"), ("Discount", "PERCENTAGE_CAP"),
    ("Join_Date", "PAST_DATE_ONLY"), ("Notes", "SOMETHING_ELSE"), ("Absent", "NON_NEGATIVE"),
]


def churn(spark, folder):
    return derived(spark, folder, "churn")


def secret(spark, folder):
    return derived(spark, folder, "people_secret")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def ml_suitability(spark, folder):
    pairs = F.transform("redundant_pairs", lambda p: F.concat_ws("~", p["col1"], p["col2"], p["coefficient"].cast("string")))
    row = suitability.suitability(churn(spark, folder), "churn")
    return row.select(
        "dataset", "target_col", "class_imbalance", "class_imbalance_ratio", "has_target_leakage", "target_leakage_col",
        "high_cardinality_col", F.array_join(pairs, ";").alias("pairs"), F.array_join("numeric_cols", ",").alias("numeric_cols"), "drifted",
    )


def column_catalog(spark, folder):
    tables = derived(spark, folder, "schemas")
    return tables.select("dataset", F.explode(F.split("baseline", r"\|")).alias("column"))


def selected_columns(spark, folder):
    tables = derived(spark, folder, "schemas")
    return tables.select("dataset", F.explode(F.split("current", r"\|")).alias("column"))


def audit(spark, folder):
    return access.parse_audit(derived(spark, folder, "audit_lines"))


FIX_ALL = list(fixes.STEPS)
QUERIES = {
    "class_imbalance": lambda s, d: suitability.class_imbalance(churn(s, d), "churn"),
    "high_cardinality": lambda s, d: suitability.high_cardinality(churn(s, d), "churn"),
    "numeric_columns": lambda s, d: suitability.numeric_columns(churn(s, d)),
    "corr_matrix": lambda s, d: suitability.correlations(churn(s, d)).select("col1", "col2", F.round("coefficient", 6).alias("r")),
    "corr_pairs": lambda s, d: suitability.redundant_pairs(churn(s, d)).select("col1", "col2", "coefficient"),
    "ml_suitability": ml_suitability,
    "churn_scorecard": lambda s, d: quality.scorecard(churn(s, d), "churn"),
    "readiness": lambda s, d: suitability.table_readiness(messy(s, d), "messy_orders"),
    "churn_readiness": lambda s, d: suitability.table_readiness(churn(s, d), "churn", security_status="Unavailable"),
    "readiness_report": lambda s, d: suitability.report(
        suitability.table_readiness(churn(s, d), "churn"), "Admin", as_of()
    ).withColumn("recommendations", F.size("recommendations")),
    "risk_index": lambda s, d: suitability.risk_index(quality.scorecard(messy(s, d), "messy_orders")),
    "fix_dedupe": lambda s, d: fixes.remove_duplicates(messy(s, d)),
    "fix_title": lambda s, d: fixes.normalize_case(messy(s, d)),
    "fix_impute": lambda s, d: fixes.fill_missing(messy(s, d)),
    "fix_outliers_sequential": lambda s, d: fixes.remove_outliers(messy(s, d)),
    "fix_outliers_single_pass": lambda s, d: fixes.remove_outliers_single_pass(messy(s, d)),
    "fix_score_gain": lambda s, d: fixes.score_gain(messy(s, d), FIX_ALL, "messy_orders"),
    "rule_suggest": lambda s, d: rules.suggest_rules(secret(s, d)),
    "rule_violations": lambda s, d: rules.violations(secret(s, d), RULES, as_of()),
    "rule_compliance": lambda s, d: rules.compliance(secret(s, d), RULES, as_of()),
    "mask_analyst": lambda s, d: privacy.mask_for_role(secret(s, d), "DATA ANALYST"),
    "mask_viewer": lambda s, d: privacy.mask_for_role(secret(s, d), "VIEWER"),
    "sensitive_columns": lambda s, d: privacy.scan_catalog(column_catalog(s, d)),
    "visible_datasets": lambda s, d: access.visible(derived(s, d, "catalog"), "VIEWER", " Guest "),
    "permitted_requests": lambda s, d: access.permitted(derived(s, d, "requests")),
    "scope_warnings": lambda s, d: access.scope_warnings(column_catalog(s, d), selected_columns(s, d)),
    "audit_scan": lambda s, d: audit(s, d).drop("_line"),
    "audit_filter": lambda s, d: access.search_audit(audit(s, d), text="PROPS", action="Click", status="failed"),
    "audit_counts": lambda s, d: audit(s, d).groupBy("action", "status").agg(F.count("*").alias("entries")),
}


def pair_sql() -> str:
    n = len(CHURN_COLUMNS)
    raw = ", ".join(f"coalesce({q.plain(c)}, 0) AS x{i}, {q.money(c)} IS NOT NULL AS k{i}" for i, c in enumerate(CHURN_COLUMNS))
    parts = " UNION ALL ".join(
        f"SELECT {i} AS o1, {j} AS o2, '{CHURN_COLUMNS[i]}' AS col1, '{CHURN_COLUMNS[j]}' AS col2, "
        f"covar_pop(x{i}, x{j}) / nullif(stddev_pop(x{i}) * stddev_pop(x{j}), 0) AS r FROM w "
        f"HAVING count(*) FILTER (k{i}) >= 4 AND count(*) FILTER (k{j}) >= 4"
        for i in range(n) for j in range(i + 1, n)
    )
    return f"w AS (SELECT {raw} FROM churn), prs AS (SELECT * FROM ({parts}) z WHERE r IS NOT NULL AND NOT isnan(r))"


TOP = """top AS (SELECT list(c ORDER BY c DESC) AS l FROM (SELECT count(*) AS c FROM churn WHERE Churn IS NOT NULL GROUP BY Churn) z),
imb AS (SELECT 'churn' AS dataset, 'Churn' AS target_col, l[1]::DOUBLE / l[2] AS ratio, l[1] || ':' || l[2] AS class_imbalance_ratio FROM top),
imbs AS (SELECT dataset, target_col, CASE WHEN ratio > 10 OR ratio < 0.1 THEN 'Severe' WHEN ratio > 3 OR ratio < 0.33 THEN 'Moderate' ELSE 'Low' END
  || ' (Ratio ' || printf('%.1f', ratio) || ':1)' AS class_imbalance, class_imbalance_ratio FROM imb)"""
HIGH = """hi AS (SELECT CASE WHEN count(DISTINCT CustomerID) / count(*)::DOUBLE > 0.8 THEN 'CustomerID' ELSE '' END AS c FROM churn)"""


def churn_sql(ctes: str, select: str) -> str:
    return check_sql(["churn"], f", {ctes}\n{select}")


def ready_sql(scores: str, ml: str, security: int) -> str:
    return f"""SELECT dataset, overall_quality AS quality, {security} AS security, {ml} AS ml_readiness,
      cast(round_even(overall_quality * 0.45::DOUBLE + {ml} * 0.35::DOUBLE + {security} * 0.20::DOUBLE, 0) AS INTEGER) AS overall_readiness FROM {scores}"""


CHURN_ML = "greatest(10, least(100, overall_quality - 25 - CASE WHEN (SELECT class_imbalance FROM imbs) LIKE 'Severe%' THEN 15 ELSE 0 END - CASE WHEN (SELECT c FROM hi) <> '' THEN 10 ELSE 0 END))"
# 'OrderID' of the messy orders is id-like and nearly all distinct.
MESSY_ML = "greatest(10, least(100, overall_quality - CASE WHEN (SELECT count(DISTINCT OrderID) / count(*)::DOUBLE FROM messy_orders) > 0.8 THEN 10 ELSE 0 END))"
STATUS = "CASE WHEN overall_readiness >= 80 THEN 'AI READY' ELSE 'NEEDS IMPROVEMENT' END AS status"


def impute(table: str, name: str) -> str:
    """CTEs that fill the messy columns of ``table`` into ``name``."""
    texts, parts = [], []
    for c in COLUMNS:
        bad = q.empty(c, q.FIX)
        fill = (
            f"SELECT coalesce(cast(quantile_cont({q.plain(c)}, 0.5) AS VARCHAR), (SELECT {c} FROM {table} WHERE NOT {bad} "
            f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), 'Unknown') AS f FROM {table}"
        )
        texts.append(f"{name}_{c} AS ({fill})")
        parts.append(f"CASE WHEN {bad} THEN (SELECT f FROM {name}_{c}) ELSE {c} END AS {c}")
    return ", ".join(texts) + f", {name} AS (SELECT _row_idx, {', '.join(parts)} FROM {table})"


def drop_outliers(table: str, name: str, columns: list[str]) -> str:
    texts = []
    for i, c in enumerate(columns):
        source = table if i == 0 else f"{name}_{i - 1}"
        target = name if i == len(columns) - 1 else f"{name}_{i}"
        texts.append(
            f"""{target} AS (SELECT t.* FROM {source} t, (SELECT a - 1.5::DOUBLE * (b - a) AS lo, b + 1.5::DOUBLE * (b - a) AS hi FROM (
            SELECT quantile_cont({q.money(c)}, 0.25) AS a, quantile_cont({q.money(c)}, 0.75) AS b FROM {source}) z) f
            WHERE {q.money('t.' + c)} IS NULL OR {q.money('t.' + c)} BETWEEN lo AND hi)"""
        )
    return ", ".join(texts)


DEDUPED = f"ded AS (SELECT min(_row_idx) AS _row_idx, {', '.join(COLUMNS)} FROM messy_orders GROUP BY {', '.join(COLUMNS)})"


def titled(table: str, name: str) -> str:
    return f"{name} AS (SELECT _row_idx, {', '.join(TITLE.replace('Client', c) + ' AS ' + c for c in COLUMNS)} FROM {table})"


FIXED = f"{DEDUPED}, {titled('ded', 'tit')}, {impute('tit', 'imp')}, {drop_outliers('imp', 'fixed', ['Phone', 'Revenue'])}"
AFTER = Steps("fixed", COLUMNS, TIERS, ["Revenue"], "z_")


def mask(c: str) -> str:
    s = q.strip(c)
    user = f"string_split({s}, '@')[1]"
    domain = f"string_split({s}, '@')[2]"
    return f"""CASE WHEN {c} IS NULL THEN NULL WHEN lower({s}) IN ('nan', 'none', 'n/a', '-', '') THEN {s}
      WHEN contains({s}, '@') AND length({user}) > 2 THEN left({user}, 2) || '***@' || {domain}
      WHEN contains({s}, '@') THEN '***@' || {domain}
      WHEN length(regexp_replace({s}, '\\D', '', 'g')) >= 8 THEN left({s}, 2) || '******' || right({s}, 2)
      WHEN length({s}) > 4 THEN left({s}, 2) || '*****' || right({s}, 1) ELSE '****' END AS {c}"""


SECRET_COLUMNS = ["Customer_Name", "Email", "Phone", "GSTIN", "Revenue", "Discount", "Join_Date", "Notes"]
MASKED = f"SELECT _row_idx, {', '.join(mask(c) for c in SECRET_COLUMNS[:4])}, Revenue, Discount, Join_Date, Notes FROM people_secret"
TAX = "[0-9]{2}[a-zA-Z]{5}[0-9]{4}[a-zA-Z]{1}[1-9a-zA-Z]{1}[zZ]{1}[0-9a-zA-Z]{1}"
DISCOUNT = q.number(q.strip("replace(Discount, '%', '')"))
VIOLATIONS = f"""SELECT _row_idx AS row_index, 'GSTIN' AS "column", GSTIN AS value, 'GSTIN_FORMAT' AS rule_type,
    CASE WHEN NOT regexp_full_match({q.strip('GSTIN')}, '{TAX}') THEN 'Invalid GSTIN format: ''' || {q.strip('GSTIN')} || '''.' END AS error_msg
    FROM people_secret WHERE GSTIN IS NOT NULL
  UNION ALL SELECT _row_idx, 'Revenue', Revenue, 'NON_NEGATIVE',
    CASE WHEN {q.plain('Revenue')} < 0 THEN 'Negative value detected: ' || cast({q.plain('Revenue')} AS VARCHAR) || '.' END FROM people_secret WHERE Revenue IS NOT NULL
  UNION ALL SELECT _row_idx, 'Discount', Discount, 'PERCENTAGE_CAP',
    CASE WHEN {DISCOUNT} > 100 THEN 'Percentage exceeds limit: ' || cast({DISCOUNT} AS VARCHAR) || '%.' END FROM people_secret WHERE Discount IS NOT NULL
  UNION ALL SELECT _row_idx, 'Join_Date', Join_Date, 'PAST_DATE_ONLY',
    CASE WHEN {q.date('Join_Date')} > TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY THEN 'Future date detected: ' || strftime({q.date('Join_Date')}, '%Y-%m-%d') || '.' END
    FROM people_secret WHERE Join_Date IS NOT NULL
  UNION ALL SELECT _row_idx, 'Notes', Notes, 'SOMETHING_ELSE', NULL FROM people_secret WHERE Notes IS NOT NULL"""
CATALOG = "cat AS (SELECT dataset, unnest(string_split(baseline, '|')) AS \"column\" FROM schemas)"


def like(words) -> str:
    return "(" + " OR ".join(f"contains(lower(\"column\"), '{w}')" for w in words) + ")"


AUDIT = """au AS (SELECT _row_idx, line, string_split(trim(line, chr(9) || ' '), chr(9)) AS p FROM audit_lines),
lg AS (SELECT _row_idx, line, p[1] AS time, p[2] AS "user", p[3] AS action, p[4] AS status, coalesce(p[5], '') AS details FROM au WHERE len(p) >= 4)"""
GRANTS = ", ".join(f"('{r}', '{p}')" for r, ps in access.PERMISSIONS.items() for p in ps)
CHECKS = {
    "class_imbalance": churn_sql(TOP, "SELECT * FROM imbs"),
    "high_cardinality": churn_sql(HIGH, "SELECT 'churn' AS dataset, c AS high_cardinality_col FROM hi"),
    "numeric_columns": churn_sql(CHURN.facts, 'SELECT ord, "column", count(x) AS numbers FROM typed GROUP BY 1, 2 HAVING count(x) >= 4'),
    "corr_matrix": churn_sql(pair_sql(), "SELECT col1, col2, round(r, 6) AS r FROM prs"),
    "corr_pairs": churn_sql(pair_sql(), "SELECT col1, col2, round_even(r, 2) AS coefficient FROM prs WHERE abs(r) > 0.85"),
    "ml_suitability": churn_sql(
        f"{CHURN.facts}, {TOP}, {HIGH}, {pair_sql()}",
        """SELECT i.*, true AS has_target_leakage, 'CancellationDate' AS target_leakage_col, (SELECT c FROM hi) AS high_cardinality_col,
        (SELECT coalesce(string_agg(col1 || '~' || col2 || '~' || round_even(r, 2), ';' ORDER BY o1, o2), '') FROM prs WHERE abs(r) > 0.85) AS pairs,
        (SELECT string_agg("column", ',' ORDER BY ord) FROM (SELECT ord, "column" FROM typed GROUP BY 1, 2 HAVING count(x) >= 4) z) AS numeric_cols,
        false AS drifted FROM imbs i""",
    ),
    "churn_scorecard": churn_sql(CHURN.scores, "SELECT * FROM scores"),
    "readiness": messy_sql(MESSY.scores, f"SELECT *, {STATUS}, 6 AS scope_selected, 6 AS scope_total FROM ({ready_sql('scores', MESSY_ML, 100)}) z"),
    "churn_readiness": churn_sql(
        f"{CHURN.scores}, {TOP}, {HIGH}", f"SELECT *, {STATUS}, 6 AS scope_selected, 6 AS scope_total FROM ({ready_sql('scores', CHURN_ML, 95)}) z"
    ),
    "readiness_report": churn_sql(
        f"{CHURN.scores}, {TOP}, {HIGH}",
        f"""SELECT 'REP-20250601-' || overall_readiness AS report_id, dataset, 'Admin' AS generated_by, '{AS_OF}' AS created_at,
        quality AS quality_score, ml_readiness AS ml_readiness_score, overall_readiness AS overall_readiness_score,
        'Protected (Encrypted)' AS security_status, 3 AS recommendations FROM ({ready_sql('scores', CHURN_ML, 100)}) z""",
    ),
    "risk_index": messy_sql(
        MESSY.scores,
        """SELECT dataset, 'Revenue Reporting Risk' AS risk, 100 - completeness AS risk_score FROM scores
        UNION ALL SELECT dataset, 'Forecasting Variance Risk', 100 - anomalies FROM scores UNION ALL SELECT dataset, 'BI Aggregations Accuracy Risk', 100 - consistency FROM scores""",
    ),
    "fix_dedupe": messy_sql(DEDUPED, "SELECT * FROM ded"),
    "fix_title": messy_sql(titled("messy_orders", "tit"), "SELECT * FROM tit"),
    "fix_impute": messy_sql(impute("messy_orders", "imp"), "SELECT * FROM imp"),
    "fix_outliers_sequential": messy_sql(drop_outliers("messy_orders", "kept", ["Phone", "Revenue"]), "SELECT * FROM kept"),
    "fix_outliers_single_pass": messy_sql(
        "b AS (SELECT " + ", ".join(f"quantile_cont({q.money(c)}, [0.25, 0.75]) AS {c}_q" for c in ("Phone", "Revenue")) + " FROM messy_orders)",
        "SELECT m.* FROM messy_orders m, b WHERE " + " AND ".join(
            f"({q.money(c)} IS NULL OR {q.money(c)} BETWEEN {c}_q[1] - 1.5::DOUBLE * ({c}_q[2] - {c}_q[1]) AND {c}_q[2] + 1.5::DOUBLE * ({c}_q[2] - {c}_q[1]))"
            for c in ("Phone", "Revenue")
        ),
    ),
    "fix_score_gain": messy_sql(
        f"{FIXED}, {MESSY.scores}, {AFTER.scores}",
        """SELECT 'messy_orders' AS dataset, (SELECT overall_quality FROM scores) AS before, (SELECT overall_quality FROM z_scores) AS after,
        (SELECT overall_quality FROM z_scores) - (SELECT overall_quality FROM scores) AS gain""",
    ),
    "rule_suggest": check_sql(
        ["people_secret"],
        f"""SELECT 'GSTIN' AS "column", 'GSTIN_FORMAT' AS rule_type, 'GSTIN must match standard 15-character alphanumeric format.' AS description, 98 AS confidence
          FROM people_secret HAVING count(GSTIN) > 0
        UNION ALL SELECT 'Revenue', 'NON_NEGATIVE', 'Value in ''Revenue'' must be greater than or equal to zero.', 95 FROM people_secret HAVING min({q.plain('Revenue')}) >= 0
        UNION ALL SELECT 'Discount', 'PERCENTAGE_CAP', 'Discount rate in ''Discount'' cannot exceed 100%.', 99 FROM people_secret HAVING count(Discount) > 0
        UNION ALL SELECT 'Join_Date', 'PAST_DATE_ONLY', 'Date in ''Join_Date'' cannot represent a future date.', 92 FROM people_secret HAVING count(Join_Date) > 0""",
    ),
    "rule_violations": check_sql(["people_secret"], f"SELECT * FROM ({VIOLATIONS}) v WHERE error_msg IS NOT NULL"),
    "rule_compliance": check_sql(
        ["people_secret"],
        f"""SELECT count(*) AS total_checks, count(error_msg) AS violations_count, {q.pct('(count(*) - count(error_msg))', 'count(*)')} AS compliance_score
        FROM ({VIOLATIONS}) v""",
    ),
    "mask_analyst": check_sql(["people_secret"], MASKED),
    "mask_viewer": check_sql(["people_secret"], "SELECT * FROM people_secret WHERE false"),
    "sensitive_columns": check_sql(
        ["schemas"],
        f""", {CATALOG}, cl AS (SELECT dataset, "column", CASE WHEN {like(privacy.FINANCIAL)} THEN 'Financial' WHEN {like(privacy.SENSITIVE)} THEN 'Sensitive'
          WHEN {like(privacy.PERSONAL)} THEN 'PII' ELSE 'Standard' END AS classification FROM cat)
        SELECT cl.*, risk_level, sensitive_columns FROM cl JOIN (SELECT dataset, CASE WHEN bool_or(classification = 'Sensitive') THEN 'High'
          WHEN bool_or(classification = 'PII') THEN 'Medium' ELSE 'Low' END AS risk_level,
          count(*) FILTER (classification IN ('Sensitive', 'PII')) AS sensitive_columns FROM cl GROUP BY dataset) r USING (dataset)""",
    ),
    "visible_datasets": check_sql(
        ["catalog"],
        "SELECT * FROM catalog WHERE dataset_id IN ('retail_sales', 'customer_churn', 'inventory_logistics') OR lower(creator) = 'guest'",
    ),
    "permitted_requests": check_sql(
        ["requests"], f"SELECT r.* FROM requests r WHERE (upper(trim(role)), permission) IN (VALUES {GRANTS})"
    ),
    "scope_warnings": check_sql(
        ["schemas"],
        f""", {CATALOG}, sel AS (SELECT dataset, unnest(string_split(current, '|')) AS "column" FROM schemas)
        SELECT dataset, "column", 'Warning: Excluding ''' || "column" || ''' may materially affect the reliability of the AI Readiness assessment.' AS warning
        FROM cat c WHERE {like(access.SCOPE_CRITICAL)} AND NOT EXISTS (SELECT 1 FROM sel s WHERE s.dataset = c.dataset AND s."column" = c."column")""",
    ),
    "audit_scan": check_sql(["audit_lines"], f', {AUDIT} SELECT _row_idx, time, "user", action, status, details FROM lg'),
    "audit_filter": check_sql(
        ["audit_lines"],
        f""", {AUDIT} SELECT _row_idx, time, "user", action, status, details FROM lg
        WHERE contains(lower(line), 'props') AND lower(action) = 'click' AND lower(status) = 'failed'""",
    ),
    "audit_counts": check_sql(["audit_lines"], f", {AUDIT} SELECT action, status, count(*) AS entries FROM lg GROUP BY 1, 2"),
}
