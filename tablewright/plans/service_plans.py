"""What a service does with the operators: versions and their fixes, masked results, files in and out."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tablewright.operators import access, inventory, monitor, privacy, profile, reconcile, rules, schemas, suitability
from tablewright.plans import business_plans, entity_plans, sequences, table_plans

from tablewright.plans.fixtures import check_sql, derived, given_table
from tablewright.plans.quality_plans import COLUMNS, MESSY, Steps, messy, messy_sql
from tablewright.sources import files, versions
from tablewright.session import remove_at_exit, shared_folder

ANALYST = "DATA ANALYST"
SCOPE, SHOWN = ["Client", "Phone", "Revenue"], ["Client", "Revenue"]
CATALOG = ("customer", "supplier", "events", "lineitem")


def work_folder(spark) -> str:
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    return folder


def fix_apply(spark, folder):
    at = work_folder(spark)
    versions.publish(messy(spark, folder), f"{at}/table")
    return versions.apply(spark, f"{at}/table", table_plans.FIX_ALL, ANALYST, "Analyst", "messy_orders", f"{at}/audit", f"{at}/export")


def masked_ledger(spark, folder):
    invoices, payments = business_plans.billed(spark, folder)
    return privacy.mask_for_role(reconcile.payment_ledger(privacy.marked(invoices), privacy.marked(payments)), ANALYST)


def scoped_profile_analyst(spark, folder):
    found = profile.scoped_profile(access.scoped(messy(spark, folder), SCOPE), ANALYST, SHOWN)
    return found.select("column", "type", "cardinality", "missing", "scope_status")


def csv_round_trip(spark, folder):
    at = work_folder(spark)
    files.export_masked(table_plans.secret(spark, folder), ANALYST, at)
    return files.read_csv(spark, at).drop(files.CORRUPT)


def csv_scan(spark, folder):
    at = work_folder(spark)
    files.export_masked(messy(spark, folder), "ADMIN", at)
    return files.read_csv(spark, at).drop(files.CORRUPT)


def saved_merge(spark, folder):
    at = work_folder(spark)
    files.save_merged(entity_plans.QUERIES["merge_outer"](spark, folder), at, "unified", {"strategy": "Outer Join"})
    return files.read_table(spark, at, "unified")


def audit_append(spark, folder):
    at = work_folder(spark)
    files.append_audit(derived(spark, folder, "audit_lines"), at)
    return access.parse_audit(files.read_audit(spark, at)).drop("_line", "day")


def payload_intake(spark, folder):
    rows = derived(spark, folder, "payloads").select(F.col("_row_idx").alias("payload_id"), "system_id", "payload")
    return files.payload_intake(rows, "k string", ["k"]).drop("payload")


def state_breaches(spark, folder):
    spotted = F.when(F.col("anomaly_count") > 8, "INFECTED").otherwise("CLEAN")
    found = monitor.rule_breaches(business_plans.metrics(spark, folder).withColumn("malware_status", spotted), derived(spark, folder, "state_rules"))
    return business_plans.naive("triggered_at")(found)


def accepted_mapping(spark, folder):
    suggested = schemas.suggest_mapping([(s, derived(spark, folder, f"src_{s}")) for s in entity_plans.SOURCES])
    return schemas.accepted_mapping(suggested, ["Email"]).select("target_field", "confidence", "confidence_level")


QUERIES = {
    "fix_apply": fix_apply,
    "masked_ledger": masked_ledger,
    "masked_anomalies": lambda s, d: privacy.mask_for_role(inventory.reconcile_inventory(*business_plans.stocked(s, d)), ANALYST),
    "masked_violations": lambda s, d: rules.masked_violations(table_plans.secret(s, d), table_plans.RULES, ANALYST, table_plans.as_of()),
    "scoped_profile_analyst": scoped_profile_analyst,
    "scoped_profile_viewer": lambda s, d: profile.scoped_profile(access.scoped(messy(s, d), SCOPE), "VIEWER", SHOWN).select("column", "type", "cardinality", "missing", "scope_status"),
    "scoped_columns": lambda s, d: access.scoped(messy(s, d), ["Revenue", "Absent", "Region"]),
    "csv_scan": csv_scan,
    "csv_round_trip": csv_round_trip,
    "saved_merge": saved_merge,
    "audit_append": audit_append,
    "dataset_catalog": lambda s, d: files.dataset_catalog({t: given_table(s, d, t) for t in CATALOG}),
    "payload_intake": payload_intake,
    "state_breaches": state_breaches,
    "accepted_mapping": accepted_mapping,
    "drop_leakage": lambda s, d: suitability.drop_leakage(table_plans.churn(s, d)),
}


def hide(select: str, columns: list[str]) -> str:
    """``select`` with the named columns masked."""
    shown = ", ".join(table_plans.mask(c) for c in columns)
    return f"SELECT * EXCLUDE ({', '.join(columns)}), {shown} FROM ({select}) m"


def unmissed(c: str) -> str:
    marks = ", ".join(f"'{m}'" for m in files.MISSING)
    return f"CASE WHEN {c} NOT IN ({marks}) THEN {c} END AS {c}"


MASKED_SCOPE = f"msk AS (SELECT _row_idx, {table_plans.mask('Client')}, {table_plans.mask('Phone')}, Revenue FROM messy_orders)"
SCOPED = Steps("msk", SCOPE, {"critical": ["Revenue"], "standard": ["Phone"], "optional": ["Client"]}, ["Revenue"], "m_")
PAYLOAD = "CASE WHEN json_valid(payload) THEN payload ELSE '{}' END"
CHECKS = {
    "fix_apply": messy_sql(
        f"{table_plans.FIXED}, {MESSY.scores}, {table_plans.AFTER.scores}",
        """SELECT 'messy_orders' AS dataset, 2 AS version, (SELECT count(*) FROM fixed) AS rows, (SELECT overall_quality FROM scores) AS before,
        (SELECT overall_quality FROM z_scores) AS after, (SELECT overall_quality FROM z_scores) - (SELECT overall_quality FROM scores) AS gain""",
    ),
    "masked_ledger": sequences.served_sql(hide("SELECT * FROM led", ["customer", "details"])),
    "masked_anomalies": check_sql(["pos_sales", "stock"], f", {business_plans.INVENTORY} {hide('SELECT * FROM ano', ['product_name'])}"),
    "masked_violations": check_sql(
        ["people_secret"],
        f"""SELECT row_index, "column", rule_type, CASE WHEN "column" = 'GSTIN' THEN hv ELSE value END AS value, CASE WHEN "column" = 'GSTIN' THEN he ELSE error_msg END AS error_msg
        FROM (SELECT *, {table_plans.mask('value').replace(' END AS value', ' END AS hv')}, {table_plans.mask('error_msg').replace(' END AS error_msg', ' END AS he')}
          FROM ({table_plans.VIOLATIONS}) v WHERE error_msg IS NOT NULL) w""",
    ),
    "scoped_profile_analyst": messy_sql(
        f"{MASKED_SCOPE}, {SCOPED.facts}",
        """SELECT "column", type, cardinality, missing, CASE WHEN "column" IN ('Client', 'Revenue') THEN 'Included' ELSE 'Excluded from analysis' END AS scope_status FROM m_kinds""",
    ),
    "scoped_profile_viewer": messy_sql(
        f"{MASKED_SCOPE}, {SCOPED.facts}", """SELECT "column", type, cardinality, missing, 'x' AS scope_status FROM m_kinds WHERE false"""
    ),
    "scoped_columns": check_sql(["messy_orders"], "SELECT _row_idx, Revenue, Region FROM messy_orders"),
    "csv_scan": check_sql(["messy_orders"], f"SELECT {', '.join(map(unmissed, COLUMNS))} FROM messy_orders"),
    "csv_round_trip": check_sql(
        ["people_secret"], f"SELECT {', '.join(map(unmissed, table_plans.SECRET_COLUMNS))} FROM ({table_plans.MASKED}) m"
    ),
    "saved_merge": entity_plans.CHECKS["merge_outer"],
    "audit_append": check_sql(["audit_lines"], f', {table_plans.AUDIT} SELECT time, "user", action, status, details FROM lg'),
    "payload_intake": check_sql(
        ["payloads"],
        f"""SELECT _row_idx AS payload_id, system_id, json_extract_string({PAYLOAD}, '$.k') AS k,
        CASE WHEN NOT json_valid(payload) THEN 'malformed' WHEN json_extract_string({PAYLOAD}, '$.k') IS NULL THEN 'missing k' END AS reason FROM payloads""",
    ),
    "state_breaches": check_sql(
        ["state_rules"],
        f""", met AS ({business_plans.DAILY}), x AS (SELECT dataset, period_end, anomaly_count AS n FROM met WHERE anomaly_count > 8)
        SELECT rule_id, rule_name, category, severity, channels, cooldown_minutes, dataset AS dataset_target, period_end AS triggered_at,
          CASE rule_id WHEN 'rule_2' THEN 'Anomalies = ' || n || ' rows' ELSE 'File Threat / Malware Flag = INFECTED' END AS metric_value,
          CASE rule_id WHEN 'rule_2' THEN 'Detected ' || n || ' anomalous records exceeding threshold (> 8.0).'
            ELSE 'File Threat / Malware Flag is INFECTED (Threshold: == INFECTED).' END AS message
        FROM x JOIN state_rules ON rule_id IN ('rule_2', 'rule_3')""",
    ),
    "accepted_mapping": re.sub(
        r",\s*string_agg\([^)]*\) AS columns", "",
        check_sql([f"src_{s}" for s in entity_plans.SOURCES], business_plans.match_sql() + " HAVING round_even(avg(conf), 0) >= 85 OR t = 'Email'"),
    ),
    "dataset_catalog": " UNION ALL ".join(
        f"SELECT '{t}' AS id, count(*) AS rows, (SELECT count(*) FROM (DESCRIBE {t}))::INTEGER AS cols FROM {t}" for t in CATALOG
    ),
    "drop_leakage": check_sql(["churn"], "SELECT * EXCLUDE (CancellationDate) FROM churn"),
}
