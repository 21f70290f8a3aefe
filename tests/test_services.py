"""Versions, carried classes, typed rules and intake with rejected payloads."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import monitor, privacy, quality, reconcile, rules
from tablewright.sources import files, versions


def table(spark, n=40):
    rows = [(i, f"C{i % 4}", None if i % 7 == 0 else str(10 + i % 5), "x@y.org") for i in range(n)]
    return spark.createDataFrame(rows, "_row_idx long, Client string, Revenue string, Email string")


def test_fixes_make_a_version(spark, tmp_path):
    at = str(tmp_path / "t")
    versions.publish(table(spark), at)
    row = versions.apply(spark, at, ["fill_missing"], "Data Analyst", "Ann", "t", str(tmp_path / "audit"), str(tmp_path / "csv")).first()
    own = versions.Versions(spark, at)
    assert (row.version, own.current(), row.rows, row.gain) == (2, 2, 40, row.after - row.before) and row.gain > 0
    assert own.read().where("Revenue IS NULL").isEmpty() and own.read(1).where("Revenue IS NULL").count() == 6
    shown = files.read_csv(spark, str(tmp_path / "csv"))
    assert {r.Email for r in shown.collect()} == {"***@y.org"} and shown.count() == 40
    line = files.read_audit(spark, str(tmp_path / "audit")).first().line.split("\t")
    assert line[1:] == ["Ann", "Apply Safe Fixes", "SUCCESS", 'Transformed dataset t with modifications: ["fill_missing"].']


def test_a_failed_write_leaves_the_version(spark, tmp_path):
    at = str(tmp_path / "t")
    own = versions.publish(table(spark), at)
    broken = table(spark).withColumn("Revenue", F.raise_error(F.lit("broken")).cast("string"))
    for _ in range(2):
        with pytest.raises(Exception, match="broken"):
            versions.publish(broken, at)
        assert own.current() == 1 and own.read().count() == 40
    assert versions.publish(table(spark, 5), at).current() == 2 and own.read().count() == 5  # over what the failed write left
    with pytest.raises(PermissionError):
        versions.apply(spark, at, ["fill_missing"], "VIEWER", "Vi", "t", str(tmp_path / "a"), str(tmp_path / "b"))
    assert own.current() == 2 and versions.Versions(spark, str(tmp_path / "none")).current() == 0


def test_classes_are_carried(spark, tmp_path):
    plain = spark.createDataFrame([(0, "24AAAAP1234F1Z9", "Ann Smith", "note")], "_row_idx long, GSTIN string, Customer string, Notes string")
    kept = privacy.marked(plain).where("Notes = 'note'").withColumnRenamed("GSTIN", "code").select("code", "Customer", "Notes")
    assert privacy.hidden_columns(kept) == ["code", "Customer"] and privacy.hidden_columns(plain.withColumnRenamed("GSTIN", "code")) == ["Customer"]
    assert privacy.mask_for_role(kept, "DATA ANALYST").first().code == "24******Z9" and privacy.mask_for_role(kept, "ADMIN").first().code.startswith("24A")
    kept.write.parquet(str(tmp_path / "p"))
    assert privacy.hidden_columns(spark.read.parquet(str(tmp_path / "p"))) == ["code", "Customer"]
    made = privacy.carried(privacy.marked(plain), "Notes", "GSTIN")[privacy.CARRIED]
    assert made == {"class": "Sensitive", "origin": ["GSTIN", "Notes"]}


def test_the_ledger_carries_its_customers(spark):
    inv = spark.createDataFrame([(0, "INV-101", "Rahul Patel", 70.0)], "_row_idx long, Invoice_No string, Customer_Name string, Amount double")
    pay = spark.createDataFrame([(0, "INV-101", "Someone Else", 70.0)], "_row_idx long, Payment_Ref string, Customer string, Paid_Amount double")
    shown = privacy.mask_for_role(reconcile.payment_ledger(privacy.marked(inv), privacy.marked(pay)), "DATA ANALYST").first()
    assert shown.status == "Conflict" and shown.customer == "Ra*****l" and "Patel" not in shown.details
    bare = privacy.mask_for_role(reconcile.payment_ledger(inv, pay), "DATA ANALYST").first()
    assert bare.customer == "Ra*****l" and "Patel" in bare.details  # by name alone


def test_violations_of_hidden_columns_are_masked(spark):
    rows = spark.createDataFrame([(0, "bad", "-5")], "_row_idx long, GSTIN string, Revenue string")
    wanted = [("GSTIN", "GSTIN_FORMAT"), ("Revenue", "NON_NEGATIVE")]
    shown = {r.column: r for r in rules.masked_violations(rows, wanted, "DATA ANALYST").collect()}
    assert shown["GSTIN"].value == "****" and "bad" not in shown["GSTIN"].error_msg and shown["Revenue"].value == "-5"
    assert rules.masked_violations(rows, wanted, "VIEWER").count() == 0 and rules.masked_violations(rows, wanted, "ADMIN").where("value = 'bad'").count() == 1


def test_states_fire_and_unknown_rules_are_named(spark):
    shape = "rule_id string, rule_name string, category string, metric string, operator string, threshold string, severity string, channels string, cooldown_minutes int, active boolean"
    given = [("r3", "File Threat / Malware Flag", "==", "INFECTED"), ("r4", "File Threat / Malware Flag", "!=", "CLEAN"), ("r5", "File Threat / Malware Flag", "<", "Z"), ("r6", "Moon", ">", "1"), ("r7", "Anomaly Count", ">", "many"), ("r8", "Anomaly Count", ">", "1")]
    table_ = spark.createDataFrame([(i, "n", "c", m, o, t, "s", "Slack", 1, True) for i, m, o, t in given], shape)
    metrics = spark.sql("SELECT 'a' AS dataset, timestamp'2024-01-01' AS period_end, 3 AS anomaly_count, 'INFECTED' AS malware_status UNION ALL SELECT 'b', timestamp'2024-01-01', 0, 'CLEAN'")
    fired = sorted((r.rule_id, r.dataset_target, r.metric_value) for r in monitor.rule_breaches(metrics, table_).collect())
    assert fired == [("r3", "a", "File Threat / Malware Flag = INFECTED"), ("r4", "a", "File Threat / Malware Flag = INFECTED"), ("r8", "a", "Anomalies = 3 rows")]
    assert {r.rule_id: r.reason for r in monitor.unknown_rules(table_).collect()} == {"r5": "a state has no order", "r6": "unknown metric", "r7": "threshold is no number"}


def test_payloads_are_turned_away(spark):
    rows = spark.createDataFrame([(1, '{"k": "a", "x": 1}'), (2, "{bad"), (3, "{}"), (4, None), (5, '{"k": null}'), (6, "[]")], "id int, payload string")
    got = {r.id: (r.k, r.reason) for r in files.payload_intake(rows, "k string", ["k"]).collect()}
    assert got[1] == ("a", None) and got[2] == (None, "malformed") and got[3] == (None, "missing k") and got[4] == (None, "malformed") and got[5] == (None, "missing k")
    assert got[6][1] is not None


def test_case_groups_list_one_example(spark):
    rows = [(i, v) for i, v in enumerate(["b", "B", "b", "a", "A", "å", "Å", "1", None])]
    found = quality.case_variants(spark.createDataFrame(rows, "_row_idx long, c string")).first()
    assert (found.groups, found.surplus, found.example) == (3, 3, "a, A")
    text = quality.case_groups(spark.createDataFrame(rows, "_row_idx long, c string"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text
