"""Small literal cases per operator."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import dates, numbers, similarity, text
from tablewright.functions.masking import mask_value
from tablewright.operators import access, columns, entities, fixes, inventory, merge, monitor, privacy, profile, quality, reconcile, rules, schemas, simjoin, suitability
from tablewright.sources import files


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "want"), [(" $1,234.50\t", 1234.5), ("5d", None), ("nan", None), ("1e3", 1000.0), ("", None), ("-.5", -0.5)]
)
def test_money(spark, value, want):
    assert one(spark, value, numbers.parse_money) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("2024-02-30", False), ("2024-2-3", True), ("31-12-2024", True), ("ORD-1000", False), ("2024", False), ("Jan 3 2024", True), ("12/13", False)],
)
def test_dates(spark, value, want):
    assert one(spark, value, dates.is_date) is want


def test_text_forms(spark):
    assert one(spark, "o'neil sku-a abc1def", text.title_case) == "O'Neil Sku-A Abc1Def"
    assert one(spark, "  x\t", text.strip) == "x"
    assert one(spark, "  Rahul   K. Patel! ", text.normalize) == "rahul k patel"
    assert one(spark, "Rahul K Patel", text.name_key) == "name_rah_patel"
    assert one(spark, "Cher", text.name_key) == "name_che"
    assert one(spark, "+91 98765-43210", text.phone_key) == "phone_9876543210"


@pytest.mark.parametrize(
    ("value", "want"),
    [("rahul@x.org", "ra***@x.org"), ("ab@x.org", "***@x.org"), ("9876543210", "98******10"), ("Rahul", "Ra*****l"), ("abcd", "****"), ("N/A", "N/A"), (None, None)],
)
def test_mask(spark, value, want):
    assert one(spark, value, mask_value) == want


def test_ratio(spark):
    row = spark.createDataFrame([("rahul patel", "rahul k patel", "a" * 300, "a" * 299 + "b")], "a string, b string, c string, d string")
    got = row.select(similarity.ratio(F.col("a"), F.col("b")).alias("x"), similarity.ratio(F.col("c"), F.col("d")).alias("y")).first()
    assert got.x == pytest.approx(91.6666, abs=1e-3)
    assert got.y == pytest.approx(100 * 299 / 300)


def test_quantiles_by_brackets(spark):
    """With a coarse sketch the brackets really cut, and the result must stay exact."""
    import numpy as np

    rng = np.random.default_rng(1)
    xs = {"a": rng.normal(size=4001).round(2), "b": np.repeat([1.0, 2.0, 3.0], [3000, 10, 990]), "c": np.arange(5000.0)}
    cells = spark.createDataFrame([(k, float(x)) for k, v in xs.items() for x in v], "k string, x double").repartition(6)
    got = {r.k: r for r in columns.exact_quantiles(cells, ["k"], "x", [0.25, 0.5, 0.75], accuracy=50).collect()}
    for k, v in xs.items():
        assert [got[k].q0, got[k].q1, got[k].q2] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 0.75])))


def test_score_before_and_after(spark):
    table = spark.createDataFrame([(0, "A", 10), (1, "A", 10), (2, None, 15)], "_row_idx long, Name string, Val int")
    row = quality.scorecard(table, "t").first()
    assert (row.completeness, row.duplicates, row.anomalies, row.overall_quality) == (83, 67, 100, 92)
    ready = suitability.table_readiness(table, "t").first()
    assert ready.overall_readiness == 94 and ready.status == "AI READY"
    clean = suitability.table_readiness(table.where("Name is not null").dropDuplicates(["Name", "Val"]), "t").first()
    assert clean.overall_readiness == 100
    assert suitability.table_readiness(table, "t", security_status="Infected").first().status == "BLOCKED (INFECTED)"


def test_empty_table(spark):
    table = spark.createDataFrame([], "_row_idx long, Name string, Revenue string")
    row = quality.scorecard(table, "t").first()
    assert row.overall_quality is None and row.completeness == row.consistency == row.anomalies == row.duplicates == 100
    assert suitability.table_readiness(table, "t").first().quality == 80
    assert profile.column_profile(table).count() == 0


def test_suitability(spark):
    rows = [(i, f"C{i}", str(i), str(2 * i), "2024-01-01" if i < 2 else None, "1" if i < 2 else "0", "7") for i in range(30)]
    table = spark.createDataFrame(rows, "_row_idx long, CustomerID string, a string, b string, CancellationDate string, Churn string, const string")
    row = suitability.suitability(table, "t").first()
    assert row.class_imbalance == "Severe (Ratio 14.0:1)" and row.class_imbalance_ratio == "28:2"
    assert row.target_leakage_col == "CancellationDate" and row.high_cardinality_col == "CustomerID"
    assert [(p.col1, p.col2, p.coefficient) for p in row.redundant_pairs] == [("a", "b", 1.0)]
    assert suitability.drop_leakage(table).columns == [c for c in table.columns if c != "CancellationDate"]


def test_fixes(spark):
    rows = [(0, "ann", "1", ""), (1, "ann", "1", ""), (2, "BOB", "", "x"), (3, None, "3", "y"), (4, "bob", "1000", "y"), (5, "c", "2", "-"), (6, "c", "4", "z")]
    table = spark.createDataFrame(rows, "_row_idx long, n string, v string, w string")
    assert fixes.remove_duplicates(table).count() == 6
    filled = {r._row_idx: r for r in fixes.fill_missing(table).collect()}
    assert filled[2].v == "2.5" and filled[0].w == "y" and filled[3].n == "ann"
    assert {r._row_idx for r in fixes.remove_outliers(table).collect()} == {0, 1, 2, 3, 5, 6}
    assert fixes.normalize_case(table).where("_row_idx = 2").first().n == "Bob"
    assert set(fixes.preview_fixes(table.withColumnRenamed("n", "Name"), ["remove_duplicates"])) == {"quality", "readiness", "preview", "name_clusters"}


def test_rules(spark):
    table = spark.createDataFrame([(0, "24AAAAP1234F1Z9", "500"), (1, None, None)], "_row_idx long, GSTIN string, Revenue string")
    found = rules.suggest_rules(table).collect()
    assert {r.rule_type for r in found} == {"GSTIN_FORMAT", "NON_NEGATIVE"}
    bad = table.withColumn("Revenue", F.lit("-500"))
    asked = [("Revenue", "NON_NEGATIVE")]
    assert rules.compliance(bad.limit(1), asked).first().compliance_score == 0
    assert rules.violations(bad.limit(1), asked).first().error_msg == "Negative value detected: -500.0."
    assert rules.compliance(bad, [("None", "NON_NEGATIVE")]).first().compliance_score == 100


def test_privacy(spark):
    table = spark.createDataFrame([("rahul@test.com", "9876543210", 10.0, "n")], "Email string, Phone string, Revenue double, Notes string")
    assert [privacy.sensitivity(c) for c in table.columns] == ["PII", "PII", "Financial", "Standard"]
    assert privacy.risk_level(table.columns) == "Medium"
    row = privacy.mask_for_role(table, "DATA ANALYST").first()
    assert row.Email.startswith("ra***@") and "******" in row.Phone and row.Revenue == 10.0
    assert privacy.mask_for_role(table, "VIEWER").count() == 0 and privacy.mask_for_role(table, "ADMIN").first().Phone == "9876543210"


SOURCES = {
    "crm": ([(0, "Rahul Patel", "9876543210", "1000"), (1, "Alice Green", "8888888888", "2000")], "_row_idx long, customer_name string, phone string, revenue string"),
    "tally": ([(0, "Rahul K Patel", "9876543210", "1100"), (1, "Bob Brown", "7777777777", "1500")], "_row_idx long, party string, mobile string, sales string"),
}
MAPPING = {"Customer_Name": {"crm": "customer_name", "tally": "party"}, "Phone": {"crm": "phone", "tally": "mobile"}, "Revenue": {"crm": "revenue", "tally": "sales"}}


def test_merge(spark):
    frames = [(k, spark.createDataFrame(*v)) for k, v in SOURCES.items()]
    groups = entities.resolve(entities.unify(frames, MAPPING))
    assert [r.primary for r in entities.duplicate_clusters(groups).collect()] == ["Rahul Patel"]
    conflict = merge.conflicts(groups, MAPPING).where("field = 'Revenue'").collect()
    assert len(conflict) == 1 and conflict[0]["values"] == {"crm": "1000", "tally": "1100"}
    golden = {r.Customer_Name: r for r in merge.apply_merge(groups, frames, "Entity Resolution", {"Rahul Patel_Revenue": "1100"}).collect()}
    assert len(golden) == 3 and golden["Rahul Patel"].Revenue == "1100" and golden["Rahul Patel"]._merge_confidence == 92
    assert merge.apply_merge(groups, frames, "Inner Join").count() == 1 and merge.apply_merge(groups, frames, "Left Join").count() == 2
    stats = merge.preview(groups, MAPPING).first()
    assert (stats.unique_entities, stats.matched_records, stats.conflicts_detected) == (3, 2, 1)
    logged = [e for r in merge.log_parts(groups, rows=1).collect() for e in json.loads(r._provenance_log)]
    assert sorted((e["source"], e["row_idx"]) for e in logged) == sorted((r._source_id, r._row_idx) for r in groups.collect())
    # one entity in each of seventy sources
    many = [(f"s{i:02}", spark.createDataFrame([(0, "Rahul Patel", "9876543210")], "_row_idx long, name string, phone string")) for i in range(70)]
    same = entities.resolve(entities.unify(many, {"Customer_Name": {n: "name" for n, _ in many}, "Phone": {n: "phone" for n, _ in many}}))
    assert merge.apply_merge(same, many, "Inner Join").count() == merge.apply_merge(same, many, "Left Join").count() == 1


def test_schema_tools(spark):
    pair = spark.createDataFrame([("d", ["Customer_Name", "Phone", "Revenue"], ["CustomerName", "Mobile", "SalesAmount", "Extra_Col"])], "dataset string, baseline array<string>, current array<string>")
    row = schemas.schema_drift(pair).first()
    assert row.stability_score < 100 and row.renamed["Customer_Name"] == "CustomerName" and "Extra_Col" in row.added
    file = spark.createDataFrame([("tally_export_2026.xlsx", ["GSTIN", "customer", "invoice_no", "total_amt"])], "filename string, columns array<string>")
    found = schemas.detect_sources(file).first()
    assert found.detected_source == "Tally" and found.confidence >= 80
    a = spark.createDataFrame([], "_row_idx long, customer_name string, phone_num string, revenue string")
    b = spark.createDataFrame([], "_row_idx long, cust_name string, tel string, sales string")
    mapping = {r.target_field: r for r in schemas.suggest_mapping([("a", a), ("b", b)]).collect()}
    assert mapping["Customer_Name"]["columns"] == {"a": "customer_name", "b": "cust_name"} and mapping["Customer_Name"].confidence_level == "HIGH"
    table = spark.createDataFrame([(0, "a", 10.0, "2024-01-01", "s1")], "_row_idx long, Customer_Name string, Revenue double, Date string, System_Id string")
    roles = {r.column: r for r in schemas.scan_scope(table).collect()}
    assert [roles[c].role for c in ("Customer_Name", "Revenue", "System_Id")] == ["Identifier", "Target", "System Field"]
    assert roles["Revenue"].recommendation == "Include" and roles["System_Id"].recommendation == "Exclude"
    assert access.scope_gaps(table, ["Customer_Name"]) == ["Revenue"]


def test_inventory(spark):
    pos = spark.createDataFrame([(0, "SKU_A", "S24 Phone", "10")], "_row_idx long, SKU string, Product_Name string, Quantity_Sold string")
    stock = spark.createDataFrame([(0, "SKU_A", "S24 Phone", "-5"), (1, "SKU_A", "S24 Phone", "50")], "_row_idx long, SKU string, Product_Name string, Stock_Remaining string")
    assert inventory.reconcile_inventory(pos, stock).first().anomaly_type == "Negative Stock Balance"
    assert inventory.inventory_stats(pos, stock).first().negative_stock_skus == 1


def test_cooldown(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    rows = [("r", "d", at(m), 60) for m in (0, 10, 59, 60, 70, 200)] + [("r", "e", at(0), 60), ("s", "d", at(5), 60)]
    found = monitor.with_cooldown(spark.createDataFrame(rows, "rule_id string, dataset_target string, triggered_at timestamp, cooldown_minutes int")).collect()
    fired = sorted((r.rule_id, r.dataset_target, (r.triggered_at - at(0)).seconds // 60) for r in found if r.alert)
    assert fired == [("r", "d", 0), ("r", "d", 60), ("r", "d", 200), ("s", "d", 5)]
    assert {r.cooldown_remaining_mins for r in found if not r.alert} == {60.0, 50.0, 1.0}


def test_files(spark, tmp_path):
    path = tmp_path / "pos_export.csv"
    path.write_bytes(b"POS_ID,Customer\n1,A\xffnn\n2,NA\n3,\xff\n4,a,b\n")
    rows = files.read_csv(spark, str(path)).collect()
    assert rows[0].Customer == "Ann" and rows[1].Customer is None and rows[2].Customer is None and rows[3]._corrupt_record is not None
    (tmp_path / "bad.csv").write_bytes(b"xx SIGNATURE yy")
    (tmp_path / "x.txt").write_bytes(b"1")
    verdicts = files.admission(spark, str(tmp_path), "SIGNATURE")
    found = {os.path.basename(r.path): r.reason for r in verdicts.collect()}
    assert found["pos_export.csv"] is None and found["bad.csv"].startswith("Security") and found["x.txt"].startswith("Unsupported")
    small = {os.path.basename(r.path): r.reason for r in files.admission(spark, str(tmp_path), "SIGNATURE", 2).collect()}
    assert small["bad.csv"].startswith("File too large") and small["x.txt"].startswith("Unsupported")
    report = files.source_report(spark, {"s1": str(path)}).first()
    assert report.source_type == "POS Export" and report.cols == 2
    table = spark.createDataFrame([(0, "rahul@test.com")], "_row_idx long, Email string")
    files.export_masked(table, "DATA ANALYST", str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().Email == "ra***@test.com"
    log = spark.createDataFrame([("ann", "Upload", "SUCCESS", None)], "u string, a string, s string, d string")
    lines = log.select(access.audit_line(F.col("u"), F.col("a"), F.col("s"), F.col("d")).alias("line"))
    files.append_audit(lines, str(tmp_path / "audit"))
    parsed = access.parse_audit(files.read_audit(spark, str(tmp_path / "audit")))
    assert access.search_audit(parsed, user="ANN").count() == 1
    files.save_merged(table, str(tmp_path), "unified_1", {"key": "Customer_Name"})
    assert files.read_table(spark, str(tmp_path), "unified_1").count() == 1
    assert files.dataset_catalog({"t": table}).first().cols == 1


def test_types_look_at_all_cells(spark):
    """A column whose first cells are dates is a date column only if all others are."""
    rows = [(i, "2024-01-02", "2024-01-02" if i < 20 else "later") for i in range(40)]
    found = profile.column_profile(spark.createDataFrame(rows, "_row_idx long, a string, b string")).collect()
    assert {r.column: r.type for r in found} == {"a": "DateTime/Other", "b": "Categorical"}


def test_distinct_counts_of_long_texts(spark):
    rows = [(i, ("x" * 100) + str(i % 7), "ab"[i % 2]) for i in range(50)]
    found = profile.column_profile(spark.createDataFrame(rows, "_row_idx long, a string, b string")).collect()
    assert {r.column: r.cardinality for r in found} == {"a": 7, "b": 2}


def test_ledger_with_an_empty_side(spark):
    ledger = spark.createDataFrame([("Unmatched Payment",)] * 3, "status string")
    only_payments = reconcile.ledger_stats(ledger).first()
    assert (only_payments.unmatched, only_payments.unmatched_pct) == (0, 100.0)
    only_invoices = reconcile.ledger_stats(spark.createDataFrame([("Unmatched",)] * 3, "status string")).first()
    assert (only_invoices.unmatched, only_invoices.unmatched_pct) == (3, 100.0)
    assert reconcile.ledger_stats(ledger.limit(0)).first().unmatched_pct == 0.0


def test_missed_ranks_are_looked_for_again(spark, monkeypatch):
    """A sketch whose bracket misses the rank costs a pass and nothing else."""
    monkeypatch.setattr(columns, "RANKED_VALUES", 100)
    numbers = spark.range(2000).selectExpr("'c' AS k", "cast(id AS double) AS x")
    for miss in (F.max, F.min):
        with monkeypatch.context() as patch:
            patch.setattr(columns.F, "percentile_approx", lambda value, points, accuracy: F.array(*[miss(value) for _ in points]))
            exact = columns.exact_quantiles(numbers, ["k"], "x", [0.25, 0.5], accuracy=100).first()
        assert (exact.q0, exact.q1) == (499.75, 999.5)


def test_ordered_bits_sort_like_the_numbers(spark):
    rng = random.Random(6)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf")]
    xs += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(500)] + [s * 2.0**e * f for e in range(-60, 60, 7) for s in (1, -1) for f in (1, 1 + 2**-50, 1 - 2**-50)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", columns.ordered_bits(F.col("x")).alias("b")).collect()
    rows.sort(key=lambda r: r.x)
    assert all(a.b <= b.b for a, b in zip(rows, rows[1:])) and len({r.b for r in rows}) > 500


@pytest.mark.parametrize("ranked", [3, 50])
def test_quantiles_by_histograms(spark, monkeypatch, ranked):
    """Few values may be ranked at once, so histograms of the bits have to narrow the brackets down."""
    import numpy as np

    monkeypatch.setattr(columns, "RANKED_VALUES", ranked)
    rng = np.random.default_rng(2)
    xs = {"a": rng.normal(size=900), "b": np.repeat([-1.0, 2.0, 3.0], [300, 10, 99]), "c": np.arange(500.0), "d": 10.0 ** rng.integers(-200, 200, 400), "e": np.array([7.0])}
    cells = spark.createDataFrame([(k, float(x)) for k, v in xs.items() for x in v], "k string, x double").repartition(4)
    got = {r.k: r for r in columns.exact_quantiles(cells, ["k"], "x", [0.0, 0.25, 0.5, 1.0], accuracy=20).collect()}
    for k, v in xs.items():
        assert [got[k].q0, got[k].q1, got[k].q2, got[k].q3] == pytest.approx(list(np.quantile(v, [0.0, 0.25, 0.5, 1.0])))


def test_stock_deviates_only_by_a_given_test(spark):
    pos = spark.createDataFrame([(0, "a", "p", 3)], "_row_idx long, SKU string, Product_Name string, Quantity_Sold int")
    stock = spark.createDataFrame([(0, "a", "p", 11)], "_row_idx long, SKU string, Product_Name string, Stock_Remaining int")
    assert inventory.reconcile_inventory(pos, stock).count() == 0
    assert inventory.reconcile_inventory(pos, stock, lambda left, sold: left > sold).first().anomaly_type == "Stock-Sales Discrepancy"


def test_scans_are_not_repeated(spark, monkeypatch):
    """Numbers are parsed once for all steps, spellings are counted once for all issues."""
    rows = [(i, str(v), f"{v}.5", "Ab" if i % 2 else "ab") for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 1000, -900, 3])]
    df = spark.createDataFrame(rows, "_row_idx long, Revenue string, Cost string, Name string").repartition(3)
    parsed, counted = [], []
    plain_cells, plain_counts = fixes.number_cells, quality.case_counts
    monkeypatch.setattr(fixes, "number_cells", lambda *a, **k: parsed.append(1) or plain_cells(*a, **k))
    monkeypatch.setattr(quality, "case_counts", lambda *a, **k: counted.append(1) or plain_counts(*a, **k))
    assert sorted(r._row_idx for r in fixes.remove_outliers(df).collect()) == [0, 1, 2, 3, 4, 5, 6, 9]
    found = {r.id: r.description for r in quality.issues(df).collect()}
    assert "ab, Ab" in found["consistent_Name"] and not parsed and len(counted) == 1


def test_windows_are_counted_without_texts(spark):
    small, large = spark.createDataFrame([("aaaaaaaaab",)], "small string"), spark.createDataFrame([("xaaaaaaaaaby",)], "large string")
    found = simjoin.contained(small, large)
    assert "count(distinct" not in found._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in found.collect()] == [("aaaaaaaaab", "xaaaaaaaaaby")]
