"""Headline queries, timed; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tablewright import build_session
from tablewright.plans import registry

HEADLINE = (
    "quality_scorecard", "column_profile", "case_variants", "duplicate_rows", "iqr_outliers", "readiness", "corr_matrix",
    "fix_impute", "fix_outliers_sequential", "rule_violations", "mask_analyst", "entity_groups", "conflicts", "merge_outer",
    "probable_duplicates", "reconcile_inventory", "payments_by_reference", "payment_ledger", "name_clusters", "schema_match",
    "schema_drift", "source_detect", "window_metrics", "cooldown_alerts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


main()
