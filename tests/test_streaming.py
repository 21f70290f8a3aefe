"""Streams give what the batch forms give."""

import datetime

from pyspark.sql import functions as F

from tablewright.operators import monitor
from tablewright.streaming import streams


def events(spark, days):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=30 * i), ["a", "b"][i % 2], float(i * 37 % 100)) for i in range(48 * days)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, dataset string, value double")


def metrics(rows, module):
    v = F.col("value")
    return module.window_metrics(rows, v < 50, v > 95, v, 50.0, period="1 day")


def test_windows_and_late_rows(spark, tmp_path):
    table = events(spark, 6)
    for day in range(6):
        part = table.where(F.dayofmonth("ts") == day + 1)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"f{day}"))
    late = table.where(F.dayofmonth("ts") == 1).limit(3).coalesce(1)
    source = lambda: streams.read_stream(spark, str(tmp_path / "in" / "*"), table.schema, files=1)
    streams.run_available(metrics(source(), streams), str(tmp_path / "out"), str(tmp_path / "cp"))
    late.write.parquet(str(tmp_path / "in" / "f9"))
    streams.run_available(metrics(source(), streams), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.dataset, r.period_start): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.dataset, r.period_start): r for r in metrics(table.withColumn("ts", F.col("ts").cast("timestamp")), monitor).collect()}
    assert len(got) >= 8 and all(want[k] == r for k, r in got.items())


def test_log_and_cooldown_streams(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, "sys", start + datetime.timedelta(minutes=25 * i), '{"k": 1}' if i % 3 else "{bad") for i in range(12)]
    table = spark.createDataFrame(rows, "payload_id long, system_id string, ts timestamp, payload string")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), table.schema)
    streams.run_available(streams.payload_log(stream, ["k"]), str(tmp_path / "log"), str(tmp_path / "cp1"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(log.collect()) == sorted(monitor.payload_log(table, ["k"]).collect())
    assert log.where("normalized_status = 'REJECTED'").count() == 4
    assert monitor.ingest_counts(log).first().records_ingested == 12
    breaches = lambda df: df.select(F.lit("r").alias("rule_id"), F.lit("d").alias("dataset_target"), F.col("ts").alias("triggered_at"), F.lit(60).alias("cooldown_minutes"))
    streams.run_available(streams.cooldown(breaches(stream)), str(tmp_path / "alerts"), str(tmp_path / "cp2"))
    key = ["triggered_at", "alert", "cooldown_remaining_mins"]
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "alerts")).select(key).collect()))
    assert got == sorted(map(str, monitor.with_cooldown(breaches(table)).select(key).collect()))
