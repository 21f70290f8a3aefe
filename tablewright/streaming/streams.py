"""Streams: payload log, ingest counts, windowed metrics, alerts with cooldown."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tablewright.operators import monitor


def read_stream(spark: SparkSession, path: str, schema: StructType, time: str = "ts", delay: str = "1 day", files: int | None = None) -> DataFrame:
    """Parquet files as a stream with event time; a time without zone is read in the session zone (UTC)."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def payload_log(payloads: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Append-only log; the same rows as the batch form."""
    return monitor.payload_log(payloads, required)


def ingest_counts(log: DataFrame) -> DataFrame:
    return monitor.ingest_counts(log)


def window_metrics(rows: DataFrame, good: Column, anomaly: Column, revenue: Column, expected: float, **period: str) -> DataFrame:
    """Metrics per closed window; rows later than the watermark are left out."""
    return monitor.window_metrics(rows, good, anomaly, revenue, expected, **period)


ALERT_SCHEMA = "rule_id string, dataset_target string, triggered_at timestamp, alert boolean, cooldown_remaining_mins double"
STATE_SCHEMA = "last bigint"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["triggered_at", "dataset_target"])
    out = []
    for at, dataset, pause in zip(rows["triggered_at"], rows["dataset_target"], rows["cooldown_minutes"]):
        now, wait = at.value // 1000, int(float(pause) * 60_000_000)
        fires = last is None or now - last >= wait
        remaining = None if fires else round((wait - (now - last)) / 60_000_000, 1)
        if fires:
            last = now
        out.append((key[0], dataset, at, fires, remaining))
    state.update((last,))
    yield pd.DataFrame(out, columns=["rule_id", "dataset_target", "triggered_at", "alert", "cooldown_remaining_mins"])


def cooldown(breaches: DataFrame) -> DataFrame:
    """Alerts and skipped breaches, the time of a rule's last alert kept as state.

    Batches must arrive in time order, as closed windows do; a micro-batch holds the breaches of few periods.
    """
    return breaches.groupBy("rule_id").applyInPandasWithState(
        _step, ALERT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what has arrived and append it to a Parquet folder, exactly once."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query
