"""Payload log, windowed metrics, threshold rules, cooldown, alerts. All but the cooldown also run on streams."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_log(payloads: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Log row per payload ``(payload_id, system_id, ts, payload)``.

    A payload that is no JSON object, or lacks a required field, is logged as REJECTED.
    """
    fields = F.from_json("payload", "map<string,string>")
    fine = fields.isNotNull()
    for name in required:
        fine = fine & F.try_element_at(fields, F.lit(name)).isNotNull()
    return payloads.select(
        F.concat(F.lit("wh_"), F.col("payload_id").cast("string")).alias("id"),
        "system_id",
        "ts",
        F.concat(F.lit("Inbound Webhook ("), F.col("system_id"), F.lit(")")).alias("source"),
        F.lit(1).alias("raw_records"),
        F.when(F.coalesce(fine, F.lit(False)), "NORMALIZED").otherwise("REJECTED").alias("normalized_status"),
        F.col("payload").alias("sample"),
    )


def ingest_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("system_id").agg(F.sum("raw_records").alias("records_ingested"), F.max("ts").alias("last_sync"))


def newest(log: DataFrame, rows: int = 10, time: str = "ts", tie: str = "id") -> DataFrame:
    return log.orderBy(F.desc(time), F.desc(tie)).limit(rows)


def window_metrics(
    rows: DataFrame, good: Column, anomaly: Column, revenue: Column, expected: float,
    dataset: str = "dataset", time: str = "ts", period: str = "1 hour", slide: str | None = None,
) -> DataFrame:
    """Per dataset and period: share of good rows, anomalous rows and deviation of the mean revenue."""
    span = F.window(time, period, slide) if slide else F.window(time, period)
    deviation = F.abs(F.avg(revenue) - F.lit(expected)) / F.lit(expected) * 100
    return rows.groupBy(span.alias("w"), F.col(dataset).alias("dataset")).agg(
        F.count("*").alias("num_rows"),
        (F.count_if(good) / F.count("*") * 100).alias("overall_quality_score"),
        F.count_if(anomaly).alias("anomaly_count"),
        deviation.alias("revenue_deviation_pct"),
    ).select("dataset", F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"),
             "num_rows", "overall_quality_score", "anomaly_count", "revenue_deviation_pct")


# Metric names, the column each reads and the value taken where it is absent.
METRICS = {
    "Overall Quality Score": ("overall_quality_score", 100.0),
    "Anomaly Count": ("anomaly_count", 0.0),
    "Revenue Deviation (%)": ("revenue_deviation_pct", 0.0),
}
# Metrics that are texts, likewise.
STATES = {"File Threat / Malware Flag": ("malware_status", "CLEAN")}
# The only metric and operator pairs that fire under strict rules.
STRICT = (("Overall Quality Score", "<"), ("Anomaly Count", ">"), ("Revenue Deviation (%)", ">"))


def rule_breaches(metrics: DataFrame, rules: DataFrame, strict: bool = False, time: str = "period_end") -> DataFrame:
    """Breaches of the active rules, of numbers and of states; ``unknown_rules`` names the rules that can never fire.

    A state is compared as a text, with ``==`` and ``!=``. A metric whose column is absent has its usual value.
    """

    def given(column: str, usual: Column) -> Column:
        return F.coalesce(F.col(column).cast(usual_type[column]), usual) if column in metrics.columns else usual

    usual_type = {c: "double" for c, _ in METRICS.values()} | {c: "string" for c, _ in STATES.values()}
    nothing = F.lit(None)
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), given(c, F.lit(d)).alias("value"), nothing.cast("string").alias("state")) for m, (c, d) in METRICS.items()],
        *[F.struct(F.lit(m).alias("metric"), nothing.cast("double").alias("value"), given(c, F.lit(d)).alias("state")) for m, (c, d) in STATES.items()],
    )
    long = metrics.select(F.col("dataset").alias("dataset_target"), F.col(time).alias("triggered_at"), F.explode(entries).alias("m"))
    long = long.select("dataset_target", "triggered_at", "m.*")
    active = rules.where(F.col("active"))
    if strict:
        pair = F.struct("metric", "operator")
        active = active.where(pair.isin(*[F.struct(F.lit(a).alias("metric"), F.lit(b).alias("operator")) for a, b in STRICT]))
    op, value, limit, state = F.col("operator"), F.col("value"), F.col("threshold").try_cast("double"), F.col("state")
    wanted = F.col("threshold").cast("string")
    broken = F.when(state.isNotNull(), F.when(op == "==", state == wanted).when(op == "!=", state != wanted)).otherwise(
        F.when(op == "<", value < limit).when(op == ">", value > limit).when(op == "==", value == limit).when(op == "!=", value != limit)
    )
    shown, mark = F.coalesce(state, F.format_string("%.1f", F.bround(value, 1))), F.coalesce(limit.cast("string"), wanted)
    count = value.cast("bigint").cast("string")
    quality, anomalies = F.col("metric") == "Overall Quality Score", F.col("metric") == "Anomaly Count"
    told = F.struct("metric", "operator").isin(*[F.struct(F.lit(a).alias("metric"), F.lit(b).alias("operator")) for a, b in STRICT])
    text = (
        F.when(~told, F.concat("metric", F.lit(" is "), shown, F.lit(" (Threshold: "), op, F.lit(" "), mark, F.lit(").")))
        .when(quality, F.concat(F.lit("Data Quality Score dropped to "), shown, F.lit("% (Threshold: < "), mark, F.lit("%).")))
        .when(anomalies, F.concat(F.lit("Detected "), count, F.lit(" anomalous records exceeding threshold (> "), mark, F.lit(").")))
        .otherwise(F.concat(F.lit("Revenue discrepancy variance of "), shown, F.lit("% flagged between POS & Tally.")))
    )
    metric_value = (
        F.when(quality, F.concat(F.lit("Quality Score = "), shown, F.lit("%")))
        .when(anomalies, F.concat(F.lit("Anomalies = "), count, F.lit(" rows")))
        .when(state.isNotNull(), F.concat("metric", F.lit(" = "), state))
        .otherwise(F.concat(F.lit("Revenue Deviation = "), shown, F.lit("%")))
    )
    return long.join(active, "metric").where(broken).select(
        "rule_id", "rule_name", "category", "severity", "channels", "cooldown_minutes", "dataset_target", "triggered_at",
        metric_value.alias("metric_value"), text.alias("message"),
    )


def unknown_rules(rules: DataFrame) -> DataFrame:
    """Active rules that can never fire, and why: an unknown metric, or an operator the metric does not have."""
    metric, op = F.col("metric"), F.col("operator")
    reason = (
        F.when(~metric.isin(*METRICS, *STATES), "unknown metric")
        .when(metric.isin(*STATES) & ~op.isin("==", "!="), "a state has no order")
        .when(metric.isin(*METRICS) & ~op.isin("<", ">", "==", "!="), "unknown operator")
        .when(metric.isin(*METRICS) & F.col("threshold").try_cast("double").isNull(), "threshold is no number")
    )
    return rules.where(F.col("active")).select("rule_id", "metric", reason.alias("reason")).where(F.col("reason").isNotNull())


def _cooldown(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("triggered_at", kind="stable")
    pause = pd.Timedelta(minutes=float(frame["cooldown_minutes"].iloc[0]))
    last, fired = None, []
    for at in frame["triggered_at"]:
        if last is None or at - last >= pause:
            last = at
        fired.append(last)
    return frame[["rule_id", "triggered_at"]].assign(last_trigger=fired)


def with_cooldown(breaches: DataFrame) -> DataFrame:
    """Breaches marked as alert or as skipped, with the minutes that remain.

    The pause belongs to the rule, whatever the dataset. What one task folds are the distinct evaluation
    times of a rule, bounded by the number of schedule periods and not by the data.
    """
    times = breaches.select("rule_id", "triggered_at", "cooldown_minutes").distinct()
    folded = times.groupBy("rule_id").applyInPandas(
        _cooldown, "rule_id string, triggered_at timestamp, last_trigger timestamp"
    )
    # At one instant the first dataset in name order raises the alert, the others find the rule paused.
    lead = breaches.groupBy("rule_id", "triggered_at").agg(F.min("dataset_target").alias("_first"))
    joined = breaches.join(folded, ["rule_id", "triggered_at"]).join(lead, ["rule_id", "triggered_at"])
    fires = (F.col("last_trigger") == F.col("triggered_at")) & (F.col("dataset_target") == F.col("_first"))
    passed = (F.unix_micros("triggered_at") - F.unix_micros("last_trigger")) / 6e7
    return joined.select(
        *breaches.columns,
        fires.alias("alert"),
        F.when(~fires, F.bround(F.col("cooldown_minutes").cast("double") - passed, 1)).alias("cooldown_remaining_mins"),
    )


def alerts(marked: DataFrame) -> DataFrame:
    """New alerts, all OPEN; the id names rule and time, so alerts of one second differ."""
    stamp = F.concat_ws("_", F.lit("alt"), F.unix_seconds("triggered_at").cast("string"), F.col("rule_id"))
    return marked.where("alert").select(
        stamp.alias("alert_id"), "rule_id", "rule_name", "category", "severity", "dataset_target", "triggered_at",
        F.lit("OPEN").alias("status"), "metric_value", "message", "channels",
    )


def latest_status(opened: DataFrame, changes: DataFrame) -> DataFrame:
    """Current status per alert from the openings and a log of changes ``(alert_id, status, user, at)``."""
    last = changes.groupBy("alert_id").agg(F.max_by(F.struct("status", "user", "at"), "at").alias("c"))
    joined = opened.join(last, "alert_id", "left")
    return joined.select(
        "alert_id", "rule_id", F.coalesce("c.status", "status").alias("status"), F.col("c.user").alias("changed_by"), F.col("c.at").alias("changed_at")
    )


def current_rules(log: DataFrame) -> DataFrame:
    """Latest version per rule of a log ``(rule_id, version, deleted, ...)``; deleted rules are left out."""
    row = F.struct(*[c for c in log.columns if c != "rule_id"])
    last = log.groupBy("rule_id").agg(F.max_by(row, "version").alias("r"))
    return last.select("rule_id", "r.*").where(~F.col("deleted")).drop("deleted")


# Channels an alert can go to, in the order they are recognized.
CHANNELS = ("WhatsApp", "Slack", "Email", "Teams", "SMS")
SNIPPET = 120


def fan_out(alert_rows: DataFrame) -> DataFrame:
    """One row per alert and recognized channel, with the start of the message."""
    wanted = F.transform(F.split("channels", r"\|"), lambda c: F.lower(F.trim(c)))

    def known(c: Column) -> Column:
        name = F.lit(None).cast("string")
        for channel in reversed(CHANNELS):
            name = F.when(c.contains(channel.lower()), channel).otherwise(name)
        return name

    body = F.concat(F.lit("Target: "), F.col("dataset_target"), F.lit(" | "), F.col("message"))
    short = F.when(F.length(body) > SNIPPET, F.concat(F.left(body, F.lit(SNIPPET)), F.lit("..."))).otherwise(body)
    sent = F.explode(F.array_distinct(F.array_compact(F.transform(wanted, known))))
    return alert_rows.select("alert_id", "severity", sent.alias("channel"), short.alias("content_snippet"))


def freshness(rows: DataFrame, source: str, time: str, as_of: Column) -> DataFrame:
    """Newest row per source and its age in minutes."""
    last = rows.groupBy(F.col(source).alias("source")).agg(F.max(time).alias("last_seen"))
    return last.withColumn("lag_minutes", F.round((F.unix_micros(as_of) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 6e7, 1))
