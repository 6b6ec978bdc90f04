"""Triage and dashboard reads over the alert and dead-letter tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import detection_category
from ..schema import SEVERITIES

DEFAULT_CATEGORIES = ["rule+ml", "rule-only", "ml-only"]  # all but "unknown"
SCORE_BUCKETS = 10


def alert_summary(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Alert count per severity, zero-filled for all four severities."""
    sev = spark.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int")
    counts = table.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    return (
        F.broadcast(sev)
        .join(counts, "severity", "left")
        .select("severity", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    )


def dead_letter_summary(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.groupBy("stage").agg(F.count(F.lit(1)).alias("count"))


def table_totals(alerts: DataFrame, dead_letters: DataFrame) -> DataFrame:
    a = alerts.agg(F.count(F.lit(1)).alias("total_alerts"))
    d = dead_letters.agg(F.count(F.lit(1)).alias("total_dead_letters"))
    return a.crossJoin(d)


def with_category(table: DataFrame) -> DataFrame:
    return table.withColumn("detection", detection_category(F.col("detection_sources")))


def detection_mix(table: DataFrame) -> DataFrame:
    """Value counts of the detection category, descending."""
    return with_category(table).groupBy("detection").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "detection")


def alerts_by_category(table: DataFrame, categories: list[str] | None = None) -> DataFrame:
    cats = categories if categories is not None else DEFAULT_CATEGORIES
    return with_category(table).where(F.col("detection").isin(cats)).withColumn("user_id", F.col("event.user_id"))


def ml_score_distribution(table: DataFrame, buckets: int = SCORE_BUCKETS) -> DataFrame:
    """Alerts with an ML score, counted per score bucket on [0, 1]."""
    scored = table.where(F.col("ml_anomaly_score").isNotNull())
    b = F.least(F.floor(F.col("ml_anomaly_score") * buckets), F.lit(buckets - 1)).cast("long")
    return scored.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def recent(table: DataFrame, ts: str, tie: str, n: int = 100) -> DataFrame:
    """Latest ``n`` rows by ``ts`` truncated to the second (ties by ``tie``): a top-k report."""
    return table.orderBy(F.desc(F.date_trunc("second", F.col(ts))), F.col(tie)).limit(n)


def alert_label() -> Column:
    """``SEV | category | title | user``."""
    return F.concat_ws(
        " | ",
        F.upper("severity"),
        detection_category(F.col("detection_sources")),
        F.col("title"),
        F.col("event.user_id"),
    )


def dead_letter_panel(dead_letters: DataFrame, n: int = 20) -> DataFrame:
    return recent(dead_letters, "failed_at", "dead_letter_id", n).select(
        "failed_at", "stage", "error_type", "event_id", F.coalesce("retryable", F.lit(False)).alias("retryable")
    )


def alert_by_id(table: DataFrame, alert_id: str) -> DataFrame:
    """One alert with its panel texts; missing model fields read ``n/a``."""
    return table.where(F.col("alert_id") == alert_id).select(
        "alert_id",
        alert_label().alias("label"),
        "description",
        F.array_join("reasons", ", ").alias("reasons_text"),
        F.array_join("recommended_actions", ", ").alias("actions_text"),
        detection_category(F.col("detection_sources")).alias("detection"),
        "suppression_count",
        "created_at",
        "last_seen_at",
        F.coalesce(F.col("ml_anomaly_score").cast("string"), F.lit("n/a")).alias("ml_score_text"),
        F.coalesce("model_version", F.lit("n/a")).alias("model_version"),
        F.coalesce(F.nullif(F.array_join("ml_top_contributors", ", "), F.lit("")), F.lit("n/a")).alias("contributors_text"),
        F.coalesce("ml_explanation", F.lit("n/a")).alias("ml_explanation"),
        "feature_context",
        "event",
    )


def dead_letter_by_id(dead_letters: DataFrame, dead_letter_id: str) -> DataFrame:
    """One dead letter with its label ``stage | error type | event id``."""
    label = F.concat_ws(" | ", "stage", "error_type", F.coalesce(F.nullif(F.col("event_id"), F.lit("")), F.lit("no-event-id")))
    return dead_letters.where(F.col("dead_letter_id") == dead_letter_id).select(
        "dead_letter_id", label.alias("label"), "failed_at", "stage", "error_type", F.coalesce("retryable", F.lit(False)).alias("retryable"),
        "error_message", F.coalesce("raw_payload", F.lit("{}")).alias("raw_payload"),
    )
