"""End-to-end detection plans: events -> features -> score -> alerts -> folded alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alerts import suppress, with_keys
from ..operators.features import feature_snapshot
from ..operators.rules import alerts as make_alerts
from ..operators.scoring import feature_stats, score_from_raw_frame, score_no_model

FIXTURE_MODEL_VERSION = "fixture-raw-score"


def scored_events(events: DataFrame, raw_col: str | None = "raw_score", model_version: str = FIXTURE_MODEL_VERSION,
                  stats: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Events + 16 features + model fields.

    With ``raw_col`` the model's raw decision value is read from that column
    (the fixture's deterministic stand-in, or ``forest.decision_function``
    output); with ``raw_col=None`` the no-model reply is used.
    """
    feats = features if features is not None else feature_snapshot(events)
    if raw_col is None:
        return score_no_model(feats)
    st = stats if stats is not None else feature_stats(feats, raw_col)
    return score_from_raw_frame(feats, st, raw_col, model_version)


def alert_rows(events: DataFrame, **kw) -> DataFrame:
    return with_keys(make_alerts(scored_events(events, **kw)))


def alert_table(events: DataFrame, **kw) -> DataFrame:
    """The stored alert table. Events count once by id, so idempotency keys are unique here; alerts
    that may be delivered again pass ``drop_known`` first, as in the stream."""
    return suppress(alert_rows(events, **kw))


def alert_flat(table: DataFrame) -> DataFrame:
    """Dashboard's flat alert frame (15 columns) with missing-value defaults."""
    from ..functions.columns import detection_category

    return table.select(
        "alert_id",
        "created_at",
        F.coalesce("last_seen_at", "created_at").alias("last_seen_at"),
        "severity",
        detection_category(F.col("detection_sources")).alias("detection"),
        "title",
        F.col("event.user_id").alias("user_id"),
        F.col("event.geo_country").alias("country"),
        F.col("event.service_name").alias("service"),
        F.col("event.api_action").alias("action"),
        F.col("anomaly_score").alias("score"),
        F.col("ml_anomaly_score").alias("ml_score"),
        F.coalesce("model_version", F.lit("n/a")).alias("model_version"),
        F.coalesce("suppression_count", F.lit(0)).alias("suppressed_repeats"),
        F.coalesce(F.col("feature_context.failed_logins_5m"), F.lit(0)).alias("failed_logins_5m"),
        F.coalesce(F.col("feature_context.distinct_countries_24h"), F.lit(0)).alias("distinct_countries_24h"),
    )
