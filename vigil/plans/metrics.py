"""Operational metrics as aggregates over the job's own tables (long form).

Counters that a long-running process would keep in memory are recomputed from
the data they describe, one aggregate pass per table: ``(metric, dimension, value)``.
The rate of a counter is its value over the span of arrival times. Processing time (latency,
uptime) isn't data; Spark's event log has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import metric_category
from ..sources.store import materialize

SCHEMA = "metric string, dimension string, value double"


def _long(df: DataFrame, items: list[tuple[str, str, Column]]) -> DataFrame:
    """One aggregate pass, stacked into rows."""
    agg = df.agg(*[e.cast("double").alias(f"_m{i}") for i, (_, _, e) in enumerate(items)])
    return agg.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.lit(d).alias("dimension"), F.col(f"_m{i}").alias("value"))
                    for i, (m, d, _) in enumerate(items)
                ]
            )
        ).alias("r")
    ).select("r.*")


def _grouped(df: DataFrame, metric: str, dim: Column) -> DataFrame:
    return df.groupBy(dim.alias("dimension")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit(metric).alias("metric"), "dimension", "value"
    )


def ingest_metrics(lines: DataFrame, dead: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    base = _long(
        lines,
        [
            ("events_consumed", "", n),
            ("events_archived", "", n),
        ],
    )
    failures = [("validation_failures", "validation"), ("alert_delivery_failures", "alert_delivery"), ("stream_processing_failures", "stream_processing")]
    dl = _long(dead, [(name, "", F.count_if(F.col("stage") == stage)) for name, stage in failures])
    return base.unionByName(dl).unionByName(_grouped(dead, "dead_letters_published", F.col("stage")))


def scoring_metrics(scored: DataFrame) -> DataFrame:
    last = F.max_by("anomaly_score", F.struct("ts_sec", "seq"))
    return _long(
        scored,
        [
            ("offline_feature_rows_buffered", "", F.count(F.lit(1))),
            ("score_requests", "", F.count(F.lit(1))),
            ("predicted_anomalies", "", F.sum(F.col("predicted_anomaly").cast("long"))),
            ("model_unavailable", "", F.sum((F.col("model_version") == "unavailable").cast("long"))),
            ("last_anomaly_score", "", last),
        ],
    )


def alert_metrics(alert_rows: DataFrame, table: DataFrame) -> DataFrame:
    emitted = _long(alert_rows, [("alerts_emitted", "", F.count(F.lit(1)))])
    by_sev = _grouped(alert_rows, "alerts_emitted", F.col("severity"))
    by_cat = _grouped(alert_rows, "alerts_emitted", metric_category(F.col("detection_sources")))
    stored = _long(
        table,
        [
            ("alerts_written", "", F.count(F.lit(1))),
            ("suppressed_updates", "", F.sum("suppression_count")),
        ],
    )
    return emitted.unionByName(by_sev).unionByName(by_cat).unionByName(stored)


def last_alert_count(scored: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """Number of alerts of the newest event."""
    newest = scored.agg(F.max_by("seq", F.struct("ts_sec", "seq")).alias("newest"))  # one row
    of_newest = alert_rows.join(F.broadcast(newest), F.col("seq") == F.col("newest"), "left_semi")
    return _long(of_newest, [("last_event_alert_count", "", F.count(F.lit(1)))])


COUNTERS = [
    "events_consumed", "events_archived", "validation_failures", "alert_delivery_failures", "stream_processing_failures",
    "offline_feature_rows_buffered", "score_requests", "predicted_anomalies", "model_unavailable", "alerts_emitted",
]


def rates(metrics: DataFrame, lines: DataFrame) -> DataFrame:
    """Counters per second of the span of arrival times."""
    span = F.max(F.unix_seconds("arrival_ts")) - F.min(F.unix_seconds("arrival_ts"))
    seconds = lines.agg(F.greatest(span, F.lit(1)).alias("seconds"))  # one row
    counters = metrics.where(F.col("metric").isin(COUNTERS) & (F.col("dimension") == ""))
    return counters.crossJoin(F.broadcast(seconds)).select(
        F.concat("metric", F.lit("_per_sec")).alias("metric"), "dimension", F.round(F.col("value") / F.col("seconds"), 3).alias("value")
    )


def ops_metrics(lines: DataFrame, dead: DataFrame, scored: DataFrame, alert_rows: DataFrame, table: DataFrame) -> DataFrame:
    all_rows = (
        ingest_metrics(lines, dead)
        .unionByName(scoring_metrics(scored))
        .unionByName(alert_metrics(alert_rows, table))
        .unionByName(last_alert_count(scored, alert_rows))
    )
    all_rows = materialize(all_rows, "metrics")
    return all_rows.unionByName(rates(all_rows, lines))
