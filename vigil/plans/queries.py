"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (through the fixture view) over whole
tables; list-valued columns are rendered with ``array_join(..., ' | ')`` so the
oracle comparison hashes plain text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import delete_like, detection_category, event_seconds, metric_category
from ..operators import rules as R
from ..operators.alerts import FOLD_COLUMNS, drop_known, suppress, with_keys
from ..operators.features import dedup_events, feature_snapshot, single_feature
from ..operators.scoring import PERCENTILES, feature_stats, feature_vector, scenario_breakdown, score_band, score_no_model
from ..schema import FEATURE_COLUMNS
from ..sources.fixtures import security_events
from ..sources.store import discard, materialize, sorted_join
from .detect import alert_flat, scored_events

SEP = " | "


def _joined(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(col, SEP)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return security_events(spark, sf)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(feature_snapshot(_events(spark, sf)), "features")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scored_events(None, features=_features(spark, sf))


def _alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    return with_keys(R.alerts(_scored(spark, sf)))


def _stored_alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts written, so that nothing reads the features any more."""
    features = _features(spark, sf)
    rows = materialize(with_keys(R.alerts(scored_events(None, features=features))).select(*FOLD_COLUMNS), "alert-rows")
    discard(features)
    return rows


def _alert_table(spark: SparkSession, sf: str) -> DataFrame:
    return suppress(_stored_alert_rows(spark, sf))


def _stored_alert_table(spark: SparkSession, sf: str, name: str, form: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
    rows = _stored_alert_rows(spark, sf)
    table = materialize(form(suppress(rows)), name)
    discard(rows)
    return table


# ----------------------------------------------------------------- features
def q_event_seconds(spark, sf):
    return _events(spark, sf).select("event_id", event_seconds(F.col("timestamp")).alias("event_seconds"))


def q_delete_like(spark, sf):
    return _events(spark, sf).select("event_id", "api_action", delete_like(F.col("api_action")).alias("delete_like"))


def _feature_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark, sf):
        return single_feature(_events(spark, sf), name)

    q.__name__ = f"q_{name}"
    return q


def q_feature_snapshot(spark, sf):
    return _features(spark, sf).select("event_id", *FEATURE_COLUMNS)


def q_dedup_events(spark, sf):
    """Every event sent twice (the repeat arrives later): one row per event_id survives."""
    ev = _events(spark, sf)
    offset = F.lit(10**12)
    doubled = ev.unionByName(ev.withColumn("seq", F.col("seq") + offset))
    return dedup_events(doubled).select("event_id", "seq")


def q_feature_vector(spark, sf):
    f = _features(spark, sf)
    return f.select("event_id", *[c for c in feature_vector(f).columns]).select(
        "event_id", *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS]
    )


# ----------------------------------------------------------------- model statistics and scores
def q_feature_stats(spark, sf):
    st = feature_stats(_features(spark, sf))
    cols = []
    for c in FEATURE_COLUMNS:
        cols += [F.col(f"median_{c}"), F.round(f"std_{c}", 6).alias(f"std_{c}")]
    return st.select(*cols)


def q_score_percentiles(spark, sf):
    return feature_stats(_features(spark, sf)).select(*PERCENTILES.keys(), "observed_anomaly_fraction", "training_rows")


def q_score_from_raw(spark, sf):
    return _scored(spark, sf).select("event_id", "raw_score", "anomaly_score", "confidence", "predicted_anomaly")


def q_score_band(spark, sf):
    f = _features(spark, sf)
    st = feature_stats(f)
    from ..functions.columns import score_from_raw

    return (
        f.select("event_id", score_from_raw(F.col("raw_score")).alias("anomaly_score"))
        .crossJoin(F.broadcast(st.select("p90", "p95", "p99")))
        .select("event_id", "anomaly_score", score_band(F.col("anomaly_score")).alias("score_band"))
    )


def q_top_contributors(spark, sf):
    return _scored(spark, sf).select("event_id", _joined("top_contributors").alias("top_contributors"))


def q_explanation(spark, sf):
    return _scored(spark, sf).select("event_id", "explanation")


def q_score_no_model(spark, sf):
    return score_no_model(_events(spark, sf)).select(
        "event_id", "anomaly_score", "confidence", "predicted_anomaly", "model_version", "explanation",
        F.size("top_contributors").alias("n_contributors"),
    )


def q_scenario_breakdown(spark, sf):
    return scenario_breakdown(_scored(spark, sf)).orderBy(F.desc("predicted_anomaly_rate"), "scenario")


# ----------------------------------------------------------------- rules
def _single_rule(rule):
    def q(spark, sf):
        return R.single_rule(_scored(spark, sf), rule).select(
            "event_id", "severity", "title", "anomaly_score", "confidence", _joined("reasons").alias("reasons"),
            _joined("recommended_actions").alias("recommended_actions"),
        )

    return q


def q_ml_threshold(spark, sf):
    return _scored(spark, sf).select(
        "event_id", R.ml_threshold().alias("ml_threshold"), R.effective_ml_score().alias("effective_ml_score")
    )


def q_rule_alerts(spark, sf):
    s = _scored(spark, sf)
    return s.select("event_id", F.explode(R.rule_alerts(s)).alias("a")).select("event_id", "a.title", "a.severity")


def _alert_projection(a: DataFrame) -> DataFrame:
    return a.select(
        "event_id",
        "title",
        "severity",
        "anomaly_score",
        "confidence",
        _joined("detection_sources").alias("detection_sources"),
        _joined("reasons").alias("reasons"),
        "ml_anomaly_score",
        "ml_confidence",
        "model_version",
        _joined("ml_top_contributors").alias("ml_top_contributors"),
        "ml_explanation",
    )


def q_alerts(spark, sf):
    return _alert_projection(R.alerts(_scored(spark, sf)))


def q_ml_alerts(spark, sf):
    return _alert_projection(R.alerts(_scored(spark, sf)).where(F.col("title") == R.ML_TITLE))


def q_hybrid_severity(spark, sf):
    s = _scored(spark, sf)
    base = s.select("event_id", "anomaly_score", "predicted_anomaly", "model_version", F.explode(R.rule_alerts(s)).alias("a"))
    return base.select(
        "event_id",
        F.col("a.title").alias("title"),
        F.col("a.severity").alias("base_severity"),
        R.hybrid_severity(F.col("a.severity")).alias("hybrid_severity"),
    )


def q_alert_reasons(spark, sf):
    return R.alerts(_scored(spark, sf)).select("event_id", "title", _joined("reasons").alias("reasons"))


def q_detection_category(spark, sf):
    return R.alerts(_scored(spark, sf)).select(
        "event_id",
        "title",
        detection_category(F.col("detection_sources")).alias("detection"),
        metric_category(F.col("detection_sources")).alias("metric_category"),
    )


def q_fingerprints(spark, sf):
    return _alert_rows(spark, sf).select("event_id", "title", "idempotency_key", "alert_fingerprint")


def q_alerts_idempotent(spark, sf):
    """Every alert delivered twice; the repeat is dropped by its idempotency key."""
    a = _alert_rows(spark, sf)
    twice = a.unionByName(a.withColumn("seq", F.col("seq") + F.lit(10**12)))
    return drop_known(twice, None).select("idempotency_key", "event_id", "title")


def _table_projection(t: DataFrame) -> DataFrame:
    return t.select(
        "alert_id",
        "alert_fingerprint",
        F.unix_seconds("created_at").alias("created_ts"),
        F.unix_seconds("last_seen_at").alias("last_seen_ts"),
        "severity",
        "title",
        "anomaly_score",
        "confidence",
        _joined("detection_sources").alias("detection_sources"),
        _joined("reasons").alias("reasons"),
        _joined("recommended_actions").alias("recommended_actions"),
        _joined("ml_top_contributors").alias("ml_top_contributors"),
        "ml_anomaly_score",
        "ml_confidence",
        "model_version",
        "ml_explanation",
        "suppression_count",
        F.col("event.event_id").alias("event_id"),
        "idempotency_key",
    )


def q_alerts_suppressed(spark, sf):
    return _table_projection(_alert_table(spark, sf))


# ----------------------------------------------------------------- triage
def q_alert_summary(spark, sf):
    from .triage import alert_summary

    return alert_summary(spark, _alert_table(spark, sf))


def q_detection_mix(spark, sf):
    from .triage import detection_mix

    return detection_mix(_alert_table(spark, sf))


def q_alerts_by_category(spark, sf):
    from .triage import alerts_by_category

    return alerts_by_category(_alert_table(spark, sf)).select(
        "alert_id", "detection", "severity", "title", "user_id", F.unix_seconds("last_seen_at").alias("last_seen_ts")
    )


def q_alert_flat(spark, sf):
    return alert_flat(_alert_table(spark, sf)).withColumn("created_at", F.unix_seconds("created_at")).withColumn(
        "last_seen_at", F.unix_seconds("last_seen_at")
    )


def q_ml_score_distribution(spark, sf):
    from .triage import ml_score_distribution

    return ml_score_distribution(_alert_table(spark, sf))


def q_recent_alerts(spark, sf):
    from .triage import recent

    t = _alert_table(spark, sf)
    return recent(t, "last_seen_at", "alert_id", 100).select(
        "alert_id", F.unix_seconds("last_seen_at").alias("last_seen_ts"), "severity", "title", "suppression_count"
    )


def q_alert_detail(spark, sf):
    from .triage import alert_label

    t = _alert_table(spark, sf)
    return t.select(
        "alert_id",
        alert_label().alias("label"),
        "description",
        F.array_join("reasons", ", ").alias("reasons_text"),
        F.array_join("recommended_actions", ", ").alias("actions_text"),
        F.coalesce(F.nullif(F.array_join("ml_top_contributors", ", "), F.lit("")), F.lit("n/a")).alias("contributors_text"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "event_seconds": q_event_seconds,
    "delete_like": q_delete_like,
    **{name: _feature_query(name) for name in FEATURE_COLUMNS if name not in ("is_privileged_action", "auth_failure")},
    "feature_snapshot": q_feature_snapshot,
    "dedup_events": q_dedup_events,
    "feature_vector": q_feature_vector,
    "feature_stats": q_feature_stats,
    "score_percentiles": q_score_percentiles,
    "score_from_raw": q_score_from_raw,
    "score_band": q_score_band,
    "top_contributors": q_top_contributors,
    "explanation": q_explanation,
    "score_no_model": q_score_no_model,
    "scenario_breakdown": q_scenario_breakdown,
    "rule_failed_login_burst": _single_rule(R.rule_failed_login_burst),
    "rule_privileged_new_country": _single_rule(R.rule_privileged_new_country),
    "rule_deletion_spike": _single_rule(R.rule_deletion_spike),
    "rule_high_volume_transfer": _single_rule(R.rule_high_volume_transfer),
    "ml_threshold": q_ml_threshold,
    "rule_alerts": q_rule_alerts,
    "ml_alerts": q_ml_alerts,
    "hybrid_severity": q_hybrid_severity,
    "alerts": q_alerts,
    "alert_reasons": q_alert_reasons,
    "detection_category": q_detection_category,
    "fingerprints": q_fingerprints,
    "alerts_idempotent": q_alerts_idempotent,
    "alerts_suppressed": q_alerts_suppressed,
    "alert_summary": q_alert_summary,
    "detection_mix": q_detection_mix,
    "alerts_by_category": q_alerts_by_category,
    "alert_flat": q_alert_flat,
    "ml_score_distribution": q_ml_score_distribution,
    "recent_alerts": q_recent_alerts,
    "alert_detail": q_alert_detail,
}



# ----------------------------------------------------------------- ingest
def _lines(spark, sf):
    from ..sources.raw import raw_event_lines

    return raw_event_lines(_events(spark, sf))


def _validated(spark, sf):
    """Validated lines, written once: valid events and dead letters are two filters over it."""
    from ..functions.validate import validate_events

    return materialize(validate_events(_lines(spark, sf)), "validated")


def _dead_letters(spark, sf):
    from ..functions.validate import dead_letters

    return dead_letters(_validated(spark, sf))


PARSE_COLUMNS = [
    "seq", "event_id", "ts_sec", "event_date", "cloud_provider", "account_id", "user_id", "principal_type", "source_ip",
    "geo_country", "region", "service_name", "api_action", "resource_type", "resource_id", "auth_result", "bytes_sent",
    "bytes_received", "device_fingerprint", "user_agent", "is_privileged_action", "scenario",
]


def q_parse_events(spark, sf):
    v = _validated(spark, sf).where("is_object")
    return v.select(*PARSE_COLUMNS, "valid", F.array_join("errors", "; ").alias("errors"))


def q_validate_events(spark, sf):
    return _validated(spark, sf).select("seq", "kind", "is_object", "valid", F.array_join("errors", "; ").alias("errors"))


def _dl_projection(d):
    return d.select(
        "dead_letter_id", F.unix_seconds("failed_at").alias("failed_ts"), "source_topic", "stage", "error_type",
        "error_message", "raw_payload", "event_id", "retryable",
    )


def q_dead_letters(spark, sf):
    return _dl_projection(_dead_letters(spark, sf))


def q_dead_letter_summary(spark, sf):
    from .triage import dead_letter_summary

    return dead_letter_summary(_dead_letters(spark, sf))


def q_recent_dead_letters(spark, sf):
    from .triage import dead_letter_panel

    return dead_letter_panel(_dead_letters(spark, sf), 20).withColumn("failed_at", F.unix_seconds("failed_at")).withColumnRenamed(
        "failed_at", "failed_ts"
    )


def q_raw_archive(spark, sf):
    from ..sources.raw import raw_archive

    return raw_archive(_lines(spark, sf))


def q_replay_slice(spark, sf):
    from ..sources.raw import replay_slice

    lines = _lines(spark, sf).withColumn("line_no", F.col("seq") + 1)
    return replay_slice(lines, start_line=1001, limit=5000).select("line_no", "value")


QUERIES.update(
    {
        "parse_events": q_parse_events,
        "validate_events": q_validate_events,
        "dead_letters": q_dead_letters,
        "dead_letter_summary": q_dead_letter_summary,
        "recent_dead_letters": q_recent_dead_letters,
        "raw_archive": q_raw_archive,
        "replay_slice": q_replay_slice,
    }
)


# ----------------------------------------------------------------- stored tables
FEATURE_ROW_OUT = [
    "event_id", "timestamp", "event_date", "cloud_provider", "account_id", "user_id", "source_ip", "geo_country",
    "region", "service_name", "api_action", "principal_type", "scenario", *FEATURE_COLUMNS,
]


def _offline_table(spark, sf):
    from ..session import scratch_path
    from ..sources.tables import feature_rows, read_feature_rows, write_feature_rows
    import uuid

    path = scratch_path(spark, f"vigil/offline-features-{uuid.uuid4().hex[:16]}")
    write_feature_rows(feature_rows(_features(spark, sf)), path, mode="overwrite")
    return read_feature_rows(spark, path)


def q_offline_feature_rows(spark, sf):
    return _offline_table(spark, sf).select(*FEATURE_ROW_OUT)


def q_recent_features(spark, sf):
    from ..sources.tables import recent_feature_rows

    return recent_feature_rows(_offline_table(spark, sf), 1000).select("event_id", "timestamp", "seq")


def q_alerts_decode(spark, sf):
    from ..sources.tables import decode_alerts, export_alerts

    t = decode_alerts(export_alerts(_alert_table(spark, sf)))
    return t.select(
        "alert_id",
        _joined("reasons").alias("reasons"),
        _joined("recommended_actions").alias("recommended_actions"),
        _joined("detection_sources").alias("detection_sources"),
        _joined("ml_top_contributors").alias("ml_top_contributors"),
        "suppression_count",
        F.col("feature_context")["failed_logins_5m"].alias("failed_logins_5m"),
        F.col("event")["event_id"].alias("event_id"),
    )


def q_dlq_decode(spark, sf):
    from ..sources.tables import decode_dead_letters, export_dead_letters

    d = decode_dead_letters(export_dead_letters(_dead_letters(spark, sf)))
    return d.select("dead_letter_id", "retryable", "event_id", "raw_payload", "stage")


def q_alerts_evolve(spark, sf):
    from ..sources.tables import evolve_alerts, export_alerts

    first_version = export_alerts(_alert_table(spark, sf)).select(
        "alert_id", "created_at", "severity", "title", "description", "anomaly_score", "confidence",
        "reasons_json", "recommended_actions_json", "event_json",
    )
    e = evolve_alerts(first_version)
    return e.select(
        "alert_id",
        F.unix_seconds("last_seen_at").alias("last_seen_ts"),
        "feature_context_json",
        "detection_sources_json",
        "ml_top_contributors_json",
        "alert_fingerprint",
        "idempotency_key",
        F.col("suppression_count").cast("long").alias("suppression_count"),
        F.col("model_version").isNull().alias("model_version_missing"),
    )


def q_table_totals(spark, sf):
    from .triage import table_totals

    return table_totals(_alert_table(spark, sf), _dead_letters(spark, sf))


def q_ops_metrics(spark, sf):
    from .metrics import ops_metrics

    scored = materialize(_scored(spark, sf), "scored")
    rows = materialize(with_keys(R.alerts(scored)), "alert-rows")
    return ops_metrics(_lines(spark, sf), _dead_letters(spark, sf), scored, rows, suppress(rows))


QUERIES.update(
    {
        "offline_feature_rows": q_offline_feature_rows,
        "recent_features": q_recent_features,
        "alerts_decode": q_alerts_decode,
        "dlq_decode": q_dlq_decode,
        "alerts_evolve": q_alerts_evolve,
        "table_totals": q_table_totals,
        "ops_metrics": q_ops_metrics,
    }
)


# ----------------------------------------------------------------- model training and scoring (rows-only checks)
TRAIN_VERSION = "iforest-fixture"


def _trained(spark, sf):
    from .train import train

    feats = _features(spark, sf).drop("raw_score")
    return feats, train(feats, model_version=TRAIN_VERSION, trained_at="fixture")


def _tree_checks(nodes: DataFrame) -> DataFrame:
    """Per tree what holds for any draw: all sampled rows reach leaves, inner nodes have two children, depth is bounded."""
    leaf = F.col("feature") == -1
    return nodes.groupBy("tree_id").agg(
        F.max(F.when(F.col("node_id") == 0, F.col("size"))).alias("root_size"),
        F.sum(F.when(leaf, F.col("size"))).alias("leaf_rows"),
        (F.sum((~leaf).cast("int")) == F.sum(leaf.cast("int")) - 1).alias("binary"),
        (F.max("depth") <= 8).alias("shallow"),
    )


def q_iforest_trees(spark, sf):
    from ..operators.forest import nodes_frame

    _, (forest, _, _) = _trained(spark, sf)
    return _tree_checks(nodes_frame(spark, forest))


def _score_checks(scored: DataFrame, stats: DataFrame) -> DataFrame:
    """All scored events, each held against its own raw value and the training percentiles, and the training share of anomalies."""
    raw, score = F.col("raw_score"), F.col("anomaly_score")
    expected = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(3.5) * raw)), 4)
    band = (
        F.when(expected < F.col("_p90"), F.lit("within the lower 90% of training anomaly scores"))
        .when(expected < F.col("_p95"), F.lit("above the training p90 anomaly score"))
        .when(expected < F.col("_p99"), F.lit("above the training p95 anomaly score"))
        .otherwise(F.lit("above the training p99 anomaly score"))
    )
    # rows on the offset are no anomalies: only ties there may leave the share below the contamination
    anomalies = F.col("observed_anomaly_fraction") * F.col("training_rows")
    wanted = F.lit(0.08) * F.col("training_rows")
    on_offset = scored.agg(F.sum((F.abs(raw) <= 1e-12).cast("long")).alias("_on_offset"))
    share = stats.crossJoin(on_offset).select(  # one row each
        *[F.col(p).alias(f"_{p}") for p in ("p90", "p95", "p99")],
        ((anomalies - wanted <= 1.0) & (anomalies + F.col("_on_offset") - wanted >= -1.0)).alias("share_ok"),
    )
    return scored.crossJoin(F.broadcast(share)).select(  # one row
        "event_id",
        (F.abs(score - F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(3.5) * raw))) <= 0.00005001).alias("score_ok"),
        (F.abs(F.col("confidence") - F.abs(raw) / (F.abs(raw) + 0.5)) <= 0.00005001).alias("confidence_ok"),
        (F.col("predicted_anomaly") == (raw < 0)).alias("predicted_ok"),
        F.contains("explanation", F.format_string("score %.4f (%s).", score, band)).alias("explained"),
        F.size("top_contributors").alias("n_contributors"),
        "share_ok",
    )


def q_score_events(spark, sf):
    from .train import score_with_model

    feats, (forest, stats, _) = _trained(spark, sf)
    return _score_checks(materialize(score_with_model(feats, forest, stats, TRAIN_VERSION), "model-scored"), materialize(stats, "model-stats"))


def _metadata_checks(meta: DataFrame, rows: DataFrame) -> DataFrame:
    """The metadata, a row per scenario; the count is null where the anomalies or rate of the scenario, the anomaly
    fraction or a percentile isn't what the scored training rows (scenario, raw_score) give."""
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(3.5) * F.col("raw_score")))
    # a percentile lies between the rows around rank q (n - 1)
    cuts = meta.select(*[F.col("anomaly_score_percentiles")[p].alias(f"_{p}") for p in PERCENTILES])
    held = [F.lit(len(PERCENTILES)) == F.size("anomaly_score_percentiles")]
    counts = [F.count("*").alias("_n"), F.sum((F.col("raw_score") < 0).cast("long")).alias("_anomalies")]
    for p, q in PERCENTILES.items():
        rank = F.lit(q) * (F.col("_n") - 1)
        counts.append(F.sum((score < F.col(f"_{p}") - 1e-12).cast("long")).alias(f"_below_{p}"))
        counts.append(F.sum((score <= F.col(f"_{p}") + 1e-12).cast("long")).alias(f"_upto_{p}"))
        held += [F.col(f"_below_{p}") <= F.ceil(rank - 1e-6), F.col(f"_upto_{p}") >= F.floor(rank + 1e-6) + 1]
    whole = rows.crossJoin(F.broadcast(cuts)).agg(*counts)  # one row
    by = rows.groupBy(F.coalesce("scenario", F.lit("unknown")).alias("_scenario")).agg(
        F.count("*").alias("_count"), F.sum((F.col("raw_score") < 0).cast("long")).alias("_predicted")
    )
    given = meta.select("*", F.explode("scenario_breakdown").alias("scenario", "v")).crossJoin(F.broadcast(whole))
    held += [
        F.abs(F.col("observed_anomaly_fraction") * F.col("_n") - F.col("_anomalies")) < 1e-3,
        F.col("v.predicted_anomalies") == F.col("_predicted"),
        F.abs(F.col("v.predicted_anomaly_rate") - F.col("_predicted") / F.col("_count")) <= 0.00005001,
    ]
    ok = held[0]
    for h in held[1:]:
        ok = ok & h
    return given.join(by, F.col("scenario") == F.col("_scenario"), "left").select(
        "model_type", "model_version", "training_rows", "contamination", "training_source",
        F.size("feature_columns").alias("n_columns"), "scenario", F.when(ok, F.col("v.count")).alias("count"),
    )


def q_model_metadata(spark, sf):
    from ..operators.forest import decision_function

    feats, (forest, _, meta) = _trained(spark, sf)
    rows = materialize(decision_function(feats, forest).select("scenario", "raw_score"), "model-raw")
    return _metadata_checks(materialize(meta, "metadata"), rows)


def q_model_metadata_defaults(spark, sf):
    """An artifact of the trained model that lacks its version, columns and breakdown, as a reader sees it."""
    from .train import read_metadata

    _, (_, _, meta) = _trained(spark, sf)
    m = read_metadata(spark, meta.drop("model_version", "feature_columns", "scenario_breakdown").withColumn("contamination", F.lit(None).cast("double")))
    return m.select(
        "model_type", "model_version", "training_rows", "contamination", "artifact_present",
        F.size("feature_columns").alias("n_columns"), F.size("scenario_breakdown").alias("n_scenarios"),
    )


def q_scenario_table(spark, sf):
    """The breakdown read back from stored metadata."""
    from .train import model_metadata, scenario_table

    scored = materialize(_scored(spark, sf), "scored")
    meta = model_metadata(feature_stats(scored), scenario_breakdown(scored), 0.08, "fixture-raw-score", "fixture", "offline_features")
    return scenario_table(materialize(meta, "metadata"))


QUERIES.update(
    {
        "iforest_trees": q_iforest_trees,
        "score_events": q_score_events,
        "model_metadata": q_model_metadata,
        "model_metadata_defaults": q_model_metadata_defaults,
        "scenario_table": q_scenario_table,
    }
)


# ----------------------------------------------------------------- streaming and artifacts
def _scratch(spark, name):
    import uuid

    from ..session import scratch_path

    return scratch_path(spark, f"vigil/{name}-{uuid.uuid4().hex[:16]}")


def _streamed(spark, lines, halves, name, **more):
    """The messages of either half as one micro-batch, however many files they lie in: a half is written when the
    batch before it has ended, and the query takes all that is there. Returns the stream's settings and its two queries."""
    from ..streaming.stream import StreamConfig, start

    lines = lines.select("seq", "arrival_ts", "value")
    src, base = _scratch(spark, f"{name}-src"), _scratch(spark, f"{name}-tables")
    cfg = StreamConfig(base=base, **more)
    queries = []
    for k, half in enumerate(halves):
        lines.where(half).write.parquet(f"{src}/part{k}")
        stream = spark.readStream.schema(lines.schema).parquet(f"{src}/*")
        query = start(spark, stream, cfg, f"{base}/_checkpoint", {"availableNow": True})
        query.awaitTermination()
        queries.append(query)
    return cfg, queries


def q_stream_alerts(spark, sf):
    """The raw messages replayed as two micro-batches through the detection stream (rules only)."""
    from ..streaming.stream import current_alerts

    lines = _lines(spark, sf)
    mid = lines.agg(F.percentile_approx("seq", 0.5)).first()[0]
    cfg, _ = _streamed(spark, lines, [F.col("seq") <= mid, F.col("seq") > mid], "stream")
    return _table_projection(current_alerts(spark, cfg))


def q_src_events_json(spark, sf):
    """JSON-lines folder read as a stream (availableNow), validated, written to a Parquet sink."""
    from ..functions.validate import validate_events
    from ..sources.raw import read_message_source

    src = _scratch(spark, "json-src")
    _lines(spark, sf).select("value").write.text(src)
    msgs = read_message_source(spark, "text", src, {"maxFilesPerTrigger": "1"}, stream=True)
    out = _scratch(spark, "json-sink")
    q = (
        validate_events(msgs)
        .drop("errors")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", out + "_ckpt")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "valid", "user_id", "ts_sec")


def _saved(spark, sf):
    from .train import load_model, save_model, train

    feats = _features(spark, sf).drop("raw_score")
    forest, stats, meta = train(feats, snapshot_path=_scratch(spark, "train-snapshot"), model_version=TRAIN_VERSION, trained_at="fixture")
    path = _scratch(spark, "model")
    save_model(spark, forest, meta, path)
    assert load_model(spark, path + "-absent") is None
    return feats, forest, stats, load_model(spark, path)


def q_model_artifact(spark, sf):
    """Training snapshot (CSV with header), model saved as Parquet + JSON, loaded back."""
    from ..operators.forest import nodes_frame

    *_, loaded = _saved(spark, sf)
    return _tree_checks(nodes_frame(spark, loaded.forest))


def q_score_loaded_model(spark, sf):
    """Scoring with the loaded artifact alone equals scoring with what training returned."""
    from .train import score_loaded, score_with_model

    feats, forest, stats, loaded = _saved(spark, sf)
    fields = ["anomaly_score", "confidence", "predicted_anomaly", "model_version", "top_contributors", "explanation"]
    before = score_with_model(feats, forest, stats, TRAIN_VERSION).select("event_id", F.struct(*fields).alias("a"))
    after = score_loaded(feats, loaded).select("event_id", F.struct(*fields).alias("b"))
    return before.join(sorted_join(after), "event_id").select("event_id", F.col("a").eqNullSafe(F.col("b")).alias("equal"))


def q_stream_late_alerts(spark, sf):
    """Alerts of odd events are stored first, those of even events come late and join or merge the stored sessions."""
    from ..streaming.stream import StreamConfig, current_alerts, store_alerts

    rows = _stored_alert_rows(spark, sf)
    cfg = StreamConfig(base=_scratch(spark, "late-tables"))
    for batch, odd in enumerate((1, 0)):
        store_alerts(spark, cfg, rows.where(F.col("seq") % 2 == odd), batch)
    return current_alerts(spark, cfg).select(
        "alert_id", "alert_fingerprint", F.unix_seconds("created_at").alias("created_ts"), F.unix_seconds("last_seen_at").alias("last_seen_ts"),
        "severity", "title", "suppression_count", F.col("event.event_id").alias("event_id"),
    )


def q_alerts_redelivered(spark, sf):
    """Every alert delivered twice: the repeats neither open sessions nor count as suppressed."""
    a = _stored_alert_rows(spark, sf)
    once = materialize(drop_known(a.unionByName(a.withColumn("seq", F.col("seq") + F.lit(10**12))), None), "alert-rows")
    discard(a)
    return _table_projection(suppress(once))


def q_replay_archive(spark, sf):
    """The archive is written as text and replayed from its physical line 1001 on."""
    from ..sources.raw import replay_archive, write_archive

    path = _scratch(spark, "archive")
    write_archive(_lines(spark, sf), path)
    return replay_archive(spark, path, start_line=1001, limit=5000)


def q_alert_by_id(spark, sf):
    from .triage import alert_by_id

    table = _stored_alert_table(spark, sf, "alert-table")
    found = alert_by_id(table, table.agg(F.min("alert_id")).first()[0])
    return found.select("alert_id", "label", "reasons_text", "detection", "suppression_count", "model_version", "contributors_text", "ml_explanation")


def q_dead_letter_by_id(spark, sf):
    from .triage import dead_letter_by_id

    letters = materialize(_dead_letters(spark, sf), "dead-letters")
    return dead_letter_by_id(letters, letters.agg(F.min("dead_letter_id")).first()[0]).drop("failed_at")


QUERIES.update(
    {
        "score_loaded_model": q_score_loaded_model,
        "stream_late_alerts": q_stream_late_alerts,
        "alerts_redelivered": q_alerts_redelivered,
        "replay_archive": q_replay_archive,
        "alert_by_id": q_alert_by_id,
        "dead_letter_by_id": q_dead_letter_by_id,
    }
)
QUERIES.update({"stream_alerts": q_stream_alerts, "src_events_json": q_src_events_json, "model_artifact": q_model_artifact})


def q_training_snapshot(spark, sf):
    """The training snapshot written as CSV and read back with its types."""
    from .train import read_snapshot, write_snapshot

    path = _scratch(spark, "train-snapshot")
    write_snapshot(_features(spark, sf), path)
    return read_snapshot(spark, path).select("event_id", *FEATURE_COLUMNS)


def q_alerts_stored_versions(spark, sf):
    """Alerts stored by three versions of the table, dealt out by the first digit of their id, read as one."""
    from ..sources.tables import export_alerts, read_alert_versions, write_alert_version

    export = _stored_alert_table(spark, sf, "alert-export", export_alerts)
    first = ["alert_id", "created_at", "severity", "title", "description", "anomaly_score", "confidence", "reasons_json", "recommended_actions_json", "event_json"]
    second = [*first, "last_seen_at", "model_version", "detection_sources_json", "suppression_count"]
    digit = F.substring("alert_id", 1, 1)
    folder = _scratch(spark, "alert-versions")
    write_alert_version(export.where(digit < "5").select(*first), folder, 1)
    write_alert_version(export.where(digit.between("5", "9")).select(*second).withColumn("suppression_count", F.col("suppression_count").cast("int")), folder, 2)
    write_alert_version(export.where(digit > "9"), folder, 3)
    return read_alert_versions(spark, folder).select(
        "version",
        "alert_id",
        "severity",
        F.unix_seconds("last_seen_at").alias("last_seen_ts"),
        "detection_sources_json",
        "model_version",
        "alert_fingerprint",
        "suppression_count",
    )


def _by_turns():
    """The messages of even, then of odd positions."""
    return [F.col("seq") % 2 == odd for odd in (0, 1)]


def q_stream_late_events(spark, sf):
    """Events more than an hour behind the batch before: dead letters of stage late, beside the others."""
    cfg, _ = _streamed(spark, _lines(spark, sf), _by_turns(), "late-events", lateness_seconds=3600)
    return spark.read.parquet(cfg.path("dead_letters")).select("seq", "stage", "error_type", "retryable")


def q_stream_latency(spark, sf):
    """Per stage of the stream's batches: batches and rows seen, and whether the times are in order."""
    from ..streaming.latency import latency, progress

    cfg, queries = _streamed(spark, _lines(spark, sf), _by_turns(), "latency")
    times = latency(spark.read.parquet(cfg.path("timings")))
    sane = (F.col("avg_ms") > 0) & (F.col("avg_ms") <= F.col("max_ms")) & (F.col("max_ms") <= F.col("total_ms"))
    whole = sum(progress(spark, q).where("phase = 'addBatch' and input_rows > 0").agg(F.sum("millis").alias("m")).first()["m"] or 0.0 for q in queries)
    return times.select("stage", "batches", "rows", "failed", (sane & (F.col("total_ms") <= F.lit(whole))).alias("sane"))


QUERIES.update(
    {
        "training_snapshot": q_training_snapshot,
        "alerts_stored_versions": q_alerts_stored_versions,
        "stream_late_events": q_stream_late_events,
        "stream_latency": q_stream_latency,
    }
)
