"""Model training and serving plans: fit the forest on stored feature rows,
compute the training statistics and metadata, score events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import Forest, decision_function, fit_and_score, load_forest, save_forest
from ..operators.scoring import PERCENTILES, feature_stats, scenario_breakdown, score_from_raw_frame, score_no_model
from ..schema import FEATURE_COLUMNS
from ..sources.tables import recent_feature_rows


def train(
    rows: DataFrame,
    *,
    trees: int = 200,
    contamination: float = 0.08,
    seed: int = 42,
    limit: int | None = None,
    snapshot_path: str | None = None,
    model_version: str = "iforest",
    trained_at: str | None = None,
    training_source: str = "offline_features",
) -> tuple[Forest, DataFrame, DataFrame]:
    """Fit on the (most recent ``limit``) feature rows; returns (forest, stats, metadata).

    ``model_version`` and ``trained_at`` are passed in (not read from the clock) so a rerun
    gives the same artifact.
    """
    train_df = recent_feature_rows(rows, limit)
    if snapshot_path:
        write_snapshot(train_df, snapshot_path)
    forest, scored = fit_and_score(train_df, trees=trees, contamination=contamination, seed=seed)
    stats = feature_stats(scored, "raw_score")
    breakdown = scenario_breakdown(scored.withColumn("predicted_anomaly", F.col("raw_score") < 0))
    metadata = model_metadata(stats, breakdown, forest.contamination, model_version, trained_at, training_source)
    return forest, stats, metadata


SNAPSHOT_TYPES = {"ip_failed_auth_rate_5m": "double", "account_service_entropy_1h": "double"} | dict.fromkeys(
    ("is_privileged_action", "auth_failure", "is_new_country_for_user", "is_new_ip_for_user"), "boolean"
)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """The rows a model is trained on, as CSV with a header: id, scenario and the 16 features."""
    rows.select("event_id", "scenario", *FEATURE_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A training snapshot with the features' types; a file with other columns is an error."""
    schema = ", ".join(["event_id string", "scenario string", *(f"{c} {SNAPSHOT_TYPES.get(c, 'bigint')}" for c in FEATURE_COLUMNS)])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def model_metadata(stats: DataFrame, breakdown: DataFrame, contamination: float, model_version: str, trained_at: str | None,
                   training_source: str) -> DataFrame:
    """One row: type, version, columns, rows, contamination, fraction, breakdown and statistic maps."""
    per_scenario = breakdown.agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "scenario",
                    F.struct(
                        F.col("count").cast("double").alias("count"),
                        F.col("predicted_anomalies").cast("double").alias("predicted_anomalies"),
                        F.col("predicted_anomaly_rate").alias("predicted_anomaly_rate"),
                    ),
                )
            )
        ).alias("scenario_breakdown")
    )
    m = stats.crossJoin(per_scenario)
    return m.select(
        F.lit("IsolationForest").alias("model_type"),
        F.lit(model_version).alias("model_version"),
        F.array(*[F.lit(c) for c in FEATURE_COLUMNS]).alias("feature_columns"),
        F.col("training_rows").cast("long").alias("training_rows"),
        F.lit(float(contamination)).alias("contamination"),
        F.lit(training_source).alias("training_source"),
        F.col("observed_anomaly_fraction"),
        F.lit(trained_at).cast("string").alias("trained_at"),
        F.col("scenario_breakdown"),
        F.create_map(*[x for k in PERCENTILES for x in (F.lit(k), F.col(k))]).alias("anomaly_score_percentiles"),
        F.create_map(*[x for c in FEATURE_COLUMNS for x in (F.lit(c), F.col(f"median_{c}"))]).alias("medians"),
        F.create_map(*[x for c in FEATURE_COLUMNS for x in (F.lit(c), F.col(f"std_{c}"))]).alias("stds"),
    )


# What a reader sees where the metadata (or a field of it) is missing.
METADATA_DEFAULTS = {
    "model_type": ("string", "'IsolationForest'"),
    "model_version": ("string", "'unavailable'"),
    "feature_columns": ("array<string>", "array()"),
    "training_rows": ("bigint", "0"),
    "contamination": ("double", "0.0"),
    "trained_at": ("string", "null"),
    "observed_anomaly_fraction": ("double", "0.0"),
    "scenario_breakdown": (
        "map<string,struct<count:double,predicted_anomalies:double,predicted_anomaly_rate:double>>",
        "map()",
    ),
    "anomaly_score_percentiles": ("map<string,double>", "map()"),
}


def read_metadata(spark: SparkSession, meta: DataFrame | None) -> DataFrame:
    """Metadata for a reader, with defaults where fields (or the whole artifact) are missing."""
    present = meta is not None
    meta = meta if present else spark.range(1)
    fields = []
    for name, (kind, default) in METADATA_DEFAULTS.items():
        given = F.col(name).cast(kind) if name in meta.columns else F.lit(None).cast(kind)
        fields.append(F.coalesce(given, F.expr(f"cast({default} as {kind})")).alias(name))
    return meta.select(*fields, F.lit(present).alias("artifact_present"))


def stats_from_metadata(meta: DataFrame) -> DataFrame:
    """The one-row statistics that scoring needs, from the maps of stored metadata (missing: median 0, std 1, percentile 1)."""

    def entry(column: str, key: str, default: float) -> Column:
        return F.coalesce(F.col(column)[key], F.lit(default)) if column in meta.columns else F.lit(default)

    cols = []
    for c in FEATURE_COLUMNS:
        std = entry("stds", c, 1.0)
        cols += [entry("medians", c, 0.0).alias(f"median_{c}"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"std_{c}")]
    return meta.select(*cols, *[entry("anomaly_score_percentiles", k, 1.0).alias(k) for k in PERCENTILES])


@dataclass
class Model:
    forest: Forest
    metadata: DataFrame

    @property
    def version(self) -> str:
        return read_metadata(self.metadata.sparkSession, self.metadata).first()["model_version"]


def save_model(spark: SparkSession, forest: Forest, metadata: DataFrame, path: str) -> None:
    save_forest(spark, forest, path)
    metadata.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> Model | None:
    """Forest and metadata as saved; None (no model) when either is absent."""
    forest = load_forest(spark, path)
    if forest is None:
        return None
    try:
        return Model(forest, spark.read.parquet(f"{path}/metadata"))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def score_loaded(features: DataFrame, model: Model | None) -> DataFrame:
    """Score with a loaded model alone: its trees, and the statistics stored with them."""
    if model is None:
        return score_no_model(features)
    return score_with_model(features, model.forest, stats_from_metadata(model.metadata), model.version)


def scenario_table(metadata: DataFrame) -> DataFrame:
    """The scenario breakdown of stored metadata as rows, highest predicted rate first."""
    rows = metadata.select(F.explode("scenario_breakdown").alias("scenario", "v"))
    out = rows.select("scenario", *[F.coalesce(F.col(f"v.{c}"), F.lit(0.0)).alias(c) for c in ("count", "predicted_anomalies", "predicted_anomaly_rate")])
    return out.orderBy(F.desc("predicted_anomaly_rate"), "scenario")


def score_with_model(features: DataFrame, forest: Forest | None, stats: DataFrame | None, model_version: str) -> DataFrame:
    """Model fields for every feature row; the no-model reply when ``forest`` is None."""
    if forest is None or stats is None:
        return score_no_model(features)
    return score_from_raw_frame(decision_function(features, forest), stats, "raw_score", model_version)
