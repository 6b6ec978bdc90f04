"""Stored tables: offline feature rows, alert and dead-letter exports, schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import iso_text, json_string_array
from ..operators.topn import first_rows
from ..schema import FEATURE_COLUMNS

PARTITION_COLUMNS = ["event_date", "cloud_provider"]


def feature_rows(features: DataFrame) -> DataFrame:
    """Flat offline feature rows: 13 event columns (time as text, date in the event's own offset,
    scenario) + the 16 features (+ ``seq`` for recency order)."""
    has_text = "timestamp_text" in features.columns
    ts_text = F.col("timestamp_text") if has_text else iso_text(F.col("timestamp"))
    scen = F.coalesce(F.col("scenario"), F.lit("unknown")) if "scenario" in features.columns else F.coalesce(
        F.col("metadata")["scenario"], F.lit("unknown")
    )
    return features.select(
        "event_id",
        ts_text.alias("timestamp"),
        F.substring(ts_text, 1, 10).alias("event_date"),
        "cloud_provider",
        "account_id",
        "user_id",
        "source_ip",
        "geo_country",
        "region",
        "service_name",
        "api_action",
        "principal_type",
        scen.alias("scenario"),
        *FEATURE_COLUMNS,
        "seq",
        F.col("ts_sec"),
    )


def write_feature_rows(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the offline table partitioned by event_date and cloud_provider.

    Rows are rebalanced by the partition columns first: each task writes few files, and a large
    day of one provider is split over tasks.
    """
    (
        rows.hint("rebalance", *PARTITION_COLUMNS)
        .write.mode(mode)
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(path)
    )


def read_feature_rows(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("basePath", path).parquet(path)
    return df.withColumn("event_date", F.col("event_date").cast("string"))


def recent_feature_rows(rows: DataFrame, n: int | None = None) -> DataFrame:
    """The ``n`` most recent rows by event time then arrival (all rows when ``n`` is None), in no order."""
    return rows if n is None else first_rows(rows, n, [-F.col("ts_sec"), -F.col("seq")])


# ---------------------------------------------------------------- alert / dead-letter exports
ALERT_JSON_COLUMNS = {
    "reasons": "reasons_json",
    "recommended_actions": "recommended_actions_json",
    "detection_sources": "detection_sources_json",
    "ml_top_contributors": "ml_top_contributors_json",
}


def export_alerts(table: DataFrame) -> DataFrame:
    """Alert table with list, map and event columns as JSON text (a row-store export)."""
    cols = [c for c in table.columns if c not in ALERT_JSON_COLUMNS and c not in ("feature_context", "event")]
    return table.select(
        *cols,
        *[json_string_array(F.col(c)).alias(j) for c, j in ALERT_JSON_COLUMNS.items()],
        F.to_json("feature_context").alias("feature_context_json"),
        F.to_json("event").alias("event_json"),
    )


def decode_alerts(export: DataFrame, event_schema: str | None = None, feature_schema: str | None = None) -> DataFrame:
    """JSON text columns back to nested values; missing text becomes {} / []."""
    out = export
    for c, j in ALERT_JSON_COLUMNS.items():
        out = out.withColumn(c, F.coalesce(F.from_json(F.col(j), "array<string>"), F.array().cast("array<string>")))
    fs = feature_schema or "map<string,string>"
    out = out.withColumn("feature_context", F.coalesce(F.from_json(F.nullif(F.col("feature_context_json"), F.lit("")), fs), F.from_json(F.lit("{}"), fs)))
    out = out.withColumn("event", F.from_json(F.col("event_json"), event_schema or "map<string,string>"))
    out = out.withColumn("suppression_count", F.coalesce(F.col("suppression_count"), F.lit(0)))
    return out.drop(*ALERT_JSON_COLUMNS.values(), "feature_context_json", "event_json")


def export_dead_letters(dl: DataFrame) -> DataFrame:
    return dl.select(
        *[c for c in dl.columns if c not in ("raw_payload", "retryable")],
        F.col("raw_payload").alias("raw_payload_json"),
        F.col("retryable").cast("int").alias("retryable"),
    )


def decode_dead_letters(export: DataFrame) -> DataFrame:
    return export.select(
        *[c for c in export.columns if c not in ("raw_payload_json", "retryable")],
        F.coalesce(F.nullif(F.col("raw_payload_json"), F.lit("")), F.lit("{}")).alias("raw_payload"),
        F.coalesce(F.col("retryable").cast("boolean"), F.lit(False)).alias("retryable"),
    )


# Columns added to the alert table after its first version, with their defaults.
ALERT_ADDED_COLUMNS = {
    "feature_context_json": ("string", "{}"),
    "detection_sources_json": ("string", "[]"),
    "ml_anomaly_score": ("double", None),
    "ml_confidence": ("double", None),
    "model_version": ("string", None),
    "ml_top_contributors_json": ("string", "[]"),
    "ml_explanation": ("string", None),
    "last_seen_at": ("timestamp", None),
    "alert_fingerprint": ("string", ""),
    "idempotency_key": ("string", ""),
    "suppression_count": ("int", 0),
}


def evolve_alerts(*frames: DataFrame) -> DataFrame:
    """Union exports of any table version; missing columns get their defaults,
    ``last_seen_at`` falls back to ``created_at``."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    for c, (typ, default) in ALERT_ADDED_COLUMNS.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(typ))
        if default is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(default).cast(typ)))
    return out.withColumn("last_seen_at", F.coalesce(F.col("last_seen_at"), F.col("created_at")))


NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def widest(frames: list[DataFrame]) -> list[DataFrame]:
    """The frames with numeric columns cast to the widest type that any of them has; other differences are errors."""
    types: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            types.setdefault(name, set()).add(kind)
    casts = {}
    for name, kinds in types.items():
        if len(kinds) > 1:
            if not kinds <= set(NUMBERS):
                raise ValueError(f"column {name} has the types {sorted(kinds)}")
            # a float holds no large whole number
            whole = kinds & {"int", "bigint"}
            casts[name] = "double" if whole and kinds & {"float", "double"} else max(kinds, key=NUMBERS.index)
    return [f.withColumns({n: F.col(n).cast(k) for n, k in casts.items() if n in f.columns}) for f in frames]


def write_alert_version(export: DataFrame, folder: str, version: int) -> None:
    """One stored version of the alert table, beside the others."""
    export.write.mode("overwrite").parquet(f"{folder}/version={version}")


def read_alert_versions(spark: SparkSession, folder: str) -> DataFrame:
    """All stored versions of the alert table as one, with the ``version`` each row was written in.

    Every version is read with its own schema; columns that it lacks get their defaults, numbers the
    widest type of all versions.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(path))
    versions = [int(n[len("version=") :]) for n in names if n.startswith("version=")]
    if not versions:
        raise ValueError(f"no version in {folder}")
    frames = widest([spark.read.parquet(f"{folder}/version={v}") for v in versions])
    return evolve_alerts(*[f.withColumn("version", F.lit(v)) for f, v in zip(frames, versions)])
