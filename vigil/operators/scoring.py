"""Model score columns: score, confidence, prediction, top contributors,
percentile band and explanation; training statistics (medians, stds, score
percentiles, anomaly fraction, scenario breakdown).

Statistics are one-row frames; attaching them to events is a cross join with
``broadcast`` of a single row (a proven size bound).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import confidence_from_raw, py_bool_text, score_from_raw
from ..schema import BOOL_FEATURES, FEATURE_COLUMNS, NO_MODEL_EXPLANATION, NO_MODEL_VERSION
from .quantiles import exact_quantiles

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
STD_FLOOR = 1e-9


def feature_vector(df: DataFrame) -> DataFrame:
    """The 16 features as doubles in fixed order (booleans become 0/1)."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS])


def raw_logistic(raw: Column) -> Column:
    """Unrounded logistic score (used for the training percentiles)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(raw * F.lit(3.5)))


def feature_stats(features: DataFrame, raw_col: str = "raw_score") -> DataFrame:
    """One row: ``median_<f>``, ``std_<f>`` for the 16 features; ``p50..p99`` of the
    training anomaly score; ``observed_anomaly_fraction``; ``training_rows``.

    Medians and percentiles are exact and distributed (``exact_quantiles``) at every size.
    """
    x = features.select(
        *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS],
        raw_logistic(F.col(raw_col)).alias("_score"),
        (F.col(raw_col) < 0).cast("double").alias("_pred"),
    )
    wanted = {f"_q_{c}": (F.col(c), [0.5]) for c in FEATURE_COLUMNS}
    quantiles = exact_quantiles(x, wanted | {"_pcts": (F.col("_score"), list(PERCENTILES.values()))})
    aggs = [F.stddev_pop(c).alias(f"_std_{c}") for c in FEATURE_COLUMNS]
    aggs.append(F.avg("_pred").alias("observed_anomaly_fraction"))
    aggs.append(F.count(F.lit(1)).alias("training_rows"))
    s = x.agg(*aggs).crossJoin(quantiles)  # one row each
    cols = []
    for c in FEATURE_COLUMNS:
        cols.append(F.col(f"_q_{c}")[0].alias(f"median_{c}"))
        std = F.col(f"_std_{c}")
        cols.append(F.when(std > STD_FLOOR, std).otherwise(F.lit(1.0)).alias(f"std_{c}"))
    for i, name in enumerate(PERCENTILES):
        cols.append(F.col("_pcts")[i].alias(name))
    cols += [F.col("observed_anomaly_fraction"), F.col("training_rows")]
    return s.select(*cols)


def _value_text(c: str) -> Column:
    if c in BOOL_FEATURES:
        return py_bool_text(F.col(c))
    return F.col(c).cast("string")


def top_contributors(n: int = 3) -> Column:
    """Top ``n`` features by ``|value - median| / std`` (ties keep feature order), as ``name=value``.

    Needs the ``median_<f>`` / ``std_<f>`` columns of ``feature_stats`` on the row.
    """
    items = []
    for pos, c in enumerate(FEATURE_COLUMNS):
        dev = F.abs(F.col(c).cast("double") - F.col(f"median_{c}")) / F.col(f"std_{c}")
        items.append(
            F.struct(
                dev.alias("dev"),
                F.lit(-pos).alias("neg_pos"),
                F.concat(F.lit(f"{c}="), _value_text(c)).alias("text"),
            )
        )
    ranked = F.sort_array(F.array(*items), asc=False)
    # field extraction over the array (no lambda) keeps the projection in codegen
    return F.slice(ranked, 1, n)["text"]


def score_band(score: Column) -> Column:
    p99 = F.coalesce(F.col("p99"), F.lit(1.0))
    p95 = F.coalesce(F.col("p95"), F.lit(1.0))
    p90 = F.coalesce(F.col("p90"), F.lit(1.0))
    return (
        F.when(score >= p99, F.lit("above the training p99 anomaly score"))
        .when(score >= p95, F.lit("above the training p95 anomaly score"))
        .when(score >= p90, F.lit("above the training p90 anomaly score"))
        .otherwise(F.lit("within the lower 90% of training anomaly scores"))
    )


def explanation(score: Column, predicted: Column, contributors: Column) -> Column:
    verdict = F.when(predicted, F.lit("anomalous")).otherwise(F.lit("within baseline"))
    head = F.concat(
        F.lit("Model classified this event as "),
        verdict,
        F.lit(" with score "),
        F.format_string("%.4f", score),
        F.lit(" ("),
        score_band(score),
        F.lit(")."),
    )
    return F.when(
        F.size(contributors) > 0,
        F.concat(head, F.lit(" The largest feature deviations were "), F.array_join(contributors, ", "), F.lit(".")),
    ).otherwise(head)


MODEL_FIELDS = ["anomaly_score", "confidence", "predicted_anomaly", "model_version", "top_contributors", "explanation"]


def score_from_raw_frame(df: DataFrame, stats: DataFrame, raw_col: str, model_version: str) -> DataFrame:
    """Attach model score fields computed from a raw decision value (score minus offset).

    ``stats`` is the one-row output of ``feature_stats`` (broadcast).
    """
    stat_cols = [c for c in stats.columns]
    j = df.crossJoin(F.broadcast(stats))
    raw = F.col(raw_col)
    j = j.withColumn("_tc", top_contributors())
    j = j.withColumns(
        {
            "anomaly_score": score_from_raw(raw),
            "confidence": confidence_from_raw(raw),
            "predicted_anomaly": raw < 0,
            "model_version": F.lit(model_version),
        }
    )
    j = j.withColumn("top_contributors", F.col("_tc")).withColumn(
        "explanation", explanation(F.col("anomaly_score"), F.col("predicted_anomaly"), F.col("_tc"))
    )
    return j.drop("_tc", *stat_cols)


def score_no_model(df: DataFrame, explanation_text: str = NO_MODEL_EXPLANATION) -> DataFrame:
    """The no-model reply: score 0, not predicted, version ``unavailable``.

    ``explanation_text=""`` gives the rules-only fallback used when scoring fails.
    """
    return df.withColumns(
        {
            "anomaly_score": F.lit(0.0),
            "confidence": F.lit(0.0),
            "predicted_anomaly": F.lit(False),
            "model_version": F.lit(NO_MODEL_VERSION),
            "top_contributors": F.array().cast("array<string>"),
            "explanation": F.lit(explanation_text),
        }
    )


def scenario_breakdown(scored: DataFrame, pred_col: str = "predicted_anomaly") -> DataFrame:
    """Per scenario: count, predicted anomalies, rate rounded to 4 places (sorted by rate desc)."""
    return (
        scored.groupBy(F.coalesce(F.col("scenario"), F.lit("unknown")).alias("scenario"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum(F.col(pred_col).cast("long")).alias("predicted_anomalies"),
        )
        .withColumn(
            "predicted_anomaly_rate",
            F.round(F.col("predicted_anomalies").cast("double") / F.col("count").cast("double"), 4),
        )
    )
