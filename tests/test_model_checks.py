"""The checks that the model queries report hold what they claim: wrong bands, shares and metadata are seen."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.operators.scoring import feature_stats, scenario_breakdown, score_from_raw_frame
from vigil.plans.queries import _features, _metadata_checks, _score_checks
from vigil.plans.train import model_metadata


@pytest.fixture(scope="module")
def given(spark):
    """Feature rows whose raw values have 8 % below 0, their statistics and scores."""
    rows = _features(spark, SF_SMALL)
    cut = rows.agg(F.expr("percentile(raw_score, 0.08)")).first()[0]
    rows = rows.withColumn("raw_score", F.col("raw_score") - cut).cache()
    return rows, feature_stats(rows).cache()


def scored(rows, stats):
    return score_from_raw_frame(rows, stats, "raw_score", "v")


def all_true(df, column):
    return df.agg(F.min(F.col(column).cast("int"))).first()[0] == 1


def test_right_scores_hold(given):
    checks = _score_checks(scored(*given), given[1])
    assert all(all_true(checks, c) for c in ("score_ok", "confidence_ok", "predicted_ok", "explained", "share_ok"))


@pytest.mark.parametrize("wrong", ["p90", "p95", "p99"])
def test_wrong_bands_are_seen(given, wrong):
    rows, stats = given
    checks = _score_checks(scored(rows, stats.withColumn(wrong, F.col(wrong) + F.lit(1.0))), stats)
    assert not all_true(checks, "explained")


@pytest.mark.parametrize("shift", [10.0, -10.0])
def test_wrong_shares_are_seen(given, shift):
    rows = given[0].withColumn("raw_score", F.col("raw_score") + shift)
    stats = feature_stats(rows)
    assert not all_true(_score_checks(scored(rows, stats), stats), "share_ok")


def test_ties_on_the_offset_are_no_fault(given):
    rows = given[0].withColumn("raw_score", F.lit(0.0))
    stats = feature_stats(rows)
    assert all_true(_score_checks(scored(rows, stats), stats), "share_ok")


@pytest.mark.parametrize("wrong", [None, "fraction", "breakdown", "p50", "p90", "p95", "p99"])
def test_metadata_is_held_against_scored_rows(given, wrong):
    rows, stats = given
    breakdown = scenario_breakdown(rows.withColumn("predicted_anomaly", F.col("raw_score") < (0.5 if wrong == "breakdown" else 0)))
    if wrong == "fraction":
        stats = stats.withColumn("observed_anomaly_fraction", F.lit(0.0))
    elif wrong and wrong != "breakdown":
        stats = stats.withColumn(wrong, F.col(wrong) * F.lit(1.2))
    out = _metadata_checks(model_metadata(stats, breakdown, 0.08, "v", "t", "s"), rows).collect()
    assert len(out) == breakdown.count() and any(r["count"] is None for r in out) == (wrong is not None)
