"""Replay slices, schema evolution defaults, ISO text."""

import datetime as dt

from pyspark.sql import functions as F

from vigil.sources.raw import replay_slice
from vigil.sources.tables import evolve_alerts, iso_text


def test_replay_slice(spark):
    lines = spark.createDataFrame(
        [(1, '{"a": 1}'), (2, "   "), (3, '{"a": 3}'), (4, '{"a": 4}'), (5, '{"a": 5}')], "line_no long, value string"
    )
    assert [r[0] for r in replay_slice(lines, start_line=2).orderBy("line_no").select("line_no").collect()] == [3, 4, 5]
    assert [r[0] for r in replay_slice(lines, start_line=1, limit=2).select("line_no").collect()] == [1, 3]
    assert replay_slice(lines, start_line=1, limit=0).count() == 1


def test_evolve_alerts_defaults(spark):
    old = spark.createDataFrame(
        [("a1", dt.datetime(2024, 1, 1, 0, 0, 5), "high")], "alert_id string, created_at timestamp, severity string"
    )
    new = old.withColumn("suppression_count", F.lit(3)).withColumn("alert_id", F.lit("a2")).withColumn(
        "last_seen_at", F.lit(dt.datetime(2024, 1, 1, 0, 9, 0))
    )
    rows = {r["alert_id"]: r for r in evolve_alerts(old, new).collect()}
    assert rows["a1"]["last_seen_at"] == rows["a1"]["created_at"]
    assert rows["a1"]["suppression_count"] == 0 and rows["a2"]["suppression_count"] == 3
    assert rows["a1"]["detection_sources_json"] == "[]" and rows["a1"]["feature_context_json"] == "{}"
    assert rows["a1"]["alert_fingerprint"] == "" and rows["a1"]["model_version"] is None
    assert rows["a2"]["last_seen_at"] == dt.datetime(2024, 1, 1, 0, 9, 0)


def test_iso_text(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 0, 0, 7),), (dt.datetime(2024, 1, 1, 0, 0, 7, 120000),)], "ts timestamp"
    )
    got = [r[0] for r in df.select(iso_text(F.col("ts"))).collect()]
    assert got == ["2024-01-01T00:00:07+00:00", "2024-01-01T00:00:07.120000+00:00"]
