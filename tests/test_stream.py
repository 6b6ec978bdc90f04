"""Stream = batch: k micro-batches give the same features and alert table as one run."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.functions.validate import validate_events
from vigil.operators import rules as R
from vigil.operators.alerts import suppress, with_keys
from vigil.operators.features import feature_snapshot
from vigil.operators.scoring import feature_stats, score_from_raw_frame
from vigil.schema import FEATURE_COLUMNS
from vigil.sources.fixtures import security_events
from vigil.sources.raw import raw_event_lines
from vigil.sources.store import materialize
from vigil.streaming.stream import StreamConfig, current_alerts, start

def RAW_fn():
    return ((F.col("seq") * 37) % 1000).cast("double") / 1000.0 * 0.6 - 0.3


def _batch(lines):
    v = materialize(validate_events(lines), "test-validated")
    ev = v.where("valid").drop("errors", "valid", "is_object", "value", "kind", "arrival_ts")
    feats = feature_snapshot(ev).withColumn("raw_score", RAW_fn())
    stats = feature_stats(feats)
    scored = score_from_raw_frame(feats, stats, "raw_score", "fixture-raw-score")
    table = suppress(with_keys(R.alerts(scored)), materialize_sessions=False)
    return feats, stats, table


@pytest.mark.parametrize("parts", [3])
def test_stream_equals_batch(spark, tmpdir_path, parts):
    lines = raw_event_lines(security_events(spark, SF_SMALL)).select("seq", "arrival_ts", "value")
    feats, stats, table = _batch(lines)
    stats = stats.cache()
    stats.count()

    src = os.path.join(tmpdir_path, "src")
    lo, hi = lines.agg(F.min("seq"), F.max("seq")).first()
    step = (hi - lo) // parts + 1
    for i in range(parts):
        part = lines.where((F.col("seq") >= lo + i * step) & (F.col("seq") < lo + (i + 1) * step))
        part.coalesce(1).write.parquet(os.path.join(src, f"part{i:03d}"))

    stream = (
        spark.readStream.schema(lines.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(os.path.join(src, "*"))
    )
    cfg = StreamConfig(
        base=os.path.join(tmpdir_path, "tables"),
        stats=stats,
        raw_score="raw_score",
        scorer=lambda df: df.withColumn("raw_score", RAW_fn()),
        model_version="fixture-raw-score",
    )
    q = start(spark, stream, cfg, os.path.join(tmpdir_path, "ckpt"))
    q.processAllAvailable()
    q.stop()

    got = spark.read.parquet(cfg.path("features")).select("event_id", *FEATURE_COLUMNS)
    want = feats.select("event_id", *FEATURE_COLUMNS)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0

    cols = ["alert_id", "alert_fingerprint", "suppression_count", "created_at", "last_seen_at", "severity", "title"]
    got_a = current_alerts(spark, cfg).select(*cols)
    want_a = table.select(*cols)
    assert got_a.count() == want_a.count()
    assert got_a.exceptAll(want_a).count() == 0

    dl = spark.read.parquet(cfg.path("dead_letters"))
    assert dl.count() == validate_events(lines).where("not valid").count()


def test_batch_retry_is_idempotent(spark, tmpdir_path):
    """Re-running a micro-batch with the same id (a retry after a failure) leaves every table unchanged."""
    from vigil.streaming.stream import process_batch

    lines = raw_event_lines(security_events(spark, SF_SMALL)).select("seq", "arrival_ts", "value")
    lo = lines.agg(F.min("seq")).first()[0]
    first = lines.where(F.col("seq") < lo + 500).cache()
    second = lines.where(F.col("seq") >= lo + 500).cache()
    cfg = StreamConfig(base=os.path.join(tmpdir_path, "tables"))
    process_batch(spark, cfg, first, 0)
    process_batch(spark, cfg, second, 1)

    def snapshot():
        return {
            "features": spark.read.parquet(cfg.path("features")).count(),
            "dead_letters": spark.read.parquet(cfg.path("dead_letters")).count(),
            "alert_log": spark.read.parquet(cfg.path("alert_log")).count(),
            "alerts": current_alerts(spark, cfg).count(),
            "history": spark.read.parquet(cfg.path("history")).count(),
        }

    before = snapshot()
    process_batch(spark, cfg, second, 1)  # the retry
    assert snapshot() == before
    assert before["features"] == validate_events(lines).where("valid").count()


BASE = dict(
    cloud_provider="aws", account_id="a1", user_id="u1", principal_type="human", source_ip="10.0.0.1", geo_country="US", region="us-east-1",
    service_name="s3", api_action="GetObject", resource_type="object", resource_id="r1", auth_result="success", bytes_sent=0, bytes_received=0,
    device_fingerprint="d1", user_agent="ua", is_privileged_action=False, metadata={"scenario": "test"},
)


def _messages(spark, *events):
    """Lines without positions; an event gives at least its id and clock time."""
    rows = [(None, json.dumps(BASE | dict(event_id=i, timestamp=f"2024-01-01T{at}+00:00") | more)) for i, at, more in events]
    return spark.createDataFrame(rows, "seq long, value string").withColumn("arrival_ts", F.lit("2024-01-01").cast("timestamp"))


def test_quiet_late_and_failing_batches(spark, tmpdir_path):
    """A first batch without alerts; a late alert joins its session; too late events, failing sinks and scorer."""
    from vigil.streaming.stream import process_batch

    def fail(*_):
        raise RuntimeError("down")

    cfg = StreamConfig(os.path.join(tmpdir_path, "t"), scorer=fail, alert_sink=fail, dead_letter_sinks=[fail], lateness_seconds=600)
    process_batch(spark, cfg, _messages(spark, ("e0", "00:10:00", {})), 0)
    assert current_alerts(spark, cfg) is None
    big = {"bytes_received": 10**12}
    process_batch(spark, cfg, _messages(spark, ("e1", "00:16:40", big)), 1)
    (first,) = current_alerts(spark, cfg).collect()
    assert first.suppression_count == 0 and first.model_version == "unavailable" and first.event.event_id == "e1"
    process_batch(spark, cfg, _messages(spark, ("e2", "00:15:00", big), ("e1", "00:16:40", big)), 2)
    (both,) = current_alerts(spark, cfg).collect()
    assert (both.alert_id, both.created_at, both.suppression_count) == (first.alert_id, first.created_at, 1)
    process_batch(spark, cfg, _messages(spark, ("e3", "00:00:01", big)), 3)
    process_batch(spark, cfg, _messages(spark, ("e4", "00:18:00", big)), 4)
    (last,) = current_alerts(spark, cfg).collect()
    assert (last.alert_id, last.suppression_count, last.event.event_id) == (first.alert_id, 2, "e4")
    letters = {(r.stage, r.event_id, r.error_type, r.retryable) for r in spark.read.parquet(cfg.path("dead_letters")).collect()}
    assert letters == {("alert_delivery", e, "RuntimeError", True) for e in ("e1", "e2", "e4")} | {("late", "e3", "LateEvent", False)}
    assert {r.event_id for r in spark.read.parquet(cfg.path("features")).collect()} == {"e0", "e1", "e2", "e4"}


def test_failing_detection_is_dead_lettered_on_request(spark, tmpdir_path, monkeypatch):
    from vigil.streaming import stream

    def fail(*_):
        raise ValueError("broken")

    monkeypatch.setattr(stream, "_detect", fail)
    cfg = StreamConfig(os.path.join(tmpdir_path, "t"), dead_letter_failures=True)
    stream.process_batch(spark, cfg, _messages(spark, ("e0", "00:10:00", {}), ("", "00:10:00", {})), 0)
    letters = {(r.stage, r.event_id, r.retryable) for r in spark.read.parquet(cfg.path("dead_letters")).collect()}
    assert letters == {("stream_processing", "e0", True), ("validation", "", False)}
    cfg.dead_letter_failures = False
    with pytest.raises(ValueError):
        stream.process_batch(spark, cfg, _messages(spark, ("e0", "00:10:00", {})), 1)


def test_wide_batches_get_distinct_numbers(spark):
    from vigil.streaming.stream import number_rows

    rows = spark.range(160).select(F.lit(None).cast("long").alias("seq"), F.col("id").cast("string").alias("value")).repartition(160)
    numbers = [sorted(r.seq for r in number_rows(rows, b).collect()) for b in (0, 1)]
    assert numbers == [list(range(160)), [(1 << 40) + k for k in range(160)]]


def _expected(spark, lines):
    v = materialize(validate_events(lines), "test-validated")
    return {r.event_id: tuple(r[c] for c in FEATURE_COLUMNS) for r in feature_snapshot(v.where("valid").drop("errors", "valid")).collect()}


def test_a_busy_key_is_read_thinned(spark, tmpdir_path):
    """A day of one user: later batches read few of its rows, and their features are those of one run over all of them."""
    from vigil.streaming import stream

    def at(seconds):
        return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"

    def event(k, seconds):
        more = {"source_ip": f"10.0.0.{k % 3 + 1}", "geo_country": ("US", "DE")[k % 2], "auth_result": ("success", "failure")[k % 5 == 0]}
        return (f"e{k}", at(seconds), more)

    early = [event(k, 60 + 25 * k) for k in range(2000)]  # 14 hours
    late = [event(3000 + k, 80_000 + 100 * k) for k in range(5)] + [event(4, 60)]  # and a repeat
    cfg = StreamConfig(os.path.join(tmpdir_path, "t"), state_buckets=4, lateness_seconds=90_000)
    seen = []
    kept = stream._context
    stream._context = lambda *a: seen.append(rows := materialize(kept(*a), "test-context")) or rows
    try:
        stream.process_batch(spark, cfg, _messages(spark, *early), 0)
        stream.process_batch(spark, cfg, _messages(spark, *late), 1)
    finally:
        stream._context = kept
    assert seen[0].count() == 0 and 0 < seen[1].count() < 500  # slots of 15 minutes, 6 combinations each
    everything = _messages(spark, *early).withColumn("seq", F.substring(F.get_json_object("value", "$.event_id"), 2, 9).cast("long")).unionByName(
        _messages(spark, *late[:-1]).withColumn("seq", F.substring(F.get_json_object("value", "$.event_id"), 2, 9).cast("long"))
    )
    got = {r.event_id: tuple(r[c] for c in FEATURE_COLUMNS) for r in spark.read.parquet(cfg.path("features")).collect()}
    assert got == _expected(spark, everything) and len(got) == 2005
    times = {r.stage: r for r in spark.read.parquet(cfg.path("timings")).where("batch_id = 1").collect()}
    assert set(times) == {"batch", "compact_state", "validate", "archive", "detect"} and times["validate"].rows == 6
    assert times["batch"].millis >= times["detect"].millis > 0
    # stored features are read by day
    assert "event_date=2024-01-01" in spark.read.parquet(cfg.path("features")).where("event_date = '2024-01-01'").inputFiles()[0]


def test_history_out_of_reach_goes(spark, tmpdir_path):
    from vigil.streaming.stream import compact_state, process_batch

    cfg = StreamConfig(os.path.join(tmpdir_path, "t"), lateness_seconds=0, state_buckets=2, state_fan=2)
    for batch, day in enumerate(("2024-01-01", "2024-01-01", "2024-01-05")):
        message = _messages(spark, (f"e{batch}", f"0{batch}:00:00", {})).withColumn("value", F.replace("value", F.lit("2024-01-01"), F.lit(day)))
        process_batch(spark, cfg, message, batch)
    assert len([n for n in os.listdir(cfg.path("history")) if n.startswith("hour=")]) == 3
    compact_state(spark, cfg, 3)
    assert len([n for n in os.listdir(cfg.path("history")) if n.startswith("hour=")]) == 1
    from vigil.streaming.stream import _states

    states = _states(spark, cfg)
    assert {r.event_id for r in states["recent_by_user"].read(3).where("ts_sec > 0").collect()} <= {"e0", "e1", "e2"}
    assert states["first_seen"].read(3).count() == 3
