"""What a job shuffles and leaves on disk (findings F1 to F23 of round 4), and that hot groups still give the same rows."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from helpers import events
from vigil.operators import rules as R
from vigil.operators.alerts import drop_known, suppress, with_keys
from vigil.operators.features import feature_snapshot
from vigil.operators.quantiles import exact_quantiles
from vigil.operators.scoring import score_no_model
from vigil.schema import FEATURE_COLUMNS
from vigil.sources.store import materialize
from vigil.streaming.state import newest
from vigil.streaming.stream import StreamConfig, current_alerts, store_alerts


def exchanges(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def drawn(n=300, seed=5, missing=False):
    """One user, IP and account with most of the events, others with few; some keys and values are null, counted ones if ``missing``."""
    rnd = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice([0, 0, 1, 40, 400, 3000])
        busy = rnd.random() < 0.7
        rows.append(
            dict(
                seq=i, ts=t, user_id="busy" if busy else rnd.choice(["a", "b", "c", None]), source_ip="10.0.0.1" if busy else rnd.choice(["10.0.0.2", "10.0.0.3", None]),
                account_id="main" if busy else rnd.choice(["x", "y"]), api_action=rnd.choice(["ConsoleLogin", "DeleteObject", "GetObject"]),
                auth_result=rnd.choice(["failure", "success", None if missing else "success"]), geo_country=rnd.choice(["US", "GB", None]), region=rnd.choice(["r1", "r2"]),
                service_name=rnd.choice(["s3", "iam", "ec2"]), bytes_received=rnd.choice([1, 2_000_000]), is_privileged_action=rnd.random() < 0.3,
            )
        )
    return rows


def alert_rows(spark, rows=None):
    rows = rows or [dict(r, auth_result="failure", api_action="ConsoleLogin", bytes_received=2_000_000) for r in drawn()]
    return materialize(with_keys(R.alerts(score_no_model(feature_snapshot(events(spark, rows))))), "test-alerts")


def test_events_are_fanned_out_behind_the_exchange(spark):
    """the sweep shuffled 10 and 8 rows an event, their totals again, and the whole events twice."""
    assert exchanges(feature_snapshot(events(spark, drawn(20)))) <= 4


@pytest.mark.parametrize("hot_rows, missing", [(1, False), (4, False), (25, True)])
def test_hot_keys_get_the_features_of_keys_that_are_swept_whole(spark, hot_rows, missing):
    rows = events(spark, drawn(missing=missing)).drop("timestamp")
    if missing:
        rows = rows.withColumn("ts_sec", F.when(F.col("seq") % 19 != 7, F.col("ts_sec")))
    whole, split = (feature_snapshot(rows, **more).select("event_id", *FEATURE_COLUMNS) for more in ({}, dict(hot_rows=hot_rows)))
    assert whole.count() == rows.where("ts_sec is not null").count()
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()


def test_repeats_of_an_event_count_once(spark):
    rows = [dict(seq=0, ts=0, event_id="e"), dict(seq=0, ts=0, event_id="e"), dict(seq=1, ts=1, event_id="f"), dict(seq=2, ts=2, event_id="e")]
    got = feature_snapshot(events(spark, rows)).select("event_id", "seq", "request_count_5m").orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("e", 0, 1), ("f", 1, 2)]


def test_alerts_are_shuffled_once_for_their_sessions(spark):
    """sessions, fold and list unions shuffled the alerts, or columns of them, in 13 exchanges of their plans."""
    assert exchanges(suppress(alert_rows(spark))) == 1


@pytest.mark.parametrize("hot_alerts", [1, 5])
def test_hot_fingerprints_fold_like_those_a_task_holds(spark, hot_alerts):
    rows = alert_rows(spark)
    # of a session the newest alert's model fields may be missing, and its lists hold items of earlier ones
    odd = F.col("seq") % 3
    rows = materialize(
        rows.withColumn("ml_explanation", F.when(odd == 0, F.lit("")).otherwise(F.col("event_id")))
        .withColumn("ml_top_contributors", F.when(odd == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.col("event_id"), F.lit(None)))),
        "test-alerts",
    )
    whole, split = (suppress(rows, **more).drop("event", "feature_context") for more in ({}, dict(hot_alerts=hot_alerts)))
    assert whole.agg(F.sum(F.col("suppression_count") + 1)).first()[0] == rows.count()
    assert whole.where("suppression_count > 1").count() > 0
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()


def test_a_written_table_leaves_no_shuffle_files(spark):
    """shuffles that nothing reads any more lay on disk until the driver's next collection of garbage."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    before = shuffles()
    table = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-shuffled")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert table.agg(F.sum("count")).first()[0] == 1000


def test_value_counts_go_with_their_quantiles(spark, monkeypatch, tmpdir_path):
    """the counts of distinct values stayed beside the one row made of them."""
    monkeypatch.setattr("vigil.sources.store.scratch_path", lambda spark, name: f"{tmpdir_path}/{name}")
    row = exact_quantiles(spark.range(101), {"q": (F.col("id"), [0.0, 0.5, 0.255])}).first()
    assert list(row.q) == [0.0, 50.0, 25.5]
    assert [f for f in os.listdir(f"{tmpdir_path}/vigil") if f.startswith("value-counts")] == []


def test_alerts_without_repeats_are_not_shuffled(spark):
    """all alerts of a batch were shuffled whole by their key."""
    rows = alert_rows(spark)
    first = rows.where("seq % 2 = 0").select("idempotency_key")
    assert drop_known(rows, first.limit(0)) is rows
    twice = materialize(rows.unionByName(rows.where("seq < 50").withColumn("seq", F.col("seq") + 1000)), "test-alerts")
    assert drop_known(twice, None).exceptAll(rows).isEmpty() and drop_known(twice, None).count() == rows.count()
    assert drop_known(twice, first).exceptAll(rows.where("seq % 2 = 1")).isEmpty()
    assert drop_known(twice, first).count() == rows.where("seq % 2 = 1").count()


def test_the_newest_version_is_found_in_the_columns_that_are_read(spark):
    """whole rows were shuffled to find the newest of a key."""
    rows = spark.createDataFrame([("k", 1, "old", "x"), ("k", 2, "new", "y"), ("l", 1, "only", "z")], "id string, batch_id long, value string, wide string")
    got = newest(["id"])(rows).select("id", "value")
    assert {tuple(r) for r in got.collect()} == {("k", "new"), ("l", "only")}
    assert "wide" not in got._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_a_batch_leaves_no_table_of_its_own(spark, monkeypatch, tmpdir_path):
    """every batch left the alerts and sessions that its fold had written."""
    for module in ("vigil.sources.store", "vigil.session"):
        monkeypatch.setattr(f"{module}.scratch_path", lambda spark, name: f"{tmpdir_path}/scratch/{name}")
    rows = alert_rows(spark)
    cfg = StreamConfig(base=f"{tmpdir_path}/tables")
    kept = [store_alerts(spark, cfg, rows.where(F.col("seq") % 2 == odd), batch) for batch, odd in enumerate((1, 0))]
    left = {f for f in os.listdir(f"{tmpdir_path}/scratch/vigil") if not f.startswith(("test-", "features"))}
    assert left == {k.scratch_folder.rsplit("/", 1)[1] for k in kept}
    assert current_alerts(spark, cfg).agg(F.sum(F.col("suppression_count") + 1)).first()[0] == rows.count()
    columns = ["alert_fingerprint", "last_seen_at", "suppression_count", "reasons"]
    late, once = current_alerts(spark, cfg).select(*columns), suppress(rows).select(*columns)
    assert late.exceptAll(once).isEmpty() and once.exceptAll(late).isEmpty()
