"""First n rows for any n, arrival numbers over partitions, snapshots and stored versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators.topn import first_rows, value_at_rank
from vigil.plans.train import read_snapshot, write_snapshot
from vigil.schema import FEATURE_COLUMNS
from vigil.sources.raw import arrival_numbers, topic_messages
from vigil.sources.tables import read_alert_versions, widest, write_alert_version


def test_first_rows_equal_a_sort(spark):
    draw = random.Random(3)
    data = [(draw.choice([None, 1, 2, 2, 2, 7, draw.randrange(50)]), k) for k in range(300)]
    df = spark.createDataFrame(data, "t long, seq long").repartition(7)
    want = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), -r[1]))
    for n in (0, 1, 40, 150, 290, 300, 1000):  # half the table and more
        got = first_rows(df, n, [-F.col("t"), -F.col("seq")])
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want[:n]))
    assert "TakeOrdered" not in first_rows(df, 150, [-F.col("t"), -F.col("seq")])._jdf.queryExecution().toString()
    assert first_rows(df.limit(0), 5, [F.col("t")]).count() == 0 and value_at_rank(df.limit(0), F.col("t"), 1) is None


def test_arrival_numbers_over_partitions(spark):
    draw = random.Random(4)
    data = [(p, o, draw.randrange(100)) for p in range(5) for o in range(40)]
    df = spark.createDataFrame(data, "partition int, offset long, t long").select(
        "partition", "offset", F.timestamp_seconds("t").alias("timestamp"), F.concat_ws("-", "partition", "offset").cast("binary").alias("value")
    )
    want = [f"{p}-{o}" for p, o, t in sorted(data, key=lambda r: (r[2], r[0], r[1]))]
    rows = sorted(topic_messages(df.repartition(6), stream=False).collect(), key=lambda r: r.seq)
    assert [r.value for r in rows] == want and [r.seq for r in rows] == list(range(200))
    streamed = topic_messages(df, stream=True)
    assert streamed.where("seq is null").count() == 200
    assert arrival_numbers(streamed.drop("seq"), start=7).agg(F.min("seq"), F.max("seq"), F.countDistinct("seq")).first() == (7, 206, 200)
    assert arrival_numbers(streamed.drop("seq").limit(0)).count() == 0


def test_topic_batches_are_numbered_by_arrival(spark):
    from vigil.streaming.stream import number_rows

    rows = [(None, 1, 5, 20, "late"), (None, 0, 9, 30, "last"), (None, 2, 0, 10, "first")]
    df = spark.createDataFrame(rows, "seq long, source_partition int, source_offset long, t long, value string")
    df = df.withColumn("arrival_ts", F.timestamp_seconds("t")).drop("t")
    got = {r.value: r.seq for r in number_rows(df, 3).collect()}
    assert got == {"first": 3 << 40, "late": (3 << 40) + 1, "last": (3 << 40) + 2}


def test_versions_with_other_columns_and_types(spark, tmpdir_path):
    one = spark.createDataFrame([("a", 1)], "alert_id string, created_at long").withColumn("created_at", F.timestamp_seconds("created_at"))
    two = one.withColumns({"alert_id": F.lit("b"), "suppression_count": F.lit(3).cast("int"), "model_version": F.lit("m")})
    three = two.withColumns({"alert_id": F.lit("c"), "suppression_count": F.lit(1 << 40), "last_seen_at": F.timestamp_seconds(F.lit(9))})
    for k, frame in enumerate((one, two, three), 1):
        write_alert_version(frame, tmpdir_path, k)
    out = read_alert_versions(spark, tmpdir_path)
    got = {r.alert_id: (r.version, r.suppression_count, r.model_version, r.last_seen_at.timestamp(), r.alert_fingerprint) for r in out.collect()}
    assert got == {"a": (1, 0, None, 1.0, ""), "b": (2, 3, "m", 1.0, ""), "c": (3, 1 << 40, "m", 9.0, "")}
    assert dict(out.dtypes)["suppression_count"] == "bigint"
    with pytest.raises(ValueError):
        widest([one, one.withColumn("created_at", F.lit("text"))])
    with pytest.raises(ValueError):
        read_alert_versions(spark, os.path.join(tmpdir_path, "version=1"))


def test_snapshot_comes_back(spark, tmpdir_path):
    kinds = {"ip_failed_auth_rate_5m": 0.25, "account_service_entropy_1h": 1.585, "is_privileged_action": True, "auth_failure": False,
             "is_new_country_for_user": True, "is_new_ip_for_user": False}
    row = {c: kinds.get(c, 1 << 40) for c in FEATURE_COLUMNS}
    df = spark.range(3).select(F.concat(F.lit("e, \""), "id").alias("event_id"), F.lit("s").alias("scenario"), *[F.lit(v).alias(c) for c, v in row.items()])
    path = os.path.join(tmpdir_path, "snap")
    write_snapshot(df, path)
    back = read_snapshot(spark, path)
    assert len(back.columns) == 18 and {(r.event_id, *[r[c] for c in FEATURE_COLUMNS]) for r in back.collect()} == {(f'e, "{i}', *row.values()) for i in range(3)}
    df.select("scenario", "event_id", *FEATURE_COLUMNS).write.option("header", True).csv(path + "-other")
    with pytest.raises(Exception):
        read_snapshot(spark, path + "-other").collect()
