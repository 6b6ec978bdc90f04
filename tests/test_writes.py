"""Writes spread over tasks; replay numbers physical lines; detail reads."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.functions.validate import validate_events
from vigil.schema import FEATURE_COLUMNS
from vigil.sources.fixtures import security_events
from vigil.sources.raw import raw_event_lines, replay_archive, replay_to, write_archive
from vigil.sources.tables import feature_rows, read_feature_rows, write_feature_rows


def test_one_day_of_one_provider_is_written_by_several_tasks(spark, tmpdir_path):
    n = 60_000
    feats = spark.range(n).select(
        F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("event_id"), F.lit(1704067200).cast("long").alias("ts_sec"),
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.lit("aws").alias("cloud_provider"),
        *[F.lit("x").alias(c) for c in ("account_id", "user_id", "source_ip", "geo_country", "region", "service_name", "api_action", "principal_type", "scenario")],
        *[F.lit(0).alias(c) for c in FEATURE_COLUMNS],
    )
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
    try:
        write_feature_rows(feature_rows(feats), tmpdir_path, mode="overwrite")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    (folder,) = [d for d, _, files in os.walk(tmpdir_path) if any(f.endswith(".parquet") for f in files)]
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > 1
    assert read_feature_rows(spark, tmpdir_path).count() == n


def test_replay_counts_physical_lines_over_files_and_blocks(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "a")
    os.makedirs(path)
    lines = []
    for k in range(4):
        own = ["" if n % 7 == 3 else f'{{"f": {k}, "n": {n}}}' for n in range(500)]
        with open(os.path.join(path, f"part-{k:05d}.txt"), "w") as f:
            f.write("\n".join(own) + "\n")
        lines += own
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    try:
        for start, limit in ((1, None), (777, 600), (3, 0), (5000, None)):
            want = [(n, x) for n, x in enumerate(lines, 1) if n >= start and x]
            want = want if limit is None else want[: max(limit, 1)]
            out = replay_archive(spark, path, start, limit)
            assert sorted((r.line_no, r.value) for r in out.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_replayed_archive_validates_to_the_same_events(spark, tmpdir_path):
    lines = raw_event_lines(security_events(spark, SF_SMALL))
    write_archive(lines, os.path.join(tmpdir_path, "a"))
    replay_to(replay_archive(spark, os.path.join(tmpdir_path, "a")), os.path.join(tmpdir_path, "b"))
    again = spark.read.text(os.path.join(tmpdir_path, "b")).withColumns({"seq": F.monotonically_increasing_id(), "arrival_ts": F.current_timestamp()})
    columns = ["event_id", "ts_sec", "user_id", "source_ip", "bytes_received", "is_privileged_action", "scenario"]
    valid = [sorted(tuple(r) for r in validate_events(x).where("valid").select(*columns).collect()) for x in (lines, again)]
    assert len(valid[0]) > 700 and valid[0] == valid[1]
