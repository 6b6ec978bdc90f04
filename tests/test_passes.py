"""What a job does once, deals out evenly, and keeps off the driver."""

import pytest
from pyspark.sql import functions as F

from helpers import events
from vigil.functions.columns import json_string
from vigil.functions.validate import SPACE, strip
from vigil.operators import rules as R
from vigil.operators.alerts import suppress, with_keys
from vigil.operators.features import feature_snapshot
from vigil.operators.scoring import score_no_model
from vigil.plans.queries import _streamed
from vigil.plans.train import train
from vigil.schema import FEATURE_COLUMNS
from vigil.sources.store import spread
from vigil.streaming.stream import first_seen_flags


def test_no_task_gets_more_rows_as_the_table_grows(spark):
    """eight partitions of 75,000 rows were left as they were."""
    largest = spread(spark.range(600_000, numPartitions=8), "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 60_000


TEXTS = ["", "plain ~!", "a b\n", 'q"q', "back\\slash", "tab\t", "\x01", "\x7f", "é", " ", "[]#", None]


def test_json_text_is_that_of_spark(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    whole = F.to_json(F.array("t"))
    assert rows.where(~json_string(F.col("t")).eqNullSafe(whole.substr(F.lit(2), F.length(whole) - 2))).count() == 0


def test_strip_takes_all_white_space_at_either_end(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, " a", "a ", " a b ", "\n", " \x1c\x85 ", "a\n"]], "t string")
    assert rows.where(~strip(F.col("t")).eqNullSafe(F.regexp_replace("t", f"^{SPACE}+|{SPACE}+$", ""))).count() == 0


def alert_rows(spark):
    rows = [dict(ts=10 * i, api_action="ConsoleLogin", auth_result="failure", bytes_received=3_000_000) for i in range(8)]
    return with_keys(R.alerts(score_no_model(feature_snapshot(events(spark, rows)))))


def test_alerts_are_made_once_for_their_sessions(spark):
    """each of the three passes over the alerts scored the events and made the alerts anew."""
    made = spark.sparkContext.accumulator(0)

    def count(seq):
        made.add(1)
        return seq

    alerts = alert_rows(spark)
    n = alerts.count()
    table = suppress(alerts.withColumn("seq", F.udf(count, "long")("seq")))
    assert table.agg(F.sum(F.col("suppression_count") + 1)).first()[0] == n
    assert made.value == n


def test_training_rows_walk_the_trees_once(spark):
    """the offset, the statistics and the breakdown each scored all rows."""
    values = [(f"e{i}", "s", *[float((i * (k + 3)) % 17) for k in range(len(FEATURE_COLUMNS))]) for i in range(300)]
    schema = "event_id string, scenario string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    _, stats, metadata = train(spark.createDataFrame(values, schema), trees=5)
    for frame in (stats, metadata):
        assert "EvalPython" not in frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("files", [1, 6])
def test_a_half_is_one_micro_batch_however_many_files_it_has(spark, files):
    """F2: every file of a half was a micro-batch of its own."""
    lines = spark.range(60).select(F.col("id").alias("seq"), F.timestamp_seconds("id").alias("arrival_ts"), F.lit("not json").alias("value"))
    cfg, queries = _streamed(spark, lines.repartition(files), [F.col("seq") < 40, F.col("seq") >= 40], "test")
    letters = spark.read.parquet(cfg.path("dead_letters")).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [tuple(r) for r in letters] == [(0, 40), (1, 20)]
    assert len(queries) == 2


def test_join_sides_that_grow_are_not_broadcast(spark):
    """tables small by their compressed size went through the driver."""
    rows = events(spark, [dict(ts=i) for i in range(3)])
    known = spark.createDataFrame([("u1", "user", "", (0, 0))], "user_id string, dim string, value string, first struct<ts_sec: bigint, seq: bigint>")
    for frame in (feature_snapshot(rows), first_seen_flags(rows, known)):
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()
