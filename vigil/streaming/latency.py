"""Processing times of the stream: per batch and stage, and what a query reports of itself.

Row counts of a stage come from ``DataFrame.observe``, so they cost no further pass over the rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TIMINGS = "stage string, millis double, rows long, failed long"


class Timings:
    """Times of one batch's stages; a stage may observe ``rows`` and ``failed`` of a frame it writes."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float, int | None, int | None]] = []

    @contextmanager
    def stage(self, name: str, counted: bool = False) -> Iterator[Observation]:
        """A stage that ends with an error is timed, too; one that is ``counted`` must execute the frame it observes."""
        seen, counts, began = Observation(), {}, time.perf_counter()
        try:
            yield seen
            counts = seen.get if counted else {}
        finally:
            self.rows.append((name, (time.perf_counter() - began) * 1000, counts.get("rows"), counts.get("failed")))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, TIMINGS)


def latency(timings: DataFrame) -> DataFrame:
    """(stage, batches, rows, failed, avg_ms, max_ms, total_ms) of a stream's ``timings`` table."""
    return timings.groupBy("stage").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("rows").alias("rows"),
        F.sum("failed").alias("failed"),
        F.avg("millis").alias("avg_ms"),
        F.max("millis").alias("max_ms"),
        F.sum("millis").alias("total_ms"),
    )


def latency_metrics(timings: DataFrame) -> DataFrame:
    """The same in the long form of the operational metrics: (metric, dimension, value)."""
    names = ["batches", "avg_ms", "max_ms", "total_ms"]
    cells = F.array(*[F.struct(F.lit(f"latency_{n}").alias("metric"), F.col("stage").alias("dimension"), F.col(n).cast("double").alias("value")) for n in names])
    return latency(timings).select(F.explode(cells).alias("r")).select("r.*")


def progress(spark: SparkSession, query) -> DataFrame:
    """What a streaming query reports of its last batches (Spark keeps a bounded number of them): (batch_id, input_rows, phase, millis)."""
    rows = [(p["batchId"], p["numInputRows"], phase, float(ms)) for p in query.recentProgress for phase, ms in p["durationMs"].items()]
    return spark.createDataFrame(rows, "batch_id long, input_rows long, phase string, millis double")
