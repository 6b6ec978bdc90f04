"""Written intermediate tables in the shared checkpoint folder.

Stage boundaries of the detection job (feature table, sessionized alerts) are
written as Parquet under ``spark.checkpoint.dir`` and read back: this cuts the
lineage (a lost executor recomputes from the written table, not from the raw
events), lets later stages prune columns, and keeps query plans small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, f"vigil/{name}-{uuid.uuid4().hex[:16]}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    folder, files = _hadoop(spark, path)
    files.deleteOnExit(folder)  # what discard doesn't delete goes when the session ends
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_folder = path
    return table


ROWS_A_TASK = 50_000


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """A stored ``table`` dealt out by ``keys`` over tasks of about ``ROWS_A_TASK`` rows, and at least as many as
    the cluster runs at once. Its files can't tell: a large one may hold few row groups, which no reader splits."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(cores, -(-table.count() // ROWS_A_TASK)), *keys)


def sorted_join(table: DataFrame) -> DataFrame:
    """``table`` as a join side that grows with the data: never broadcast through the driver. Spark goes by compressed
    sizes, under which rows of many times the threshold pass it."""
    return table.hint("merge")


def _hadoop(spark, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned, once nothing reads it any more."""
    folder, files = _hadoop(table.sparkSession, table.__dict__["scratch_folder"])
    files.delete(folder, True)
