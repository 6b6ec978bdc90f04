"""The first n rows of an order for any n, without gathering them in one task.

The value at rank n is found from counts per value, range-partitioned with running counts; rows
before it are kept by a filter, rows that share it are cut by the next column of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import discard, materialize


def value_at_rank(df: DataFrame, column: Column, rank: int) -> tuple[object, int] | None:
    """The ``rank``-th smallest value (from 1) and the number of rows with smaller ones; None beyond the last row."""
    counts = df.groupBy(column.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(counts.repartitionByRange("v").withColumn("b", F.spark_partition_id()), "rank-counts")
    # a row per range
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("b").agg(F.sum("n").alias("t")).select("b", "t", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("first"))
    hit = ranges.where((F.col("first") < rank) & (F.col("first") + F.col("t") >= rank)).first()
    found = None
    if hit is not None:
        upto = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        inside = ranged.where(F.col("b") == hit.b).withColumn("start", F.lit(hit["first"]) + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        row = inside.where((F.col("start") < rank) & (F.col("start") + F.col("n") >= rank)).first()
        found = row.v, row.start
    discard(ranged)
    return found


def first_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The ``n`` first rows by ``order`` (ascending; negate a number to descend), in no order.

    ``order`` should tell all rows apart; of rows that share all of it, those at rank n all stay.
    Nulls come last.
    """
    if n <= 0:
        return df.limit(0)
    kept, tied = F.lit(False), F.lit(True)
    for column in order:
        rows = df.where(tied & column.isNotNull())
        cut = value_at_rank(rows, column, n)
        if cut is None:
            # all rows with a value are among the first; those without follow
            n -= rows.count()
            kept = kept | (tied & column.isNotNull())
            tied = tied & column.isNull()
            if n <= 0:
                return df.where(kept)
            continue
        value, smaller = cut
        kept = kept | (tied & (column < F.lit(value)))
        tied = tied & (column == F.lit(value))
        n -= smaller
    return df.where(F.coalesce(kept | tied, F.lit(False)))
