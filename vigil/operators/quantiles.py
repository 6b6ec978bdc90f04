"""Exact quantiles of many columns at once, by one path at every size.

Values are counted (map-side combined), the distinct values are range-partitioned by column and
value, and each range's rows get a running count on top of the counts of the ranges before it. The
values at the ranks next to ``q * (n - 1)`` are then picked and interpolated. No task holds more than
a range of the distinct values, and only one row per column and quantile is left at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import discard, materialize


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> DataFrame:
    """One row with a column ``<name>`` (array of doubles, in the order asked for) per entry.

    ``wanted`` maps a name to a numeric column and its quantiles in [0, 1]. Values between two ranks
    are interpolated linearly; nulls are left out, and a column without values gives nulls.
    """
    names = list(wanted)
    cells = F.array(*[F.struct(F.lit(k).alias("c"), col.cast("double").alias("v")) for k, (col, _) in enumerate(wanted.values())])
    counts = (
        df.select(F.explode(cells).alias("e"))
        .select("e.c", "e.v")
        .where("v is not null")
        .groupBy("c", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranged = materialize(counts.repartitionByRange("c", "v").withColumn("b", F.spark_partition_id()), "value-counts")
    totals = ranged.groupBy("c", "b").agg(F.sum("n").alias("t"))
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "c",
        "b",
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("first"),
        F.sum("t").over(Window.partitionBy("c")).alias("rows"),
    )
    upto = Window.partitionBy("c", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("inside", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(totals, ["c", "b"])
    start = F.col("first") + F.col("inside")
    spark = df.sparkSession
    asked = spark.createDataFrame(
        [(k, j, float(q)) for k, (_, qs) in enumerate(wanted.values()) for j, q in enumerate(qs)], "c int, j int, q double"
    )
    # one row per column and quantile asked for
    near = ranked.join(F.broadcast(asked), "c").withColumn("at", F.col("q") * (F.col("rows") - 1))

    def covers(rank: Column) -> Column:
        return (rank >= start) & (rank < start + F.col("n"))

    low, high = F.floor("at"), F.ceil("at")
    picked = (
        near.where(covers(low) | covers(high))
        .groupBy("c", "j")
        .agg(
            F.max("at").alias("at"),
            F.max(F.when(covers(low), F.col("v"))).alias("low"),
            F.max(F.when(covers(high), F.col("v"))).alias("high"),
        )
    )
    part = F.col("at") - F.floor("at")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        (F.ceil("at") - F.col("at")) * F.col("low") + part * F.col("high")
    )
    picked = picked.withColumn("value", value)
    result = picked.agg(
        *[
            F.array(
                *[F.max(F.when((F.col("c") == k) & (F.col("j") == j), F.col("value"))) for j in range(len(wanted[name][1]))]
            ).alias(name)
            for k, name in enumerate(names)
        ]
    )
    result = materialize(result, "quantiles")  # one row, so that the counts can go
    discard(ranged)
    return result
