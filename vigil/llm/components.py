"""Connected components of an edge table by alternating star contractions.

Every round links each vertex's neighbours to its smallest neighbour (first the larger neighbours,
then the smaller ones) until only stars around each component's smallest vertex are left. The work
is joins and map-side combined minimums, so a hub vertex is split by the adaptive skew join and no
neighbour list is ever gathered. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import discard, materialize


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = (
        both.join(least, "a")
        .filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        .distinct()
    )
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    return (
        joined.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
        .filter("a != b")
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (two columns of one orderable type) -> (vertex, component).

    ``component`` is the smallest vertex reachable. Null ends, self links and repeated links are
    ignored; an empty table gives an empty result.
    """
    x, y = (F.col(f"`{c}`") for c in edges.columns[:2])
    now = materialize(
        edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .filter(x.isNotNull() & y.isNotNull() & (x != y))
        .distinct(),
        "llm-links",
    )
    seen = _print(now)
    while seen[0]:
        after = materialize(_round(now), "llm-links")
        discard(now)
        now, before, seen = after, seen, _print(after)
        if seen == before:
            break
    ends = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
