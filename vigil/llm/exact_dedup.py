"""Exact duplicates by skew-safe combining.

Rows are combined in three steps, the largest id winning each time and the whole normalised text
being part of every grouping key, so equal digests of different texts never merge: first inside each
task (map-side combine), then by (digest, salt), which splits a hot text over ``salts`` tasks, then
the salt winners by digest. The salt follows from the task, so a task passes on one copy of a text.
Only the winners of texts that occur more than once are kept and joined back by digest. Where one digest turns out to stand for several texts, that join compares
the texts as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize
from .common import ascii_lower, without

OUT = ["keep_id", "group_size", "kept", "text_sha256"]


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """All rows and columns of ``df`` plus keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest id of a group stays. Rows that share an id are one document: they get the same flag. A
    null id is below all others; in a group of null ids only, keep_id is null and all rows stay.
    Input columns named like an output column are replaced; an empty table gives an empty result.
    ``digest`` (default SHA-256) only spreads the work: a weaker one gives the same result.
    """
    norm = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    base = without(df, OUT)
    keyed = base.withColumn("_norm", norm).withColumn("text_sha256", F.sha2("_norm", 256))
    keyed = keyed.withColumn("_digest", digest(F.col("_norm")) if digest else F.col("text_sha256"))
    ident = F.col(f"`{id_col}`")

    def winners(rows: DataFrame) -> DataFrame:
        salted = (
            rows.select(ident.alias("_id"), "_norm", "_digest")
            .withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
            .groupBy("_digest", "_salt", "_norm")
            .agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
        )
        return (
            salted.repartition("_digest")
            .groupBy("_digest", "_norm")
            .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        )

    groups = materialize(
        winners(keyed)
        .groupBy("_digest")
        .agg(F.count("*").alias("_texts"), F.max("_keep").alias("_keep"), F.max("_n").alias("_n"))
        .filter("_texts > 1 or _n > 1"),
        "llm-exact-groups",
    )
    clash = groups.filter("_texts > 1").select("_digest")
    if clash.isEmpty():
        joined = keyed.drop("_norm").join(groups.drop("_texts"), "_digest", "left")
    else:
        shared = winners(keyed.join(clash, "_digest", "left_semi"))
        single = groups.filter("_texts = 1").select("_digest", F.lit(None).cast("string").alias("_same"), "_keep", "_n")
        shared = single.unionByName(shared.withColumnRenamed("_norm", "_same"))
        left, right = keyed.alias("l"), shared.alias("r")
        on = (F.col("l._digest") == F.col("r._digest")) & (
            F.col("r._same").isNull() | (F.col("l._norm") == F.col("r._same"))
        )
        joined = left.join(right, on, "left").drop(F.col("r._digest")).drop("_same")
    return joined.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.when(F.col("_n") > 1, F.col("_keep")).otherwise(ident).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("_n") > 1, F.col("_keep").eqNullSafe(ident)).otherwise(True).alias("kept"),
        "text_sha256",
    )
