"""Sharding by jump consistent hashing, with gapless slots inside every shard.

A shard is a function of the key and the shard count alone, so no ring table exists, and going from
``n`` to ``n + 1`` shards moves only the rows that land in the new shard. Slots are dealt in two
levels: rows are numbered inside (shard, bucket), and a bucket's first slot is the running count of
the buckets before it, so no shard is ever sorted as a whole by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import without

OUT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard (0 to ``shards`` - 1) of every unsigned 64-bit key."""
    key = keys.astype(np.uint64)
    at, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while live.size:
        at[live] = ahead[live]
        key[live] = key[live] * STEP + np.uint64(1)
        draw = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def stable_key(col: Column) -> Column:
    """60 bits of the MD5 of the value's text; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return shard(key)


def shard_by_key(
    df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int = 512
) -> DataFrame:
    """All rows and columns of ``df`` plus size, text_crc32, law, shard, slot and grown_shard.

    ``size`` is the UTF-8 length plus 1 and ``text_crc32`` the unsigned CRC-32 (null: as empty).
    Rows with the same id share a shard; a null id is hashed as the empty text. Slots run from 0
    without gaps in each shard, in an order set by id and text; equal rows may swap slots. Input
    columns named like an output column are replaced. An empty table gives an empty result.
    ``buckets`` is the number of sort groups in a shard and doesn't change any shard.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = stable_key(F.col(f"`{id_col}`"))
    rows = (
        without(df, OUT)
        .withColumns({"_key": key, "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
        .withColumns({"shard": jump_shard(F.col("_key"), shards), "grown_shard": jump_shard(F.col("_key"), shards + 1)})
        .withColumn("_bucket", F.pmod(F.xxhash64("_key", "text_crc32"), F.lit(buckets)))
    )
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", "text_crc32")
    return (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(first, ["shard", "_bucket"])
        .select(
            *[F.col(f"`{c}`") for c in without(df, OUT).columns],
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_first") + F.col("_rank")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
