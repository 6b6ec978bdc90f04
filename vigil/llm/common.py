"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = string.ascii_uppercase


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def without(df: DataFrame, names) -> DataFrame:
    """``df`` less the columns an operator is about to add (names compare as Spark compares them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bound_batches(spark) -> None:
    """Python workers get Arrow batches of at most 2,000 rows and about 16 MB: texts may be long.

    A session setting; smaller ones stay.
    """
    for key, most in BATCH_LIMITS.items():
        now = int(spark.conf.get(key).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_labels(n: int, a: np.ndarray, b: np.ndarray, lab: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each of ``n`` items' component under the links ``a[i]-b[i]`` (and earlier labels)."""
    lab = np.arange(n) if lab is None else lab
    while a.size:
        la, lb = lab[a], lab[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while (up := lab[lab]).tobytes() != lab.tobytes():
            lab = up
    return lab
