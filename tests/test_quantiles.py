"""Exact distributed quantiles: ties, one row, nulls, many partitions, one hot value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators.quantiles import exact_quantiles

QS = [0.0, 0.08, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("seed, n, parts", [(0, 1, 1), (1, 2, 3), (2, 997, 40), (3, 5000, 17)])
def test_matches_linear_interpolation(spark, seed, n, parts):
    rng = np.random.default_rng(seed)
    hot = np.where(rng.random(n) < 0.6, 3.0, rng.integers(0, 9, n).astype(float))
    rows = [(float(a), float(b), None if k % 3 == 0 and n > 2 else float(b)) for k, (a, b) in enumerate(zip(rng.normal(size=n), hot))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(parts)
    got = exact_quantiles(df, {x: (F.col(x), QS) for x in "abc"}).first()
    for k, x in enumerate("abc"):
        want = np.quantile([r[k] for r in rows if r[k] is not None], QS)
        assert np.allclose(got[x], want, rtol=0, atol=1e-12)


def test_empty_column_gives_nulls(spark):
    df = spark.createDataFrame([(None, 1)], "a double, b int")
    row = exact_quantiles(df, {"a": (F.col("a"), [0.5]), "b": (F.col("b"), [0.5, 1.0])}).first()
    assert row.a == [None] and row.b == [1.0, 1.0]
