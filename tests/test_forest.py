"""Isolation forest: planted outliers rank first, anomaly fraction, determinism."""

import random

from pyspark.sql import functions as F

from vigil.operators.forest import decision_function, fit_forest
from vigil.schema import FEATURE_COLUMNS


def _frame(spark, n=2000, outliers=20, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        out = i < outliers
        vals = [rnd.gauss(50 if out else 0, 1) for _ in FEATURE_COLUMNS]
        rows.append((f"e{i}", out, *vals))
    schema = "event_id string, outlier boolean, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    return spark.createDataFrame(rows, schema)


def test_outliers_and_fraction(spark):
    df = _frame(spark)
    forest = fit_forest(df, trees=50, contamination=0.08, seed=42)
    s = decision_function(df, forest).cache()
    top = s.orderBy("raw_score").limit(20).select("outlier").collect()
    assert all(r["outlier"] for r in top)
    frac = s.agg(F.avg((F.col("raw_score") < 0).cast("double"))).first()[0]
    assert abs(frac - 0.08) <= 0.01


def test_same_seed_same_trees(spark):
    df = _frame(spark, n=600)
    a = fit_forest(df.repartition(1), trees=10, seed=9).nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    b = fit_forest(df.repartition(7), trees=10, seed=9).nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    assert a.equals(b)
