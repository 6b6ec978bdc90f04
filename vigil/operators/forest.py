"""Isolation forest on Spark (Liu, Ting and Zhou, 2008): fit, score, metadata.

Fit:
  1. one narrow pass draws the per-tree subsamples: one hash decides how many
     trees a row is drawn for (mostly none), and only drawn rows are hashed again
     to pick them (about 1.5 * psi rows per tree, no n x trees cross join), then
     ``row_number`` by hash inside each tree keeps psi rows;
  2. ``groupBy(tree_id).applyInPandas`` grows each tree from its <= psi rows
     (random feature, uniform split between the node's min and max, depth
     limit ceil(log2 psi)); trees come back as a node table.
Score:
  the node table (at most trees * (2 psi - 1) rows, independent of the data
  size) is broadcast; a pandas UDF walks all trees for a batch of rows with
  numpy and returns the mean path length. The raw decision value is
  ``-2^(-E[h]/c(psi)) - offset`` with ``offset`` the contamination quantile of
  the training scores, so "anomaly" is ``raw < 0``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FEATURE_COLUMNS
from ..sources.store import materialize
from .quantiles import exact_quantiles

EULER_GAMMA = 0.5772156649015329
HASH_MODULUS = 1 << 30

NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree_id", T.IntegerType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
    ]
)


def average_path_length(n) -> np.ndarray:
    """c(n): expected path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


def _grow(x: np.ndarray, rng: np.random.RandomState, max_depth: int) -> list[tuple]:
    """Nodes (node_id, feature, threshold, left, right, size, depth) of one isolation tree."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, None, None)]
    while stack:
        idx, depth, parent, side = stack.pop()
        node_id = len(nodes)
        nodes.append([node_id, -1, 0.0, -1, -1, int(len(idx)), depth])
        if parent is not None:
            nodes[parent][3 if side == "L" else 4] = node_id
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if len(candidates) == 0:
            continue
        f = int(candidates[rng.randint(len(candidates))])
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        nodes[node_id][1] = f
        nodes[node_id][2] = thr
        stack.append((idx[~go_left], depth + 1, node_id, "R"))
        stack.append((idx[go_left], depth + 1, node_id, "L"))
    return [tuple(n) for n in nodes]


@dataclass
class Forest:
    nodes: pd.DataFrame  # NODE_SCHEMA columns
    sample_size: int
    offset: float
    trees: int
    features: list[str]
    training_rows: int
    contamination: float
    seed: int

    def arrays(self):
        """The trees as complete binary trees of one depth (children of i: 2i + 1, 2i + 2), a leaf's value at all places
        of the last level below it, so that every row takes the same number of steps."""
        depth, t = int(self.nodes["depth"].max()), self.trees
        inner = (1 << depth) - 1
        feat, thr, leaf_add = np.zeros((t, inner), dtype=np.int64), np.zeros((t, inner)), np.zeros((t, inner + 1))
        for tree, nodes in self.nodes.groupby("tree_id"):
            nodes = nodes.set_index("node_id")
            feature, threshold = nodes["feature"].to_dict(), nodes["threshold"].to_dict()
            left, right = nodes["left"].to_dict(), nodes["right"].to_dict()
            value = dict(zip(nodes.index, nodes["depth"].to_numpy() + average_path_length(nodes["size"].to_numpy())))
            stack = [(0, 0, 0)]
            while stack:
                node, place, level = stack.pop()
                if feature[node] >= 0:
                    feat[tree, place], thr[tree, place] = feature[node], threshold[node]
                    stack += [(left[node], 2 * place + 1, level + 1), (right[node], 2 * place + 2, level + 1)]
                else:
                    width = 1 << (depth - level)
                    first = ((place + 1) << (depth - level)) - 1 - inner
                    leaf_add[tree, first : first + width] = value[node]
        return feat, thr, leaf_add, depth


SCORED_AT_ONCE = 4096  # rows whose values and places stay in a core's cache


def _path_lengths(x: np.ndarray, arrays) -> np.ndarray:
    feat, thr, leaf_add, depth = arrays
    total = np.zeros(len(x))
    for first in range(0, len(x), SCORED_AT_ONCE):
        part = np.ascontiguousarray(x[first : first + SCORED_AT_ONCE])
        values, row = part.ravel(), np.arange(len(part)) * x.shape[1]
        for t in range(feat.shape[0]):
            node = np.zeros(len(part), dtype=np.int64)
            for _ in range(depth):
                # right unless the value is below the threshold (a missing one isn't)
                below = values.take(feat[t].take(node) + row) < thr[t].take(node)
                node = 2 * node + 2 - below
            total[first : first + SCORED_AT_ONCE] += leaf_add[t].take(node - len(thr[t]))
    return total / feat.shape[0]


def sample_for_trees(df: DataFrame, n_rows: int, trees: int, psi: int, seed: int, id_col: str, boost: float = 1.0) -> DataFrame:
    """``(tree_id, features...)``: exactly ``psi`` rows per tree (all rows when n <= psi)."""
    feats = [F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS]
    if n_rows <= psi:
        return df.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree_id"), *feats)
    p = min(1.0, boost * (1.5 * psi / n_rows + 64.0 / n_rows))
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    if p < 1.0:
        # so many draws, with repeats, that a row reaches each tree with probability p
        mean = p if trees == 1 else math.log1p(-p) / math.log1p(-1.0 / trees)
        extra = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(-1)), F.lit(HASH_MODULUS)) < int((mean % 1) * HASH_MODULUS)
        df = df.withColumn("_draws", F.lit(int(mean)) + extra.cast("int")).where("_draws > 0")
        pick = lambda j: F.pmod(F.xxhash64(F.col(id_col), j, F.lit(seed)), F.lit(trees)).cast("int")
        every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_draws")), pick))
    cand = df.select(F.explode(every).alias("tree_id"), F.col(id_col), *feats)
    cand = cand.withColumn("_h", F.xxhash64(F.col(id_col), F.col("tree_id"), F.lit(seed + 1)))
    w = Window.partitionBy("tree_id").orderBy("_h", id_col)
    return cand.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= psi).drop("_rk", "_h", id_col)


def fit_forest(
    train: DataFrame,
    *,
    trees: int = 200,
    sample_size: int = 256,
    contamination: float = 0.08,
    seed: int = 42,
    id_col: str = "event_id",
) -> Forest:
    """Fit on the 16 feature columns of ``train`` (booleans as 0/1)."""
    return fit_and_score(train, trees=trees, sample_size=sample_size, contamination=contamination, seed=seed, id_col=id_col)[0]


def fit_and_score(
    train: DataFrame, *, trees: int, sample_size: int = 256, contamination: float, seed: int, id_col: str = "event_id"
) -> tuple[Forest, DataFrame]:
    """The forest, and the training rows with their raw decision values, written once (as ``decision_function`` gives them)."""
    n = train.count()
    if n == 0:
        raise ValueError("no training rows")
    psi = min(sample_size, n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    boost = 1.0
    while True:
        # written once: the check below and the growing of the trees read the same draw
        sample = materialize(sample_for_trees(train, n, trees, psi, seed, id_col, boost), "tree-sample")
        # every tree must hold exactly psi rows; a short draw is redrawn at a higher rate
        # (at rate 1 every row is a candidate, so this ends)
        full = sample.groupBy("tree_id").count().where(F.col("count") == psi).count()
        if full == trees or boost * (1.5 * psi / n) >= 1.0:
            break
        boost *= 2.0

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        x = pdf[FEATURE_COLUMNS].to_numpy(dtype=float)
        rng = np.random.RandomState((seed * 1_000_003 + tree_id) % (2**32))
        rows = _grow(x, rng, max_depth)
        out = pd.DataFrame(rows, columns=["node_id", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree_id", tree_id)
        return out.astype({"tree_id": "int32", "node_id": "int32", "feature": "int32", "left": "int32", "right": "int32", "size": "int32", "depth": "int32"})

    # Bounded by trees * (2 * psi - 1) rows whatever the training size.
    nodes = sample.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA).toPandas()
    forest = Forest(nodes, psi, 0.0, trees, list(FEATURE_COLUMNS), n, contamination, seed)
    # every row walks the trees once: the offset and the caller's statistics read the written scores
    scores = materialize(score_samples(train, forest), "training-scores")
    forest.offset = float(exact_quantiles(scores, {"o": (F.col("_s"), [contamination])}).first()["o"][0])
    return forest, _decided(scores, forest)


def _score_udf(forest: Forest):
    spark_ctx = None
    from pyspark import SparkContext

    spark_ctx = SparkContext.getOrCreate()
    bc = spark_ctx.broadcast(forest.arrays())
    cpsi = float(average_path_length([forest.sample_size])[0])

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        h = _path_lengths(x, bc.value)
        return pd.Series(-np.power(2.0, -h / cpsi))

    return score


def score_samples(df: DataFrame, forest: Forest, out: str = "_s") -> DataFrame:
    """Add ``out`` = -(anomaly score in (0, 1]) like scikit-learn's ``score_samples``."""
    udf = _score_udf(forest)
    return df.withColumn(out, udf(*[F.col(c).cast("double") for c in forest.features]))


def decision_function(df: DataFrame, forest: Forest, out: str = "raw_score") -> DataFrame:
    """Add the raw decision value (negative = anomaly)."""
    return _decided(score_samples(df, forest, "_s"), forest, out)


def _decided(scores: DataFrame, forest: Forest, out: str = "raw_score") -> DataFrame:
    return scores.withColumn(out, F.col("_s") - F.lit(forest.offset)).drop("_s")


def nodes_frame(spark, forest: Forest) -> DataFrame:
    return spark.createDataFrame(forest.nodes, NODE_SCHEMA)


def save_forest(spark, forest: Forest, path: str) -> None:
    """Trees as Parquet, parameters as one-row JSON."""
    nodes_frame(spark, forest).write.mode("overwrite").parquet(f"{path}/trees")
    params = spark.createDataFrame(
        [(forest.sample_size, forest.offset, forest.trees, forest.training_rows, forest.contamination, forest.seed)],
        "sample_size int, offset double, trees int, training_rows long, contamination double, seed int",
    )
    params.coalesce(1).write.mode("overwrite").json(f"{path}/params")


def load_forest(spark, path: str) -> Forest | None:
    """The saved forest, or None when the artifact is absent (the no-model path)."""
    try:
        nodes = spark.read.parquet(f"{path}/trees").toPandas()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    p = spark.read.json(f"{path}/params").first()
    return Forest(nodes, int(p["sample_size"]), float(p["offset"]), int(p["trees"]), list(FEATURE_COLUMNS),
                  int(p["training_rows"]), float(p["contamination"]), int(p["seed"]))
