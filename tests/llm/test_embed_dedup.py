import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm import plain
from vigil.llm import embed_dedup
from vigil.llm.embed_dedup import compare, embedding_dedup, near_blocks, principal_axes
from vigil.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    """rows: (vec_id, vector, label) -> per row (vec_id, n_links, component_id, kept)."""
    x = [None if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, np.float32).astype(float) for _, v, _ in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if x[a] is None or x[b] is None or rows[a][2] is None or rows[a][2] != rows[b][2] or len(x[a]) != len(x[b]):
                continue
            if x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= cosine:
                links.append((a, b))
    comp = plain.components(range(len(rows)), links)
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows)) if links else np.zeros(len(rows), int)
    out = []
    for a, (i, _, _) in enumerate(rows):
        least = min((rows[b][0] for b in comp if comp[b] == comp[a] and rows[b][0] is not None), default=None)
        out.append((i, int(n[a]), least, i == least))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def clustered(seed, n, dim=16, copies=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.25, size=(n, dim))
    x[:copies] = x[0]
    label = rng.integers(0, 3, n)
    label[: n // 3] = 1
    return [(int(i), [float(np.float32(v)) for v in row], int(k)) for i, row, k in zip(rng.permutation(n), x, label)]


@pytest.mark.parametrize("block", [8, 256])
def test_matches_brute_force(spark, block):
    rows = clustered(1, 400)
    want = brute(rows)
    assert sum(r[1] for r in want) > 1000
    assert got(embedding_dedup(spark.createDataFrame(rows, SCHEMA), block=block)) == want


NAN, INF = float("nan"), float("inf")
ODD = [
    (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1),
    (7, [NAN, 1.0], 1), (8, [INF, 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.1], 1), (12, [-1.0, 0.0], 1),
    (None, [1.0, 0.05], 1), (14, [1.0, 0.0], 2), (2, [2.0, 0.0], 1), (15, [-0.0, 3.0], 2), (16, [0.0, 3.0], 2),
]


@pytest.mark.parametrize("rows", [ODD, [], [(None, [1.0, 2.0], 1)] * 3, ODD[:1], [(i, [1.0, 1.0], 5) for i in range(30)]])
def test_odd_rows(spark, rows):
    assert got(embedding_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_very_large_and_small_components(spark):
    """Cosines of exact fractions, so the size of the components can't matter."""
    from fractions import Fraction

    rng = np.random.default_rng(8)
    sizes = [1e200, 1e-200, 1.0, 1e307, 1e-310, 3e-320]
    rows = [(k, [float(np.round(v, 2)) * sizes[k % 6] for v in rng.normal(size=3)], 1 + k % 2) for k in range(90)]
    rows += [(100, [1e200, 2e200, 3e200], 1), (101, [2e200, 4e200, 6e200], 1), (102, [1e-200, 2e-200, 3e-200], 1), (103, [5e-324, 1e-323, 1.5e-323], 1)]
    rows += [(104, [1e300, 1e-300, 0.0], 1), (105, [3.0, 0.0, 0.0], 1), (106, [1.7e308, -1.7e308, 1.7e308], 2), (107, [1e-5, -1e-5, 1e-5], 2)]
    exact = [[Fraction(v) for v in x] for _, x, _ in rows]

    def near(a, b):
        dot = sum(p * q for p, q in zip(exact[a], exact[b]))
        squares = sum(p * p for p in exact[a]) * sum(q * q for q in exact[b])
        return dot > 0 and dot * dot >= Fraction(93, 100) ** 2 * squares

    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][2] == rows[b][2] and near(a, b)]
    comp = plain.components(range(len(rows)), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    least = {c: min(rows[k][0] for k in comp if comp[k] == c) for c in set(comp.values())}
    want = [(rows[k][0], int(n[k]), least[comp[k]], rows[k][0] == least[comp[k]]) for k in range(len(rows))]
    assert n[90] >= 3
    assert got(embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == sorted(want, key=repr)


def test_axes_come_from_a_bounded_sample(spark, monkeypatch):
    rng = np.random.default_rng(9)
    wide = [(k, rng.normal(size=1024).tolist(), 1) for k in range(40)] + [(50 + k, rng.normal(size=3).tolist(), 1) for k in range(9)]
    points = spark.createDataFrame(wide, "vec_id long, vector array<double>, label int")
    axes = principal_axes(points, values=20 * 2 * 1024)
    assert {d: a.shape for d, a in axes.items()} == {1024: (1024, 6), 3: (3, 3)}
    assert all(np.allclose(a.T @ a, np.eye(a.shape[1])) for a in axes.values())
    # dimensions beyond the most frequent ones have no axes of their own
    assert set(principal_axes(points, dims=1)) == {1024} and principal_axes(points.limit(0)) == {}
    rows = [(k, v, 1) for k, (_, v, _) in enumerate(clustered(3, 60, dim=4) + clustered(4, 60, dim=9) + clustered(5, 30, dim=12))]
    want = brute(rows)
    for dims in (1, 2):
        monkeypatch.setattr(embed_dedup, "principal_axes", lambda p, d=dims: principal_axes(p, dims=d))
        assert got(embedding_dedup(spark.createDataFrame(rows, SCHEMA))) == want


def test_clashing_columns(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({"KEPT": F.lit(1), "n": F.lit(1), "links": F.lit(2), "component": F.lit(3)})
    out = embedding_dedup(df)
    assert got(out) == brute(ODD) and {"n", "links", "component"} <= set(out.columns)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    x = np.array([r[1] for r in rows], float)
    near = (x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) >= 0.93
    label = np.array([r[2] for r in rows])
    near &= label[:, None] == label
    np.fill_diagonal(near, False)
    assert {r[0]: r[1] for r in got(QUERIES["op1_epsilon_grid_join"](spark, SF_SMALL))} == {r[0]: int(n) for r, n in zip(rows, near.sum(1))}


def test_interval_recursion_keeps_all_near_blocks(spark):
    rng = np.random.default_rng(0)
    lo = rng.normal(size=(300, 6))
    lo[:, 0] = np.sort(lo[:, 0])
    hi = lo + rng.random((300, 6)) * 0.2
    block = [(k // 40) * (1 << 24) + k % 40 for k in range(300)]
    columns = [f"lo{k}" for k in range(6)] + [f"hi{k}" for k in range(6)]
    rows = [(k % 2, 6, block[k], *lo[k].tolist(), *hi[k].tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, ["label", "dim", "block", *columns])
    found = {(r.a, r.b) for r in near_blocks(df, 0.7, fan=2).collect()}
    gap = np.maximum(0, np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]))
    near = (gap**2).sum(-1) <= 0.49
    assert found == {(block[a], block[b]) for a in range(300) for b in range(a, 300) if near[a, b] and a % 2 == b % 2}


def test_compare_skips_nothing_near():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 4))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    i, j = compare(x, x, x, x, True, 0.93, np.sqrt(0.14))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(a.tolist(), b.tolist()))
