"""Embedding near-duplicates by an epsilon grid order join.

Two unit vectors whose cosine reaches the threshold lie within eps = sqrt(2 - 2 * threshold) of each
other, and so do their projections on the leading principal axes.

1. Equal vectors of one label become one point with a count.
2. The principal axes come from a bounded sample of the points; they decide what is skipped, not what links.
3. Points are sorted by label and by the cells of a grid of side eps on the leading axes (epsilon
   grid order) and cut into blocks, intervals of that order, each with its bounding box.
4. Blocks are joined by recursion over intervals: pairs of coarse intervals whose boxes are farther
   apart than eps are skipped with all they hold, the others are split, down to pairs of blocks.
5. A task that holds two blocks goes on splitting in the same way and compares the vectors of what is
   left in double precision. It returns each vector's number of links and a spanning set of links.
6. Connected components join the spanning links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize
from .common import bound_batches, join_labels, without
from .components import connected_components

OUT = ["n_links", "component_id", "kept"]
BLOCK = 1024
LEAF = 128
AXES = 6
PER_TASK = 1 << 24  # blocks a sorted partition may hold
SLACK = 1e-9


def scaled_rows(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1, so that squares neither overflow nor vanish.

    Powers of two leave every cosine as it is, bit by bit.
    """
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = scaled_rows(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(points: DataFrame, axes: int = AXES, values: int = 4_000_000, vectors: int = 4096, dims: int = 64) -> dict[int, np.ndarray]:
    """Leading principal axes (dimension x axes) of a sample of the vectors of each of the ``dims`` most frequent dimensions.

    The sample, taken in the order of the vectors' hashes, has at most ``vectors`` vectors a dimension
    and about ``values`` numbers in all. Axes only decide how much is skipped; any orthonormal axes are right.
    """
    spark = points.sparkSession
    size = F.size("vector").alias("dim")
    sizes = points.groupBy(size).count().orderBy(F.desc("count"), "dim").limit(dims).collect()
    if not sizes:
        return {}
    bounds = []
    for r in sizes:
        most = max(2 * axes, min(vectors, values // (len(sizes) * r.dim)))
        bounds.append((r.dim, min(2**63 - 1, 2**63 * 4 * most // r["count"]), most))
    bounds = F.broadcast(spark.createDataFrame(bounds, "dim int, bound long, most int"))  # a row per dimension
    order = F.shiftrightunsigned(F.xxhash64("vector"), 1).alias("order")
    some = points.select(size, order, "vector").join(bounds, "dim").filter("order <= bound")
    some = some.groupBy("dim", "most", "order").agg(F.min("vector").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy("order"))
    some = some.withColumn("rank", rank).filter("rank <= most").orderBy("dim", "order").select("vector").toArrow()
    out = {}
    for dim, x in by_dimension(some.column("vector").combine_chunks()):
        x = unit_rows(x)
        _, _, across = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        out[dim] = np.ascontiguousarray(across[:axes].T)
    return out


def by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a list column as one double matrix per dimension, in row order within it."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        part = column if (lengths == dim).all() else column.filter(pa.array(lengths == dim))
        yield dim, part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def project(x: np.ndarray, axes: np.ndarray | None, width: int) -> np.ndarray:
    """Projections of vectors (without axes: their first components); axes that a short vector lacks are zero."""
    p = unit_rows(x) @ axes if axes is not None else unit_rows(x)[:, :width]
    return np.pad(p, ((0, 0), (0, width - p.shape[1])))


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), matrix.shape[1]).cast(pa.list_(kind))


def grid_order(points: DataFrame, axes: dict[int, np.ndarray], eps: float, block: int = BLOCK) -> DataFrame:
    """Points (label, vector, first_id, n) in epsilon grid order, numbered: adds dim, block, at and box coordinates p."""
    shared = points.sparkSession.sparkContext.broadcast(axes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            p = np.zeros((batch.num_rows, AXES))
            for dim, x in by_dimension(batch.column(1)):
                p[lengths == dim] = project(x, shared.value.get(dim), AXES)
            columns = [*batch.columns, pa.array(lengths.astype(np.int32)), _lists(np.floor(p / eps).astype(np.int32), pa.int32()), _lists(p, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "dim", "cell", "p"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, now, at, last = TaskContext.get().partitionId() * PER_TASK, -1, 0, None
        for batch in batches:
            blocks, places = [], []
            for key in zip(batch.column(0).to_pylist(), batch.column(len(names)).to_pylist()):
                if key != last or at + 1 >= block:
                    now, at, last = now + 1, 0, key
                else:
                    at += 1
                blocks.append(first + now)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], [*names, "dim", "p", "block", "at"])

    names = points.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    placed = points.mapInArrow(cells, f"{types}, dim int, cell array<int>, p array<double>")
    ordered = placed.orderBy("label", "dim", "cell", F.xxhash64("vector"), "first_id").drop("cell")
    return ordered.mapInArrow(number, f"{types}, dim int, p array<double>, block long, at int")


# ---------------------------------------------------------------- interval recursion

def _apart(a: str, b: str, eps: float) -> Column:
    """Squared distance of two boxes is beyond eps."""
    gaps = [
        F.greatest(F.col(f"{a}.lo{k}") - F.col(f"{b}.hi{k}"), F.col(f"{b}.lo{k}") - F.col(f"{a}.hi{k}"), F.lit(0.0))
        for k in range(AXES)
    ]
    return reduce(lambda x, y: x + y, [g * g for g in gaps]) > (eps + SLACK) ** 2


def near_blocks(blocks: DataFrame, eps: float, fan: int = 6) -> DataFrame:
    """Blocks (label, dim, block, lo0.., hi0..) -> pairs (a, b), a <= b, whose boxes are within eps.

    An interval of level s holds the blocks with the same number after dropping s low bits. From one
    root per label downwards, each pair of near intervals splits into at most 4 ** ``fan`` pairs.
    """
    boxes = [f"lo{k}" for k in range(AXES)] + [f"hi{k}" for k in range(AXES)]
    spread = [F.min(c).alias(c) if c[0] == "l" else F.max(c).alias(c) for c in boxes]
    low = F.col("block").bitwiseAND(PER_TASK - 1)
    most = blocks.agg(F.max("block").alias("block"), F.max(low).alias("low")).first()
    if most.block is None:
        return blocks.select(F.col("block").alias("a"), F.col("block").alias("b"))
    inner, outer = int(most.low).bit_length(), (int(most.block) // PER_TASK).bit_length()
    bits = PER_TASK.bit_length() - 1
    shifts = [0, *range(fan, inner, fan), *range(bits, bits + outer, fan)]
    pairs = None
    above = None
    for shift in reversed(shifts):
        level = blocks if shift == 0 else (
            blocks.withColumn("block", F.shiftright("block", shift)).groupBy("label", "dim", "block").agg(*spread)
        )
        if pairs is None:
            sides = level.alias("x").join(level.alias("y"), ["label", "dim"])
        else:
            up = above - shift
            child = level.withColumn("parent", F.shiftright("block", up))
            x = child.select("label", "dim", F.col("parent").alias("a"), F.struct("block", *boxes).alias("x"))
            y = child.select("label", "dim", F.col("parent").alias("b"), F.struct("block", *boxes).alias("y"))
            sides = pairs.join(x, ["label", "dim", "a"]).join(y, ["label", "dim", "b"])
        pairs = sides.filter((F.col("x.block") <= F.col("y.block")) & ~_apart("x", "y", eps)).select(
            "label", "dim", F.col("x.block").alias("a"), F.col("y.block").alias("b")
        )
        above = shift
    return pairs.select("a", "b")


def compare(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row of x, row of y) by splitting both intervals and skipping boxes farther apart than eps."""
    x, y = scaled_rows(x), scaled_rows(y)
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    work = [(0, len(x), 0, len(y))]
    while work:
        a, b, c, d = work.pop()
        if same and a >= d:
            continue  # the mirror image of a part that is done
        p, q = px[a:b], py[c:d]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if gap @ gap > (eps + SLACK) ** 2:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero((x[a:b] @ y[c:d].T) / np.outer(nx[a:b], ny[c:d]) >= cosine)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            left.append(i)
            right.append(j)
        elif b - a >= d - c:
            m = (a + b) // 2
            work += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            work += [(a, b, c, m), (a, b, m, d)]
    return np.concatenate(left), np.concatenate(right)


def block_links(cosine: float, eps: float, block: int):
    """mapInArrow function: pairs of blocks with their points -> (vertex, other, links)."""

    def points(cell: pa.StructScalar | pa.ListScalar):
        rows = cell.values
        vectors = rows.field("vector")
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
        p = rows.field("p").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        return x, p, rows.field("n").to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                x, px, nx = points(batch.column(2)[r])
                y, py, ny = (x, px, nx) if a == b else points(batch.column(3)[r])
                i, j = compare(x, y, px, py, a == b, cosine, eps)
                if not i.size:
                    continue
                vertex = a * block + np.arange(len(x))
                if a == b:
                    links = np.bincount(i, ny[j], len(x)) + np.bincount(j, nx[i], len(x))
                    lab = join_labels(len(x), i, j)
                else:
                    vertex = np.concatenate([vertex, b * block + np.arange(len(y))])
                    links = np.concatenate([np.bincount(i, ny[j], len(x)), np.bincount(j, nx[i], len(y))])
                    lab = join_labels(len(vertex), i, j + len(x))
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vertex[some]), pa.array(vertex[lab[some]]), pa.array(links[some].astype(np.int64))],
                    ["vertex", "other", "links"],
                )

    return run


# ---------------------------------------------------------------- operator

def embedding_dedup(
    df: DataFrame,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """All rows and columns of ``df`` plus n_links, component_id and kept.

    Vectors of one label (and dimension) link where their cosine, in double precision, is ``cosine``
    or more, whatever the size of their (finite) components. ``n_links`` counts the other rows linked directly, equal vectors included;
    ``component_id`` is the smallest id reachable (null where all are null), and ``kept`` marks the
    rows with that id. Rows with a null label, and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Rows that share an id are rows of their own. Input
    columns named like an output column are replaced. An empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    eps = float(np.sqrt(2 - 2 * cosine))
    base = without(df, OUT)
    vector, ident = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    usable = F.col(f"`{label_col}`").isNotNull() & F.coalesce(
        F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False)
    )
    points = materialize(
        base.filter(usable)
        .groupBy(F.col(f"`{label_col}`").alias("label"), vector.alias("vector"))
        .agg(F.min(ident).alias("first_id"), F.count("*").alias("n")),
        "llm-vectors",
    )
    ordered = materialize(grid_order(points, principal_axes(points), eps, block), "llm-grid-order")
    corner = [f(F.col("p")[k]).alias(f"{name}{k}") for name, f in (("lo", F.min), ("hi", F.max)) for k in range(AXES)]
    boxes = materialize(ordered.groupBy("label", "dim", "block").agg(*corner), "llm-boxes")
    # a block holds at most ``block`` points
    held = F.sort_array(F.collect_list(F.struct("at", "vector", "p", "n")))
    content = ordered.groupBy("block").agg(held.alias("points"))
    pairs = near_blocks(boxes, eps)
    left = content.select(F.col("block").alias("a"), F.col("points").alias("left"))
    right = content.select(F.col("block").alias("b"), F.col("points").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    found = materialize(joined.mapInArrow(block_links(cosine, eps, block), "vertex long, other long, links long"), "llm-vector-links")

    parts = connected_components(found.select("vertex", "other"))
    sums = found.groupBy("vertex").agg(F.sum("links").alias("links"))
    known = (
        ordered.select("label", "vector", "first_id", "n", (F.col("block") * block + F.col("at")).alias("vertex"))
        .join(sums, "vertex", "left")
        .join(parts, "vertex", "left")
        .filter("n > 1 or links is not null")
        .withColumn("component", F.coalesce("component", "vertex"))
    )
    least = known.groupBy("component").agg(F.min("first_id").alias("_least"))
    known = known.join(least, "component").select(
        F.col("label").alias("_label"),
        F.col("vector").alias("_vector"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"),
        "_least",
    )
    match = (F.col(f"`{label_col}`") == F.col("_label")) & (vector == F.col("_vector"))
    component = F.when(F.col("_links").isNotNull(), F.col("_least")).otherwise(ident)
    return base.join(known, match, "left").select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(ident).alias("kept"),
    )
