"""SimHash near-duplicates found with BK-trees.

1. Every whole text becomes a 64-bit fingerprint; equal fingerprints are then one point.
2. The points are dealt into shards of some thousands, as many as their measured number asks for. The
   64 bits are cut into ``radius`` + k blocks; fingerprints within the radius agree on k whole blocks at
   least, so a point joins one shard for every choice of k blocks, keyed by their leading bits, and no
   link is lost between shards. k is 1 (``radius`` + 1 copies of a point) until a block has too few bits.
3. A shard's points form a BK-tree: a child hangs under its parent by their Hamming distance. A
   query at distance d from a node follows only the edges d - radius to d + radius. All trees of a
   batch grow and are searched together, level by level.
4. A shard beyond ``tree_size`` points is cut into chunks. Every chunk's tree meets every later
   chunk as queries in a task of its own, so a hot shard is spread over tasks and stays whole.
5. Each task hands on a spanning set of its links; connected components join them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import materialize
from .common import bound_batches, join_labels, without
from .components import connected_components

OUT = ["fingerprint", "component_id", "kept"]
BITS = 64
OCTETS_AT_ONCE = 4_000_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
ROWS_AT_ONCE = 100_000
PAIRS_AT_ONCE = 250_000


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``words`` words (A-Z lower-cased, split at ASCII white space), in portions.

    A text with fewer words is one shingle. A long text is read in pieces that end at white space, each
    with the last words of the piece before.
    """
    hashed = xxhash.xxh64_intdigest
    kept: list[bytes] = []
    whole = 0
    at = 0
    while at < len(text):
        end = at + OCTETS_AT_ONCE
        if end < len(text):
            space = SPACE.search(text, end)
            end = space.start() if space else len(text)
        parts = kept + text[at:end].lower().split()
        at = end
        kept = parts
        if len(parts) >= words:
            joined = b" ".join(parts)
            starts = np.cumsum([0, *(len(p) + 1 for p in parts)]).tolist()
            yield np.array([hashed(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:])], np.uint64)
            kept = parts[len(parts) - words + 1 :]
            whole += 1
    if not whole and kept:
        yield np.array([hashed(b" ".join(kept), seed)], np.uint64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """Bits set in over half the shingle hashes, as an unsigned 64-bit number; no words: zero."""
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words):
        total += len(hashes)
        for at in range(0, len(hashes), 65536):
            octets = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", words: int = 4, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``df`` (default: all) plus ``_fp``, the fingerprint as a signed long."""
    carry = df.columns if carry is None else carry
    bound_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in carry), T.StructField("_fp", T.LongType())])
    read = [] if text_col in carry else [F.col(f"`{text_col}`").alias("_text")]
    at = carry.index(text_col) if text_col in carry else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            values = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carry)], pa.array(values.view(np.int64))], [*carry, "_fp"]
            )

    return df.select(*[F.col(f"`{c}`") for c in carry], *read).mapInArrow(run, schema)


def grow_trees(unit: np.ndarray, point: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One BK-tree per unit over the rows marked ``tree``.

    Returns the root row of each unit (-1: none) and the edges: sorted keys parent * 65 + distance,
    and the child row under each key. Children are placed as one-by-one insertion would place them.
    """
    nodes = np.flatnonzero(tree)
    root = np.full(int(unit[-1]) + 1, -1)
    units, first = np.unique(unit[nodes], return_index=True)
    root[units] = nodes[first]
    rest = np.delete(nodes, first)
    at = root[unit[rest]]
    keys, kids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while rest.size:
        key = at * (BITS + 1) + np.bitwise_count(point[rest] ^ point[at])
        edge, first, which = np.unique(key, return_index=True, return_inverse=True)
        keys.append(edge)
        kids.append(rest[first])
        below = np.ones(len(rest), bool)
        below[first] = False
        at, rest = rest[first][which][below], rest[below]
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return root, key[order], np.concatenate(kids)[order]


def tree_links(
    unit: np.ndarray, point: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int, visited: list[int] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (query, node) of one unit within ``radius`` bits, in bounded portions.

    ``visited`` counts the nodes that queries come to, and all nodes of the trees they are put to.
    """
    root, keys, kids = grow_trees(unit, point, tree)
    size = np.bincount(unit[tree], minlength=len(root))
    asked = np.flatnonzero(query & (size[unit] > 0))
    # where the edges of a node begin that are as long as a distance, or longer
    wide = BITS + 2
    edge = keys // (BITS + 1) * wide + keys % (BITS + 1)
    begin = np.zeros(len(point) * wide + 1, np.int32)
    np.cumsum(np.bincount(edge, minlength=len(point) * wide), out=begin[1:], dtype=np.int32)
    portion = np.cumsum(size[unit[asked]]) // PAIRS_AT_ONCE
    for q in np.split(asked, np.flatnonzero(np.diff(portion)) + 1):
        if visited is not None:
            visited[1] += int(size[unit[q]].sum())
        node = root[unit[q]]
        while q.size:
            if visited is not None:
                visited[0] += len(q)
            d = np.bitwise_count(point[q] ^ point[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            low = begin[node * wide + np.maximum(d - radius, 0)]
            high = begin[node * wide + np.minimum(d + radius, BITS) + 1]
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, node = np.repeat(q, n), kids[at]


def spanning_links(radius: int):
    """mapInArrow function: rows (shard, i, j, role, fp), sorted by unit -> links (a, b) that span each unit."""

    def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
        shard, i, j, role, fp = rows
        new = np.ones(len(fp), bool)
        new[1:] = (shard[1:] != shard[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        unit = np.cumsum(new) - 1
        lab = np.arange(len(fp))
        if len(fp):
            for a, b in tree_links(unit, fp.view(np.uint64), role != 1, role != 0, radius):
                lab = join_labels(len(fp), a, b, lab)
        linked = np.flatnonzero(lab != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[lab[linked]])], ["a", "b"])

    def joined(waiting: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*waiting)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n < ROWS_AT_ONCE:
                continue
            rows = joined(waiting)
            # the last unit may go on in the next batch
            unlike = np.any([c[:-1] != c[-1] for c in rows[:3]], axis=0)
            cut = int(np.flatnonzero(unlike)[-1]) + 1 if unlike.any() else 0
            if cut:
                yield solve([c[:cut] for c in rows])
            waiting = [[c[cut:] for c in rows]]
            n -= cut
        if waiting:
            yield solve(joined(waiting))

    return run


def shard_plan(points: int, radius: int, tree_size: int) -> tuple[int, int]:
    """How many blocks a shard's key is made of, and how many of their bits, for trees of half of ``tree_size`` points.

    No blocks: all points are one shard.
    """
    bits = max(0, math.ceil(math.log2(max(points, 1) / max(tree_size / 2, 1))))
    blocks = 1
    while bits and blocks * (BITS // (radius + blocks)) < bits and radius + blocks < BITS:
        blocks += 1
    return (blocks, min(bits, blocks * (BITS // (radius + blocks)))) if bits else (0, 0)


def shard_keys(fp: Column, radius: int, blocks: int, bits: int) -> Column:
    """One key for every choice of ``blocks`` of the ``radius`` + ``blocks`` bit blocks: the choice's number and ``bits`` bits."""
    edges = np.linspace(0, BITS, radius + blocks + 1).round().astype(int).tolist()
    cut = list(zip(edges, edges[1:]))
    keys = []
    for k, chosen in enumerate(combinations(cut, blocks)):
        value, width = F.lit(0).cast("long"), 0
        for a, b in chosen:
            take = min(b - a, bits - width)
            value = F.shiftleft(value, take).bitwiseOR(F.shiftrightunsigned(fp, b - take).bitwiseAND((1 << take) - 1))
            width += take
        keys.append(F.lit(k << bits).cast("long").bitwiseOR(value))
    return F.array(*keys)


def hamming_links(points: DataFrame, radius: int = 4, tree_size: int = 4096) -> DataFrame:
    """Distinct fingerprints ``fp`` (long) -> links (a, b) whose components are those of all links within ``radius``."""
    rows = points.select("fp", F.explode(shard_keys(F.col("fp"), radius, *shard_plan(points.count(), radius, tree_size))).alias("shard"))
    hot = (
        rows.groupBy("shard")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > tree_size)
        .select("shard", F.ceil(F.col("n") / tree_size).cast("int").alias("chunks"))
    )
    own, other = F.col("own"), F.col("other")
    units = (
        rows.join(hot, "shard", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", F.pmod(F.hash("fp"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "shard",
            F.least(own, other).alias("i"),
            F.greatest(own, other).alias("j"),
            F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("role"),
            "fp",
        )
        .repartition("shard", "i", "j")
        .sortWithinPartitions("shard", "i", "j", "fp")
    )
    return units.mapInArrow(spanning_links(radius), "a long, b long")


def simhash_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
    carry: list[str] | None = None,
    tree_size: int = 4096,
) -> DataFrame:
    """The ``carry`` columns of every row of ``df`` plus fingerprint, component_id and kept.

    ``fingerprint`` is 16 hexadecimal digits; rows link at ``radius`` or fewer differing bits, and
    ``component_id`` is the smallest id reachable, the row's own included (null where all are null).
    ``kept`` marks the rows with that id. Null texts count as empty; texts without words have the
    fingerprint zero and link like any other; shorter texts than ``words`` are one shingle. Rows that
    share an id get a flag each. Input columns named like an output column are replaced. An empty
    table gives an empty result. ``carry`` (default: all columns) must hold the id column.
    """
    base = without(df, OUT)
    carry = base.columns if carry is None else carry
    rows = materialize(fingerprints(base, text_col, words, carry), "llm-fingerprints")
    ident = F.col(f"`{id_col}`")
    points = materialize(
        rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(ident).alias("first_id"), F.count("*").alias("n")),
        "llm-points",
    )
    parts = connected_components(hamming_links(points.select("fp"), radius, tree_size))
    groups = (
        points.join(parts, F.col("fp") == F.col("vertex"), "left")
        .filter("n > 1 or component is not null")
        .select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    )
    least = groups.groupBy("component").agg(F.min("first_id").alias("_least"))
    known = groups.join(least, "component").select(F.col("fp").alias("_fp"), "_least", F.lit(True).alias("_known"))
    component = F.when(F.col("_known"), F.col("_least")).otherwise(ident)
    return rows.join(known, "_fp", "left").select(
        *[F.col(f"`{c}`") for c in carry],
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
        component.eqNullSafe(ident).alias("kept"),
    )
