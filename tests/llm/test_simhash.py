import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm import plain
from vigil.llm.components import connected_components
from vigil.llm.queries import QUERIES
from vigil.llm.simhash import hamming_links, shard_keys, shard_plan, simhash_dedup, tree_links


def expected(rows):
    prints = [plain.fingerprint(t) for _, t in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    comp = plain.components(range(len(rows)), near)
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in comp if comp[m] == comp[n] and rows[m][0] is not None]
        least = min(ids, default=None)
        out.append((i, f"{prints[n]:016x}", least, i == least))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id, r.kept) for r in df.collect()), key=repr)


def variants(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in rng.integers(0, 500, 300)]
    out = []
    for _ in range(n):
        w = list(words)
        for k in rng.integers(0, 300, rng.integers(0, 4)):
            w[k] = f"v{rng.integers(0, 9)}"
        out.append(" ".join(w))
    return out


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "a  b\tc"), (None, "one"), (8, "É b c d e"),
       (9, "word " * 70_000), (10, "a b c d e f"), (None, None)]


@pytest.mark.parametrize("rows", [ODD, [], [(3, "x y z w q")] * 3, [(i, t) for i, t in enumerate(variants(1, 30) + variants(2, 20))]])
def test_matches_plain_version(spark, rows):
    assert got(simhash_dedup(plain.docs(spark, rows))) == expected(rows)


def test_query_matches_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op8_simhash_bktree"](spark, SF_SMALL)) == expected(rows)


def test_clashing_columns(spark):
    df = plain.docs(spark, ODD).withColumns({"Fingerprint": F.lit(1), "fp": F.lit(1), "a": F.lit(1), "component": F.lit(1)})
    out = simhash_dedup(df)
    assert got(out) == expected(ODD) and {"fp", "a", "component", "lang"} <= set(out.columns)


def test_long_texts_are_read_in_pieces(monkeypatch):
    from vigil.llm import simhash

    rng = np.random.default_rng(5)
    for octets in (1, 2, 7, 40, 10**6):
        monkeypatch.setattr(simhash, "OCTETS_AT_ONCE", octets)
        for n in (0, 1, 2, 3, 4, 5, 50):
            text = "".join(f"{'Wörd'[: k % 5]}{k}" + " \t\n  "[: 1 + k % 5] for k in rng.integers(0, 999, n))
            assert simhash.fingerprint(text.encode()) == plain.fingerprint(text), (octets, text)


def points(n, near, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    out = list(base)
    for k in range(near):
        x = int(base[k % 7])
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_trees_find_all_links_of_a_unit(radius):
    fp = points(300, 300)
    unit = np.repeat([0, 1], [len(fp) // 2, len(fp) - len(fp) // 2])
    role = np.arange(len(fp)) % 3
    found = {(int(q), int(n)) for q, n in itertools.chain(*(zip(a, b) for a, b in tree_links(unit, fp, role != 1, role != 0, radius)))}
    brute = {
        (q, n)
        for q in range(len(fp))
        for n in range(len(fp))
        if q != n and unit[q] == unit[n] and role[q] != 0 and role[n] != 1 and int(fp[q] ^ fp[n]).bit_count() <= radius
    }
    assert found == brute


def test_trees_are_large_and_prune():
    """What a query visits of its tree: less the smaller the radius, and far from all of it."""
    fp = points(3000, 200)
    unit, every = np.zeros(len(fp), int), np.ones(len(fp), bool)
    share = []
    for radius in (0, 1, 2, 4):
        visited = [0, 0]
        list(tree_links(unit, fp, every, every, radius, visited))
        assert visited[1] == len(fp) ** 2
        share.append(visited[0] / visited[1])
    assert share == sorted(share) and share[0] < 0.01 and share[3] < 0.6


@pytest.mark.parametrize("n", [0, 1, 2048, 2049, 47_000, 235_000, 10**7, 10**8, 10**10, 10**12])
def test_shards_follow_the_number_of_points(n):
    blocks, bits = shard_plan(n, 4, 4096)
    copies = math.comb(4 + blocks, blocks)
    assert n <= 2048 or 512 < n / 2**bits <= 2048
    assert bits <= blocks * (64 // (4 + blocks)) if bits else copies == 1
    assert copies <= (1 if n <= 2048 else 5 if n <= 8 * 10**6 else 15 if n <= 10**9 else 70)


def test_near_fingerprints_share_a_shard(spark):
    base = points(200, 0)
    near = [(int(x), int(x) ^ sum(1 << int(b) for b in np.random.default_rng(k).choice(64, 4, replace=False))) for k, x in enumerate(base)]
    signed = [tuple(int(np.uint64(v).view(np.int64)) for v in p) for p in near]
    df = spark.createDataFrame(signed, "a long, b long")
    for plan in ((0, 0), (1, 5), (1, 12), (2, 13), (2, 20), (3, 27), (4, 32)):
        assert df.filter(~F.arrays_overlap(shard_keys(F.col("a"), 4, *plan), shard_keys(F.col("b"), 4, *plan))).isEmpty()


@pytest.mark.parametrize("tree_size", [5, 64, 4096])
def test_shards_and_hot_chunks_lose_no_link(spark, tree_size):
    fp = points(400, 500).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    found = {r.vertex: r.component for r in connected_components(hamming_links(df, 4, tree_size)).collect()}
    u = fp.view(np.uint64)
    near = [(int(a), int(b)) for k, a in enumerate(fp) for b in fp[k + 1 :][np.bitwise_count(u[k + 1 :] ^ u[k]) <= 4]]
    want = plain.components([int(x) for x in fp], near)
    assert {x: found.get(x, x) for x in want} == want


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (None, 3)], "a long, b long")
    out = {r.vertex: r.component for r in connected_components(edges).collect()}
    assert out == {i: 0 for i in range(201)} | {500: 500, 501: 500}
