import hashlib
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm import plain
from vigil.llm.mixing import poisson_cdf, poisson_mix, repetition_rates
from vigil.llm.queries import ORACLES, QUERIES


def number(*parts):
    text = "|".join(str(p) for p in parts if p is not None)
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def quantile(u, mean):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


def expected(rows, weights=None, total=1.0, seed=7):
    """rows: (doc_id, source) -> Counter of (doc_id, source, copies, copy)."""
    sizes = Counter(s for _, s in rows)
    share = {s: 1.0 if weights is None else weights.get(s, 0.0) for s in sizes}
    out = Counter()
    for i, s in rows:
        mean = share[s] / (sum(share.values()) or 1) * len(rows) * total / sizes[s]
        parts = max(1, math.ceil(mean / 500))
        n = sum(quantile(number(seed, p, i), mean / parts) for p in range(parts)) if mean else 0
        out.update((i, s, n, c) for c in range(n))
    return out


def got(df):
    return Counter((r.doc_id, r.source, r.n_copies, r.copy) for r in df.collect())


ROWS = [(k, "big") for k in range(200)] + [(k, "small") for k in range(200, 220)] + [(500, None), (None, "big"), (3, "big"), (3, "big")]


def frame(spark, rows):
    return plain.docs(spark, [(i, "t" * (100_000 if i == 5 else 3) if i != 6 else None, "en", s, 3) for i, s in rows])


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None)] * 4])
@pytest.mark.parametrize("weights, total", [(None, 1.0), ({"small": 3.0, "big": 1.0, "absent": 5.0}, 2.5), ({"absent": 1.0}, 1.0)])
def test_counts_match_plain_version(spark, rows, weights, total):
    assert got(poisson_mix(frame(spark, rows), weights, total=total)) == expected(rows, weights, total)


def test_large_means_are_sums_of_smaller_ones(spark):
    rows = [(k, "a") for k in range(3)]
    found = got(poisson_mix(frame(spark, rows), total=1200.0))
    assert found == expected(rows, total=1200.0)
    assert all(1000 < n < 1400 for _, _, n, _ in found)


def test_shares_reach_the_target(spark):
    rows = [(k, "big" if k % 3 else "small") for k in range(6000)]
    found = got(poisson_mix(frame(spark, rows)))
    by = Counter(s for _, s, _, _ in found.elements())
    assert abs(by["big"] - 3000) < 250 and abs(by["small"] - 3000) < 250


def test_order_is_global_and_columns_stay(spark):
    df = frame(spark, ROWS).withColumns({"COPY": F.lit("x"), "rate": F.lit(1), "n": F.lit(2), "w": F.lit(3)})
    out = poisson_mix(df)
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys) and {"rate", "n", "w", "lang"} <= set(out.columns) and "COPY" not in out.columns
    assert got(out) == expected(ROWS)


def test_cdf_and_rates(spark):
    df = spark.createDataFrame([(0.3,), (40.0,)], "m double").select("m", poisson_cdf(F.col("m")).alias("c"))
    for r in df.collect():
        assert r.c[0] == pytest.approx(math.exp(-r.m)) and r.c[-1] == pytest.approx(1, abs=1e-12) and sorted(r.c) == r.c
    rates = {r.source: r.rate for r in repetition_rates(frame(spark, [(1, "a"), (2, "a"), (3, "b")])).collect()}
    assert rates == {"a": 0.75, "b": 1.5}


def test_query_is_native_and_whole(spark):
    df = QUERIES["op7_poisson_mix"](spark, SF_SMALL)
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source").collect()]
    assert got(df) == expected(rows)


def test_sql_keeps_all_copies_of_rare_sources(spark):
    rows = [(k, f"s{k % 4}") for k in range(3000)] + [(4000, None), (4001, None), (4002, None), (5000, "rare")]
    df = frame(spark, rows)
    documents = df.toPandas()  # noqa: F841 (the table of the SQL)
    found = duckdb.sql(ORACLES["op7_poisson_mix"]).fetchall()
    keys = [(i, s, n, c, key) for i, _, _, s, _, n, c, key in found]
    assert Counter(keys) == Counter((r.doc_id, r.source, r.n_copies, r.copy, r.shuffle_key) for r in poisson_mix(df).collect())
    assert max(n for _, s, n, *_ in keys if s == "rare") > 400


def test_rows_of_a_hot_source_spread_over_the_tasks(spark):
    rows = [(k, "big") for k in range(4000)]
    sizes = poisson_mix(frame(spark, rows)).groupBy(F.spark_partition_id().alias("t")).count().toPandas()["count"]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sizes.max() < 1.5 * sizes.min()
