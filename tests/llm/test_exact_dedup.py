import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm import plain
from vigil.llm.exact_dedup import exact_dedup
from vigil.llm.queries import QUERIES

ROWS = [
    (1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (4, ""), (5, None), (6, "École"), (7, "école"),
    (8, "long " * 50_000), (3, "LONG " * 50_000), (10, "same text "), (11, "x"),
]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(plain.ascii_lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[plain.ascii_lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(plain.ascii_lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None)], [(None, "a"), (2, "A"), (None, "b")], [(1, "a"), (1, "a")]])
def test_groups_match_plain_version(spark, rows):
    assert got(exact_dedup(plain.docs(spark, rows))) == expected(rows)


def test_weak_digest_never_merges_different_texts(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    out = exact_dedup(plain.docs(spark, rows), salts=3, digest=lambda t: F.length(t).cast("string"))
    assert got(out) == expected(rows)


def test_hot_group_over_many_partitions(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    assert got(exact_dedup(plain.docs(spark, rows).repartition(40))) == expected(rows)


def test_copies_that_lie_in_one_task_or_in_many(spark):
    rows = [(i, f"t{i // 3}" if i < 900 else f"u{i}") for i in range(1200)]
    df = plain.docs(spark, rows)
    assert got(exact_dedup(df.coalesce(1))) == got(exact_dedup(df.repartition(30, "doc_id"), salts=2)) == expected(rows)


def test_clashing_and_extra_columns(spark):
    df = plain.docs(spark, ROWS).withColumns({"KEPT": F.lit("x"), "group_size": F.lit("y"), "n": F.lit(1), "win": F.lit(2)})
    out = exact_dedup(df)
    assert got(out) == expected(ROWS)
    assert {"n", "win", "lang"} <= set(out.columns) and "KEPT" not in out.columns


def test_query_runs_without_python(spark):
    df = QUERIES["op10_exact_dedup"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert df.count() == 200
