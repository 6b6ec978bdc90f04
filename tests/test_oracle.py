"""Registered queries vs their DuckDB oracle on the smallest fixture (the driver uses sf 0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ["events"]
KEYS = [
    "feature_snapshot", "dedup_events", "feature_stats", "score_band", "rule_failed_login_burst", "rule_deletion_spike",
    "alerts", "alerts_suppressed", "alert_summary", "validate_events", "dead_letters", "raw_archive", "ops_metrics",
]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    odf = con.execute(E.oracle_sql()[key]).df()
    assert sorted(odf.columns) == cols
    want = sorted((tuple(_norm(v) for v in row) for row in odf[cols].itertuples(index=False)), key=repr)
    want = [tuple(None if (isinstance(x, float) and math.isnan(x)) else x for x in r) for r in want]
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "alert_fingerprint" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
