"""One hot key split over many small time buckets still gives the exact windowed values."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import events
from vigil.operators import sweep as S
from vigil.operators.features import account_family, feature_snapshot, ip_family, user_family


def check(spark, rows, **options):
    def visible(x, e, w):
        return e["ts"] - w <= x["ts"] <= e["ts"] and (x["ts"] < e["ts"] or x["seq"] <= e["seq"])

    want = {}
    for e in rows:
        fails = sum(1 for x in rows if visible(x, e, 300) and x["auth_result"] == "failure")
        ips = len({x["source_ip"] for x in rows if visible(x, e, 86400)})
        c = Counter(x["service_name"] for x in rows if visible(x, e, 3600))
        n = sum(c.values())
        h = -sum((k / n) * math.log2(k / n) for k in c.values())
        want[e["seq"]] = (fails, ips, max(round(h, 3), 0.0))

    f = feature_snapshot(events(spark, rows), **options)
    got = {
        r["seq"]: (r["failed_logins_5m"], r["distinct_ips_24h"], r["account_service_entropy_1h"])
        for r in f.select("seq", "failed_logins_5m", "distinct_ips_24h", "account_service_entropy_1h").collect()
    }
    assert got.keys() == want.keys()
    bad = [(k, got[k], want[k]) for k in want if got[k][:2] != want[k][:2] or abs(got[k][2] - want[k][2]) > 1e-9]
    assert not bad, bad[:5]


def draw(steps, n=400, seed=11):
    rnd = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice(steps)
        rows.append(
            dict(seq=i, ts=t, service_name=rnd.choice(["a", "b", "c"]), source_ip=f"10.0.0.{rnd.randint(1, 4)}",
                 auth_result=rnd.choice(["success", "failure"]))
        )
    return rows


def test_hot_key_many_buckets(spark):
    check(spark, draw([0, 1, 5, 30, 200, 700]), bucket_seconds=60)


@pytest.mark.parametrize("steps", [[0, 1, 5], [0], [0, 1, 5, 30, 200, 700]])
def test_burst_inside_one_bucket(spark, steps, monkeypatch):
    """Measured buckets are split into seconds, and seconds into blocks of arrival numbers."""
    monkeypatch.setattr(S, "ORD_BLOCK", 16)
    check(spark, draw(steps), hot_rows=20)


def test_hot_hour_spreads_over_tasks(spark):
    """One key with all its rows inside one hour: no task of the local sums holds more than a second of it."""
    n = 40_000
    rows = spark.range(n).select(
        F.lit("u").alias("k"), (F.col("id") % 3600).alias("_t"), F.col("id").alias("_ord"), F.lit(1).cast("long").alias("d")
    )
    out = S.running_sum(rows, ["k"], ["d"], hot=F.lit(True))
    assert out.agg(F.sum("d_cum"), F.max("d_cum"), F.countDistinct("d_cum")).first() == (n * (n + 1) // 2, n, n)
    plain = S.running_sum(rows, ["k"], ["d"])
    assert out.select("_t", "_ord", "d_cum").exceptAll(plain.select("_t", "_ord", "d_cum")).isEmpty()
    parts = rows.withColumns({"_bkt": F.lit(0), "_sec": F.col("_t"), "_blk": F.floor(F.col("_ord") / S.ORD_BLOCK)}).groupBy("_bkt", "_sec", "_blk").count()
    assert parts.agg(F.max("count")).first()[0] <= n // 3600 + 1


def test_hot_buckets_are_measured(spark):
    rows = events(spark, draw([0, 1], n=300) + [dict(seq=900, ts=7200, user_id="quiet", source_ip="9.9.9.9", account_id="other")])
    families = [user_family(), ip_family(), account_family()]
    assert S.hot_buckets(rows, families, hot_rows=300) == []
    # user and account in the first hour, with the buckets that their expiries fall into
    found = S.hot_buckets(rows, families, hot_rows=200)
    assert len(found) == len({0, 1, 2, 24, 25}) + len({0, 1, 2})
