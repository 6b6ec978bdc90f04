"""Sweep = naive definition on random frames, independent of partition count and bucket size."""

import random

from pyspark.sql import functions as F

from helpers import events
from vigil.operators.features import feature_snapshot


def naive(rows):
    out = {}
    for e in rows:
        def vis(x, w, key):
            return x[key] == e[key] and e["ts"] - w <= x["ts"] <= e["ts"] and (x["ts"] < e["ts"] or x["seq"] <= e["seq"])

        fails = [x for x in rows if vis(x, 300, "user_id") and x["auth_result"] == "failure"]
        ips = {x["source_ip"] for x in rows if vis(x, 86400, "user_id")}
        users = {x["user_id"] for x in rows if vis(x, 86400, "source_ip")}
        out[e["seq"]] = (len(fails), len(ips), len(users))
    return out


def test_sweep_matches_naive(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        rows.append(
            dict(
                seq=i,
                ts=rnd.randint(0, 200000),
                user_id=f"u{rnd.randint(0, 4)}",
                source_ip=f"10.0.0.{rnd.randint(0, 5)}",
                auth_result=rnd.choice(["success", "failure"]),
            )
        )
    want = naive(rows)
    for parts, bucket in [(1, 3600), (8, 600), (3, 86400)]:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        f = feature_snapshot(events(spark, rows), bucket_seconds=bucket)
        got = {
            r["seq"]: (r["failed_logins_5m"], r["distinct_ips_24h"], r["ip_users_24h"])
            for r in f.select("seq", "failed_logins_5m", "distinct_ips_24h", "ip_users_24h").collect()
        }
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    _ = F
