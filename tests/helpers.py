"""Small hand-made event frames for unit tests."""

from pyspark.sql import functions as F

DEFAULTS = dict(
    user_id="u1", source_ip="10.0.0.1", account_id="a1", auth_result="success", is_privileged_action=False,
    geo_country="US", region="us-east-1", api_action="GetObject", bytes_received=0, service_name="s3",
    cloud_provider="aws", principal_type="human", resource_type="object", resource_id="r1", bytes_sent=0,
    device_fingerprint="d1", user_agent="ua", scenario="test",
)
COLS = ["event_id", "seq", "ts_sec"] + list(DEFAULTS)


def events(spark, rows):
    """rows: dicts with at least ts (seconds, may be fractional); seq defaults to position."""
    data = []
    for i, r in enumerate(rows):
        d = dict(DEFAULTS)
        d.update(r)
        seq = d.pop("seq", i + 1)
        ts = d.pop("ts")
        eid = d.pop("event_id", f"e{seq}")
        data.append((eid, seq, float(ts), *[d[k] for k in DEFAULTS]))
    schema = (
        "event_id string, seq long, ts double, user_id string, source_ip string, account_id string, auth_result string,"
        " is_privileged_action boolean, geo_country string, region string, api_action string, bytes_received long,"
        " service_name string, cloud_provider string, principal_type string, resource_type string, resource_id string,"
        " bytes_sent long, device_fingerprint string, user_agent string, scenario string"
    )
    df = spark.createDataFrame(data, schema)
    df = df.withColumn("timestamp", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    return df.withColumn("ts_sec", F.unix_seconds("timestamp")).drop("ts")


def feature_list(spark, rows, name):
    from vigil.operators.features import feature_snapshot

    out = feature_snapshot(events(spark, rows)).orderBy("seq").select(name).collect()
    return [r[0] for r in out]


def scored(spark, rows, model):
    """Events + features + given model fields (anomaly_score, predicted_anomaly, ...)."""
    from vigil.operators.features import feature_snapshot

    f = feature_snapshot(events(spark, rows))
    m = dict(anomaly_score=0.0, confidence=0.0, predicted_anomaly=False, model_version="unavailable")
    m.update(model)
    return f.withColumns(
        {
            "anomaly_score": F.lit(float(m["anomaly_score"])),
            "confidence": F.lit(float(m["confidence"])),
            "predicted_anomaly": F.lit(bool(m["predicted_anomaly"])),
            "model_version": F.lit(m["model_version"]),
            "top_contributors": F.array(F.lit("failed_logins_5m=1")),
            "explanation": F.lit("model says so"),
        }
    )

