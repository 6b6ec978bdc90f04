"""Rule thresholds, ML edge, hybrid severity, suppression sessions and idempotency."""

from pyspark.sql import functions as F

from helpers import scored
from vigil.operators import rules as R
from vigil.operators.alerts import drop_known, suppress, with_keys

LOGIN_FAIL = dict(api_action="ConsoleLogin", auth_result="failure", service_name="iam")


def _alerts(spark, rows, model=None):
    return R.alerts(scored(spark, rows, model or {})).orderBy("seq")


def test_failed_login_burst(spark):
    rows = [dict(ts=i * 10, **LOGIN_FAIL) for i in range(5)]
    a = _alerts(spark, rows).collect()
    assert [r["seq"] for r in a] == [5]
    assert a[0]["anomaly_score"] == 0.9 and a[0]["severity"] == "high"


def test_other_failures_count(spark):
    rows = [dict(ts=i, api_action="Decrypt", auth_result="failure") for i in range(4)] + [dict(ts=10, **LOGIN_FAIL)]
    a = _alerts(spark, rows).collect()
    assert [r["seq"] for r in a] == [5]


def test_deletion_spike(spark):
    rows = [dict(ts=i, api_action="TerminateInstances") for i in range(4)]
    a = _alerts(spark, rows).collect()
    assert [r["seq"] for r in a] == [4]
    assert a[0]["anomaly_score"] == 0.45 + 4 * 0.1  # 0.8500000000000001
    rows = [dict(ts=i, api_action="ScheduleKeyDeletion") for i in range(6)]
    assert _alerts(spark, rows).count() == 0


def test_volume(spark):
    assert _alerts(spark, [dict(ts=0, bytes_received=1_999_999)]).count() == 0
    a = _alerts(spark, [dict(ts=0, bytes_received=2_000_000)]).collect()
    assert a[0]["severity"] == "medium" and a[0]["title"] == R.VOLUME_TITLE


def test_privileged_new_country(spark):
    rows = [
        dict(ts=0, geo_country="US"),
        dict(ts=1, geo_country="US"),
        dict(ts=2, geo_country="DE", is_privileged_action=True),
        dict(ts=3, geo_country="DE", is_privileged_action=True),
    ]
    a = _alerts(spark, rows).collect()
    assert [(r["seq"], r["severity"]) for r in a] == [(3, "critical")]
    assert _alerts(spark, [dict(ts=0, geo_country="DE", is_privileged_action=True)]).count() == 0


def test_ml_edge(spark):
    base = dict(predicted_anomaly=True, model_version="m1")
    assert _alerts(spark, [dict(ts=0)], dict(anomaly_score=0.5399, **base)).count() == 0
    a = _alerts(spark, [dict(ts=0)], dict(anomaly_score=0.54, **base)).collect()
    assert a[0]["title"] == R.ML_TITLE and a[0]["detection_sources"] == ["ml"]


def test_ml_with_context(spark):
    rows = [dict(ts=0, geo_country="US"), dict(ts=1, geo_country="DE")]
    base = dict(predicted_anomaly=True, model_version="m1")
    got = _alerts(spark, rows, dict(anomaly_score=0.4799, **base)).where(F.col("seq") == 2).count()
    assert got == 0
    got = _alerts(spark, rows, dict(anomaly_score=0.48, **base)).where(F.col("seq") == 2).count()
    assert got == 1


def test_hybrid_severity(spark):
    rows = [dict(ts=i * 10, **LOGIN_FAIL) for i in range(5)]
    sev = {}
    for s in (0.5599, 0.56, 0.64):
        a = _alerts(spark, rows, dict(anomaly_score=s, predicted_anomaly=True, model_version="m1"))
        a = a.where(F.col("title") == R.FAILED_LOGIN_TITLE).collect()
        sev[s] = a[0]["severity"]
        assert a[0]["anomaly_score"] == s  # model score replaces the rule score
        assert a[0]["detection_sources"] == ["rule", "ml"]
    assert sev == {0.5599: "high", 0.56: "critical", 0.64: "critical"}
    v = _alerts(spark, [dict(ts=0, bytes_received=2_000_000)], dict(anomaly_score=0.64, predicted_anomaly=True, model_version="m1"))
    assert v.first()["severity"] == "critical"


def test_model_present_predicts_normal(spark):
    a = _alerts(spark, [dict(ts=0, bytes_received=2_000_000)], dict(anomaly_score=0.3, confidence=0.2, model_version="m1"))
    r = a.first()
    assert r["anomaly_score"] == 0.3 and r["confidence"] == 0.2 and r["detection_sources"] == ["rule"]


def test_suppression_sessions(spark):
    rows = [dict(ts=t, bytes_received=2_000_000) for t in (0, 300, 600, 901)]
    t = suppress(with_keys(_alerts(spark, rows)), materialize_sessions=False)
    got = sorted((r["suppression_count"], r["created_at"].timestamp()) for r in t.collect())
    assert [c for c, _ in got] == [0, 2]


def test_exact_retry(spark):
    a = with_keys(_alerts(spark, [dict(ts=0, bytes_received=2_000_000)]))
    twice = a.unionByName(a.withColumn("seq", F.col("seq") + 100))
    assert drop_known(twice, None).count() == 1
    assert drop_known(a, a).count() == 0
