"""Hand-worked window cases: edges, same-second peers, fractions, late events, repeats."""

from helpers import feature_list

FAIL = dict(auth_result="failure")
DEL = dict(api_action="TerminateInstances")


def test_five_minute_edge(spark):
    assert feature_list(spark, [dict(ts=0, **FAIL), dict(ts=300, **FAIL)], "failed_logins_5m") == [1, 2]
    assert feature_list(spark, [dict(ts=0, **FAIL), dict(ts=301, **FAIL)], "failed_logins_5m") == [1, 1]


def test_ten_minute_edge(spark):
    assert feature_list(spark, [dict(ts=0, **DEL), dict(ts=600, **DEL)], "account_delete_actions_10m") == [1, 2]
    assert feature_list(spark, [dict(ts=0, **DEL), dict(ts=601, **DEL)], "account_delete_actions_10m") == [1, 1]


def test_hour_and_day_edges(spark):
    assert feature_list(spark, [dict(ts=0, **FAIL), dict(ts=3600, **FAIL)], "failed_logins_1h") == [1, 2]
    assert feature_list(spark, [dict(ts=0, **FAIL), dict(ts=3601, **FAIL)], "failed_logins_1h") == [1, 1]
    two_ips = [dict(ts=0, source_ip="10.0.0.1"), dict(ts=86400, source_ip="10.0.0.2")]
    assert feature_list(spark, two_ips, "distinct_ips_24h") == [1, 2]
    two_ips[1]["ts"] = 86401
    assert feature_list(spark, two_ips, "distinct_ips_24h") == [1, 1]


def test_same_second_peers(spark):
    rows = [dict(ts=50, seq=1, **FAIL), dict(ts=50, seq=2, **FAIL), dict(ts=50, seq=3, **FAIL)]
    assert feature_list(spark, rows, "failed_logins_5m") == [1, 2, 3]


def test_fractional_seconds_are_cut(spark):
    assert feature_list(spark, [dict(ts=10.9, **FAIL), dict(ts=310.1, **FAIL)], "failed_logins_5m") == [1, 2]


def test_late_event_sees_only_earlier_time(spark):
    rows = [dict(ts=500, seq=1), dict(ts=100, seq=2)]
    assert feature_list(spark, rows, "request_count_5m") == [1, 1]


def test_repeat_counts_once(spark):
    rows = [dict(ts=0, seq=1, event_id="x", **FAIL), dict(ts=0, seq=2, event_id="x", **FAIL), dict(ts=10, seq=3, **FAIL)]
    assert feature_list(spark, rows, "failed_logins_5m") == [1, 2]


def test_entropy(spark):
    rows = [dict(ts=t, service_name=s) for t, s in [(0, "a"), (1, "a"), (2, "b"), (3, "c")]]
    assert feature_list(spark, rows, "account_service_entropy_1h") == [0.0, 0.0, 0.918, 1.5]


def test_new_country(spark):
    rows = [
        dict(ts=0, geo_country="US"),
        dict(ts=10, geo_country="US"),
        dict(ts=20, geo_country="DE", is_privileged_action=True),
        dict(ts=30, geo_country="DE", is_privileged_action=True),
    ]
    assert feature_list(spark, rows, "is_new_country_for_user") == [False, False, True, False]
    assert feature_list(spark, [dict(ts=0, geo_country="DE")], "is_new_country_for_user") == [False]


def test_ip_rate_and_users(spark):
    rows = [dict(ts=0, user_id="u1", **FAIL), dict(ts=1, user_id="u2"), dict(ts=2, user_id="u3")]
    assert feature_list(spark, rows, "ip_failed_auth_rate_5m") == [1.0, 0.5, 0.333]
    assert feature_list(spark, rows, "ip_users_24h") == [1, 2, 3]


def test_bytes_sum(spark):
    rows = [dict(ts=0, bytes_received=5), dict(ts=3600, bytes_received=7), dict(ts=3601, bytes_received=11)]
    assert feature_list(spark, rows, "account_bytes_received_1h") == [5, 12, 18]
