"""One bad line per constraint -> one validation dead letter; good variants pass."""

import json

from vigil.functions.validate import dead_letters, validate_events

GOOD = {
    "event_id": "e1", "timestamp": "2024-01-01T00:00:00+00:00", "cloud_provider": "aws", "account_id": "a",
    "user_id": "u", "principal_type": "human", "source_ip": "10.0.0.1", "geo_country": "US", "region": "r",
    "service_name": "s3", "api_action": "GetObject", "resource_type": "object", "resource_id": "x",
    "auth_result": "success", "bytes_sent": 1, "bytes_received": 2, "device_fingerprint": "d", "user_agent": "ua",
    "is_privileged_action": False, "metadata": {"scenario": "t"},
}


def _with(**kw):
    d = dict(GOOD)
    for k, v in kw.items():
        if v is KeyError:
            d.pop(k)
        else:
            d[k] = v
    return json.dumps(d)


BAD = [
    "not json",
    "[1,2]",
    '"text"',
    _with(event_id=KeyError),
    _with(user_id="  "),
    _with(cloud_provider="oci"),
    _with(principal_type="bot"),
    _with(source_ip="999.1.1.1"),
    _with(geo_country="USA"),
    _with(geo_country="U1"),
    _with(geo_country=" U"),
    _with(bytes_received=-1),
    _with(bytes_received="x"),
    _with(bytes_received=None),
    _with(timestamp="2024-01-01T00:00:00"),
    _with(timestamp="nope"),
    _with(auth_result="maybe"),
]
GOOD_VARIANTS = [
    (_with(geo_country="us"), "geo_country", "US"),
    (_with(source_ip="2001:db8::1"), "source_ip", "2001:db8::1"),
    (_with(bytes_received=KeyError), "bytes_received", 0),
    (_with(bytes_received="7"), "bytes_received", 7),
    (_with(user_id="  u9  "), "user_id", "u9"),
    (_with(timestamp="2024-01-01T23:30:00-05:00"), "event_date", "2024-01-01"),
]


def _lines(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, value string").selectExpr(
        "seq", "current_timestamp() as arrival_ts", "value"
    )


def test_each_bad_line_is_one_dead_letter(spark):
    v = validate_events(_lines(spark, BAD)).cache()
    rows = v.orderBy("seq").collect()
    assert all(not r["valid"] and len(r["errors"]) == 1 for r in rows), [(r["seq"], r["errors"]) for r in rows]
    dl = dead_letters(v).collect()
    assert len(dl) == len(BAD)
    assert {r["stage"] for r in dl} == {"validation"} and not any(r["retryable"] for r in dl)
    assert sorted(r["error_type"] for r in dl)[0] == "JSONDecodeError"
    missing = [r for r in dl if r["seq"] == 3][0]
    assert missing["event_id"] is None


def test_good_variants(spark):
    v = validate_events(_lines(spark, [g for g, _, _ in GOOD_VARIANTS])).orderBy("seq").collect()
    for row, (_, col, want) in zip(v, GOOD_VARIANTS):
        assert row["valid"], row["errors"]
        assert row[col] == want
    ts = v[-1]["timestamp"]
    assert (ts.year, ts.month, ts.day, ts.hour, ts.minute) == (2024, 1, 2, 4, 30)


def test_json_types_are_told_apart(spark):
    """Values that the typed event takes or rejects by their JSON type (field, JSON text, valid)."""
    import json

    from pyspark.sql import functions as F

    base = dict(
        event_id="e", timestamp="2024-01-01T00:00:00Z", cloud_provider="aws", account_id="a", user_id="u", principal_type="human", source_ip="10.0.0.1",
        geo_country="US", region="r", service_name="s3", api_action="x", resource_type="t", resource_id="i", auth_result="success",
        device_fingerprint="d", user_agent="ua",
    )
    cases = [
        ("user_id", "5", False), ("user_id", "true", False), ("user_id", "null", False), ("region", "{}", False), ("user_id", '"\\u00a0"', False),
        ("user_id", '"\\u3000x\\u2003"', True), ("cloud_provider", "1", False), ("geo_country", "12", False), ("source_ip", "7", False),
        ("metadata", "[1]", False), ("metadata", "null", False), ("metadata", '"t"', False), ("metadata", '{"a": {"b": 1}}', True),
        ("source_ip", '"::ffff:10.0.0.1"', True), ("source_ip", '"::ffff:10.0.0.256"', False), ("source_ip", '"fe80::1%eth0"', True), ("source_ip", '"10.0.0.1%1"', False),
        ("bytes_received", "7.0", True), ("bytes_received", "7.5", False), ("bytes_received", '"7"', True), ("bytes_received", '"7.0"', True), ("bytes_received", '"7.5"', False),
        ("bytes_received", "true", True), ("bytes_received", "null", False), ("bytes_received", "[7]", False), ("bytes_received", "1e3", True), ("bytes_received", "-1", False),
        ("is_privileged_action", '"on"', True), ("is_privileged_action", '"OFF"', True), ("is_privileged_action", "1", True), ("is_privileged_action", "1.0", True),
        ("is_privileged_action", "2", False), ("is_privileged_action", '"maybe"', False), ("is_privileged_action", "null", False),
        ("timestamp", "1704067200", True), ("timestamp", "1704067200.5", True), ("timestamp", "1704067200000", True), ("timestamp", '"1704067200"', True),
        ("timestamp", '"2024-01-01"', False), ("timestamp", '"2024-01-01 00:00:00+0530"', True), ("timestamp", "true", False),
    ]
    rows = []
    for n, (name, text, _) in enumerate(cases):
        body = ", ".join(f'"{k}": {text if k == name else json.dumps(v)}' for k, v in ({name: None} | base).items())
        rows.append((n, "{" + body + "}"))
    lines = spark.createDataFrame(rows, "seq long, value string").withColumn("arrival_ts", F.lit("2024-01-01").cast("timestamp"))
    out = {r.seq: r for r in validate_events(lines).collect()}
    wrong = [(c, out[n].errors) for n, c in enumerate(cases) if out[n].valid != c[2]]
    assert not wrong
    by_text = {c[1]: out[n] for n, c in enumerate(cases)}
    assert by_text["1e3"].bytes_received == 1000 and by_text['{"a": {"b": 1}}'].metadata == {"a": '{"b":1}'}
    assert by_text["1704067200"].timestamp_text == "2024-01-01T00:00:00+00:00" and by_text["1704067200.5"].timestamp_text == "2024-01-01T00:00:00.500000+00:00"
    assert by_text["1704067200000"].ts_sec == 1704067200
    assert by_text['"2024-01-01 00:00:00+0530"'].timestamp_text == "2024-01-01T00:00:00+05:30"
    assert by_text['"\\u3000x\\u2003"'].user_id == "x" and by_text['"\\u3000x\\u2003"'].timestamp_text == "2024-01-01T00:00:00+00:00"
