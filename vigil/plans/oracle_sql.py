"""DuckDB oracle SQL for every registered query.

The oracles deliberately use a different formula from the engine: features
come from a self join with the visibility predicate, alerts from plain CASE
expressions, suppression from gaps-and-islands.
"""

from __future__ import annotations

from ..sources.fixtures import SECURITY_EVENTS_SQL

DEDUP_SQL = """
dedup AS (
  SELECT * FROM security_events
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1
)
"""

USER_SQL = """
uf AS (
  SELECT e.seq,
    count(*) FILTER (WHERE x.auth_result = 'failure' AND x.ts_sec >= e.ts_sec - 300) AS failed_logins_5m,
    count(*) FILTER (WHERE x.auth_result = 'failure' AND x.ts_sec >= e.ts_sec - 3600) AS failed_logins_1h,
    count(*) FILTER (WHERE x.ts_sec >= e.ts_sec - 300) AS request_count_5m,
    count(DISTINCT x.source_ip) AS distinct_ips_24h,
    count(DISTINCT x.geo_country) AS distinct_countries_24h,
    count(DISTINCT x.region) AS distinct_regions_24h,
    count(*) FILTER (WHERE x.is_privileged_action AND x.ts_sec >= e.ts_sec - 3600) AS privileged_actions_1h
  FROM dedup e JOIN dedup x
    ON x.user_id = e.user_id AND x.ts_sec BETWEEN e.ts_sec - 86400 AND e.ts_sec
   AND (x.ts_sec < e.ts_sec OR x.seq <= e.seq)
  GROUP BY e.seq
),
firsts AS (
  SELECT seq,
    row_number() OVER (PARTITION BY user_id ORDER BY ts_sec, seq) AS rn_user,
    row_number() OVER (PARTITION BY user_id, geo_country ORDER BY ts_sec, seq) AS rn_country,
    row_number() OVER (PARTITION BY user_id, source_ip ORDER BY ts_sec, seq) AS rn_ip
  FROM dedup
)
"""

IP_SQL = """
ipf AS (
  SELECT e.seq,
    count(DISTINCT x.user_id) AS ip_users_24h,
    count(*) FILTER (WHERE x.auth_result = 'failure' AND x.ts_sec >= e.ts_sec - 300) AS ip_failed,
    count(*) FILTER (WHERE x.ts_sec >= e.ts_sec - 300) AS ip_total
  FROM dedup e JOIN dedup x
    ON x.source_ip = e.source_ip AND x.ts_sec BETWEEN e.ts_sec - 86400 AND e.ts_sec
   AND (x.ts_sec < e.ts_sec OR x.seq <= e.seq)
  GROUP BY e.seq
)
"""

ACCOUNT_SQL = """
af AS (
  SELECT e.seq,
    count(*) FILTER (WHERE x.ts_sec >= e.ts_sec - 600
                       AND (x.api_action LIKE '%Delete%' OR x.api_action LIKE '%Terminate%')) AS account_delete_actions_10m,
    sum(x.bytes_received) AS account_bytes_received_1h
  FROM dedup e JOIN dedup x
    ON x.account_id = e.account_id AND x.ts_sec BETWEEN e.ts_sec - 3600 AND e.ts_sec
   AND (x.ts_sec < e.ts_sec OR x.seq <= e.seq)
  GROUP BY e.seq
),
asv AS (
  SELECT e.seq, x.service_name, count(*)::DOUBLE AS c
  FROM dedup e JOIN dedup x
    ON x.account_id = e.account_id AND x.ts_sec BETWEEN e.ts_sec - 3600 AND e.ts_sec
   AND (x.ts_sec < e.ts_sec OR x.seq <= e.seq)
  GROUP BY e.seq, x.service_name
),
aent AS (
  SELECT seq, greatest(round(-sum((c / n) * log2(c / n)), 3), 0.0) + 0.0 AS account_service_entropy_1h
  FROM (SELECT seq, c, sum(c) OVER (PARTITION BY seq) AS n FROM asv)
  GROUP BY seq
)
"""

FEATURES_SQL = """
features AS (
  SELECT d.*,
    uf.failed_logins_5m, uf.failed_logins_1h, uf.request_count_5m,
    uf.distinct_ips_24h, uf.distinct_countries_24h, uf.distinct_regions_24h,
    uf.privileged_actions_1h,
    ipf.ip_users_24h,
    coalesce(round(ipf.ip_failed::DOUBLE / nullif(ipf.ip_total, 0), 3), 0.0) AS ip_failed_auth_rate_5m,
    af.account_delete_actions_10m,
    aent.account_service_entropy_1h,
    af.account_bytes_received_1h::BIGINT AS account_bytes_received_1h,
    (f.rn_user > 1 AND f.rn_country = 1) AS is_new_country_for_user,
    (f.rn_user > 1 AND f.rn_ip = 1) AS is_new_ip_for_user,
    d.auth_result = 'failure' AS auth_failure
  FROM dedup d
  JOIN uf USING (seq) JOIN firsts f USING (seq) JOIN ipf USING (seq)
  JOIN af USING (seq) JOIN aent USING (seq)
)
"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


FEATURE_CTES = with_ctes(SECURITY_EVENTS_SQL, DEDUP_SQL, USER_SQL, IP_SQL, ACCOUNT_SQL, FEATURES_SQL)


def feature_query(cols: list[str]) -> str:
    return FEATURE_CTES + f"SELECT event_id, {', '.join(cols)} FROM features"


# ----------------------------------------------------------------- model statistics and scores
FEATURES16 = [
    "failed_logins_5m", "failed_logins_1h", "request_count_5m", "distinct_ips_24h", "distinct_countries_24h",
    "distinct_regions_24h", "privileged_actions_1h", "ip_users_24h", "ip_failed_auth_rate_5m",
    "account_delete_actions_10m", "account_service_entropy_1h", "account_bytes_received_1h",
    "is_new_country_for_user", "is_new_ip_for_user", "is_privileged_action", "auth_failure",
]
BOOLS = {"is_new_country_for_user", "is_new_ip_for_user", "is_privileged_action", "auth_failure"}


def _d(c: str) -> str:
    return f"{c}::INTEGER::DOUBLE" if c.split(".")[-1] in BOOLS else f"{c}::DOUBLE"


def _txt(c: str) -> str:
    if c.split(".")[-1] in BOOLS:
        return f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
    return f"{c}::VARCHAR"


STATS_SQL = (
    "stats AS (\n  SELECT\n"
    + ",\n".join(
        f"    median({_d(c)}) AS median_{c},\n"
        f"    CASE WHEN stddev_pop({_d(c)}) > 1e-9 THEN stddev_pop({_d(c)}) ELSE 1.0 END AS std_{c}"
        for c in FEATURES16
    )
    + ",\n    quantile_cont(1.0 / (1.0 + exp(raw_score * 3.5)), 0.5) AS p50"
    + ",\n    quantile_cont(1.0 / (1.0 + exp(raw_score * 3.5)), 0.9) AS p90"
    + ",\n    quantile_cont(1.0 / (1.0 + exp(raw_score * 3.5)), 0.95) AS p95"
    + ",\n    quantile_cont(1.0 / (1.0 + exp(raw_score * 3.5)), 0.99) AS p99"
    + ",\n    avg(CASE WHEN raw_score < 0 THEN 1.0 ELSE 0.0 END) AS observed_anomaly_fraction"
    + ",\n    count(*) AS training_rows"
    + "\n  FROM features\n)"
)

SCORE_BASE_SQL = """
score_base AS (
  SELECT f.*,
    round(1.0 / (1.0 + exp(raw_score * 3.5)), 4) AS anomaly_score,
    round(abs(raw_score) / (abs(raw_score) + 0.5), 4) AS confidence,
    raw_score < 0 AS predicted_anomaly,
    'fixture-raw-score' AS model_version
  FROM features f
)
"""

CONTRIB_SQL = (
    "contrib AS (\n"
    + "\n  UNION ALL\n".join(
        f"  SELECT s.seq, {i} AS pos, '{c}=' || {_txt('s.' + c)} AS item,"
        f" abs({_d('s.' + c)} - st.median_{c}) / st.std_{c} AS dev FROM score_base s CROSS JOIN stats st"
        for i, c in enumerate(FEATURES16)
    )
    + "\n),\n"
    + """top3 AS (
  SELECT seq, string_agg(item, ', ' ORDER BY dev DESC, pos) AS tc
  FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY dev DESC, pos) AS rk FROM contrib)
  WHERE rk <= 3 GROUP BY seq
)"""
)

SCORED_SQL = """
scored AS (
  SELECT b.*, t.tc,
    CASE WHEN b.anomaly_score >= st.p99 THEN 'above the training p99 anomaly score'
         WHEN b.anomaly_score >= st.p95 THEN 'above the training p95 anomaly score'
         WHEN b.anomaly_score >= st.p90 THEN 'above the training p90 anomaly score'
         ELSE 'within the lower 90% of training anomaly scores' END AS band,
    'Model classified this event as ' || CASE WHEN b.predicted_anomaly THEN 'anomalous' ELSE 'within baseline' END
      || ' with score ' || printf('%.4f', b.anomaly_score) || ' ('
      || CASE WHEN b.anomaly_score >= st.p99 THEN 'above the training p99 anomaly score'
              WHEN b.anomaly_score >= st.p95 THEN 'above the training p95 anomaly score'
              WHEN b.anomaly_score >= st.p90 THEN 'above the training p90 anomaly score'
              ELSE 'within the lower 90% of training anomaly scores' END
      || '). The largest feature deviations were ' || t.tc || '.' AS explanation
  FROM score_base b JOIN top3 t USING (seq) CROSS JOIN stats st
)
"""

SCORED_CTES = with_ctes(
    SECURITY_EVENTS_SQL, DEDUP_SQL, USER_SQL, IP_SQL, ACCOUNT_SQL, FEATURES_SQL, STATS_SQL, SCORE_BASE_SQL,
    CONTRIB_SQL, SCORED_SQL,
)

# ----------------------------------------------------------------- rules and alerts
RULES_SQL = """
rule_rows AS (
  SELECT seq, 1 AS rule_pos, 'high' AS base_severity, 'Failed login burst detected' AS title,
    least(0.99::DOUBLE, 0.5::DOUBLE + failed_logins_5m * 0.08::DOUBLE) AS rule_score, 0.86::DOUBLE AS rule_conf,
    [failed_logins_5m::VARCHAR || ' failed console logins in the last 5 minutes',
     'Source country ' || geo_country,
     'IP failed auth rate in 5 minutes: ' || ip_failed_auth_rate_5m::VARCHAR] AS base_reasons,
    ['Lock the account if the failures continue',
     'Verify whether the source IP belongs to corporate infrastructure',
     'Require MFA re-authentication'] AS actions
  FROM scored WHERE api_action = 'ConsoleLogin' AND auth_result = 'failure' AND failed_logins_5m >= 5
  UNION ALL
  SELECT seq, 2, 'critical', 'Privileged action from unseen country', 0.97::DOUBLE, 0.91::DOUBLE,
    ['Privileged action ' || api_action, 'New country for user: ' || geo_country,
     'Distinct countries seen in 24 hours: ' || distinct_countries_24h::VARCHAR],
    ['Review the initiating session and recent IAM activity',
     'Temporarily revoke high-risk credentials if unverified',
     'Correlate with device and VPN logs']
  FROM scored WHERE is_privileged_action AND is_new_country_for_user
  UNION ALL
  SELECT seq, 3, 'high', 'Deletion activity spike',
    least(0.98::DOUBLE, 0.45::DOUBLE + account_delete_actions_10m * 0.1::DOUBLE), 0.79::DOUBLE,
    [account_delete_actions_10m::VARCHAR || ' delete or terminate actions in 10 minutes',
     'Account ' || account_id,
     'Account service entropy in 1 hour: ' || account_service_entropy_1h::VARCHAR],
    ['Confirm whether an authorized cleanup job is running',
     'Snapshot impacted resources if available',
     'Pause destructive automation until triage completes']
  FROM scored WHERE (api_action LIKE '%Delete%' OR api_action LIKE '%Terminate%') AND account_delete_actions_10m >= 4
  UNION ALL
  SELECT seq, 4, 'medium', 'High-volume data access', 0.84::DOUBLE, 0.72::DOUBLE,
    [bytes_received::VARCHAR || ' bytes received', 'API action ' || api_action,
     'Account bytes received in 1 hour: ' || account_bytes_received_1h::VARCHAR],
    ['Check whether the transfer matches an approved backup or analytics job',
     'Review the affected bucket or dataset']
  FROM scored WHERE bytes_received >= 2000000
),
ml_ctx AS (
  SELECT s.*,
    greatest(0.48::DOUBLE, 0.54::DOUBLE
      - CASE WHEN is_new_country_for_user THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END
      - CASE WHEN is_new_ip_for_user THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END
      - CASE WHEN account_service_entropy_1h >= 1.4 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END
      - CASE WHEN distinct_countries_24h >= 3 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END) AS ml_threshold,
    least(0.99::DOUBLE, anomaly_score + (0.0::DOUBLE
      + CASE WHEN is_new_country_for_user THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN is_new_ip_for_user THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN account_service_entropy_1h >= 1.4 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN distinct_countries_24h >= 3 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END)) AS effective_ml_score
  FROM scored s
),
ml_rows AS (
  SELECT seq, 5 AS rule_pos, CASE WHEN effective_ml_score >= 0.6 THEN 'high' ELSE 'medium' END AS base_severity,
    'Behavioral anomaly detected by ML model' AS title, anomaly_score AS rule_score, confidence AS rule_conf,
    list_concat(['Isolation Forest anomaly score: ' || anomaly_score::VARCHAR, explanation],
      list_filter([
        CASE WHEN is_new_country_for_user THEN 'New country observed for user: ' || geo_country END,
        CASE WHEN is_new_ip_for_user THEN 'New IP observed for user: ' || source_ip END,
        CASE WHEN account_service_entropy_1h >= 1.4
             THEN 'Broad account service spread in 1 hour: ' || account_service_entropy_1h::VARCHAR END,
        CASE WHEN distinct_countries_24h >= 3
             THEN 'User has touched ' || distinct_countries_24h::VARCHAR || ' countries in 24 hours' END], lambda x: x IS NOT NULL))
      AS base_reasons,
    ['Review the feature snapshot and recent user activity',
     'Correlate the alert with recent authentication and resource access patterns'] AS actions
  FROM ml_ctx
  WHERE predicted_anomaly AND effective_ml_score >= ml_threshold AND seq NOT IN (SELECT seq FROM rule_rows)
),
all_rows AS (
  SELECT r.*, CASE WHEN r.rule_pos = 5 THEN ['ml'] ELSE ['rule'] END AS base_sources FROM rule_rows r
  UNION ALL
  SELECT m.*, ['ml'] FROM ml_rows m
),
alerts AS (
  SELECT s.event_id, s.seq, s.ts_sec, s.account_id, s.user_id, s.source_ip, s.geo_country, s.service_name,
    s.api_action, a.title, a.rule_pos, a.base_severity, a.actions,
    s.anomaly_score, s.confidence, s.model_version, s.tc, s.explanation,
    CASE WHEN s.predicted_anomaly AND NOT list_contains(a.base_sources, 'ml')
         THEN list_concat(a.base_sources, ['ml']) ELSE a.base_sources END AS sources,
    (['low','medium','high','critical'])[1 + least(3, list_position(['low','medium','high','critical'], a.base_severity) - 1
      + CASE WHEN NOT s.predicted_anomaly THEN 0 WHEN s.anomaly_score >= 0.64 THEN 2
             WHEN s.anomaly_score >= 0.56 THEN 1 ELSE 0 END)] AS severity,
    list_concat(a.base_reasons,
      CASE WHEN s.predicted_anomaly AND NOT list_contains(a.base_sources, 'ml')
           THEN ['ML contributors: ' || s.tc, s.explanation] ELSE [] END) AS reasons0
  FROM all_rows a JOIN scored s USING (seq)
),
alerts_final AS (
  SELECT *,
    list_concat(reasons0, CASE WHEN severity <> base_severity
      THEN ['Hybrid severity adjusted from ' || base_severity || ' to ' || severity || ' based on model corroboration.']
      ELSE [] END) AS reasons,
    '{"event_id": "' || event_id || '", "model_version": "' || model_version || '", "sources": ['
      || array_to_string(list_transform(list_sort(sources), lambda x: '"' || x || '"'), ', ')
      || '], "title": "' || title || '"}' AS idempotency_key,
    '{"account_id": "' || account_id || '", "api_action": "' || api_action || '", "geo_country": "' || geo_country
      || '", "service_name": "' || service_name || '", "severity": "' || severity || '", "source_ip": "' || source_ip
      || '", "sources": [' || array_to_string(list_transform(list_sort(sources), lambda x: '"' || x || '"'), ', ')
      || '], "title": "' || title || '", "user_id": "' || user_id || '"}' AS alert_fingerprint
  FROM alerts
)
"""

ALERT_CTES = SCORED_CTES.rstrip() + ",\n" + RULES_SQL.strip() + "\n"

SESSIONS_SQL = """
,
islands AS (
  SELECT *, sum(CASE WHEN prev_ts IS NULL OR ts_sec - prev_ts > 300 THEN 1 ELSE 0 END)
      OVER (PARTITION BY alert_fingerprint ORDER BY ts_sec, seq ROWS UNBOUNDED PRECEDING) AS sid
  FROM (SELECT *, lag(ts_sec) OVER (PARTITION BY alert_fingerprint ORDER BY ts_sec, seq) AS prev_ts FROM alerts_final)
),
reason_items AS (
  SELECT alert_fingerprint, sid, ts_sec, seq, unnest(reasons) AS item, generate_subscripts(reasons, 1) AS pos FROM islands
),
action_items AS (
  SELECT alert_fingerprint, sid, ts_sec, seq, unnest(actions) AS item, generate_subscripts(actions, 1) AS pos FROM islands
),
contrib_items AS (
  SELECT alert_fingerprint, sid, ts_sec, seq, unnest(string_split(tc, ', ')) AS item,
         generate_subscripts(string_split(tc, ', '), 1) AS pos FROM islands
),
reason_u AS (
  SELECT alert_fingerprint, sid, string_agg(item, ' | ' ORDER BY ts_sec, seq, pos) AS reasons FROM (
    SELECT *, row_number() OVER (PARTITION BY alert_fingerprint, sid, item ORDER BY ts_sec, seq, pos) AS rn FROM reason_items
  ) WHERE rn = 1 GROUP BY ALL
),
action_u AS (
  SELECT alert_fingerprint, sid, string_agg(item, ' | ' ORDER BY ts_sec, seq, pos) AS recommended_actions FROM (
    SELECT *, row_number() OVER (PARTITION BY alert_fingerprint, sid, item ORDER BY ts_sec, seq, pos) AS rn FROM action_items
  ) WHERE rn = 1 GROUP BY ALL
),
contrib_u AS (
  SELECT alert_fingerprint, sid, string_agg(item, ' | ' ORDER BY ts_sec, seq, pos) AS ml_top_contributors FROM (
    SELECT *, row_number() OVER (PARTITION BY alert_fingerprint, sid, item ORDER BY ts_sec, seq, pos) AS rn FROM contrib_items
  ) WHERE rn = 1 GROUP BY ALL
),
folded AS (
  SELECT alert_fingerprint, sid,
    sha256(first(idempotency_key ORDER BY ts_sec, seq)) AS alert_id,
    min(ts_sec) AS created_ts, max(ts_sec) AS last_seen_ts,
    (['low','medium','high','critical'])[max(list_position(['low','medium','high','critical'], severity))] AS severity,
    last(title ORDER BY ts_sec, seq) AS title,
    max(anomaly_score) AS anomaly_score, max(confidence) AS confidence,
    array_to_string(list_sort(first(sources)), ' | ') AS detection_sources,
    max(anomaly_score) AS ml_anomaly_score, max(confidence) AS ml_confidence,
    last(model_version ORDER BY ts_sec, seq) AS model_version,
    last(explanation ORDER BY ts_sec, seq) AS ml_explanation,
    count(*) - 1 AS suppression_count,
    last(event_id ORDER BY ts_sec, seq) AS event_id,
    last(idempotency_key ORDER BY ts_sec, seq) AS idempotency_key
  FROM islands GROUP BY alert_fingerprint, sid
),
alert_table AS (
  SELECT f.*, coalesce(r.reasons, '') AS reasons, coalesce(a.recommended_actions, '') AS recommended_actions,
         coalesce(c.ml_top_contributors, '') AS ml_top_contributors
  FROM folded f LEFT JOIN reason_u r USING (alert_fingerprint, sid)
  LEFT JOIN action_u a USING (alert_fingerprint, sid) LEFT JOIN contrib_u c USING (alert_fingerprint, sid)
)
"""

TABLE_CTES = ALERT_CTES.rstrip() + SESSIONS_SQL

CATEGORY_SQL = """CASE WHEN detection_sources = 'ml' THEN 'ml-only'
       WHEN detection_sources LIKE '%ml%' AND detection_sources LIKE '%rule%' THEN 'rule+ml'
       WHEN detection_sources LIKE '%rule%' THEN 'rule-only' ELSE 'unknown' END"""


def _alert_select(where: str = "") -> str:
    return (
        ALERT_CTES
        + "SELECT event_id, title, severity, anomaly_score, confidence, array_to_string(sources, ' | ') AS detection_sources,"
        " array_to_string(reasons, ' | ') AS reasons, anomaly_score AS ml_anomaly_score, confidence AS ml_confidence,"
        " model_version, replace(tc, ', ', ' | ') AS ml_top_contributors, explanation AS ml_explanation FROM alerts_final"
        + where
    )


def _rule_select(pos: int) -> str:
    return (
        SCORED_CTES.rstrip() + ",\n" + RULES_SQL.strip().split("\n),\nml_ctx AS")[0] + "\n)\n"
        + "SELECT s.event_id, r.base_severity AS severity, r.title, r.rule_score AS anomaly_score, r.rule_conf AS confidence,"
        " array_to_string(r.base_reasons, ' | ') AS reasons, array_to_string(r.actions, ' | ') AS recommended_actions"
        f" FROM rule_rows r JOIN scored s USING (seq) WHERE r.rule_pos = {pos}"
    )


def oracles() -> dict[str, str]:
    o: dict[str, str] = dict(ingest_oracles())
    o.update(table_oracles())
    o.update(more_oracles())
    ev = with_ctes(SECURITY_EVENTS_SQL)
    o["event_seconds"] = ev + "SELECT event_id, epoch(\"timestamp\")::BIGINT AS event_seconds FROM security_events"
    o["delete_like"] = ev + (
        "SELECT event_id, api_action, (api_action LIKE '%Delete%' OR api_action LIKE '%Terminate%') AS delete_like"
        " FROM security_events"
    )
    for c in FEATURES16:
        if c in ("is_privileged_action", "auth_failure"):
            continue
        o[c] = feature_query([c])
    o["feature_snapshot"] = feature_query(FEATURES16)
    o["dedup_events"] = ev + "SELECT event_id, min(seq) AS seq FROM security_events GROUP BY event_id"
    o["feature_vector"] = FEATURE_CTES + "SELECT event_id, " + ", ".join(f"{_d(c)} AS {c}" for c in FEATURES16) + " FROM features"
    st = with_ctes(SECURITY_EVENTS_SQL, DEDUP_SQL, USER_SQL, IP_SQL, ACCOUNT_SQL, FEATURES_SQL, STATS_SQL)
    o["feature_stats"] = st + "SELECT " + ", ".join(f"median_{c}, round(std_{c}, 6) AS std_{c}" for c in FEATURES16) + " FROM stats"
    o["score_percentiles"] = st + "SELECT p50, p90, p95, p99, observed_anomaly_fraction, training_rows FROM stats"
    o["score_from_raw"] = SCORED_CTES + "SELECT event_id, raw_score, anomaly_score, confidence, predicted_anomaly FROM scored"
    o["score_band"] = SCORED_CTES + "SELECT event_id, anomaly_score, band AS score_band FROM scored"
    o["top_contributors"] = SCORED_CTES + "SELECT event_id, replace(tc, ', ', ' | ') AS top_contributors FROM scored"
    o["explanation"] = SCORED_CTES + "SELECT event_id, explanation FROM scored"
    o["score_no_model"] = ev + (
        "SELECT event_id, 0.0::DOUBLE AS anomaly_score, 0.0::DOUBLE AS confidence, false AS predicted_anomaly,"
        " 'unavailable' AS model_version,"
        " 'Model artifact unavailable. Falling back to rules-only detection.' AS explanation,"
        " 0 AS n_contributors FROM security_events"
    )
    o["scenario_breakdown"] = SCORED_CTES + (
        "SELECT coalesce(scenario, 'unknown') AS scenario, count(*) AS count,"
        " sum(predicted_anomaly::INTEGER)::BIGINT AS predicted_anomalies,"
        " round(sum(predicted_anomaly::INTEGER)::DOUBLE / count(*)::DOUBLE, 4) AS predicted_anomaly_rate"
        " FROM scored GROUP BY 1 ORDER BY predicted_anomaly_rate DESC, scenario"
    )
    o["rule_failed_login_burst"] = _rule_select(1)
    o["rule_privileged_new_country"] = _rule_select(2)
    o["rule_deletion_spike"] = _rule_select(3)
    o["rule_high_volume_transfer"] = _rule_select(4)
    o["ml_threshold"] = ALERT_CTES + "SELECT event_id, ml_threshold, effective_ml_score FROM ml_ctx"
    o["rule_alerts"] = ALERT_CTES + "SELECT s.event_id, r.title, r.base_severity AS severity FROM rule_rows r JOIN scored s USING (seq)"
    o["ml_alerts"] = _alert_select(" WHERE rule_pos = 5")
    o["alerts"] = _alert_select()
    o["hybrid_severity"] = ALERT_CTES + (
        "SELECT event_id, title, base_severity, severity AS hybrid_severity FROM alerts WHERE rule_pos < 5"
    )
    o["alert_reasons"] = ALERT_CTES + "SELECT event_id, title, array_to_string(reasons, ' | ') AS reasons FROM alerts_final"
    o["detection_category"] = ALERT_CTES + (
        "SELECT event_id, title,"
        " CASE WHEN sources = ['ml'] THEN 'ml-only' WHEN list_contains(sources, 'rule') AND list_contains(sources, 'ml')"
        " THEN 'rule+ml' WHEN list_contains(sources, 'rule') THEN 'rule-only' ELSE 'unknown' END AS detection,"
        " CASE WHEN sources = ['ml'] THEN 'ml_only' WHEN sources = ['rule'] THEN 'rule_only'"
        " WHEN list_contains(sources, 'rule') AND list_contains(sources, 'ml') THEN 'rule_plus_ml' ELSE 'unknown' END"
        " AS metric_category FROM alerts_final"
    )
    o["fingerprints"] = ALERT_CTES + "SELECT event_id, title, idempotency_key, alert_fingerprint FROM alerts_final"
    o["alerts_idempotent"] = ALERT_CTES + "SELECT idempotency_key, event_id, title FROM alerts_final"
    o["alerts_suppressed"] = TABLE_CTES + (
        "SELECT alert_id, alert_fingerprint, created_ts, last_seen_ts, severity, title, anomaly_score, confidence,"
        " detection_sources, reasons, recommended_actions, ml_top_contributors, ml_anomaly_score, ml_confidence,"
        " model_version, ml_explanation, suppression_count, event_id, idempotency_key FROM alert_table"
    )
    o["alert_summary"] = TABLE_CTES + (
        "SELECT s.severity, coalesce(c.n, 0)::BIGINT AS count FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) s(severity)"
        " LEFT JOIN (SELECT severity, count(*) AS n FROM alert_table GROUP BY severity) c USING (severity)"
    )
    o["detection_mix"] = TABLE_CTES + (
        f"SELECT {CATEGORY_SQL} AS detection, count(*) AS count FROM alert_table GROUP BY 1 ORDER BY count DESC, detection"
    )
    o["alerts_by_category"] = TABLE_CTES + (
        f"SELECT alert_id, {CATEGORY_SQL} AS detection, severity, title,"
        " split_part(split_part(alert_fingerprint, '\"user_id\": \"', 2), '\"', 1) AS user_id, last_seen_ts"
        f" FROM alert_table WHERE {CATEGORY_SQL} IN ('rule+ml', 'rule-only', 'ml-only')"
    )
    o["alert_flat"] = TABLE_CTES + (
        f"SELECT alert_id, created_ts AS created_at, last_seen_ts AS last_seen_at, severity, {CATEGORY_SQL} AS detection,"
        " title, e.user_id, e.geo_country AS country, e.service_name AS service, e.api_action AS action,"
        " anomaly_score AS score, ml_anomaly_score AS ml_score, coalesce(model_version, 'n/a') AS model_version,"
        " suppression_count AS suppressed_repeats, e.failed_logins_5m, e.distinct_countries_24h"
        " FROM alert_table JOIN features e USING (event_id)"
    )
    o["ml_score_distribution"] = TABLE_CTES + (
        "SELECT least(floor(ml_anomaly_score * 10), 9)::BIGINT AS bucket, count(*) AS count FROM alert_table"
        " WHERE ml_anomaly_score IS NOT NULL GROUP BY 1"
    )
    o["recent_alerts"] = TABLE_CTES + (
        "SELECT alert_id, last_seen_ts, severity, title, suppression_count FROM alert_table"
        " ORDER BY last_seen_ts DESC, alert_id LIMIT 100"
    )
    o["alert_detail"] = TABLE_CTES + (
        f"SELECT alert_id, upper(severity) || ' | ' || {CATEGORY_SQL} || ' | ' || title || ' | '"
        " || split_part(split_part(alert_fingerprint, '\"user_id\": \"', 2), '\"', 1) AS label,"
        " d.description, replace(reasons, ' | ', ', ') AS reasons_text,"
        " replace(recommended_actions, ' | ', ', ') AS actions_text,"
        " coalesce(nullif(replace(ml_top_contributors, ' | ', ', '), ''), 'n/a') AS contributors_text"
        " FROM alert_table JOIN (VALUES"
        " ('Failed login burst detected', 'Multiple failed console login attempts observed in a short window.'),"
        " ('Privileged action from unseen country', 'A privileged API action originated from a country not previously observed for this identity.'),"
        " ('Deletion activity spike', 'Resource deletion velocity exceeded the expected local baseline for the account.'),"
        " ('High-volume data access', 'An unusually large data transfer was observed for a single event.'),"
        " ('Behavioral anomaly detected by ML model', 'The event deviated materially from the learned behavioral baseline.')"
        ") d(title, description) USING (title)"
    )
    return o


# ----------------------------------------------------------------- ingest: raw lines and validation
def _q(x: str) -> str:
    return f"'\"' || {x} || '\"'"


RAW_LINES_SQL = f"""
raw_base AS (
  SELECT *, (seq * 2654435761) % 128 AS kind,
    strftime(make_timestamp(ts_sec * 1000000), '%Y-%m-%dT%H:%M:%S') AS ts_local
  FROM security_events
),
raw_lines AS (
  SELECT seq, make_timestamp(ts_sec * 1000000) AS arrival_ts, kind,
    CASE WHEN kind = 0 THEN 'not json {{' || event_id
         WHEN kind = 1 THEN '[1, 2]'
         WHEN kind = 2 THEN '"text"'
         ELSE '{{' || concat_ws(', ',
           '"account_id": ' || {_q('account_id')},
           '"api_action": ' || {_q('api_action')},
           '"auth_result": ' || {_q("CASE WHEN kind = 16 THEN 'maybe' ELSE auth_result END")},
           '"bytes_received": ' || CASE WHEN kind = 11 THEN '-1' WHEN kind = 12 THEN '"x"' WHEN kind = 13 THEN 'null'
                                        WHEN kind = 19 THEN NULL WHEN kind = 20 THEN '"7"' WHEN kind = 27 THEN '7.0' ELSE bytes_received::VARCHAR END,
           '"bytes_sent": ' || bytes_sent::VARCHAR,
           '"cloud_provider": ' || {_q("CASE WHEN kind = 5 THEN 'oci' ELSE cloud_provider END")},
           '"device_fingerprint": ' || {_q('device_fingerprint')},
           '"event_id": ' || CASE WHEN kind = 3 THEN NULL WHEN kind = 21 THEN {_q("'  ' || event_id || '  '")}
                                  ELSE {_q('event_id')} END,
           '"geo_country": ' || {_q("CASE WHEN kind = 8 THEN 'USA' WHEN kind = 9 THEN 'U1' WHEN kind = 10 THEN ' U' WHEN kind = 17 THEN lower(geo_country) ELSE geo_country END")},
           '"is_privileged_action": ' || CASE WHEN kind = 28 THEN '"on"' WHEN is_privileged_action THEN 'true' ELSE 'false' END,
           '"metadata": ' || CASE WHEN kind = 24 THEN '[1]' WHEN kind = 25 THEN 'null' ELSE '{{"scenario": ' || {_q('scenario')} || '}}' END,
           '"principal_type": ' || {_q("CASE WHEN kind = 6 THEN 'bot' ELSE principal_type END")},
           '"region": ' || {_q('region')},
           '"resource_id": ' || {_q('resource_id')},
           '"resource_type": ' || {_q('resource_type')},
           '"service_name": ' || {_q('service_name')},
           '"source_ip": ' || {_q("CASE WHEN kind = 7 THEN '999.1.1.1' WHEN kind = 18 THEN '2001:db8::1' WHEN kind = 26 THEN '::ffff:10.0.0.1' ELSE source_ip END")},
           '"timestamp": ' || CASE WHEN kind = 29 THEN ts_sec::VARCHAR ELSE {_q("CASE WHEN kind = 14 THEN ts_local WHEN kind = 15 THEN 'nope' WHEN kind = 22 THEN strftime(make_timestamp((ts_sec - 18000) * 1000000), '%Y-%m-%dT%H:%M:%S') || '-05:00' ELSE ts_local || '+00:00' END")} END,
           '"user_agent": ' || {_q('user_agent')},
           '"user_id": ' || CASE WHEN kind = 23 THEN '5' ELSE {_q("CASE WHEN kind = 4 THEN '  ' WHEN kind = 30 THEN chr(160) WHEN kind = 21 THEN '  ' || user_id || '  ' ELSE user_id END")} END
         ) || '}}'
    END AS value
  FROM raw_base
)
"""


def _validation_sql() -> str:
    from ..functions import validate as V
    from ..schema import AUTH_RESULTS, CLOUD_PROVIDERS, NON_BLANK_FIELDS, PRINCIPAL_TYPES, REQUIRED_FIELDS

    def js(f: str) -> str:
        return f"json_extract_string(j, '$.{f}')"

    def text(f: str) -> str:
        return f"CASE WHEN json_type(j, '$.{f}') = 'VARCHAR' THEN {js(f)} END"

    def number(f: str) -> str:
        exact = f"TRY_CAST(trim({js(f)}) AS DECIMAL(38, 6))"
        whole = f"CASE WHEN {exact} = floor({exact}) THEN TRY_CAST({exact} AS BIGINT) END"
        return (
            f"CASE json_type(j, '$.{f}') WHEN 'BOOLEAN' THEN CASE WHEN {js(f)} = 'true' THEN 1 ELSE 0 END"
            f" WHEN 'VARCHAR' THEN CASE WHEN regexp_matches({js(f)}, '{V.INTEGER_PATTERN}') THEN {whole} END"
            f" WHEN 'UBIGINT' THEN {whole} WHEN 'BIGINT' THEN {whole} WHEN 'DOUBLE' THEN {whole} END"
        )

    def strip(x: str) -> str:
        return f"regexp_replace({x}, '^{V.SPACE}+|{V.SPACE}+$', '', 'g')"

    errs = [f"CASE WHEN NOT is_object THEN '{V.MSG_OBJECT}' END"]
    for f in REQUIRED_FIELDS:
        errs.append(f"CASE WHEN is_object AND {js(f)} IS NULL THEN '{f}: {V.MSG_REQUIRED}' END")
    for f in (*NON_BLANK_FIELDS, "geo_country", "source_ip"):
        errs.append(f"CASE WHEN {js(f)} IS NOT NULL AND {text(f)} IS NULL THEN '{f}: {V.MSG_STRING}' END")
    for f in NON_BLANK_FIELDS:
        errs.append(f"CASE WHEN {strip(text(f))} = '' THEN '{f}: {V.MSG_BLANK}' END")
    for f, allowed in (("cloud_provider", CLOUD_PROVIDERS), ("principal_type", PRINCIPAL_TYPES), ("auth_result", AUTH_RESULTS)):
        lst = ", ".join(f"'{a}'" for a in allowed)
        errs.append(f"CASE WHEN {js(f)} IS NOT NULL AND NOT coalesce({text(f)} IN ({lst}), false) THEN '{f}: {V.MSG_CHOICE}' END")
    gc = text("geo_country")
    errs.append(f"CASE WHEN length({gc}) <> 2 THEN 'geo_country: {V.MSG_COUNTRY_LEN}' END")
    errs.append(
        f"CASE WHEN length({gc}) = 2 AND NOT regexp_full_match(upper({strip(gc)}), '\\p{{L}}{{2}}')"
        f" THEN 'geo_country: {V.MSG_COUNTRY}' END"
    )
    ip = strip(text("source_ip"))
    plain6 = f"regexp_replace(regexp_replace({ip}, '%[^%]+$', ''), '{V.IPV4_TAIL_PATTERN}', ':0:0')"
    errs.append(
        f"CASE WHEN NOT (regexp_matches({ip}, '{V.IPV4_PATTERN}') OR regexp_matches({plain6}, '{V.IPV6_PATTERN}'))"
        f" THEN 'source_ip: {V.MSG_IP}' END"
    )
    for f in ("bytes_sent", "bytes_received"):
        n = number(f)
        errs.append(f"CASE WHEN json_exists(j, '$.{f}') AND {n} IS NULL THEN '{f}: {V.MSG_INT}' END")
        errs.append(f"CASE WHEN {n} < 0 THEN '{f}: {V.MSG_NONNEG}' END")
    words = lambda ws: ", ".join(f"'{w}'" for w in ws)
    word = f"lower({js('is_privileged_action')})"
    pb = f"CASE WHEN {word} IN ({words(V.TRUE_WORDS)}) THEN true WHEN {word} IN ({words(V.FALSE_WORDS)}) THEN false END"
    errs.append(f"CASE WHEN json_exists(j, '$.is_privileged_action') AND {pb} IS NULL THEN 'is_privileged_action: {V.MSG_BOOL}' END")
    tt = js("timestamp")
    epoch = f"CASE WHEN json_type(j, '$.timestamp') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST({tt} AS BIGINT) END"
    ts = f"coalesce(to_timestamp({epoch}), TRY_CAST({tt} AS TIMESTAMPTZ))"
    day = f"CASE WHEN {epoch} IS NOT NULL THEN strftime(make_timestamp({epoch} * 1000000), '%Y-%m-%d') ELSE substring({tt}, 1, 10) END"
    errs.append(f"CASE WHEN {tt} IS NOT NULL AND {ts} IS NULL THEN 'timestamp: {V.MSG_TS}' END")
    errs.append(f"CASE WHEN {epoch} IS NULL AND {ts} IS NOT NULL AND NOT regexp_matches({tt}, '{V.ZONE_PATTERN}') THEN 'timestamp: {V.MSG_TZ}' END")
    errs.append(f"CASE WHEN json_exists(j, '$.metadata') AND json_type(j, '$.metadata') <> 'OBJECT' THEN 'metadata: {V.MSG_DICT}' END")
    errors = "list_filter([" + ",\n      ".join(errs) + "], lambda x: x IS NOT NULL)"
    trimmed = {f: strip(text(f)) for f in NON_BLANK_FIELDS}
    return f"""
decoded AS (
  SELECT seq, arrival_ts, kind, value,
    CASE WHEN json_valid(value) THEN json_type(CASE WHEN json_valid(value) THEN value ELSE '0' END) = 'OBJECT' ELSE false END AS is_object
  FROM raw_lines
),
decoded2 AS (SELECT *, CASE WHEN is_object THEN value END AS j FROM decoded),
validated AS (
  SELECT seq, arrival_ts, kind, value, is_object,
    {trimmed['event_id']} AS event_id,
    epoch({ts})::BIGINT AS ts_sec,
    {day} AS event_date,
    {js('cloud_provider')} AS cloud_provider,
    {trimmed['account_id']} AS account_id,
    {trimmed['user_id']} AS user_id,
    {js('principal_type')} AS principal_type,
    {ip} AS source_ip,
    upper({strip(gc)}) AS geo_country,
    {trimmed['region']} AS region,
    {trimmed['service_name']} AS service_name,
    {trimmed['api_action']} AS api_action,
    {trimmed['resource_type']} AS resource_type,
    {trimmed['resource_id']} AS resource_id,
    {js('auth_result')} AS auth_result,
    coalesce({number('bytes_sent')}, 0)::BIGINT AS bytes_sent,
    coalesce({number('bytes_received')}, 0)::BIGINT AS bytes_received,
    {trimmed['device_fingerprint']} AS device_fingerprint,
    {trimmed['user_agent']} AS user_agent,
    coalesce({pb}, false) AS is_privileged_action,
    coalesce(json_extract_string(j, '$.metadata.scenario'), 'unknown') AS scenario,
    {errors} AS errors
  FROM decoded2
)
"""


INGEST_CTES = with_ctes(SECURITY_EVENTS_SQL, RAW_LINES_SQL, _validation_sql())

PARSE_COLUMNS = [
    "seq", "event_id", "ts_sec", "event_date", "cloud_provider", "account_id", "user_id", "principal_type", "source_ip",
    "geo_country", "region", "service_name", "api_action", "resource_type", "resource_id", "auth_result", "bytes_sent",
    "bytes_received", "device_fingerprint", "user_agent", "is_privileged_action", "scenario",
]


def ingest_oracles() -> dict[str, str]:
    o = {}
    o["parse_events"] = INGEST_CTES + (
        "SELECT " + ", ".join(PARSE_COLUMNS) + ", len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors"
        " FROM validated WHERE is_object"
    )
    o["validate_events"] = INGEST_CTES + (
        "SELECT seq, kind, is_object, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors FROM validated"
    )
    dl = (
        "SELECT sha256('cloud-security-events:' || seq::VARCHAR || ':validation') AS dead_letter_id,"
        " epoch(arrival_ts)::BIGINT AS failed_ts, 'cloud-security-events' AS source_topic, 'validation' AS stage,"
        " CASE WHEN json_valid(value) THEN 'ValidationError' ELSE 'JSONDecodeError' END AS error_type,"
        " array_to_string(errors, '; ') AS error_message,"
        " CASE WHEN is_object THEN value ELSE '{\"raw\": ' || to_json(value)::VARCHAR || '}' END AS raw_payload,"
        " CASE WHEN is_object THEN json_extract_string(value, '$.event_id') END AS event_id, false AS retryable"
        " FROM validated WHERE len(errors) > 0"
    )
    o["dead_letters"] = INGEST_CTES + dl
    o["dead_letter_summary"] = INGEST_CTES + "SELECT stage, count(*) AS count FROM (" + dl + ") GROUP BY stage"
    o["recent_dead_letters"] = INGEST_CTES + (
        "SELECT failed_ts, stage, error_type, event_id, retryable FROM (" + dl + ")"
        " ORDER BY failed_ts DESC, dead_letter_id LIMIT 20"
    )
    o["raw_archive"] = INGEST_CTES + (
        # whole numbers are written without a fraction
        "SELECT seq, CASE WHEN is_object THEN replace(json(value)::VARCHAR, ':7.0,', ':7,')"
        " ELSE '{\"raw\":' || to_json(value)::VARCHAR || '}' END AS line, value FROM validated"
    )
    o["replay_slice"] = INGEST_CTES + (
        "SELECT seq + 1 AS line_no, value FROM raw_lines WHERE seq + 1 >= 1001 AND trim(value) <> ''"
        " ORDER BY line_no LIMIT 5000"
    )
    return o


# ----------------------------------------------------------------- stored tables and metrics
ALL_CTES = TABLE_CTES.rstrip() + ",\n" + RAW_LINES_SQL.strip() + ",\n" + _validation_sql().strip() + """,
dead AS (
  SELECT sha256('cloud-security-events:' || seq::VARCHAR || ':validation') AS dead_letter_id, seq, arrival_ts,
    'validation' AS stage, CASE WHEN is_object THEN value ELSE '{"raw": ' || to_json(value)::VARCHAR || '}' END AS raw_payload,
    CASE WHEN is_object THEN json_extract_string(value, '$.event_id') END AS event_id
  FROM validated WHERE len(errors) > 0
)
"""

ISO_SQL = "strftime(make_timestamp(ts_sec * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def table_oracles() -> dict[str, str]:
    o = {}
    cols = ", ".join(FEATURES16)
    o["offline_feature_rows"] = FEATURE_CTES + (
        f"SELECT event_id, {ISO_SQL} AS \"timestamp\", substring({ISO_SQL}, 1, 10) AS event_date, cloud_provider,"
        " account_id, user_id, source_ip, geo_country, region, service_name, api_action, principal_type,"
        f" coalesce(scenario, 'unknown') AS scenario, {cols} FROM features"
    )
    o["recent_features"] = FEATURE_CTES + (
        f"SELECT event_id, {ISO_SQL} AS \"timestamp\", seq FROM features ORDER BY ts_sec DESC, seq DESC LIMIT 1000"
    )
    o["alerts_decode"] = TABLE_CTES + (
        "SELECT alert_id, reasons, recommended_actions, detection_sources, ml_top_contributors, suppression_count,"
        " f.failed_logins_5m::VARCHAR AS failed_logins_5m, event_id FROM alert_table JOIN features f USING (event_id)"
    )
    o["dlq_decode"] = ALL_CTES + "SELECT dead_letter_id, false AS retryable, event_id, raw_payload, stage FROM dead"
    o["alerts_evolve"] = TABLE_CTES + (
        "SELECT alert_id, created_ts AS last_seen_ts, '{}' AS feature_context_json, '[]' AS detection_sources_json,"
        " '[]' AS ml_top_contributors_json, '' AS alert_fingerprint, '' AS idempotency_key,"
        " 0::BIGINT AS suppression_count, true AS model_version_missing FROM alert_table"
    )
    o["table_totals"] = ALL_CTES + (
        "SELECT (SELECT count(*) FROM alert_table) AS total_alerts, (SELECT count(*) FROM dead) AS total_dead_letters"
    )
    o["ops_metrics"] = ALL_CTES + """,
ops AS (
  SELECT 'events_consumed' AS metric, '' AS dimension, count(*)::DOUBLE AS value FROM raw_lines
  UNION ALL SELECT 'events_archived', '', count(*)::DOUBLE FROM raw_lines
  UNION ALL SELECT 'validation_failures', '', count(*)::DOUBLE FROM dead
  UNION ALL SELECT x, '', 0.0::DOUBLE FROM (VALUES ('alert_delivery_failures'), ('stream_processing_failures')) v(x)
  UNION ALL SELECT 'last_event_alert_count', '', count(*)::DOUBLE FROM alerts_final
    WHERE seq = (SELECT seq FROM scored ORDER BY ts_sec DESC, seq DESC LIMIT 1)
  UNION ALL SELECT 'dead_letters_published', stage, count(*)::DOUBLE FROM dead GROUP BY stage
  UNION ALL SELECT 'offline_feature_rows_buffered', '', count(*)::DOUBLE FROM scored
  UNION ALL SELECT 'score_requests', '', count(*)::DOUBLE FROM scored
  UNION ALL SELECT 'predicted_anomalies', '', sum(predicted_anomaly::INTEGER)::DOUBLE FROM scored
  UNION ALL SELECT 'model_unavailable', '', sum((model_version = 'unavailable')::INTEGER)::DOUBLE FROM scored
  UNION ALL SELECT 'last_anomaly_score', '', last(anomaly_score ORDER BY ts_sec, seq)::DOUBLE FROM scored
  UNION ALL SELECT 'alerts_emitted', '', count(*)::DOUBLE FROM alerts_final
  UNION ALL SELECT 'alerts_emitted', severity, count(*)::DOUBLE FROM alerts_final GROUP BY severity
  UNION ALL SELECT 'alerts_emitted', CASE WHEN sources = ['ml'] THEN 'ml_only' WHEN sources = ['rule'] THEN 'rule_only'
      WHEN list_contains(sources, 'rule') AND list_contains(sources, 'ml') THEN 'rule_plus_ml' ELSE 'unknown' END,
      count(*)::DOUBLE FROM alerts_final GROUP BY 2
  UNION ALL SELECT 'alerts_written', '', count(*)::DOUBLE FROM alert_table
  UNION ALL SELECT 'suppressed_updates', '', sum(suppression_count)::DOUBLE FROM alert_table
)
SELECT * FROM ops
UNION ALL SELECT metric || '_per_sec', '', round(value / (SELECT greatest(max(epoch(arrival_ts)) - min(epoch(arrival_ts)), 1) FROM raw_lines), 3)::DOUBLE
FROM ops WHERE dimension = '' AND metric NOT IN ('last_anomaly_score', 'last_event_alert_count', 'alerts_written', 'suppressed_updates')"""
    return o


# ----------------------------------------------------------------- stream, model and detail reads
NO_MODEL_SQL = """
scored AS (
  SELECT f.*, 0.0::DOUBLE AS anomaly_score, 0.0::DOUBLE AS confidence, false AS predicted_anomaly,
    'unavailable' AS model_version, '' AS tc,
    'Model artifact unavailable. Falling back to rules-only detection.' AS explanation
  FROM features f
)
"""


def more_oracles() -> dict[str, str]:
    table = (
        "SELECT alert_id, alert_fingerprint, created_ts, last_seen_ts, severity, title, anomaly_score, confidence,"
        " detection_sources, reasons, recommended_actions, ml_top_contributors, ml_anomaly_score, ml_confidence,"
        " model_version, ml_explanation, suppression_count, event_id, idempotency_key FROM alert_table"
    )
    stream = with_ctes(
        SECURITY_EVENTS_SQL, RAW_LINES_SQL, _validation_sql(),
        DEDUP_SQL.replace("security_events", "(SELECT * FROM validated WHERE len(errors) = 0)"),
        USER_SQL, IP_SQL, ACCOUNT_SQL, FEATURES_SQL, NO_MODEL_SQL,
        # without a model an alert carries the rule's own score
        RULES_SQL.replace("s.anomaly_score, s.confidence,", "a.rule_score AS anomaly_score, a.rule_conf AS confidence,"),
    ).rstrip() + SESSIONS_SQL
    trees = (
        "SELECT i::INTEGER AS tree_id, least(256, n)::INTEGER AS root_size, least(256, n)::BIGINT AS leaf_rows, true AS binary, true AS shallow"
        " FROM range(200) r(i), (SELECT count(DISTINCT event_id) AS n FROM events)"
    )
    late = """, late AS (
  SELECT alert_fingerprint, sid,
    sha256(coalesce(first(idempotency_key ORDER BY ts_sec, seq) FILTER (WHERE seq % 2 = 1), first(idempotency_key ORDER BY ts_sec, seq))) AS alert_id,
    coalesce(min(ts_sec) FILTER (WHERE seq % 2 = 1), min(ts_sec)) AS created_ts
  FROM islands GROUP BY alert_fingerprint, sid
)
"""
    letter = (
        "SELECT dead_letter_id, stage || ' | ' || error_type || ' | ' || coalesce(nullif(event_id, ''), 'no-event-id') AS label, stage, error_type,"
        " retryable, error_message, raw_payload FROM ({0}) WHERE dead_letter_id = (SELECT min(dead_letter_id) FROM ({0}))"
    )
    dead = ingest_oracles()["dead_letters"][len(INGEST_CTES):]
    return {
        "stream_alerts": stream + table.replace("ml_anomaly_score, ml_confidence", "0.0::DOUBLE AS ml_anomaly_score, 0.0::DOUBLE AS ml_confidence"),
        "alerts_redelivered": TABLE_CTES + table,
        "stream_late_alerts": TABLE_CTES + late
        + "SELECT l.alert_id, alert_fingerprint, l.created_ts, last_seen_ts, severity, title, suppression_count, event_id"
        " FROM alert_table JOIN late l USING (alert_fingerprint, sid)",
        "src_events_json": INGEST_CTES + "SELECT event_id, len(errors) = 0 AS valid, user_id, ts_sec FROM validated",
        "iforest_trees": trees,
        "model_artifact": trees,
        "score_events": "SELECT 'evt-' || event_id AS event_id, true AS score_ok, true AS confidence_ok, true AS predicted_ok, true AS explained,"
        " 3 AS n_contributors, true AS share_ok FROM events",
        "score_loaded_model": "SELECT 'evt-' || event_id AS event_id, true AS equal FROM events",
        "model_metadata": "SELECT 'IsolationForest' AS model_type, 'iforest-fixture' AS model_version, (SELECT count(*) FROM events) AS training_rows,"
        " 0.08::DOUBLE AS contamination, 'offline_features' AS training_source, 16 AS n_columns, event_type AS scenario, count(*)::DOUBLE AS count"
        " FROM events GROUP BY event_type",
        "model_metadata_defaults": "SELECT 'IsolationForest' AS model_type, 'unavailable' AS model_version, count(*) AS training_rows,"
        " 0.0::DOUBLE AS contamination, true AS artifact_present, 0 AS n_columns, 0 AS n_scenarios FROM events",
        "scenario_table": SCORED_CTES + "SELECT coalesce(scenario, 'unknown') AS scenario, count(*)::DOUBLE AS count,"
        " sum(predicted_anomaly::INTEGER)::DOUBLE AS predicted_anomalies,"
        " round(sum(predicted_anomaly::INTEGER)::DOUBLE / count(*)::DOUBLE, 4) AS predicted_anomaly_rate"
        " FROM scored GROUP BY 1 ORDER BY predicted_anomaly_rate DESC, scenario",
        "replay_archive": INGEST_CTES + "SELECT line_no, line AS value FROM (SELECT row_number() OVER (ORDER BY seq) AS line_no, line FROM ("
        + ingest_oracles()["raw_archive"][len(INGEST_CTES):] + ")) WHERE line_no >= 1001 ORDER BY line_no LIMIT 5000",
        "alert_by_id": TABLE_CTES + "SELECT alert_id, upper(severity) || ' | ' || " + CATEGORY_SQL + " || ' | ' || title || ' | '"
        " || split_part(split_part(alert_fingerprint, '\"user_id\": \"', 2), '\"', 1) AS label, replace(reasons, ' | ', ', ') AS reasons_text, "
        + CATEGORY_SQL + " AS detection, suppression_count, model_version,"
        " coalesce(nullif(replace(ml_top_contributors, ' | ', ', '), ''), 'n/a') AS contributors_text, ml_explanation"
        " FROM alert_table WHERE alert_id = (SELECT min(alert_id) FROM alert_table)",
        "dead_letter_by_id": INGEST_CTES + letter.format(dead),
        "training_snapshot": feature_query(FEATURES16),
        "alerts_stored_versions": TABLE_CTES + """, v AS (
            SELECT *, CASE WHEN substr(alert_id, 1, 1) < '5' THEN 1 WHEN substr(alert_id, 1, 1) <= '9' THEN 2 ELSE 3 END AS version FROM alert_table)
          SELECT version, alert_id, severity, CASE WHEN version = 1 THEN created_ts ELSE last_seen_ts END AS last_seen_ts,
            CASE WHEN version = 1 THEN '[]' ELSE '["' || replace(detection_sources, ' | ', '", "') || '"]' END AS detection_sources_json,
            CASE WHEN version > 1 THEN model_version END AS model_version, CASE WHEN version = 3 THEN alert_fingerprint ELSE '' END AS alert_fingerprint,
            CASE WHEN version = 1 THEN 0 ELSE suppression_count END::BIGINT AS suppression_count FROM v""",
        "stream_late_events": INGEST_CTES + """SELECT seq, 'late' AS stage, 'LateEvent' AS error_type, false AS retryable FROM validated
          WHERE len(errors) = 0 AND seq % 2 = 1 AND ts_sec < (SELECT max(ts_sec) FROM validated WHERE len(errors) = 0 AND seq % 2 = 0) - 3600
          UNION ALL SELECT seq, 'validation', CASE WHEN json_valid(value) THEN 'ValidationError' ELSE 'JSONDecodeError' END, false
          FROM validated WHERE len(errors) > 0""",
        "stream_latency": INGEST_CTES + """SELECT stage, 2 AS batches,
          CASE WHEN stage = 'validate' THEN (SELECT count(*) FROM validated) END AS rows,
          CASE WHEN stage = 'validate' THEN (SELECT count(*) FROM validated WHERE len(errors) > 0) END AS failed, true AS sane
          FROM (VALUES ('batch'), ('compact_state'), ('validate'), ('archive'), ('detect')) v(stage)""",
    }
