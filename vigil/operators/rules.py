"""Detection rules as column expressions.

Each rule is a nullable alert struct; ``alerts()`` puts the four rule structs in
one array (or the ML alert when no rule fired), explodes it, drops the nulls and
enriches each alert with the model context: one scan, no unions, no lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import delete_like, severity_of_rank, severity_rank
from ..schema import FEATURE_COLUMNS, NO_MODEL_VERSION

# Rule texts and thresholds.
FAILED_LOGIN_TITLE = "Failed login burst detected"
FAILED_LOGIN_DESCRIPTION = "Multiple failed console login attempts observed in a short window."
FAILED_LOGIN_ACTIONS = [
    "Lock the account if the failures continue",
    "Verify whether the source IP belongs to corporate infrastructure",
    "Require MFA re-authentication",
]
NEW_COUNTRY_TITLE = "Privileged action from unseen country"
NEW_COUNTRY_DESCRIPTION = (
    "A privileged API action originated from a country not previously observed for this identity."
)
NEW_COUNTRY_ACTIONS = [
    "Review the initiating session and recent IAM activity",
    "Temporarily revoke high-risk credentials if unverified",
    "Correlate with device and VPN logs",
]
DELETION_TITLE = "Deletion activity spike"
DELETION_DESCRIPTION = "Resource deletion velocity exceeded the expected local baseline for the account."
DELETION_ACTIONS = [
    "Confirm whether an authorized cleanup job is running",
    "Snapshot impacted resources if available",
    "Pause destructive automation until triage completes",
]
VOLUME_TITLE = "High-volume data access"
VOLUME_DESCRIPTION = "An unusually large data transfer was observed for a single event."
VOLUME_ACTIONS = [
    "Check whether the transfer matches an approved backup or analytics job",
    "Review the affected bucket or dataset",
]
ML_TITLE = "Behavioral anomaly detected by ML model"
ML_DESCRIPTION = "The event deviated materially from the learned behavioral baseline."
ML_ACTIONS = [
    "Review the feature snapshot and recent user activity",
    "Correlate the alert with recent authentication and resource access patterns",
]
FAILED_LOGIN_MIN = 5
DELETION_MIN = 4
VOLUME_MIN_BYTES = 2_000_000
ENTROPY_CONTEXT = 1.4
COUNTRIES_CONTEXT = 3



def _txt(c: str) -> Column:
    return F.col(c).cast("string")


def _opt(cond: Column, text: Column) -> Column:
    """A one-item list when ``cond`` holds, else empty (concat of these keeps codegen; a lambda filter would not)."""
    return F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))


def _alert(
    cond: Column,
    severity: str | Column,
    title: str,
    description: str,
    score: Column,
    confidence: float | Column,
    reasons: list[Column],
    actions: list[str],
    sources: list[str],
) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    body = F.struct(
        sev.alias("severity"),
        F.lit(title).alias("title"),
        F.lit(description).alias("description"),
        score.cast("double").alias("anomaly_score"),
        conf.cast("double").alias("confidence"),
        F.array(*reasons).alias("reasons"),
        F.array(*[F.lit(a) for a in actions]).alias("recommended_actions"),
        F.array(*[F.lit(s) for s in sources]).alias("detection_sources"),
    )
    return F.when(cond, body)


def rule_failed_login_burst() -> Column:
    n = F.col("failed_logins_5m")
    return _alert(
        (F.col("api_action") == "ConsoleLogin") & (F.col("auth_result") == "failure") & (n >= FAILED_LOGIN_MIN),
        "high",
        FAILED_LOGIN_TITLE,
        FAILED_LOGIN_DESCRIPTION,
        F.least(F.lit(0.99), F.lit(0.5) + n * F.lit(0.08)),
        0.86,
        [
            F.concat(_txt("failed_logins_5m"), F.lit(" failed console logins in the last 5 minutes")),
            F.concat(F.lit("Source country "), F.col("geo_country")),
            F.concat(F.lit("IP failed auth rate in 5 minutes: "), _txt("ip_failed_auth_rate_5m")),
        ],
        FAILED_LOGIN_ACTIONS,
        ["rule"],
    )


def rule_privileged_new_country() -> Column:
    return _alert(
        F.col("is_privileged_action") & F.col("is_new_country_for_user"),
        "critical",
        NEW_COUNTRY_TITLE,
        NEW_COUNTRY_DESCRIPTION,
        F.lit(0.97),
        0.91,
        [
            F.concat(F.lit("Privileged action "), F.col("api_action")),
            F.concat(F.lit("New country for user: "), F.col("geo_country")),
            F.concat(F.lit("Distinct countries seen in 24 hours: "), _txt("distinct_countries_24h")),
        ],
        NEW_COUNTRY_ACTIONS,
        ["rule"],
    )


def rule_deletion_spike() -> Column:
    n = F.col("account_delete_actions_10m")
    return _alert(
        delete_like(F.col("api_action")) & (n >= DELETION_MIN),
        "high",
        DELETION_TITLE,
        DELETION_DESCRIPTION,
        F.least(F.lit(0.98), F.lit(0.45) + n * F.lit(0.1)),
        0.79,
        [
            F.concat(_txt("account_delete_actions_10m"), F.lit(" delete or terminate actions in 10 minutes")),
            F.concat(F.lit("Account "), F.col("account_id")),
            F.concat(F.lit("Account service entropy in 1 hour: "), _txt("account_service_entropy_1h")),
        ],
        DELETION_ACTIONS,
        ["rule"],
    )


def rule_high_volume_transfer() -> Column:
    return _alert(
        F.col("bytes_received") >= VOLUME_MIN_BYTES,
        "medium",
        VOLUME_TITLE,
        VOLUME_DESCRIPTION,
        F.lit(0.84),
        0.72,
        [
            F.concat(_txt("bytes_received"), F.lit(" bytes received")),
            F.concat(F.lit("API action "), F.col("api_action")),
            F.concat(F.lit("Account bytes received in 1 hour: "), _txt("account_bytes_received_1h")),
        ],
        VOLUME_ACTIONS,
        ["rule"],
    )


def _context_flags() -> list[tuple[Column, float, float]]:
    """(condition, threshold step, score bonus) in the fixed order."""
    return [
        (F.col("is_new_country_for_user"), 0.03, 0.03),
        (F.col("is_new_ip_for_user"), 0.02, 0.02),
        (F.col("account_service_entropy_1h") >= ENTROPY_CONTEXT, 0.02, 0.02),
        (F.col("distinct_countries_24h") >= COUNTRIES_CONTEXT, 0.01, 0.01),
    ]


def ml_threshold() -> Column:
    """0.54 minus context steps, subtracted one by one; floor 0.48."""
    t = F.lit(0.54)
    for cond, step, _ in _context_flags():
        t = F.when(cond, t - F.lit(step)).otherwise(t)
    return F.greatest(F.lit(0.48), t)


def effective_ml_score() -> Column:
    """Model score plus the same context bonuses, capped at 0.99."""
    b = F.lit(0.0)
    for cond, _, bonus in _context_flags():
        b = F.when(cond, b + F.lit(bonus)).otherwise(b)
    return F.least(F.lit(0.99), F.col("anomaly_score") + b)


def ml_alert() -> Column:
    eff = effective_ml_score()
    cond = F.col("predicted_anomaly") & (eff >= ml_threshold())
    optional = F.concat(
        _opt(F.col("is_new_country_for_user"), F.concat(F.lit("New country observed for user: "), F.col("geo_country"))),
        _opt(F.col("is_new_ip_for_user"), F.concat(F.lit("New IP observed for user: "), F.col("source_ip"))),
        _opt(
            F.col("account_service_entropy_1h") >= ENTROPY_CONTEXT,
            F.concat(F.lit("Broad account service spread in 1 hour: "), _txt("account_service_entropy_1h")),
        ),
        _opt(
            F.col("distinct_countries_24h") >= COUNTRIES_CONTEXT,
            F.concat(F.lit("User has touched "), _txt("distinct_countries_24h"), F.lit(" countries in 24 hours")),
        ),
    )
    body = F.struct(
        F.when(eff >= 0.6, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        F.lit(ML_TITLE).alias("title"),
        F.lit(ML_DESCRIPTION).alias("description"),
        F.col("anomaly_score").cast("double").alias("anomaly_score"),
        F.col("confidence").cast("double").alias("confidence"),
        F.concat(
            F.array(
                F.concat(F.lit("Isolation Forest anomaly score: "), _txt("anomaly_score")),
                F.col("explanation"),
            ),
            optional,
        ).alias("reasons"),
        F.array(*[F.lit(a) for a in ML_ACTIONS]).alias("recommended_actions"),
        F.array(F.lit("ml")).alias("detection_sources"),
    )
    return F.when(cond, body)


def hybrid_severity(base: Column) -> Column:
    """Raise by 2 levels at score >= .64, by 1 at >= .56, when the model predicts an anomaly."""
    r = severity_rank(base)
    s = F.col("anomaly_score")
    up = F.when(~F.col("predicted_anomaly"), F.lit(0)).when(s >= 0.64, F.lit(2)).when(s >= 0.56, F.lit(1)).otherwise(F.lit(0))
    return severity_of_rank(F.least(r + up, F.lit(3)))


def _enrich(a: Column) -> Column:
    """Model context on one alert struct ``a`` (the row carries the model fields)."""
    has_ml = F.array_contains(a["detection_sources"], "ml")
    add_ml = F.col("predicted_anomaly") & ~has_ml
    sources = F.when(add_ml, F.concat(a["detection_sources"], F.array(F.lit("ml")))).otherwise(a["detection_sources"])
    extra = F.concat(
        _opt(
            add_ml & (F.size(F.col("top_contributors")) > 0),
            F.concat(F.lit("ML contributors: "), F.array_join(F.col("top_contributors"), ", ")),
        ),
        _opt(add_ml & (F.coalesce(F.col("explanation"), F.lit("")) != ""), F.col("explanation")),
    )
    model_present = F.col("model_version") != NO_MODEL_VERSION
    calibrated = hybrid_severity(a["severity"])
    changed = model_present & (calibrated != a["severity"])
    hybrid_reason = _opt(
        changed,
        F.concat(
            F.lit("Hybrid severity adjusted from "),
            a["severity"],
            F.lit(" to "),
            calibrated,
            F.lit(" based on model corroboration."),
        ),
    )
    return F.struct(
        F.when(changed, calibrated).otherwise(a["severity"]).alias("severity"),
        a["title"].alias("title"),
        a["description"].alias("description"),
        F.when(model_present, F.col("anomaly_score")).otherwise(a["anomaly_score"]).alias("anomaly_score"),
        F.when(model_present, F.col("confidence")).otherwise(a["confidence"]).alias("confidence"),
        F.concat(a["reasons"], extra, hybrid_reason).alias("reasons"),
        a["recommended_actions"].alias("recommended_actions"),
        sources.alias("detection_sources"),
        F.col("anomaly_score").alias("ml_anomaly_score"),
        F.col("confidence").alias("ml_confidence"),
        F.col("model_version").alias("model_version"),
        F.col("top_contributors").alias("ml_top_contributors"),
        F.col("explanation").alias("ml_explanation"),
    )


DEFAULT_RULES = (rule_failed_login_burst, rule_privileged_new_country, rule_deletion_spike, rule_high_volume_transfer)

EVENT_CONTEXT = [
    "event_id",
    "seq",
    "ts_sec",
    "timestamp",
    "account_id",
    "user_id",
    "source_ip",
    "geo_country",
    "service_name",
    "api_action",
]


def rule_alerts(scored: DataFrame, rules=DEFAULT_RULES) -> Column:
    """Array of the rule alerts that fired (0..4)."""
    fired = [r() for r in rules]
    # concat keeps the projection in whole-stage codegen; a lambda filter would not
    return F.concat(*[F.when(f.isNotNull(), F.array(f)).otherwise(F.slice(F.array(f), 1, 0)) for f in fired])


def alerts(scored: DataFrame, rules=DEFAULT_RULES, keep: list[str] | None = None) -> DataFrame:
    """One row per alert: rule alerts (0..4 per event) or the ML alert when no rule fired.

    ``scored`` = events + 16 features + model fields. The nullable alert structs are
    exploded and the nulls dropped, then each alert is enriched with the model
    context: plain column expressions, inside whole-stage codegen.
    """
    fired = [r() for r in rules]
    n_fired = sum((f.isNotNull().cast("int") for f in fired), F.lit(0))
    chosen = F.when(n_fired > 0, F.array(*fired)).otherwise(F.array(ml_alert()))
    keep = keep or EVENT_CONTEXT
    event_cols = [c for c in scored.columns if c in _event_struct_fields()]
    model = ["anomaly_score", "confidence", "predicted_anomaly", "model_version", "top_contributors", "explanation"]
    exploded = scored.select(
        *keep,
        *[F.col(m) for m in model if m not in keep],
        F.struct(*[F.col(c) for c in event_cols]).alias("event"),
        F.struct(*[F.col(c) for c in FEATURE_COLUMNS]).alias("feature_context"),
        F.explode(chosen).alias("a"),
    ).where(F.col("a").isNotNull())
    return exploded.select(*keep, "event", "feature_context", _enrich(F.col("a")).alias("e")).select(
        *keep, "event", "feature_context", "e.*"
    )


def _event_struct_fields() -> set[str]:
    from ..schema import EVENT_COLUMNS

    return set(EVENT_COLUMNS)


def single_rule(scored: DataFrame, rule) -> DataFrame:
    """Rows where one rule fires (before ML fallback/enrichment), for per-rule queries."""
    return scored.select(*EVENT_CONTEXT, rule().alias("a")).where(F.col("a").isNotNull()).select(*EVENT_CONTEXT, "a.*")
