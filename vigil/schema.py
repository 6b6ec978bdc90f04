"""Schemas and fixed values of the event, feature, score, alert and dead-letter data."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being matched).
# ---------------------------------------------------------------------------
CLOUD_PROVIDERS = ["aws", "azure", "gcp"]
PRINCIPAL_TYPES = ["human", "service_account", "root"]
AUTH_RESULTS = ["success", "failure"]
SEVERITIES = ["low", "medium", "high", "critical"]  # ordinal order
SUPPRESSION_WINDOW_SECONDS = 300
NO_MODEL_VERSION = "unavailable"
NO_MODEL_EXPLANATION = "Model artifact unavailable. Falling back to rules-only detection."

# The 16 features, in the fixed order of the model vector.
FEATURE_COLUMNS = [
    "failed_logins_5m",
    "failed_logins_1h",
    "request_count_5m",
    "distinct_ips_24h",
    "distinct_countries_24h",
    "distinct_regions_24h",
    "privileged_actions_1h",
    "ip_users_24h",
    "ip_failed_auth_rate_5m",
    "account_delete_actions_10m",
    "account_service_entropy_1h",
    "account_bytes_received_1h",
    "is_new_country_for_user",
    "is_new_ip_for_user",
    "is_privileged_action",
    "auth_failure",
]
BOOL_FEATURES = ["is_new_country_for_user", "is_new_ip_for_user", "is_privileged_action", "auth_failure"]

# Event columns in the order of the typed event.
EVENT_COLUMNS = [
    "event_id",
    "timestamp",
    "cloud_provider",
    "account_id",
    "user_id",
    "principal_type",
    "source_ip",
    "geo_country",
    "region",
    "service_name",
    "api_action",
    "resource_type",
    "resource_id",
    "auth_result",
    "bytes_sent",
    "bytes_received",
    "device_fingerprint",
    "user_agent",
    "is_privileged_action",
    "metadata",
]
# String fields that are trimmed and must not be blank.
NON_BLANK_FIELDS = [
    "event_id",
    "account_id",
    "user_id",
    "region",
    "service_name",
    "api_action",
    "resource_type",
    "resource_id",
    "device_fingerprint",
    "user_agent",
]
REQUIRED_FIELDS = [
    "event_id",
    "timestamp",
    "cloud_provider",
    "account_id",
    "user_id",
    "principal_type",
    "source_ip",
    "geo_country",
    "region",
    "service_name",
    "api_action",
    "resource_type",
    "resource_id",
    "auth_result",
    "device_fingerprint",
    "user_agent",
]

RAW_EVENTS_TOPIC = "cloud-security-events"
