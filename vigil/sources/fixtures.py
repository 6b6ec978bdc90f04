"""The security-event view over the driver's ``events`` table.

Time is compressed 60x and users are grouped by 15 so that every detection rule
fires at every scale factor (see FIXTURES.md section 3). The same view is given
as DuckDB SQL (``SECURITY_EVENTS_SQL``) for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import spread

# Fixed values of the fixture view.
EPOCH_2024 = 1704067200
COMPRESSION_US = 60_000_000
PROVIDERS = ["aws", "azure", "gcp"]
RARE_COUNTRIES = ["DE", "IN", "JP"]
REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "ap-south-1"]
SERVICE_BY_TYPE = {"error": "iam", "signup": "iam", "click": "s3", "view": "kms", "purchase": "ec2"}
ACTION_BY_TYPE = {"error": "ConsoleLogin", "signup": "CreateUser", "click": "GetObject", "view": "Decrypt"}
RESOURCE_BY_SERVICE = {"iam": "user", "s3": "object", "kms": "key", "ec2": "instance"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _map_value(mapping: dict[str, str], key: Column) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed security events (plus ``seq``, ``ts_sec`` and a stand-in ``raw_score``)."""
    ev = spread(read_table(spark, sf_dir, "events"), "event_id", "ts")
    eid = F.col("event_id")
    uid = F.col("user_id")
    seq = F.col("seq")
    grp = F.expr("_uid div 15")
    ts_sec = F.lit(EPOCH_2024) + F.expr(
        f"(unix_micros(cast(ts as timestamp)) - {EPOCH_2024 * 1_000_000}) div {COMPRESSION_US}"
    )
    service = _map_value(SERVICE_BY_TYPE, F.col("event_type"))
    action = F.when(
        F.col("event_type") == "purchase",
        F.when(seq % 3 == 0, F.lit("TerminateInstances")).otherwise(F.lit("DescribeInstances")),
    ).otherwise(_map_value(ACTION_BY_TYPE, F.col("event_type")))
    country = F.when(seq % 97 == 0, _pick(RARE_COUNTRIES, F.expr("(seq div 97) % 3 + 1"))).otherwise(
        F.when(grp % 2 == 0, F.lit("US")).otherwise(F.lit("GB"))
    )
    out = ev.select(
        F.concat(F.lit("evt-"), eid.cast("string")).alias("event_id"),
        eid.alias("seq"),
        ts_sec.cast("long").alias("ts_sec"),
        F.col("event_type"),
        uid.alias("_uid"),
        F.col("value"),
    ).select(
        "event_id",
        "seq",
        "ts_sec",
        F.timestamp_seconds("ts_sec").alias("timestamp"),
        _pick(PROVIDERS, F.col("seq") % 3 + 1).alias("cloud_provider"),
        F.concat(F.lit("acct-"), F.expr("_uid div 30").cast("string")).alias("account_id"),
        F.concat(F.lit("user-"), F.expr("_uid div 15").cast("string")).alias("user_id"),
        _pick(["human", "service_account", "root"], F.expr("(_uid div 15) % 3 + 1")).alias("principal_type"),
        F.concat(
            F.lit("10."), F.expr("_uid div 45").cast("string"), F.lit(".0."), (F.col("seq") % 5 + 1).cast("string")
        ).alias("source_ip"),
        country.alias("geo_country"),
        _pick(REGIONS, F.col("seq") % 4 + 1).alias("region"),
        service.alias("service_name"),
        action.alias("api_action"),
        _map_value(RESOURCE_BY_SERVICE, service).alias("resource_type"),
        F.concat(service, F.lit("-"), (F.col("seq") % 9000 + 1000).cast("string")).alias("resource_id"),
        F.when(F.col("event_type") == "error", F.lit("failure")).otherwise(F.lit("success")).alias("auth_result"),
        (F.col("seq") % 50000).alias("bytes_sent"),
        F.floor(F.col("value") * 10000).cast("long").alias("bytes_received"),
        F.concat(F.lit("device-"), (F.col("seq") % 15 + 1).cast("string")).alias("device_fingerprint"),
        F.concat(F.lit("agent-"), (F.col("seq") % 4).cast("string")).alias("user_agent"),
        (F.col("event_type") == "signup").alias("is_privileged_action"),
        F.create_map(F.lit("scenario"), F.col("event_type")).alias("metadata"),
        F.col("event_type").alias("scenario"),
        (((F.col("seq") * 37) % 1000).cast("double") / 1000.0 * 0.6 - 0.3).alias("raw_score"),
    )
    return out


# DuckDB text of the same view, used as a CTE by every oracle query.
SECURITY_EVENTS_SQL = """
security_events AS (
  SELECT
    'evt-' || event_id AS event_id,
    event_id AS seq,
    1704067200 + (epoch_us(ts) - 1704067200000000) // 60000000 AS ts_sec,
    to_timestamp(1704067200 + (epoch_us(ts) - 1704067200000000) // 60000000) AS "timestamp",
    (['aws','azure','gcp'])[event_id % 3 + 1] AS cloud_provider,
    'acct-' || (user_id // 30) AS account_id,
    'user-' || (user_id // 15) AS user_id,
    (['human','service_account','root'])[(user_id // 15) % 3 + 1] AS principal_type,
    '10.' || (user_id // 45) || '.0.' || (event_id % 5 + 1) AS source_ip,
    CASE WHEN event_id % 97 = 0 THEN (['DE','IN','JP'])[(event_id // 97) % 3 + 1]
         WHEN (user_id // 15) % 2 = 0 THEN 'US' ELSE 'GB' END AS geo_country,
    (['us-east-1','us-west-2','eu-west-1','ap-south-1'])[event_id % 4 + 1] AS region,
    CASE event_type WHEN 'error' THEN 'iam' WHEN 'signup' THEN 'iam' WHEN 'click' THEN 's3'
                    WHEN 'view' THEN 'kms' WHEN 'purchase' THEN 'ec2' END AS service_name,
    CASE event_type WHEN 'error' THEN 'ConsoleLogin' WHEN 'signup' THEN 'CreateUser'
                    WHEN 'click' THEN 'GetObject' WHEN 'view' THEN 'Decrypt'
                    WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'TerminateInstances'
                                              ELSE 'DescribeInstances' END END AS api_action,
    CASE event_type WHEN 'error' THEN 'user' WHEN 'signup' THEN 'user' WHEN 'click' THEN 'object'
                    WHEN 'view' THEN 'key' WHEN 'purchase' THEN 'instance' END AS resource_type,
    CASE event_type WHEN 'error' THEN 'iam' WHEN 'signup' THEN 'iam' WHEN 'click' THEN 's3'
                    WHEN 'view' THEN 'kms' WHEN 'purchase' THEN 'ec2' END
      || '-' || (event_id % 9000 + 1000) AS resource_id,
    CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS auth_result,
    event_id % 50000 AS bytes_sent,
    CAST(floor(value * 10000) AS BIGINT) AS bytes_received,
    'device-' || (event_id % 15 + 1) AS device_fingerprint,
    'agent-' || (event_id % 4) AS user_agent,
    event_type = 'signup' AS is_privileged_action,
    event_type AS scenario,
    ((event_id * 37) % 1000)::DOUBLE / 1000.0 * 0.6 - 0.3 AS raw_score
  FROM events
)
"""
