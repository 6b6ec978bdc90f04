"""Message decoding and event validation in one projection (no UDF).

``validate_events(lines)`` decodes each JSON message once, into a variant per field (which tells
``5`` from ``"5"``), takes every field's text and kind from it once, checks every constraint
of the typed event and returns the typed columns plus
``errors: array<string>`` (empty when valid). Invalid lines become dead letters
(``dead_letters``); nothing raises, so one bad line never stops a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import iso_text, json_string
from ..schema import (
    AUTH_RESULTS,
    CLOUD_PROVIDERS,
    NON_BLANK_FIELDS,
    PRINCIPAL_TYPES,
    RAW_EVENTS_TOPIC,
    REQUIRED_FIELDS,
)

# Address and zone patterns.
IPV4_PATTERN = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
IPV6_PATTERN = (
    r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|([0-9a-fA-F]{1,4}:){1,7}:"
    r"|([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
    r"|([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}"
    r"|([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}"
    r"|([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}"
    r"|([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}"
    r"|[0-9a-fA-F]{1,4}:(:[0-9a-fA-F]{1,4}){1,6}"
    r"|:((:[0-9a-fA-F]{1,4}){1,7}|:))$"
)
IPV4_TAIL_PATTERN = r":(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"
EPOCH_PATTERN = r"^[+-]?[0-9]+(\.[0-9]*)?$"
LARGEST_EPOCH_SECONDS = 20_000_000_000  # larger numbers are milliseconds
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "off", "f", "false", "n", "no"]
ZONE_PATTERN = r"(Z|z|[+-][0-9]{2}:?[0-9]{2})$"
COUNTRY_PATTERN = r"^\p{L}{2}$"

FIELDS = [*REQUIRED_FIELDS, "bytes_sent", "bytes_received", "is_privileged_action", "metadata"]
UNDECODED = "_undecoded"  # holds a text that is no JSON object

ERROR_SEP = "; "
MSG_REQUIRED = "field required"
MSG_STRING = "must be a string"
MSG_DICT = "must be an object"
MSG_BLANK = "must not be blank"
MSG_CHOICE = "input is not one of the allowed values"
MSG_COUNTRY_LEN = "must have exactly 2 characters"
MSG_COUNTRY = "must be a 2-letter country code"
MSG_IP = "must be a valid IPv4 or IPv6 address"
MSG_INT = "must be an integer"
MSG_NONNEG = "must be greater than or equal to 0"
MSG_BOOL = "must be a boolean"
MSG_TS = "must be a valid datetime"
MSG_TZ = "timestamp must be timezone-aware"
MSG_OBJECT = "payload must be a JSON object"


def strip(c: Column) -> Column:
    """Leading and trailing white space of any script removed (only a text that has some is searched)."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(SPACE), F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")).otherwise(c)


def iso_offset_text(c: Column) -> Column:
    """A valid timestamp text with ``T``, six or no fraction digits and a ``+hh:mm`` offset."""
    c = F.regexp_replace(F.regexp_replace(c, "^(.{10}) ", "$1T"), "[Zz]$", "+00:00")
    c = F.regexp_replace(c, "([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    fraction = F.regexp_extract(c, r"\.([0-9]+)[+-]", 1)
    padded = F.concat(F.lit("."), F.rpad(fraction, 6, "0"))
    return F.when(fraction != "", F.regexp_replace(c, F.concat(F.lit(r"\."), fraction), padded)).otherwise(c)


def _err(cond: Column, field: str, msg: str) -> Column:
    return F.when(cond, F.lit(f"{field}: {msg}"))


def validate_events(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Typed event columns + ``errors`` + ``valid`` for each message line."""
    decoded = F.from_json(
        F.col(value_col), ", ".join([*(f"{f} variant" for f in FIELDS), f"{UNDECODED} string"]), {"columnNameOfCorruptRecord": UNDECODED}
    )
    # three projections, each of whose columns are computed once and read several times
    fields = lines.withColumn("_s", decoded).select(
        *lines.columns,
        (F.col("_s").isNotNull() & F.col(f"_s.{UNDECODED}").isNull()).alias("_object"),
        *[F.col(f"_s.{f}").alias(f"_v_{f}") for f in FIELDS],
    )
    typed = fields.select(
        *lines.columns,
        "_object",
        "_v_metadata",
        *[F.expr(f"try_variant_get(_v_{f}, '$', 'string')").alias(f"_t_{f}") for f in FIELDS],
        *[F.schema_of_variant(f"_v_{f}").alias(f"_k_{f}") for f in FIELDS],
    )
    stripped = [*NON_BLANK_FIELDS, "geo_country", "source_ip"]
    d = typed.select("*", *[strip(F.when(F.col(f"_k_{f}") == "STRING", F.col(f"_t_{f}"))).alias(f"_x_{f}") for f in stripped])

    def has(k: str) -> Column:
        return F.col(f"_k_{k}").isNotNull()

    def raw(k: str) -> Column:
        return F.col(f"_t_{k}")

    def kind(k: str) -> Column:
        return F.col(f"_k_{k}")

    def text(k: str) -> Column:
        """The field where it is a JSON string."""
        return F.when(kind(k) == "STRING", raw(k))

    def trimmed(k: str) -> Column:
        return F.col(f"_x_{k}")

    def number(k: str) -> Column:
        """An integer: a whole number, a text of one, or a boolean."""
        exact = F.expr(f"try_cast(trim(_t_{k}) as decimal(38,6))")
        whole = F.when(exact == F.floor(exact), F.expr(f"try_cast(try_cast(trim(_t_{k}) as decimal(38,6)) as bigint)"))
        return (
            F.when(kind(k) == "BOOLEAN", (raw(k) == "true").cast("long"))
            .when(kind(k) == "STRING", F.when(raw(k).rlike(INTEGER_PATTERN), whole))
            .when(kind(k).rlike("^(BIGINT|DECIMAL|DOUBLE)"), whole)
        )

    is_obj = F.col("_object")
    errs: list[Column] = [F.when(~is_obj, F.lit(MSG_OBJECT))]
    for f in REQUIRED_FIELDS:
        errs.append(_err(is_obj & raw(f).isNull(), f, MSG_REQUIRED))
    for f in (*NON_BLANK_FIELDS, "geo_country", "source_ip"):
        errs.append(_err(raw(f).isNotNull() & text(f).isNull(), f, MSG_STRING))
    for f in NON_BLANK_FIELDS:
        errs.append(_err(trimmed(f) == "", f, MSG_BLANK))
    for f, allowed in (("cloud_provider", CLOUD_PROVIDERS), ("principal_type", PRINCIPAL_TYPES), ("auth_result", AUTH_RESULTS)):
        errs.append(_err(raw(f).isNotNull() & ~F.coalesce(text(f).isin(allowed), F.lit(False)), f, MSG_CHOICE))
    gc = text("geo_country")
    errs.append(_err(F.length(gc) != 2, "geo_country", MSG_COUNTRY_LEN))
    errs.append(_err((F.length(gc) == 2) & ~F.upper(trimmed("geo_country")).rlike(COUNTRY_PATTERN), "geo_country", MSG_COUNTRY))
    ip = trimmed("source_ip")
    # an IPv6 address may end in an IPv4 one and may name a scope
    plain6 = F.regexp_replace(F.regexp_replace(ip, "%[^%]+$", ""), IPV4_TAIL_PATTERN, ":0:0")
    errs.append(_err(~(ip.rlike(IPV4_PATTERN) | plain6.rlike(IPV6_PATTERN)), "source_ip", MSG_IP))
    counts = {f: number(f) for f in ("bytes_sent", "bytes_received")}
    for f, n in counts.items():
        errs.append(_err(has(f) & n.isNull(), f, MSG_INT))
        errs.append(_err(n < 0, f, MSG_NONNEG))
    flag = raw("is_privileged_action")
    word = F.when(kind("is_privileged_action") == "STRING", F.lower(flag)).when(
        kind("is_privileged_action") != "VOID", F.regexp_replace(flag, r"^([01])\.0+$", "$1")
    )
    pb = F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))
    errs.append(_err(has("is_privileged_action") & pb.isNull(), "is_privileged_action", MSG_BOOL))
    tt = raw("timestamp")
    epoch = F.when(
        kind("timestamp").rlike("^(BIGINT|DECIMAL|DOUBLE)") | ((kind("timestamp") == "STRING") & tt.rlike(EPOCH_PATTERN)),
        F.expr("try_cast(_t_timestamp as double)"),
    )
    seconds = F.when(F.abs(epoch) > LARGEST_EPOCH_SECONDS, epoch / 1000).otherwise(epoch)
    ts = F.when(epoch.isNotNull(), F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))).otherwise(
        F.try_to_timestamp(text("timestamp"))
    )
    ts_text = F.when(epoch.isNotNull(), iso_text(ts)).otherwise(iso_offset_text(tt))
    errs.append(_err(tt.isNotNull() & ts.isNull(), "timestamp", MSG_TS))
    errs.append(_err(epoch.isNull() & ts.isNotNull() & ~tt.rlike(ZONE_PATTERN), "timestamp", MSG_TZ))
    errs.append(_err(has("metadata") & ~F.coalesce(kind("metadata").startswith("OBJECT"), F.lit(False)), "metadata", MSG_DICT))

    # concat_ws skips NULLs and stays inside whole-stage codegen (a lambda filter would not)
    message = F.concat_ws(ERROR_SEP, *errs)
    errors = F.when(message == "", F.array().cast("array<string>")).otherwise(F.split(message, ERROR_SEP))
    out = d.select(
        *[c for c in lines.columns],
        is_obj.alias("is_object"),
        trimmed("event_id").alias("event_id"),
        ts.alias("timestamp"),
        ts_text.alias("timestamp_text"),
        F.unix_seconds(ts).alias("ts_sec"),
        F.substring(ts_text, 1, 10).alias("event_date"),
        raw("cloud_provider").alias("cloud_provider"),
        trimmed("account_id").alias("account_id"),
        trimmed("user_id").alias("user_id"),
        raw("principal_type").alias("principal_type"),
        ip.alias("source_ip"),
        F.upper(trimmed("geo_country")).alias("geo_country"),
        trimmed("region").alias("region"),
        trimmed("service_name").alias("service_name"),
        trimmed("api_action").alias("api_action"),
        trimmed("resource_type").alias("resource_type"),
        trimmed("resource_id").alias("resource_id"),
        raw("auth_result").alias("auth_result"),
        F.coalesce(counts["bytes_sent"], F.lit(0).cast("long")).alias("bytes_sent"),
        F.coalesce(counts["bytes_received"], F.lit(0).cast("long")).alias("bytes_received"),
        trimmed("device_fingerprint").alias("device_fingerprint"),
        trimmed("user_agent").alias("user_agent"),
        F.coalesce(pb, F.lit(False)).alias("is_privileged_action"),
        F.expr("try_variant_get(_v_metadata, '$', 'map<string,string>')").alias("metadata"),
        F.coalesce(F.expr("try_variant_get(_v_metadata, '$.scenario', 'string')"), F.lit("unknown")).alias("scenario"),
        errors.alias("errors"),
    )
    return out.withColumn("valid", F.size("errors") == 0)


def dead_letters(
    validated: DataFrame,
    stage: str = "validation",
    source_topic: str = RAW_EVENTS_TOPIC,
    failed_at: Column | None = None,
    value_col: str = "value",
) -> DataFrame:
    """Dead-letter rows for the invalid lines (not retryable).

    ``raw_payload`` is the object text, or ``{"raw": text}`` for anything else;
    ``event_id`` is lifted from an object payload as sent. The id is a hash of
    topic, position and stage, so a task retry writes the same row.
    """
    v = F.col(value_col)
    undecodable = F.try_parse_json(v).isNull()
    payload = F.when(F.col("is_object"), v).otherwise(F.concat(F.lit('{"raw": '), json_string(v), F.lit("}")))
    when_failed = failed_at if failed_at is not None else F.col("arrival_ts")
    return validated.where(~F.col("valid")).select(
        F.sha2(F.concat_ws(":", F.lit(source_topic), F.col("seq").cast("string"), F.lit(stage)), 256).alias("dead_letter_id"),
        when_failed.alias("failed_at"),
        F.lit(source_topic).alias("source_topic"),
        F.lit(stage).alias("stage"),
        F.when(undecodable, F.lit("JSONDecodeError")).otherwise(F.lit("ValidationError")).alias("error_type"),
        F.array_join("errors", "; ").alias("error_message"),
        payload.alias("raw_payload"),
        F.when(F.col("is_object"), F.get_json_object(v, "$.event_id")).alias("event_id"),
        F.lit(False).alias("retryable"),
        F.col("seq"),
    )


def failure_letters(
    validated: DataFrame,
    stage: str,
    error_type: str,
    error_message: str,
    retryable: bool,
    source_topic: str = RAW_EVENTS_TOPIC,
    value_col: str = "value",
) -> DataFrame:
    """Dead-letter rows for valid events that a later stage could not take (same columns as ``dead_letters``)."""
    return validated.select(
        F.sha2(F.concat_ws(":", F.lit(source_topic), F.col("seq").cast("string"), F.lit(stage)), 256).alias("dead_letter_id"),
        F.col("arrival_ts").alias("failed_at"),
        F.lit(source_topic).alias("source_topic"),
        F.lit(stage).alias("stage"),
        F.lit(error_type).alias("error_type"),
        F.lit(error_message).alias("error_message"),
        F.col(value_col).alias("raw_payload"),
        "event_id",
        F.lit(retryable).alias("retryable"),
        F.col("seq"),
    )
