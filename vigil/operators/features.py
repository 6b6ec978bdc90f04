"""The 16 behavioural features per event (user, IP and account families).

``feature_snapshot`` deduplicates events by ``event_id`` (lowest ``seq`` wins),
runs one sweep over all three key families on a narrow projection (only the
columns the families read, so the Parquet scan is pruned) and joins the
per-event result back to the events on ``seq``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import delete_like, safe_ratio
from ..schema import FEATURE_COLUMNS
from ..sources.store import sorted_join
from .sweep import DEFAULT_BUCKET_SECONDS, HOT_ROWS, Count, Distinct, Entropy, Family, FirstSeen, Load, measure, sweep

FIVE_MIN = 300
TEN_MIN = 600
HOUR = 3600
DAY = 86400


def dedup_events(df: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """Keep one row per ``event_id``: the lowest ``seq`` (a repeat never counts twice)."""
    w = Window.partitionBy(key).orderBy(F.col(order).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def user_family() -> Family:
    failed = (F.col("auth_result") == "failure").cast("long")
    return Family(
        key="user_id",
        counts=[
            Count("failed_logins_5m", FIVE_MIN, failed),
            Count("failed_logins_1h", HOUR, failed),
            Count("request_count_5m", FIVE_MIN, F.lit(1)),
            Count("privileged_actions_1h", HOUR, F.col("is_privileged_action").cast("long")),
            Count("_user_events", None, F.lit(1)),
        ],
        distincts=[
            Distinct("distinct_ips_24h", DAY, "source_ip"),
            Distinct("distinct_countries_24h", DAY, "geo_country"),
            Distinct("distinct_regions_24h", DAY, "region"),
        ],
        firsts=[FirstSeen("_first_country", "geo_country"), FirstSeen("_first_ip", "source_ip")],
    )


def ip_family() -> Family:
    return Family(
        key="source_ip",
        counts=[
            Count("_ip_failed_5m", FIVE_MIN, (F.col("auth_result") == "failure").cast("long")),
            Count("_ip_requests_5m", FIVE_MIN, F.lit(1)),
        ],
        distincts=[Distinct("ip_users_24h", DAY, "user_id")],
    )


def account_family() -> Family:
    return Family(
        key="account_id",
        counts=[
            Count("account_delete_actions_10m", TEN_MIN, delete_like(F.col("api_action")).cast("long")),
            Count("account_bytes_received_1h", HOUR, F.col("bytes_received").cast("long")),
        ],
        entropies=[Entropy("account_service_entropy_1h", HOUR, "service_name")],
    )


FAMILY_INPUTS = sorted(
    {"user_id", "auth_result", "is_privileged_action", "source_ip", "geo_country", "region",
     "api_action", "bytes_received", "service_name", "account_id"}
)


# How a feature follows from the measures of its family (others: the measure itself).
DERIVED = {
    "ip_failed_auth_rate_5m": (["_ip_failed_5m", "_ip_requests_5m"], lambda: safe_ratio(F.col("_ip_failed_5m"), F.col("_ip_requests_5m"))),
    "is_new_country_for_user": (["_user_events", "_first_country"], lambda: (F.col("_user_events") > 1) & F.col("_first_country")),
    "is_new_ip_for_user": (["_user_events", "_first_ip"], lambda: (F.col("_user_events") > 1) & F.col("_first_ip")),
}


def _from_measures(name: str) -> Column:
    return DERIVED[name][1]().alias(name) if name in DERIVED else F.col(name)


def family_features(ev: DataFrame, load: Load, bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """``seq`` + the 14 windowed/membership features."""
    f = sweep(
        ev.select("seq", "ts_sec", *FAMILY_INPUTS),
        [user_family(), ip_family(), account_family()],
        bucket_seconds=bucket_seconds,
        load=load,
    )
    return f.select("seq", *[_from_measures(c) for c in FEATURE_COLUMNS if c not in ("is_privileged_action", "auth_failure")])


def single_feature(events: DataFrame, name: str, bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """``event_id`` + one windowed/membership feature: only its family and measures are swept."""
    needed = DERIVED[name][0] if name in DERIVED else [name]
    for family in (user_family(), ip_family(), account_family()):
        parts = {k: [m for m in getattr(family, k) if m.name in needed] for k in ("counts", "distincts", "entropies", "firsts")}
        if any(parts.values()):
            break
    ev = dedup_events(events.select("event_id", "seq", "ts_sec", *FAMILY_INPUTS))
    family = replace(family, **parts)
    load = measure(events, [family], bucket_seconds=bucket_seconds)
    f = sweep(ev, [family], bucket_seconds=bucket_seconds, load=load)
    return ev.select("event_id", "seq").join(sorted_join(f), "seq").select("event_id", _from_measures(name))


def feature_snapshot(
    events: DataFrame,
    *,
    dedup: bool = True,
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    context: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Events + the 16 feature columns (one row per distinct ``event_id``).

    ``events`` needs ``seq`` (unique, >= 0, arrival order) and ``ts_sec`` (whole
    UTC seconds) besides the event fields. Events of ``context`` (the sweep's columns)
    count in the windows without being returned. A key's bucket of more than ``hot_rows`` events
    is split, in a key of more than ``WHOLE_KEY`` times as many (measured before the repeats go). The whole events
    are shuffled once, by ``seq``: the repeats are found in the sweep's columns alone.
    """
    ev = dedup_events(events) if dedup else events
    seen = ev.select("seq", "ts_sec", *FAMILY_INPUTS)
    if context is not None:
        seen = seen.unionByName(context.select(*seen.columns))
    measured = events if context is None else events.select("ts_sec", *FAMILY_INPUTS).unionByName(context.select("ts_sec", *FAMILY_INPUTS))
    families = [user_family(), ip_family(), account_family()]
    load = measure(measured, families, bucket_seconds=bucket_seconds, hot_rows=hot_rows)
    if dedup:
        # an event_id's later rows find no features; rows of one arrival are told apart in its task
        copies = Window.partitionBy("seq", "event_id").orderBy("seq")
        ev = events.repartition("seq").withColumn("_rn", F.row_number().over(copies)).where("_rn = 1").drop("_rn")
    out = ev.join(sorted_join(family_features(seen, load, bucket_seconds)), "seq")
    out = out.withColumn("auth_failure", F.col("auth_result") == "failure")
    feats = [c for c in FEATURE_COLUMNS if c != "is_privileged_action"]
    return out.select(*ev.columns, *feats)
