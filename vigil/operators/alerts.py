"""Alert upsert: idempotency key, fingerprint, suppression sessions, fold.

An alert folds into the open alert of its fingerprint when that alert was last
seen at most 300 s earlier (each repeat extends the window: a session).
Event time replaces the wall clock, so a batch rerun and a stream give the same
table. Sessions are found with gaps-and-islands over ``(ts_sec, seq)``. The alerts
are dealt out by fingerprint, once: sessions, fold and list unions follow in the
same task. A fingerprint that is measured to hold many alerts (``HOT_ALERTS``) is
split by time bucket instead, and the previous bucket's last time / last session
start is carried in from a small per-bucket table, so no hot fingerprint lands
whole in one task; its fold uses aggregates with map-side combine, and its list
unions are de-duplicated by aggregation before the per-alert collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import json_string, severity_of_rank, severity_rank, sorted_key_json
from ..schema import SUPPRESSION_WINDOW_SECONDS
from ..sources.store import ROWS_A_TASK, materialize, sorted_join

SESSION_BUCKET_SECONDS = 3600
HOT_ALERTS = 20_000  # alerts of one fingerprint from which it is split
HOT_LISTED = 10_000  # so many hot fingerprints are split at most, the largest ones


def _json_list(c: Column) -> Column:
    """JSON list text of detection sources (a fixed vocabulary of plain tokens)."""
    return F.when(F.size(c) == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), F.array_join(c, '", "'), F.lit('"]')))


def idempotency_key() -> Column:
    """Sorted-key JSON of {event_id, title, sorted sources, model_version}."""
    mv = F.when(F.col("model_version").isNull(), F.lit("null")).otherwise(json_string(F.col("model_version")))
    return sorted_key_json(
        ("event_id", json_string(F.col("event_id"))),
        ("title", json_string(F.col("title"))),
        ("sources", _json_list(F.array_sort(F.col("detection_sources")))),
        ("model_version", mv),
    )


def fingerprint() -> Column:
    """Sorted-key JSON of {title, severity, sorted sources, account, user, IP, country, service, action}."""
    return sorted_key_json(
        ("title", json_string(F.col("title"))),
        ("severity", json_string(F.col("severity"))),
        ("sources", _json_list(F.array_sort(F.col("detection_sources")))),
        ("account_id", json_string(F.col("account_id"))),
        ("user_id", json_string(F.col("user_id"))),
        ("source_ip", json_string(F.col("source_ip"))),
        ("geo_country", json_string(F.col("geo_country"))),
        ("service_name", json_string(F.col("service_name"))),
        ("api_action", json_string(F.col("api_action"))),
    )


def with_keys(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("idempotency_key", idempotency_key()).withColumn("alert_fingerprint", fingerprint())


LISTED = 10_000  # so many key hashes go into a filter at most


def drop_known(alerts: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Idempotency: drop repeats inside the input and keys already stored (semi/anti join).

    Of a written input, only alerts whose key's hash occurs again are shuffled for it, if these are few.
    """
    if "scratch_folder" not in alerts.__dict__:
        return _drop_known(alerts, stored)
    key = F.xxhash64("idempotency_key")
    seen = alerts.select(key.alias("k"), F.lit(1).alias("here"), F.lit(0).alias("there"))
    if stored is not None:
        seen = seen.unionByName(stored.select(key.alias("k"), F.lit(0).alias("here"), F.lit(1).alias("there")))
    again = seen.groupBy("k").agg(F.sum("here").alias("here"), F.max("there").alias("there")).where("here > 1 or (here = 1 and there = 1)")
    found = [r["k"] for r in again.select("k").limit(LISTED + 1).collect()]
    if not found:
        return alerts
    if len(found) > LISTED:
        return _drop_known(alerts, stored)
    return alerts.where(~key.isin(found)).unionByName(_drop_known(alerts.where(key.isin(found)), stored))


def _drop_known(alerts: DataFrame, stored: DataFrame | None) -> DataFrame:
    w = Window.partitionBy("idempotency_key").orderBy("ts_sec", "seq")
    out = alerts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    if stored is not None:
        out = out.join(sorted_join(stored.select("idempotency_key").distinct()), "idempotency_key", "left_anti")
    return out


def assign_sessions(
    alerts: DataFrame,
    gap_seconds: int = SUPPRESSION_WINDOW_SECONDS,
    bucket_seconds: int = SESSION_BUCKET_SECONDS,
    key: str = "alert_fingerprint",
) -> DataFrame:
    """Add ``session_ts``/``session_seq``: the (ts, seq) of the alert that opened the session."""
    d = alerts.withColumn("_b", F.floor(F.col("ts_sec") / F.lit(bucket_seconds)))
    part = [key, "_b"]
    w = Window.partitionBy(*part).orderBy("ts_sec", "seq")
    d = d.withColumn("_prev", F.lag("ts_sec").over(w))
    # last time of the key in earlier buckets
    last = d.groupBy(*part).agg(F.max("ts_sec").alias("_last"))
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry_t = last.select(*part, F.max("_last").over(wb).alias("_carry_last"))
    d = d.join(sorted_join(carry_t), part)
    prev = F.coalesce(F.col("_prev"), F.col("_carry_last"))
    d = d.withColumn("_start", prev.isNull() | ((F.col("ts_sec") - prev) > gap_seconds))
    start_key = F.when(F.col("_start"), F.struct(F.col("ts_sec").alias("t"), F.col("seq").alias("s")))
    wr = Window.partitionBy(*part).orderBy("ts_sec", "seq").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_loc_start", F.max(start_key).over(wr))
    # last session start of the key in earlier buckets
    # (every bucket gets a row, also those without a start of their own)
    starts = d.groupBy(*part).agg(F.max(start_key).alias("_ls"))
    carry_s = starts.select(*part, F.max("_ls").over(wb).alias("_carry_start"))
    d = d.join(sorted_join(carry_s), part)
    sess = F.coalesce(F.col("_loc_start"), F.col("_carry_start"))
    return d.withColumn("session_ts", sess["t"]).withColumn("session_seq", sess["s"]).drop(
        "_b", "_prev", "_carry_last", "_start", "_loc_start", "_carry_start"
    )


LIST_COLUMNS = ("reasons", "recommended_actions", "ml_top_contributors")


def _ordered_unions(df: DataFrame, group: list[str], cols=LIST_COLUMNS) -> DataFrame:
    """Per group and list column: distinct items in first-seen order (by ts, seq, position).

    One explode of all list columns; duplicates collapse in a map-side-combined
    aggregate before the per-alert collect, which then holds distinct items only.
    """
    def tag(k: int):
        return lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), x.alias("item"))

    def of_kind(k: int):
        return lambda x: x["k"] == k

    tagged = F.flatten(F.array(*[F.transform(F.col(c), tag(k)) for k, c in enumerate(cols)]))
    items = df.select(*group, "ts_sec", "seq", F.explode(tagged).alias("e"))
    firsts = items.groupBy(*group, F.col("e.k").alias("k"), F.col("e.item").alias("item")).agg(
        F.min(F.struct("ts_sec", "seq", F.col("e.pos").alias("pos"))).alias("first")
    )
    per = firsts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("k", "first", "item"))).alias("_l"))
    return per.select(
        *group,
        *[F.transform(F.filter("_l", of_kind(k)), lambda x: x["item"]).alias(c) for k, c in enumerate(cols)],
    )


def _sessions_whole(alerts: DataFrame, gap_seconds: int, rows: int) -> DataFrame:
    """``assign_sessions`` for fingerprints that a task holds whole: one exchange, which the fold shares."""
    cores = alerts.sparkSession.sparkContext.defaultParallelism
    d = alerts.where("alert_fingerprint is not null and ts_sec is not null")
    d = d.repartition(max(cores, -(-rows // ROWS_A_TASK)), "alert_fingerprint")
    # the hash tells the fingerprints apart in the sort's first eight bytes, where their text would tie
    d = d.withColumn("_g", F.xxhash64("alert_fingerprint"))
    w = Window.partitionBy("_g", "alert_fingerprint").orderBy("ts_sec", "seq")
    prev = F.lag("ts_sec").over(w)
    d = d.withColumn("_start", prev.isNull() | ((F.col("ts_sec") - prev) > gap_seconds))
    start = F.when(F.col("_start"), F.struct(F.col("ts_sec").alias("t"), F.col("seq").alias("s")))
    d = d.withColumn("_at", F.max(start).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("session_ts", F.col("_at.t")).withColumn("session_seq", F.col("_at.s")).drop("_g", "_start", "_at")


def _collected_unions(cols=LIST_COLUMNS) -> Column:
    """The items of all list columns of a group, for groups that a task may hold: as ``_ordered_unions`` orders them."""
    def tag(k: int):
        return lambda x, i: F.struct(F.lit(k).alias("k"), F.col("ts_sec"), F.col("seq"), i.alias("pos"), x.alias("item"))

    return F.array_sort(F.flatten(F.collect_list(F.flatten(F.array(*[F.transform(F.col(c), tag(k)) for k, c in enumerate(cols)])))))


SESSION = ["alert_fingerprint", "session_ts", "session_seq"]


def _fold(s: DataFrame, *more: Column) -> DataFrame:
    """One row per session."""
    newest = F.struct("ts_sec", "seq")
    nonempty = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", newest)
    return s.groupBy(*SESSION).agg(
        F.min_by("idempotency_key", newest).alias("_first_key"),
        F.min("timestamp").alias("created_at"),
        F.max("timestamp").alias("last_seen_at"),
        F.max(severity_rank(F.col("severity"))).alias("_sev"),
        F.max_by("title", newest).alias("title"),
        F.max_by("description", newest).alias("description"),
        F.max("anomaly_score").alias("anomaly_score"),
        F.max("confidence").alias("confidence"),
        F.max_by("feature_context", newest).alias("feature_context"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("detection_sources")))).alias("detection_sources"),
        F.max("ml_anomaly_score").alias("ml_anomaly_score"),
        F.max("ml_confidence").alias("ml_confidence"),
        F.max_by("model_version", nonempty("model_version")).alias("model_version"),
        F.max_by("ml_explanation", nonempty("ml_explanation")).alias("ml_explanation"),
        (F.count(F.lit(1)) - 1).alias("suppression_count"),
        F.max_by("event", newest).alias("event"),
        F.max_by("idempotency_key", newest).alias("idempotency_key"),
        *more,
    )


def _hot_fingerprints(rows: DataFrame, hot_alerts: int) -> tuple[int, list[int]]:
    """The number of alerts, and the hashes of fingerprints with more than ``hot_alerts`` of them."""
    counts = rows.groupBy(F.xxhash64("alert_fingerprint").alias("_g")).count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    if not total or most <= hot_alerts:
        return total or 0, []
    large = counts.where(F.col("count") > hot_alerts).orderBy(F.desc("count")).limit(HOT_LISTED)
    return total, [r["_g"] for r in large.collect()]


# What the fold reads of an alert.
FOLD_COLUMNS = [
    "seq", "ts_sec", "timestamp", "event", "feature_context", "severity", "title", "description", "anomaly_score", "confidence",
    "reasons", "recommended_actions", "detection_sources", "ml_anomaly_score", "ml_confidence", "model_version", "ml_top_contributors",
    "ml_explanation", "idempotency_key", "alert_fingerprint",
]


def suppress(
    alerts: DataFrame,
    gap_seconds: int = SUPPRESSION_WINDOW_SECONDS,
    bucket_seconds: int = SESSION_BUCKET_SECONDS,
    materialize_sessions: bool = True,
    hot_alerts: int = HOT_ALERTS,
) -> DataFrame:
    """Fold alerts (with keys) into the stored alert table: one row per session.

    Keeps id and created_at of the first alert; max scores (null-aware); newest
    title, description, features and event; sorted source union; first-seen
    ordered union of reasons, actions and contributors; count - 1 repeats.
    The alerts are written to the checkpoint folder before they are counted by fingerprint and folded, unless
    they were read from it, and so are the sessionized ones of hot fingerprints before the two aggregations read them.
    """
    rows = alerts
    if materialize_sessions and "scratch_folder" not in alerts.__dict__:
        rows = materialize(alerts.select(*FOLD_COLUMNS), "alert-rows")
    total, hot = _hot_fingerprints(rows, hot_alerts)
    is_hot = F.xxhash64("alert_fingerprint").isin(hot)
    whole = _sessions_whole((rows.where(~is_hot) if hot else rows).select(*FOLD_COLUMNS), gap_seconds, total)

    def of_kind(k: int):
        return lambda x: x["k"] == k

    unions = [F.array_distinct(F.transform(F.filter("_l", of_kind(k)), lambda x: x["item"])).alias(c) for k, c in enumerate(LIST_COLUMNS)]
    out = _fold(whole, _collected_unions().alias("_l")).select("*", *unions).drop("_l")
    if hot:
        s = assign_sessions(rows.where(is_hot).select(*FOLD_COLUMNS), gap_seconds, bucket_seconds)
        s = materialize(s, "alert-sessions") if materialize_sessions else s
        out = out.unionByName(_fold(s).join(sorted_join(_ordered_unions(s, SESSION)), SESSION, "left"))
    return out.select(
        F.sha2(F.col("_first_key"), 256).alias("alert_id"),
        "created_at",
        "last_seen_at",
        severity_of_rank(F.col("_sev")).alias("severity"),
        "title",
        "description",
        "anomaly_score",
        "confidence",
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
        F.coalesce("recommended_actions", F.array().cast("array<string>")).alias("recommended_actions"),
        "feature_context",
        "detection_sources",
        "ml_anomaly_score",
        "ml_confidence",
        "model_version",
        F.coalesce("ml_top_contributors", F.array().cast("array<string>")).alias("ml_top_contributors"),
        "ml_explanation",
        "idempotency_key",
        "alert_fingerprint",
        "suppression_count",
        "event",
    )
