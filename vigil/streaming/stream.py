"""Structured Streaming detection: ``readStream -> foreachBatch(process_batch)``.

Each micro-batch reuses the batch functions:
  1. number the rows, validate; archive every payload; dead-letter the invalid lines and, with
     ``lateness_seconds``, the valid events that come too late;
  2. drop repeats of stored event ids; compute the 16 features over the batch and the stored events
     that can still tell (see ``_context``); first-seen flags come from the first-seen state of the
     batch's users (exact, all time);
  3. score, evaluate the rules, key the alerts; repeats inside the batch and of stored idempotency
     keys are dropped. A scorer that fails leaves rules-only detection;
  4. suppression: the stored sessions of the touched fingerprints that the new alerts can reach are
     folded again with them. A session keeps the id and creation time it was first stored with, also
     when a late alert opens it earlier; sessions that grow together keep the earliest one's;
  5. every table and state is written per ``batch_id`` (overwritten on retry) and holds what the
     batch adds or changes, never a copy of the state, so a replayed batch after a failure gives the
     same tables: the checkpoint plus idempotent writes make the sink exactly-once.

State lies in key buckets and is merged in generations (``state.py``), so a batch reads the buckets of
its own keys, and what it costs doesn't grow with the batches before it. With ``lateness_seconds``, state
that no event can reach any more is dropped.

For in-order input, k micro-batches give the same feature rows and alert table
as one batch run (tested).
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.validate import dead_letters, failure_letters, validate_events
from ..operators import rules as R
from ..operators.alerts import FOLD_COLUMNS, drop_known, suppress, with_keys
from ..operators.features import FAMILY_INPUTS, dedup_events, feature_snapshot
from ..operators.scoring import score_from_raw_frame, score_no_model
from ..sources.raw import archive_line, arrival_numbers
from ..sources.store import discard, materialize, sorted_join
from ..sources.tables import PARTITION_COLUMNS, feature_rows
from .latency import Timings
from .state import KeyedState, buckets_of, least, newest, stored_schema

LOGGER = logging.getLogger(__name__)
DAY = 86400
HOUR = 3600
SLOT = 900  # events are thinned per slot; the day's window is exact at its ends by whole slots
EVENT_COLUMNS = [
    "event_id", "seq", "ts_sec", "timestamp", "timestamp_text", "cloud_provider", "account_id", "user_id",
    "principal_type", "source_ip", "geo_country", "region", "service_name", "api_action", "resource_type",
    "resource_id", "auth_result", "bytes_sent", "bytes_received", "device_fingerprint", "user_agent",
    "is_privileged_action", "metadata", "scenario",
]
HISTORY_COLUMNS = ["event_id", "seq", "ts_sec", *FAMILY_INPUTS]


@dataclass
class StreamConfig:
    base: str  # folder holding all tables of the stream
    stats: DataFrame | None = None  # one-row training statistics; None = no model
    raw_score: str | None = None  # column holding the model's raw decision value (scorer output)
    scorer: Callable[[DataFrame], DataFrame] | None = None  # features -> features + raw score column
    model_version: str = "unavailable"
    suppression_seconds: int = 300
    lateness_seconds: int | None = None  # later events become dead letters of stage "late"; None: all are taken
    alert_sink: Callable[[DataFrame, int], None] | None = None  # gets the batch's new alerts; a failure dead-letters them
    dead_letter_sinks: list[Callable[[DataFrame, int], None]] = field(default_factory=list)  # besides the table, each failing alone
    dead_letter_failures: bool = False  # failing detection dead-letters the batch's events instead of ending the query
    state_buckets: int = 16
    state_fan: int = 8  # so many runs of state are merged into one

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _state(spark: SparkSession, cfg: StreamConfig, name: str, schema: T.StructType | str, key: list[str], **more) -> KeyedState:
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return KeyedState(spark, cfg.path(name), schema, key, buckets=cfg.state_buckets, fan=cfg.state_fan, **more)


TELLING = ["user_id", "source_ip", "geo_country", "region", "slot"]


def _states(spark: SparkSession, cfg: StreamConfig) -> dict[str, KeyedState]:
    """The states whose rows don't depend on the alerts' schema."""
    thin = T.StructType([*(f for f in _history_schema()), T.StructField("slot", T.LongType())])
    first_seen = "user_id string, dim string, value string, first struct<ts_sec: bigint, seq: bigint>"
    return {
        "event_ids": _state(spark, cfg, "event_ids", "event_id string, ts_sec long", ["event_id"], merge=newest(["event_id"])),
        "recent_by_user": _state(spark, cfg, "recent_by_user", thin, ["user_id"], merge=least(TELLING, "seq")),
        "recent_by_ip": _state(spark, cfg, "recent_by_ip", thin, ["source_ip"], merge=least(TELLING, "seq")),
        "first_seen": _state(spark, cfg, "first_seen", first_seen, ["user_id"], merge=least(["user_id", "dim", "value"], "first")),
        "alert_keys": _state(spark, cfg, "alert_keys", "idempotency_key string, ts_sec long", ["idempotency_key"]),
    }


def _history_schema() -> T.StructType:
    types = {"ts_sec": T.LongType(), "seq": T.LongType(), "bytes_received": T.LongType(), "is_privileged_action": T.BooleanType()}
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in HISTORY_COLUMNS])


def _alert_log(spark: SparkSession, cfg: StreamConfig, schema: T.StructType) -> KeyedState:
    return _state(spark, cfg, "alert_log", schema, ["alert_fingerprint"])


def _alert_state(spark: SparkSession, cfg: StreamConfig, schema: T.StructType) -> KeyedState:
    return _state(spark, cfg, "alerts", schema, ["alert_fingerprint"], merge=newest(["alert_id"]), keep=~F.col("deleted"))


def _together(spark: SparkSession, *jobs: Callable[[], object]) -> None:
    """Independent writes of a batch, some at a time; the first error is raised when all have ended."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()


def compact_state(spark: SparkSession, cfg: StreamConfig, before: int) -> None:
    """Merge the state of earlier batches; with ``lateness_seconds``, drop what no event can reach.

    Ids and idempotency keys are kept for a day behind the latest event that is still taken, thinned events
    as long as a window can reach them. First-seen values, sessions and the alerts in them stay.
    """
    seen = _progress(spark, cfg, before)
    reach = None if seen is None or cfg.lateness_seconds is None else seen - cfg.lateness_seconds - DAY - SLOT
    fresh = None if reach is None else F.col("ts_sec") >= reach
    jobs = [partial(state.compact, before, None if name == "first_seen" else fresh) for name, state in _states(spark, cfg).items()]
    for name, make in (("alert_log", _alert_log), ("alerts", _alert_state)):
        if _exists(spark, cfg.path(name)):
            jobs.append(partial(make(spark, cfg, stored_schema(spark, cfg.path(name))).compact, before))
    _together(spark, *jobs)
    if reach is not None and _exists(spark, cfg.path("history")):
        folder = spark._jvm.org.apache.hadoop.fs.Path(cfg.path("history"))
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("hour=") and (int(name[5:]) + 1) * HOUR <= reach:
                files.delete(status.getPath(), True)


def _write_partition(
    df: DataFrame, path: str, batch_id: int, fmt: str = "parquet", by: tuple[str, ...] = (), before: list[str] | tuple[str, ...] = ()
) -> None:
    """Overwrite only this batch's partitions (idempotent on retry); ``before`` and ``by`` are the ones above and below it."""
    out = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
    if before:
        out = out.hint("rebalance", *before)
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*before, "batch_id", *by)
        .format(fmt)
        .save(path)
    )


def number_rows(batch: DataFrame, batch_id: int) -> DataFrame:
    """Rows without a position get gapless batch-major arrival numbers, however many partitions the batch has.

    Messages of a topic are numbered by arrival time, partition and offset, others in the order they were read.
    """
    if "source_offset" in batch.columns:
        return arrival_numbers(batch.drop("seq"), start=batch_id << 40).drop("source_partition", "source_offset")
    rows = materialize(batch.withColumn("_at", F.monotonically_increasing_id()), "batch-rows")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of the batch
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    number = F.lit(batch_id << 40) + F.col("_first") + inside
    numbered = rows.join(F.broadcast(first), part == F.col("_part")).withColumn("seq", F.coalesce(F.col("seq"), number))
    return numbered.drop("_at", "_part", "_first")


def batch_minima(events: DataFrame) -> DataFrame:
    """Earliest (ts, seq) per (user, dim, value) of a batch, dims: user / country / ip."""
    rows = events.select(
        "user_id",
        "ts_sec",
        "seq",
        F.explode(
            F.array(
                F.struct(F.lit("user").alias("dim"), F.lit("").alias("value")),
                F.struct(F.lit("country").alias("dim"), F.col("geo_country").alias("value")),
                F.struct(F.lit("ip").alias("dim"), F.col("source_ip").alias("value")),
            )
        ).alias("d"),
    ).select("user_id", "d.dim", "d.value", F.struct("ts_sec", "seq").alias("first"))
    return rows.groupBy("user_id", "dim", "value").agg(F.min("first").alias("first"))


def first_seen_flags(batch: DataFrame, first_seen: DataFrame) -> DataFrame:
    """``seq`` + is_new_country_for_user / is_new_ip_for_user, exact over all time."""
    rows = batch.select(
        "seq",
        "user_id",
        F.struct("ts_sec", "seq").alias("me"),
        F.explode(
            F.array(
                F.struct(F.lit("user").alias("dim"), F.lit("").alias("value")),
                F.struct(F.lit("country").alias("dim"), F.col("geo_country").alias("value")),
                F.struct(F.lit("ip").alias("dim"), F.col("source_ip").alias("value")),
            )
        ).alias("d"),
    ).select("seq", "user_id", "me", "d.dim", "d.value")
    w = Window.partitionBy("user_id", "dim", "value").orderBy("me")
    rows = rows.withColumn("_rn", F.row_number().over(w))
    rows = rows.join(sorted_join(first_seen), ["user_id", "dim", "value"], "left")
    prior = F.col("first").isNotNull() & (F.col("first") < F.col("me"))
    rows = rows.withColumn("_first", ~prior & (F.col("_rn") == 1))
    f = rows.groupBy("seq").agg(
        F.max(F.when(F.col("dim") == "user", F.col("_first"))).alias("_first_user"),
        F.max(F.when(F.col("dim") == "country", F.col("_first"))).alias("_first_country"),
        F.max(F.when(F.col("dim") == "ip", F.col("_first"))).alias("_first_ip"),
    )
    return f.select(
        "seq",
        (~F.col("_first_user") & F.col("_first_country")).alias("is_new_country_for_user"),
        (~F.col("_first_user") & F.col("_first_ip")).alias("is_new_ip_for_user"),
    )


def _score(cfg: StreamConfig, feats: DataFrame) -> DataFrame:
    if cfg.scorer is not None:
        try:
            feats = materialize(cfg.scorer(feats), "batch-scores")
        except Exception:  # noqa: BLE001 - the scorer is foreign code; whatever it raises leaves rules only
            return score_no_model(feats, "")
    if cfg.stats is None or cfg.raw_score is None:
        return score_no_model(feats)
    return score_from_raw_frame(feats, cfg.stats, cfg.raw_score, cfg.model_version)


def _dead_letter(cfg: StreamConfig, rows: DataFrame, batch_id: int) -> None:
    """Dead letters to the stream's table, then to every further sink; a sink that fails stops no other."""
    _write_partition(rows, cfg.path("dead_letters"), batch_id, by=("stage",))
    for n, sink in enumerate(cfg.dead_letter_sinks):
        try:
            sink(rows, batch_id)
        except Exception as exc:  # noqa: BLE001 - foreign code; the rows are in the table
            LOGGER.warning("dead-letter sink %d failed: %s", n, exc)


def _progress(spark: SparkSession, cfg: StreamConfig, before: int) -> int | None:
    """The latest event time of all batches before ``before``, as the last of them noted it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cfg.path("progress"))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    batches = [int(n[len("batch_id=") :]) for n in found if n.startswith("batch_id=")]
    last = max((b for b in batches if b < before), default=None)
    for b in batches:
        if last is not None and b < last:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"batch_id={b}"), True)
    return None if last is None else spark.read.schema("max_ts long").parquet(f"{cfg.path('progress')}/batch_id={last}").first()["max_ts"]


def _split_late(spark: SparkSession, cfg: StreamConfig, events: DataFrame, batch_id: int) -> DataFrame:
    """The events to process; those more than ``lateness_seconds`` behind earlier batches are dead-lettered."""
    seen = _progress(spark, cfg, batch_id)
    if cfg.lateness_seconds is not None and seen is not None:
        late = F.col("ts_sec") < seen - cfg.lateness_seconds
        message = f"event time is more than {cfg.lateness_seconds} s behind"
        _dead_letter(cfg, failure_letters(events.where(late), "late", "LateEvent", message, retryable=False), batch_id)
        events = events.where(~late)
    latest = F.greatest(F.max("ts_sec"), F.lit(seen).cast("long"))
    _write_partition(events.agg(latest.alias("max_ts")).where("max_ts is not null"), cfg.path("progress"), batch_id)
    return events


def _slot() -> Column:
    return F.floor(F.col("ts_sec") / SLOT)


def thin(events: DataFrame) -> DataFrame:
    """The first event of every user, IP, country and region in a slot: all that a day's distinct counts need of it."""
    first = Window.partitionBy(*TELLING).orderBy("seq")
    rows = events.select(*HISTORY_COLUMNS).withColumn("slot", _slot())
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def _context(
    spark: SparkSession, cfg: StreamConfig, events: DataFrame, states: dict[str, KeyedState], buckets: dict[str, list[int]], batch_id: int
) -> DataFrame:
    """Stored events that decide the windows of the batch's events.

    Of the last hour and of the slot in which an event's day begins, all stored events of its user, IP
    or account; of the slots between, which lie in the day whole, only the thinned ones of its user and
    IP, since nothing but distinct values is counted there.
    """
    slots = events.select(F.explode(F.concat(F.sequence(_slot() - HOUR // SLOT, _slot()), F.array(F.floor((F.col("ts_sec") - DAY) / SLOT)))).alias("slot"))
    slots = slots.distinct()
    hours = sorted({r[0] for r in slots.select(F.floor(F.col("slot") * SLOT / HOUR)).distinct().collect()})  # hours that a batch's events lie in
    paths = [p for p in (f"{cfg.path('history')}/hour={h}" for h in hours) if _exists(spark, p)]
    parts = []
    if paths:
        schema = T.StructType([*_history_schema().fields, T.StructField("batch_id", T.LongType())])
        stored = spark.read.schema(schema).option("basePath", cfg.path("history")).parquet(*paths).where(F.col("batch_id") < batch_id)
        stored = stored.withColumn("slot", _slot()).join(slots, "slot", "left_semi").select(*HISTORY_COLUMNS)
        parts += [stored.join(sorted_join(events.select(k).distinct()), k, "left_semi").select(*HISTORY_COLUMNS) for k in ("user_id", "source_ip", "account_id")]
    span = events.agg(F.min("ts_sec").alias("lo"), F.max("ts_sec").alias("hi")).first()
    for name, key in (("recent_by_user", "user_id"), ("recent_by_ip", "source_ip")):
        rows = states[name].read(batch_id, events.select(key), buckets[name])
        parts.append(rows.where(F.col("ts_sec").between(span.lo - DAY, span.hi)).select(*HISTORY_COLUMNS))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["seq"])


def process_batch(spark: SparkSession, cfg: StreamConfig, batch: DataFrame, batch_id: int) -> None:
    """One micro-batch of raw messages ``(seq, arrival_ts, value)``."""
    timings = Timings()
    with timings.stage("batch"):
        _process(spark, cfg, batch, batch_id, timings)
    _write_partition(timings.frame(spark), cfg.path("timings"), batch_id)


def _process(spark: SparkSession, cfg: StreamConfig, batch: DataFrame, batch_id: int, timings: Timings) -> None:
    with timings.stage("compact_state"):
        compact_state(spark, cfg, batch_id)
    with timings.stage("validate", counted=True) as seen:
        rows = validate_events(number_rows(batch, batch_id))
        validated = materialize(rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("valid")).alias("failed")), "batch-validated")
    try:
        if validated.isEmpty():
            return
        with timings.stage("archive"):
            _write_partition(validated.select(archive_line(F.col("value")).alias("value")), cfg.path("archive"), batch_id, "text")
            _dead_letter(cfg, dead_letters(validated), batch_id)
        events = _split_late(spark, cfg, validated.where("valid"), batch_id)
        if events.isEmpty():
            return
        try:
            with timings.stage("detect"):
                _detect(spark, cfg, events, batch_id)
        except Exception as exc:  # noqa: BLE001 - only where the caller asked for it
            if not cfg.dead_letter_failures:
                raise
            _dead_letter(cfg, failure_letters(events, "stream_processing", type(exc).__name__, str(exc)[:500], retryable=True), batch_id)
    finally:
        discard(validated)


def _detect(spark: SparkSession, cfg: StreamConfig, validated: DataFrame, batch_id: int) -> None:
    """Features, first-seen flags, scores, alerts and the alert table of one batch's valid events."""
    states = _states(spark, cfg)
    events = dedup_events(validated.select(*EVENT_COLUMNS))
    names = ["event_ids", "recent_by_user", "recent_by_ip", "first_seen"]
    buckets = dict(zip(names, buckets_of(events, [states[n] for n in names])))
    stored = states["event_ids"].read(batch_id, events.select("event_id"), buckets["event_ids"])
    events = materialize(events.join(sorted_join(stored.select("event_id")), "event_id", "left_anti"), "batch-events")
    context = materialize(_context(spark, cfg, events, states, buckets, batch_id), "batch-context")
    feats = feature_snapshot(events, dedup=False, context=context)

    minima = batch_minima(events)
    known = states["first_seen"].read(batch_id, events.select("user_id"), buckets["first_seen"]).drop("batch_id")
    flags = first_seen_flags(events, known)
    feats = materialize(feats.drop("is_new_country_for_user", "is_new_ip_for_user").join(sorted_join(flags), "seq"), "batch-features")

    hour = F.floor(F.col("ts_sec") / HOUR)
    was = known.withColumnRenamed("first", "was")
    changed = minima.join(sorted_join(was), ["user_id", "dim", "value"], "left").where("was is null or first < was").drop("was")
    _together(
        spark,
        lambda: _write_partition(feature_rows(feats), cfg.path("features"), batch_id, before=PARTITION_COLUMNS),
        lambda: _write_partition(events.select(*HISTORY_COLUMNS).withColumn("hour", hour), cfg.path("history"), batch_id, before=["hour"]),
        lambda: states["recent_by_user"].write(thin(events), batch_id),
        lambda: states["recent_by_ip"].write(thin(events), batch_id),
        lambda: states["event_ids"].write(events.select("event_id", "ts_sec"), batch_id),
        lambda: states["first_seen"].write(changed, batch_id),
    )

    rows = store_alerts(spark, cfg, with_keys(R.alerts(_score(cfg, feats))), batch_id)
    _deliver(cfg, rows, validated, batch_id)
    for table in (events, context, feats, rows):
        discard(table)


def store_alerts(spark: SparkSession, cfg: StreamConfig, alerts: DataFrame, batch_id: int) -> DataFrame:
    """Log a batch's new alerts and fold them into the alert table; returns the alerts that were new."""
    keys = _states(spark, cfg)["alert_keys"]
    rows = materialize(alerts, "batch-keyed")
    new = drop_known(rows, keys.read(batch_id, rows.select("idempotency_key")))
    if new is not rows:
        new = materialize(new, "batch-alerts")
        discard(rows)
    folded = new.select(*FOLD_COLUMNS)
    log = _alert_log(spark, cfg, folded.schema)
    _together(spark, lambda: keys.write(new.select("idempotency_key", "ts_sec"), batch_id), lambda: log.write(folded, batch_id))
    if not new.isEmpty():
        _upsert_alerts(spark, cfg, new, log, batch_id)
    return new


def _deliver(cfg: StreamConfig, rows: DataFrame, events: DataFrame, batch_id: int) -> None:
    """New alerts to the sink that was passed in; if it fails, their events are dead-lettered for a retry."""
    if cfg.alert_sink is None or rows.isEmpty():
        return
    try:
        cfg.alert_sink(rows, batch_id)
    except Exception as exc:  # noqa: BLE001 - foreign code; the alerts are in the alert table all the same
        failed = events.join(sorted_join(rows.select("seq").distinct()), "seq", "left_semi")
        _dead_letter(cfg, failure_letters(failed, "alert_delivery", type(exc).__name__, str(exc)[:500], retryable=True), batch_id)


STATE = ["session_start", "deleted"]
REACHED = ["alert_id", "alert_fingerprint", "created_at", "last_seen_at", "session_start"]  # what tells a stored session apart


def _upsert_alerts(spark: SparkSession, cfg: StreamConfig, new: DataFrame, log: KeyedState, batch_id: int) -> None:
    """Fold the sessions that the batch's alerts can reach again; write what changed."""
    gap = cfg.suppression_seconds
    path, rows, reached, used = cfg.path("alerts"), new, None, []
    if _exists(spark, path):
        schema = stored_schema(spark, path)
        touched = new.groupBy("alert_fingerprint").agg(F.min("ts_sec").alias("_lo"))
        (buckets,) = buckets_of(touched, [log])  # the alerts lie in the same buckets
        reached = materialize(
            _alert_state(spark, cfg, schema)
            .read(batch_id, touched, buckets)
            .where("not deleted")
            .join(sorted_join(touched), "alert_fingerprint")
            .where(F.unix_seconds("last_seen_at") >= F.col("_lo") - F.lit(gap))
            .select(*REACHED),
            "batch-sessions",
        )
        since = reached.groupBy("alert_fingerprint").agg(F.min("session_start").alias("_since"))
        old = log.read(batch_id, since, buckets).join(sorted_join(since), "alert_fingerprint").where(F.col("ts_sec") >= F.col("_since"))
        rows = materialize(new.select(*FOLD_COLUMNS).unionByName(old.select(*FOLD_COLUMNS)), "batch-reached")
        used = [reached, rows]
    live = suppress(rows, gap).withColumn("session_start", F.unix_seconds("created_at")).withColumn("deleted", F.lit(False))
    if reached is None:
        _alert_state(spark, cfg, live.schema).write(live, batch_id)
        return
    # the earliest stored session inside a folded one lends it its id and creation time
    stored = reached.select(
        F.col("alert_fingerprint").alias("_fp"),
        F.col("session_start").alias("_at"),
        F.struct("session_start", F.col("alert_id").alias("id"), F.col("created_at").alias("at")).alias("_was"),
    )
    inside = (F.col("alert_fingerprint") == F.col("_fp")) & F.col("_at").between(F.col("session_start"), F.unix_seconds("last_seen_at"))
    lent = live.select("alert_id", "alert_fingerprint", "session_start", "last_seen_at").join(sorted_join(stored), inside).groupBy("alert_id").agg(F.min("_was").alias("_was"))
    live = live.join(sorted_join(lent), "alert_id", "left").withColumns(
        {"alert_id": F.coalesce(F.col("_was.id"), F.col("alert_id")), "created_at": F.coalesce(F.col("_was.at"), F.col("created_at"))}
    )
    live = materialize(live.select(*schema.fieldNames()), "batch-live")
    # of a session that went into another only its keys are written
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in (*REACHED, "deleted")]
    gone = reached.join(sorted_join(live.select("alert_id")), "alert_id", "left_anti").select(*REACHED, F.lit(True).alias("deleted"), *blank)
    _alert_state(spark, cfg, schema).write(live.unionByName(gone), batch_id)
    for table in (*used, live):
        discard(table)


def current_alerts(spark: SparkSession, cfg: StreamConfig) -> DataFrame | None:
    """The alert table as the last batch left it; None before any batch with alerts."""
    if not _exists(spark, cfg.path("alerts")):
        return None
    state = _alert_state(spark, cfg, stored_schema(spark, cfg.path("alerts")))
    return state.read(1 << 62).where("not deleted").drop(*STATE, "batch_id")


def start(
    spark: SparkSession,
    messages: DataFrame,
    cfg: StreamConfig,
    checkpoint: str,
    trigger: dict | None = None,
):
    """Start the detection stream over a streaming frame of ``(seq, arrival_ts, value)``."""
    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, bid: process_batch(spark, cfg, df, bid)
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
