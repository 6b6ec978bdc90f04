"""Raw event messages: JSON lines, the raw archive, archive replay, message sources.

``raw_event_lines`` renders every security event as the JSON message a
producer would send (keys sorted), and gives a deterministic share of the
lines one of the malformed or unusual shapes the validator must handle
(``LINE_KINDS``). The kind is a function of ``seq``, so the whole table is
processed and the same lines come out on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import json_string
from ..schema import RAW_EVENTS_TOPIC
from ..operators.topn import first_rows
from .store import materialize

# The line shapes (one per validation constraint, plus good variants).
LINE_KINDS = {
    0: "not json",
    1: "json array",
    2: "json string",
    3: "missing event_id",
    4: "blank user_id",
    5: "cloud_provider oci",
    6: "principal_type bot",
    7: "source_ip 999.1.1.1",
    8: "geo_country USA",
    9: "geo_country U1",
    10: "geo_country ' U'",
    11: "bytes_received -1",
    12: "bytes_received 'x'",
    13: "bytes_received null",
    14: "timestamp without zone",
    15: "timestamp 'nope'",
    16: "auth_result maybe",
    17: "geo_country lower case (good)",
    18: "IPv6 source (good)",
    19: "bytes_received missing (good)",
    20: "bytes_received as text '7' (good)",
    21: "padded ids (good)",
    22: "timestamp in a -05:00 offset (good)",
    23: "user_id as a number",
    24: "metadata a list",
    25: "metadata null",
    26: "IPv4-mapped IPv6 source (good)",
    27: "bytes_received 7.0 (good)",
    28: "is_privileged_action 'on' (good)",
    29: "timestamp as epoch seconds (good)",
    30: "user_id a no-break space",
}
KIND_MODULUS = 128
KIND_MULTIPLIER = 2654435761


def line_kind(seq: Column) -> Column:
    return F.pmod(seq * F.lit(KIND_MULTIPLIER), F.lit(KIND_MODULUS))


def _q(c: Column) -> Column:
    return json_string(c)


def raw_event_lines(events: DataFrame) -> DataFrame:
    """``(seq, arrival_ts, kind, value)``: one JSON message per event."""
    k = F.col("_kind")
    ts_utc = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    ts_text = (
        F.when(k == 14, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 15, F.lit("nope"))
        .when(
            k == 22,
            F.concat(F.date_format(F.col("timestamp") - F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")),
        )
        .otherwise(ts_utc)
    )
    fields: list[tuple[str, Column]] = [
        ("account_id", _q(F.col("account_id"))),
        ("api_action", _q(F.col("api_action"))),
        ("auth_result", _q(F.when(k == 16, F.lit("maybe")).otherwise(F.col("auth_result")))),
        (
            "bytes_received",
            F.when(k == 11, F.lit("-1"))
            .when(k == 12, F.lit('"x"'))
            .when(k == 13, F.lit("null"))
            .when(k == 19, F.lit(None).cast("string"))
            .when(k == 20, F.lit('"7"'))
            .when(k == 27, F.lit("7.0"))
            .otherwise(F.col("bytes_received").cast("string")),
        ),
        ("bytes_sent", F.col("bytes_sent").cast("string")),
        ("cloud_provider", _q(F.when(k == 5, F.lit("oci")).otherwise(F.col("cloud_provider")))),
        ("device_fingerprint", _q(F.col("device_fingerprint"))),
        (
            "event_id",
            F.when(k == 3, F.lit(None).cast("string"))
            .when(k == 21, _q(F.concat(F.lit("  "), F.col("event_id"), F.lit("  "))))
            .otherwise(_q(F.col("event_id"))),
        ),
        (
            "geo_country",
            _q(
                F.when(k == 8, F.lit("USA"))
                .when(k == 9, F.lit("U1"))
                .when(k == 10, F.lit(" U"))
                .when(k == 17, F.lower("geo_country"))
                .otherwise(F.col("geo_country"))
            ),
        ),
        ("is_privileged_action", F.when(k == 28, F.lit('"on"')).when(F.col("is_privileged_action"), F.lit("true")).otherwise(F.lit("false"))),
        (
            "metadata",
            F.when(k == 24, F.lit("[1]"))
            .when(k == 25, F.lit("null"))
            .otherwise(F.concat(F.lit('{"scenario": '), _q(F.col("scenario")), F.lit("}"))),
        ),
        ("principal_type", _q(F.when(k == 6, F.lit("bot")).otherwise(F.col("principal_type")))),
        ("region", _q(F.col("region"))),
        ("resource_id", _q(F.col("resource_id"))),
        ("resource_type", _q(F.col("resource_type"))),
        ("service_name", _q(F.col("service_name"))),
        (
            "source_ip",
            _q(F.when(k == 7, F.lit("999.1.1.1")).when(k == 18, F.lit("2001:db8::1")).when(k == 26, F.lit("::ffff:10.0.0.1")).otherwise(F.col("source_ip"))),
        ),
        ("timestamp", F.when(k == 29, F.col("ts_sec").cast("string")).otherwise(_q(ts_text))),
        ("user_agent", _q(F.col("user_agent"))),
        (
            "user_id",
            F.when(k == 23, F.lit("5")).otherwise(_q(
                F.when(k == 4, F.lit("  "))
                .when(k == 30, F.lit("\u00a0"))
                .when(k == 21, F.concat(F.lit("  "), F.col("user_id"), F.lit("  ")))
                .otherwise(F.col("user_id"))
            )),
        ),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), v) for n, v in fields]), F.lit("}"))
    value = (
        F.when(k == 0, F.concat(F.lit("not json {"), F.col("event_id")))
        .when(k == 1, F.lit("[1, 2]"))
        .when(k == 2, F.lit('"text"'))
        .otherwise(body)
    )
    return events.withColumn("_kind", line_kind(F.col("seq"))).select(
        "seq", F.col("timestamp").alias("arrival_ts"), F.col("_kind").alias("kind"), value.alias("value")
    )


def archive_line(value: Column) -> Column:
    """Archive form of a consumed message: objects with sorted keys, anything else as ``{"raw": text}``.

    Numbers come out in canonical form (``7.0`` as ``7``); ``raw_archive`` keeps the text as sent beside it.
    """
    parsed = F.try_parse_json(value)
    is_obj = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(is_obj, F.to_json(parsed)).otherwise(F.concat(F.lit('{"raw":'), json_string(value), F.lit("}")))


def raw_archive(lines: DataFrame) -> DataFrame:
    """Every consumed payload before validation, in arrival order, ready for ``write.text``."""
    return lines.select("seq", archive_line(F.col("value")).alias("line"), "value")


def write_archive(lines: DataFrame, path: str) -> None:
    """Append the archive as text (one JSON object per line), in arrival order over and within files."""
    raw_archive(lines).repartitionByRange("seq").sortWithinPartitions("seq").select("line").write.mode("append").text(path)


def replay_slice(lines: DataFrame, start_line: int = 1, limit: int | None = None, line_col: str = "line_no") -> DataFrame:
    """Lines from physical line ``start_line`` on, blank lines skipped, at most ``limit`` of them.

    ``limit=0`` still yields one line (the reference sends before it checks).
    """
    out = lines.where((F.col(line_col) >= start_line) & (F.trim(F.col("value")) != ""))
    if limit is not None:
        out = first_rows(out, max(limit, 1), [F.col(line_col)])
    return out


def _number(rows: DataFrame, blocks: list[str], order: str, name: str) -> DataFrame:
    """Numbers 1, 2, ... in the order of the blocks and of ``order`` inside them; no task holds more than a block."""
    counts = rows.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n"))
    # one row per block of the files
    before = Window.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*blocks, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(*blocks).orderBy(order))
    return rows.withColumn("_inside", inside).join(first, blocks).withColumn(name, F.col("_first") + F.col("_inside")).drop("_inside", "_first")


def arrival_numbers(rows: DataFrame, order: tuple[str, ...] = ("arrival_ts", "source_partition", "source_offset"), name: str = "seq", start: int = 0) -> DataFrame:
    """``rows`` plus dense numbers from ``start`` on in arrival order, whatever partition of the source they came from.

    The rows are dealt into ranges of the order and numbered inside them, on top of the counts of the ranges
    before; ties of time go by partition, then offset.
    """
    placed = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "arrivals")
    counts = placed.groupBy("_range").count()
    # one row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_range", (F.coalesce(F.sum("count").over(before), F.lit(0)) + F.lit(start - 1)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_inside", inside).join(first, "_range").withColumn(name, F.col("_first") + F.col("_inside")).drop("_inside", "_first", "_range")


def replay_archive(spark: SparkSession, path: str, start_line: int = 1, limit: int | None = None) -> DataFrame:
    """``(line_no, value)`` of a written archive: as ``replay_slice`` over its physical lines.

    Files count in name order. Lines are numbered by file block, so neither the numbering nor the
    limit gathers the lines in one task.
    """
    blocks = ["_file", "_block"]
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.trim("value").alias("value"),
    )
    rows = materialize(rows, "archive-lines")
    sent = _number(rows, blocks, "_at", "line_no").where((F.col("line_no") >= start_line) & (F.col("value") != ""))
    if limit is not None:
        sent = _number(sent, blocks, "_at", "_sent").where(F.col("_sent") <= max(limit, 1))
    return sent.select("line_no", "value")


def replay_to(lines: DataFrame, path: str) -> None:
    """Replayed lines as a folder of text files that ``read_message_source`` reads, in line order."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.mode("append").text(path)


def read_message_source(spark: SparkSession, fmt: str, path_or_topic: str, options: dict | None = None, stream: bool = False) -> DataFrame:
    """Event messages as ``(seq, arrival_ts, value)``.

    ``fmt='kafka'`` reads a topic from the earliest offset: in batch, seq numbers the messages of all
    partitions by arrival; a stream keeps ``source_partition`` and ``source_offset``, by which each
    micro-batch is numbered (the connector must be on the classpath). ``'text'`` reads folders of JSON
    lines (seq from the file order in batch; assigned per micro-batch in a stream).
    """
    options = dict(options or {})
    reader = spark.readStream if stream else spark.read
    if fmt == "kafka":
        options.setdefault("subscribe", path_or_topic or RAW_EVENTS_TOPIC)
        options.setdefault("startingOffsets", "earliest")
        return topic_messages(reader.format("kafka").options(**options).load(), stream)
    df = reader.format("text").options(**options).load(path_or_topic)
    if stream:
        # position ids are not available on a stream; foreachBatch assigns batch-major seq
        return df.select(F.lit(None).cast("long").alias("seq"), F.current_timestamp().alias("arrival_ts"), "value")
    return df.select(
        F.monotonically_increasing_id().alias("seq"), F.current_timestamp().alias("arrival_ts"), "value"
    )


def topic_messages(topic: DataFrame, stream: bool) -> DataFrame:
    """Messages of a frame with a topic's columns (partition, offset, timestamp, value)."""
    rows = topic.select(
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        F.col("timestamp").alias("arrival_ts"),
        F.col("value").cast("string").alias("value"),
    )
    if stream:
        return rows.withColumn("seq", F.lit(None).cast("long"))
    return arrival_numbers(rows).select("seq", "arrival_ts", "value")
