"""Scalar column functions (all JVM-side expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SEVERITIES


def event_seconds(ts: Column) -> Column:
    """Event time in whole epoch seconds (UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def delete_like(action: Column) -> Column:
    """Case-sensitive ``Delete`` or ``Terminate`` inside the API action."""
    return action.contains("Delete") | action.contains("Terminate")


def safe_ratio(num: Column, den: Column, digits: int = 3) -> Column:
    """``round(num/den, digits)``; 0.0 when the denominator is 0."""
    return F.coalesce(F.round(F.try_divide(num.cast("double"), den.cast("double")), digits), F.lit(0.0))


def score_from_raw(raw: Column) -> Column:
    """Logistic anomaly score ``1 / (1 + e^(3.5 raw))`` rounded to 4 places."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(raw * F.lit(3.5))), 4)


def confidence_from_raw(raw: Column) -> Column:
    """``|raw| / (|raw| + 0.5)`` rounded to 4 places."""
    return F.round(F.abs(raw) / (F.abs(raw) + F.lit(0.5)), 4)


def severity_rank(sev: Column) -> Column:
    """Ordinal of a severity: low=0 .. critical=3."""
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), sev) - 1).cast("int")


def severity_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))


def py_bool_text(b: Column) -> Column:
    """Python's text of a bool: ``True`` / ``False``."""
    return F.when(b, F.lit("True")).otherwise(F.lit("False"))


def detection_category(sources: Column) -> Column:
    """Dashboard category: ml-only, rule+ml, rule-only (rule with any third source), unknown."""
    has_ml = F.array_contains(sources, "ml")
    has_rule = F.array_contains(sources, "rule")
    only_ml = has_ml & (F.size(F.array_distinct(sources)) == 1)
    return (
        F.when(only_ml, F.lit("ml-only"))
        .when(has_rule & has_ml, F.lit("rule+ml"))
        .when(has_rule, F.lit("rule-only"))
        .otherwise(F.lit("unknown"))
    )


def metric_category(sources: Column) -> Column:
    """Stream-metric category: ml_only, rule_only, rule_plus_ml, unknown."""
    has_ml = F.array_contains(sources, "ml")
    has_rule = F.array_contains(sources, "rule")
    n = F.size(F.array_distinct(sources))
    return (
        F.when(has_ml & (n == 1), F.lit("ml_only"))
        .when(has_rule & (n == 1), F.lit("rule_only"))
        .when(has_rule & has_ml, F.lit("rule_plus_ml"))
        .otherwise(F.lit("unknown"))
    )


def sorted_key_json(*pairs: tuple[str, Column]) -> Column:
    """JSON object text with keys in sorted order, Python ``json.dumps(sort_keys=True)`` spacing."""
    items = sorted(pairs, key=lambda p: p[0])
    parts = []
    for i, (k, v) in enumerate(items):
        sep = "" if i == 0 else ", "
        parts.append(F.lit(f'{sep}"{k}": '))
        parts.append(v)
    return F.concat(F.lit("{"), *parts, F.lit("}"))


NOT_PLAIN = r'[^ !#-\[\]-~]'  # all but the ASCII characters that JSON shows as they are


def json_string(c: Column) -> Column:
    """JSON text of a string value (quoted, escaped)."""
    escaped = F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - F.lit(2))
    return F.when(c.isNull(), F.lit("null")).when(c.rlike(NOT_PLAIN), escaped).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def json_string_array(c: Column) -> Column:
    """JSON list text with ``", "`` separators like Python's json.dumps."""
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(c, lambda x: json_string(x)), ", "),
        F.lit("]"),
    )


def iso_text(ts: Column) -> Column:
    """ISO-8601 text of a UTC timestamp: microseconds only when non-zero, ``+00:00`` offset."""
    micros = F.unix_micros(ts) % 1_000_000
    frac = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))
