"""Scalar value expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour used when a symbol has no usable RGB array.
DEFAULT_COLOUR = "#3388ff"
DEFAULT_OPACITY = 0.4

# Years 1 to 9999 in epoch milliseconds; anything outside has no calendar date.
_MIN_MS, _MAX_MS = -62135596800000, 253402300799999


def ntz_sql(value: datetime | str) -> str:
    """SQL literal of a zone-less timestamp."""
    moment = value if isinstance(value, datetime) else datetime.fromisoformat(value)
    return f"TIMESTAMP_NTZ '{moment.isoformat(sep=' ')}'"


def ntz(value: datetime | str | Column) -> Column:
    """Zone-less timestamp (``F.lit(datetime)`` would depend on the session's zone)."""
    return value.cast("timestamp_ntz") if isinstance(value, Column) else F.expr(ntz_sql(value))


def epoch_ms_to_ntz(ms: Column) -> Column:
    """UTC time of epoch milliseconds; null for null, zero and out-of-calendar values."""
    usable = (ms != 0) & ms.between(_MIN_MS, _MAX_MS)
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / F.lit(1000)).cast("decimal(18,6)"))
    return F.when(usable, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since)


def strip(value: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def split_tags(text: Column) -> Column:
    """Comma-separated tags; empty pieces stay, so ``""`` is one empty tag."""
    return F.transform(F.split(text, ","), strip)


def canonical_digest(*fields: Column) -> Column:
    """SHA-256 over ``length:value`` per field, ``~`` for null, joined with ``;``.

    The length prefix keeps ("a", "bc") and ("ab", "c") apart.
    """
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(
            F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))
        )
    return F.sha2(F.concat_ws(";", *parts), 256)


def clamp(value: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def short_id(run_id: Column) -> Column:
    return F.substring(run_id, 1, 8)


def report_base_name(started_at: Column, run_id: Column) -> Column:
    """Common stem of a run's report files."""
    day = F.date_format(started_at, "yyyy-MM-dd")
    return F.concat(F.lit("catalog_health_"), day, F.lit("_"), short_id(run_id))


def layer_key(item_id: Column, layer_index: Column) -> Column:
    return F.concat_ws(":", item_id, layer_index.cast("string"))


def _has_rgb(rgba: Column) -> Column:
    return F.coalesce(F.size(rgba) >= 3, F.lit(False))


def colour_hex(rgba: Column) -> Column:
    """``#rrggbb`` of an RGB(A) integer array."""
    rgb = F.format_string("#%02x%02x%02x", F.get(rgba, 0), F.get(rgba, 1), F.get(rgba, 2))
    return F.when(_has_rgb(rgba), rgb).otherwise(F.lit(DEFAULT_COLOUR))


def colour_opacity(rgba: Column) -> Column:
    """Alpha as a fraction; an RGB array without alpha is opaque."""
    alpha = F.when(F.size(rgba) > 3, F.get(rgba, 3)).otherwise(F.lit(255))
    return F.when(_has_rgb(rgba), alpha / F.lit(255.0)).otherwise(F.lit(DEFAULT_OPACITY))
