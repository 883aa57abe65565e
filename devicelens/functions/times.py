"""Time helpers: epoch microseconds, durations, alert time strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a timestamp column."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def duration_seconds(text: str) -> int:
    """'5m', '1h30m' -> seconds (for rule definitions, which are driver-side constants)."""
    parts = re.findall(r"(\d+)(ms|[smhdwy])", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return int(sum(int(n) * _UNITS[u] for n, u in parts))


def duration_col(col: Column) -> Column:
    """Column version of :func:`duration_seconds`; NULL if malformed."""
    parts = F.regexp_extract_all(col, F.lit(r"\d+(?:ms|[smhdwy])"), F.lit(0))

    def milliseconds(part: Column) -> Column:
        unit = F.regexp_extract(part, r"\D+", 0)
        factor = F.lit(None).cast("bigint")
        for name, seconds in _UNITS.items():
            factor = F.when(unit == name, F.lit(int(seconds * 1000)).cast("bigint")).otherwise(factor)
        return F.regexp_extract(part, r"\d+", 0).try_cast("bigint") * factor

    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + milliseconds(p))
    return F.when(col.rlike(r"^(\d+(ms|[smhdwy]))+$"), F.floor(total / 1000).cast("bigint"))


def slot_of(t_us: Column, width_us: int) -> Column:
    """Index of the time slot holding ``t_us`` (exact integer arithmetic, also before 1970)."""
    return F.floor((t_us - F.pmod(t_us, F.lit(width_us))) / F.lit(width_us)).cast("bigint")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with offset, microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    has_fraction = F.pmod(F.unix_micros(ts), F.lit(MICROS)) != 0
    fraction = F.when(has_fraction, F.date_format(ts, ".SSSSSS")).otherwise(F.lit(""))
    return F.concat(whole, fraction, F.lit("+00:00"))


def parse_alert_ts(text: Column, now: Column) -> Column:
    """Alert time string -> timestamp.

    Nanoseconds are cut to microseconds, ``Z`` and numeric offsets are honoured, a fraction
    without an offset is UTC, anything unreadable becomes ``now``.
    """
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    zoned = F.when(cut.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), cut).otherwise(F.concat(cut, F.lit("Z")))
    shaped = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"),
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(zoned),
    )
    return F.coalesce(shaped.try_cast("timestamp"), now)


def parse_resolved_ts(text: Column, now: Column) -> Column:
    """End time of a resolved alert; the zero time (year 1) means "not given" -> now."""
    parsed = parse_alert_ts(text, now)
    return F.when(F.year(parsed) <= 1, now).otherwise(parsed)
