"""Instants are epoch milliseconds (BIGINT); days are derived without the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def iso_ms(text: Column) -> Column:
    """ISO-8601 text to epoch milliseconds, NULL when it does not parse."""
    return F.unix_millis(F.try_to_timestamp(text))


def nano_ms(ns: Column) -> Column:
    """Nanoseconds as text or number to epoch milliseconds."""
    return F.expr("bigint(0)") + (ns.cast("decimal(38,0)") / F.lit(1_000_000)).cast("bigint")


def wall_clock(ms: Column, zone: str | Column) -> Column:
    """The wall-clock time in ``zone`` as TIMESTAMP_NTZ."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = F.timestamp_add("MILLISECOND", ms, base)
    zone_col = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(F.lit("UTC"), zone_col, utc)


def local_day(ms: Column, zone: str = "UTC") -> Column:
    if zone == "UTC":
        return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))
    return F.to_date(wall_clock(ms, zone))


def ntz_ms(ts: Column) -> Column:
    """A zone-less timestamp read as UTC, in epoch milliseconds."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", base, ts.cast("timestamp_ntz"))
