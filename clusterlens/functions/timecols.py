"""Epoch conversions of wall-clock (``timestamp_ntz``) columns that do not
depend on the session time zone: the time since 1970-01-01 00:00:00 as a
wall-clock difference (the stored values are read as UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch_start() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch_start(), ts)


def epoch_millis(ts: Column) -> Column:
    """Milliseconds, floored."""
    return F.floor(epoch_micros(ts) / 1000).cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    """Seconds, floored."""
    return F.floor(epoch_micros(ts) / 1000000).cast("bigint")
