"""Event time, window numbers and time-of-day features, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgelake.schemas import WINDOW_SECONDS


# First and last millisecond of the years 1 to 9999.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def event_time(epoch_ms: Column) -> Column:
    """Time of a number of milliseconds; NULL outside the years 1 to 9999."""
    return F.when(epoch_ms.between(FIRST_MS, LAST_MS), F.timestamp_millis(epoch_ms))


def window_index(ts: Column, seconds: int = WINDOW_SECONDS) -> Column:
    """Number of the tumbling window that holds ``ts``, counted from the epoch."""
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("bigint")


def hour_of_day(window: Column, seconds: int = WINDOW_SECONDS) -> Column:
    """UTC hour at the start of a window, from the window number alone."""
    return F.pmod(F.floor(window * F.lit(seconds) / 3600), F.lit(24)).cast("int")


def hour_sin(hour: Column) -> Column:
    return F.sin(2 * F.pi() * hour / 24)


def hour_cos(hour: Column) -> Column:
    return F.cos(2 * F.pi() * hour / 24)
