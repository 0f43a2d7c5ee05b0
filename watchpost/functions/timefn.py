"""Calendar functions: weekly buckets, roster windows, clock correction."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of_week(ts) -> Column:
    """0..167 with Monday 00:00 = 0."""
    return (F.weekday(ts) * 24 + F.hour(ts)).cast("int")


def minute_of_day(ts) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def local_time(ts, zone) -> Column:
    """UTC event time to the wall clock of the post that wrote the roster."""
    return F.from_utc_timestamp(ts, zone)


def _circular(a, b) -> Column:
    d = F.abs(a - b)
    return F.least(d, 1440 - d)


def minutes_outside(ts, days, start, end) -> Column:
    """0 inside the weekly window, else minutes to its nearer end.

    ``days`` is an array of weekday numbers (Monday 0); empty means every day.
    A window whose end is before its start runs past midnight and still covers
    the early minutes of the next day.  A weekday that does not match at all is
    infinitely far away.
    """
    minute, weekday = minute_of_day(ts), F.weekday(ts)
    wraps = end < start
    inside = F.when(wraps, (minute >= start) | (minute <= end)).otherwise(minute.between(start, end))
    spill = wraps & F.array_contains(days, F.pmod(weekday - 1, F.lit(7)).cast("int")) & (minute <= end)
    day_ok = (F.size(days) == 0) | F.array_contains(days, weekday.cast("int")) | spill
    gap = F.least(_circular(minute, start), _circular(minute, end)).cast("double")
    return F.when(~day_ok, F.lit(float("inf"))).when(inside, 0.0).otherwise(gap)


def window_occurrence(patrol_id, ts, start, end) -> Column:
    """Key of one occurrence of a window; past midnight it keeps its start day."""
    early = (end < start) & (minute_of_day(ts) <= end)
    day = F.when(early, F.date_sub(F.to_date(ts), 1)).otherwise(F.to_date(ts))
    return F.concat_ws(":", patrol_id, day.cast("string"), start.cast("string"))


def is_night_hour(ts, start: int, end: int) -> Column:
    return (F.hour(ts) >= start) | (F.hour(ts) < end)


def clock_drift_s(received_us, sent_us) -> Column:
    return (received_us - sent_us) / 1e6


def drifted(drift_s, trusted, tolerance: float) -> Column:
    return (F.abs(drift_s) > tolerance) | ~trusted


def corrected_us(node_us, drift_us, is_drifted) -> Column:
    return F.when(is_drifted, node_us + drift_us).otherwise(node_us)
