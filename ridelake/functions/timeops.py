"""Time expressions. 'Now' is always the caller's ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelake.schema import PEAK_HOURS


def as_timestamp(value: dt.datetime | dt.date | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def as_date(value: dt.date | str) -> Column:
    return F.lit(str(value)).cast("date")


def minutes_between(start: Column, end: Column) -> Column:
    """Whole elapsed minutes, truncated toward zero, whatever the session zone."""
    return (end - start).cast("interval minute").cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    return (end - start).cast("interval second").cast("bigint")


def is_peak(ts: Column, tz: str = "UTC") -> Column:
    """Whether a zone-less UTC time falls in a surge hour of zone ``tz``."""
    local = ts if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)
    return F.hour(local).isin(*PEAK_HOURS)


def between_days(ts: Column, start=None, end=None, end_inclusive: bool = True) -> Column | None:
    """Date-range test on a timestamp, as plain comparisons that reach the parquet scan.

    ``end_inclusive=True`` keeps the whole last day; ``False`` stops at its midnight.
    """
    tests = []
    if start is not None:
        tests.append(ts >= as_timestamp(start))
    if end is not None:
        last = as_timestamp(end)
        tests.append(ts < last + F.expr("INTERVAL 1 DAY") if end_inclusive else ts <= last)
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]
