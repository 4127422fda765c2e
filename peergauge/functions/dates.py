"""Calendar arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month", "quarter", "year")


def period_start(ts: Column, unit: str) -> Column:
    """First instant of the period ``ts`` falls in, as a zoneless timestamp.

    ``date_trunc`` would turn the value into a zoned timestamp; truncating the
    date keeps it zoneless.
    """
    if unit not in PERIODS:
        raise ValueError(f"unknown period {unit!r}")
    day = ts.cast("date")
    return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")


def day_gap(start: Column, end: Column) -> Column:
    """Midnights crossed between the two instants (not full 24-hour spans)."""
    return F.datediff(end, start).cast("bigint")


def slice_start(ts: Column, first_day: Column, days: int) -> Column:
    """First day of the fixed-length slice ``ts`` falls in, counted from ``first_day``."""
    day = ts.cast("date")
    return F.date_sub(day, F.pmod(F.datediff(day, first_day), F.lit(days)))


def epoch_second(ts: Column) -> Column:
    """Whole seconds from the beginning of 1970 to a zoneless time or a day."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def moment(second: Column) -> Column:
    """The zoneless time so many seconds after the beginning of 1970."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=second.cast("decimal(18,6)"))
