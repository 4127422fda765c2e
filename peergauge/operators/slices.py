"""Calendar spines built from the data's own date range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.functions.dates import period_start, slice_start
from peergauge.session import write_shared

WEEK = 7
DAY_SECONDS = 86_400
SPLIT, WHOLE = "cannot be split", "ok"


def date_range(rows: DataFrame, ts: str) -> DataFrame:
    """One row: first and last day that occur."""
    day = F.col(ts).cast("date")
    return rows.agg(F.min(day).alias("date_from"), F.max(day).alias("date_to"))


def window_slices(bounds: DataFrame, days: int = WEEK) -> DataFrame:
    """Contiguous slices of an inclusive date range, the last one clipped.

    ``bounds`` holds one row (``date_from``, ``date_to``).
    """
    # An interval of calendar days: one of hours would drift where clocks change.
    step = F.make_interval(days=F.lit(days))
    return bounds.where("date_from <= date_to").select(
        F.explode(F.sequence("date_from", "date_to", step)).alias("slice_from"), "date_to"
    ).select(
        "slice_from",
        F.least(F.date_add("slice_from", days - 1), F.col("date_to")).alias("slice_to"),
    )


def rows_per_slice(rows: DataFrame, ts: str, days: int = WEEK) -> DataFrame:
    """Rows in each slice of the data's range; empty slices show 0.

    The rows are read once, into counts per day; range and slices follow from those.
    """
    daily = _counts(rows, F.col(ts).cast("date"), "day")
    bounds = date_range(daily, "day")
    start = slice_start(F.col("day"), bounds.select("date_from").scalar(), days)
    # Never null; saying so spares the join a null test that would set the scans apart.
    start = F.coalesce(start, F.lit("0001-01-01").cast("date"))
    counts = daily.groupBy(start.alias("slice_from")).agg(F.sum("n").alias("n"))
    return _on_spine(window_slices(bounds, days), counts, "slice_from")


def pull_plan(rows: DataFrame, ts: str, ceiling: int, days: int = WEEK) -> DataFrame:
    """Slices of time, each with fewer rows than the source can return, that cover the data's days.

    Slices of ``days`` that reach the ceiling are cut in two halves of time, again and again. Returns
    slice_from and slice_to (both inclusive, to the second), ``n`` and ``status``: a single second
    that reaches the ceiling cannot be split. Rows without a time are left out, and without any
    there is no slice.

    Rows are counted per second once; after that only the seconds of slices over the ceiling go on,
    and their number of rounds is bounded by the length of a slice.
    """
    day = F.col(ts).cast("date")
    second = _seconds(day) + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    moments = write_shared(_counts(rows, second.cast("bigint"), "t"), "moments")
    epoch = F.lit("1970-01-01").cast("date")
    days_seen = moments.select(F.date_add(epoch, F.floor(F.col("t") / DAY_SECONDS).cast("int")).alias("day"))
    spine = write_shared(window_slices(date_range(days_seen, "day"), days), "slices").select(
        _seconds(F.col("slice_from")).alias("low"),
        (_seconds(F.col("slice_to")) + DAY_SECONDS - 1).alias("high"),
    )
    first_day = date_range(days_seen, "day").select(_seconds(F.col("date_from"))).scalar()
    length = days * DAY_SECONDS
    low = F.col("t") - F.pmod(F.col("t") - first_day, F.lit(length))
    placed = moments.select("t", "n", F.coalesce(low, F.lit(0)).alias("low"))
    found = []
    while True:
        totals = placed.groupBy("low").agg(F.sum("n").alias("n"))
        counted = spine.join(totals, "low", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        counted = write_shared(counted, "pull-plan")
        over = (F.col("n") >= ceiling) & (F.col("low") < F.col("high"))
        found.append(counted.where(~over))
        capped = counted.where(over).select(
            "low", "high", F.floor((F.col("low") + F.col("high")) / 2).alias("middle")
        )
        if capped.isEmpty():
            break
        spine = capped.select(
            F.inline(
                F.array(
                    F.struct("low", F.col("middle").alias("high")),
                    F.struct((F.col("middle") + 1).alias("low"), "high"),
                )
            )
        )
        half = F.when(F.col("t") <= F.col("middle"), F.col("low")).otherwise(F.col("middle") + 1)
        placed = placed.join(capped, "low").select("t", "n", half.alias("low"))
        placed = write_shared(placed, "moments")
    plan = reduce(DataFrame.unionByName, found)
    return plan.select(
        _moment(F.col("low")).alias("slice_from"),
        _moment(F.col("high")).alias("slice_to"),
        F.col("n").cast("bigint").alias("n"),
        F.when(F.col("n") >= ceiling, SPLIT).otherwise(WHOLE).alias("status"),
    )


def _seconds(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_SECONDS


def _moment(second: Column) -> Column:
    """The zoneless time so many seconds after 1970 began."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=second.cast("decimal(18,6)"))


def rows_per_month(rows: DataFrame, ts: str) -> DataFrame:
    """Rows in every month of the data's range; empty months show 0."""
    monthly = _counts(rows, period_start(F.col(ts), "month").cast("date"), "month")
    return _on_spine(month_spine(monthly, "month"), monthly, "month").withColumn(
        "month", F.col("month").cast("timestamp_ntz")
    )


def month_spine(rows: DataFrame, ts: str) -> DataFrame:
    """First day of every calendar month from the first to the last that occurs."""
    first, last = F.trunc("date_from", "month"), F.trunc("date_to", "month")
    one_month = F.make_ym_interval(F.lit(0), F.lit(1))
    bounds = date_range(rows, ts).where("date_from IS NOT NULL")
    return bounds.select(F.explode(F.sequence(first, last, one_month)).alias("month"))


def _counts(rows: DataFrame, period: Column, name: str) -> DataFrame:
    """Rows per period.

    The test of ``n`` is always true. It keeps the optimizer from computing the
    range of the periods from the raw rows, which would read those again.
    """
    known = rows.select(period.alias(name)).where(F.col(name).isNotNull())
    return known.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 0")


def _on_spine(spine: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    joined = spine.join(counts, key, "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
