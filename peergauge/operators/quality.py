"""Checks to run on a case table before trusting any rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergauge.functions.dates import epoch_second, moment, period_start
from peergauge.functions.rates import pct, rounded
from peergauge.operators.rates import conditional_rate
from peergauge.operators.scope import at_least, top_k
from peergauge.operators.slices import WEEK, rows_per_month, rows_per_slice
from peergauge.spec import CaseSpec

# Fixed value: the most rows one slice of the source can return.
SLICE_CEILING = 10_000

# A cluster is larger than this, and so many of them are shown.
BURST_SIZE = 20
BURST_ROWS = 20


def coverage(cases: DataFrame, spec: CaseSpec) -> DataFrame:
    """Date range that landed, rows, distinct ids."""
    return cases.agg(
        F.min(spec.received).alias("earliest"),
        F.max(spec.received).alias("latest"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct(spec.case_id).alias("distinct_ids"),
    )


def volume_by_period(rows: DataFrame, ts: str, unit: str = "month") -> DataFrame:
    return rows.groupBy(period_start(F.col(ts), unit).alias(unit)).agg(F.count(F.lit(1)).alias("n"))


def null_counts(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row; per output name the nulls of its column, all in one pass."""
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(name) for name, c in columns.items()])


def _named(column: str) -> Column:
    """The column of this name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def populated_pct(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows with a value, and their percentage."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(_named(c)).alias(f"_{i}") for i, c in enumerate(columns)],
    )
    facts = [
        F.struct(F.lit(c).alias("field"), F.col(f"_{i}").alias("populated"))
        for i, c in enumerate(columns)
    ]
    long = counts.select("_rows", F.inline(F.array(*facts)))
    return long.select(
        "field", "populated", pct(F.col("populated"), F.col("_rows")).alias("pct_populated")
    )


def dead_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: is it null throughout, or does it hold a single value?"""
    probes = [F.count(F.lit(1)).alias("_rows")]
    facts = []
    for i, c in enumerate(columns):
        probes += [
            F.count(_named(c)).alias(f"_{i}_count"),
            (F.min(_named(c)) == F.max(_named(c))).alias(f"_{i}_single"),
        ]
        single = F.coalesce(f"_{i}_single", F.lit(False))
        facts.append(
            F.struct(
                F.lit(c).alias("field"),
                F.col(f"_{i}_count").alias("populated"),
                single.alias("constant"),
            )
        )
    return (
        rows.agg(*probes)
        .select("_rows", F.inline(F.array(*facts)))
        .select(
            "field",
            "populated",
            ((F.col("_rows") > 0) & (F.col("populated") == 0)).alias("dead"),
            "constant",
        )
    )


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return at_least(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), 2)


def duplicate_key_count(rows: DataFrame, key: str) -> DataFrame:
    return duplicate_keys(rows, key).agg(F.count(F.lit(1)).alias("duplicate_id_count"))


def burst_clusters(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    more_than: int = BURST_SIZE,
    show: int = BURST_ROWS,
    grain: str | None = None,
) -> DataFrame:
    """Groups alike in all keys and in time, larger than ``more_than``; the ``show`` largest.

    Times are equal to the last digit unless ``grain`` names a period.
    """
    time = period_start(F.col(ts), grain) if grain else F.col(ts)
    groups = rows.groupBy(*keys, time.alias(ts)).agg(F.count(F.lit(1)).alias("n"))
    return top_k(at_least(groups, more_than + 1), show, "n", [*keys, ts])


def sliding_bursts(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    seconds: int,
    more_than: int = BURST_SIZE,
    show: int = BURST_ROWS,
    buckets: int = 8,
) -> DataFrame:
    """Windows of ``seconds`` in which rows alike in all keys are more than ``more_than``.

    A window ends at each second that has a row. Returns the keys, window_from and window_to (both
    inclusive), and ``n``; the ``show`` largest, ties by keys and time. Rows without a time are left out.

    Rows are counted per second first. Time is cut into buckets of ``buckets`` windows, and the end of
    each bucket is also given to the next one: so keys that hold most of the rows are many small
    groups, none with more counts than a bucket and a window have seconds. What a window holds is
    what there is up to its end, less what there is before its start: both are running totals, so
    a group costs as much as it has counts, however many of them a window spans.
    """
    counts = (
        rows.where(F.col(ts).isNotNull())
        .groupBy(*keys, epoch_second(F.col(ts)).alias("_second"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    width = buckets * seconds
    own = F.floor(F.col("_second") / width)
    reaches_on = F.pmod(F.col("_second"), F.lit(width)) > width - seconds
    places = F.when(reaches_on, F.array(own, own + 1)).otherwise(F.array(own))
    window = Window.partitionBy(*keys, "_bucket").orderBy("_second")
    until = F.sum("_rows").over(window.rangeBetween(Window.unboundedPreceding, 0))
    before = F.sum("_rows").over(window.rangeBetween(Window.unboundedPreceding, -seconds))
    counted = (
        counts.withColumn("_bucket", F.explode(places))
        .withColumn("n", until - F.coalesce(before, F.lit(0)))
        .where(own == F.col("_bucket"))
    )
    found = at_least(counted, more_than + 1).select(
        *keys,
        moment(F.col("_second") - (seconds - 1)).alias("window_from"),
        moment(F.col("_second")).alias("window_to"),
        "n",
    )
    return top_k(found, show, "n", [*keys, "window_to"])


def text_share(rows: DataFrame, spec: CaseSpec, keys: Sequence[str]) -> DataFrame:
    """Rows per group, rows with free text among them, and the percentage."""
    return conditional_rate(
        rows,
        keys,
        F.col(spec.has_text),
        "pct_with_narrative",
        "total",
        "with_narrative",
        spec.weight,
    )


def first_last_seen(rows: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n")
    )


def category_cutover(
    rows: DataFrame, keys: Sequence[str], ts: str, margin_days: int = 31
) -> DataFrame:
    """Categories that begin or end inside the window instead of spanning it.

    The window is the range of all rows; ``margin_days`` is how far from its
    edges a first or last row may lie. ``ending`` tells of a category that ends
    inside the window whether it is cut off or tapers: it tapers if the calendar
    month before its last one has less than half of its median month. One that
    has no such month is cut off. Rows without a time count in ``n`` only.
    """
    month = period_start(F.col(ts), "month")
    months = first_last_seen(rows.withColumn("_month", month), [*keys, "_month"], ts)
    dated = F.when(F.col("_month").isNotNull(), F.struct("_month", "n"))
    # Always true; keeps the window's range a matter of the groups, not of the raw rows.
    seen = (
        months.groupBy(*keys)
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.sum("n").alias("n"),
            # As many as the category has months.
            F.collect_list(dated).alias("_months"),
            F.median(F.when(F.col("_month").isNotNull(), F.col("n"))).alias("_usual"),
        )
        .where("n > 0")
    )
    edges = F.struct(F.min("first_seen").alias("opens"), F.max("last_seen").alias("closes"))
    window = seen.agg(edges.alias("window")).scalar()
    late = F.datediff("first_seen", window.getField("opens")) > margin_days
    early = F.datediff(window.getField("closes"), "last_seen") > margin_days
    before = F.add_months(F.trunc("last_seen", "month"), -1).cast("timestamp_ntz")
    at = F.filter("_months", lambda m: m["_month"] == before)
    there = F.coalesce(F.get(at, F.lit(0))["n"], F.lit(0))
    full = F.when(before >= F.trunc("first_seen", "month"), there)
    tapers = F.coalesce(full < F.col("_usual") / 2, F.lit(False))
    return seen.withColumns(
        {
            "drift": F.when(late & early, "appears and disappears")
            .when(late, "appears mid-window")
            .when(early, "disappears mid-window")
            .otherwise("spans window"),
            "ending": F.when(early, F.when(tapers, "tapers").otherwise("cut off")),
        }
    ).drop("_months", "_usual")


def volume_gaps(
    rows: DataFrame, ts: str, low_ratio: float = 0.5, slice_days: int | None = None
) -> DataFrame:
    """Months (or slices of ``slice_days``) without rows, or with far fewer than the median."""
    if slice_days:
        period, counts = "slice_from", rows_per_slice(rows, ts, slice_days)
    else:
        period, counts = "month", rows_per_month(rows, ts)
    median = counts.agg(F.median("n").alias("m"))
    ratio = F.try_divide(F.col("n"), median.scalar())
    return counts.select(
        period,
        "n",
        rounded(ratio, 2).alias("ratio_to_median"),
        F.when(F.col("n") == 0, "missing")
        .when(ratio < low_ratio, "low")
        .otherwise("ok")
        .alias("volume"),
    )


def capped_slices(
    rows: DataFrame, ts: str, ceiling: int = SLICE_CEILING, days: int = WEEK
) -> DataFrame:
    """Rows per slice; a slice that reaches the source's ceiling is undercounted."""
    return rows_per_slice(rows, ts, days).withColumn("capped", F.col("n") >= ceiling)


def mark_provisional(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """Mark the rows of the last ``days`` days, which later pulls may still add to."""
    latest = rows.agg(F.max(ts).alias("latest")).scalar()
    recent: Column = F.col(ts) > latest - F.make_dt_interval(F.lit(days))
    return rows.withColumn("provisional", F.coalesce(recent, F.lit(False)))


def scope_violations(rows: DataFrame, column: str, allowed: str) -> DataFrame:
    """Rows per value other than the one the pull was meant for."""
    return (
        rows.where(F.col(column) != allowed).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    )
