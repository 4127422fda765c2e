"""Counts, shares and rates per group.

Every aggregate here has a map-side part, so a group that holds most of the
rows reaches its reducer as one row per task. Statistics over groups are joined
back as a small table or a scalar subquery instead of a window over the groups:
no task ever holds all groups of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.functions.dates import day_gap
from peergauge.functions.rates import (
    case_count,
    count_where,
    is_favourable,
    is_timely,
    pct,
    rounded,
    subject_or_rest,
)
from peergauge.operators.scope import at_least
from peergauge.spec import CaseSpec


def rate_counts(
    rows: DataFrame,
    keys: Sequence[str | Column],
    hits: Mapping[str, Column],
    weight: str | None = None,
) -> DataFrame:
    """Cases per group (``n``) and, per name in ``hits``, the cases the predicate holds for.

    With ``weight`` a row stands for as many cases as that column says, so rows counted
    beforehand, say before a join, give what the raw rows would.
    """
    return rows.groupBy(*keys).agg(
        case_count(weight).alias("n"),
        *[count_where(p, weight).alias(name) for name, p in hits.items()],
    )


def conditional_rate(
    rows: DataFrame,
    keys: Sequence[str | Column],
    predicate: Column,
    rate: str,
    count: str = "n",
    hits: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Group size and percentage of its rows for which the predicate holds.

    The denominator is the whole group: a null predicate counts as a miss.
    """
    counts = rate_counts(rows, keys, {"_hits": predicate}, weight)
    rated = counts.withColumn(rate, pct(F.col("_hits"), F.col("n")))
    rated = rated.withColumnRenamed("_hits", hits) if hits else rated.drop("_hits")
    return rated.withColumnRenamed("n", count)


def favourable_rate(rows: DataFrame, spec: CaseSpec, keys: Sequence[str]) -> DataFrame:
    return conditional_rate(rows, keys, is_favourable(spec), "pct_relief", weight=spec.weight)


def timely_rate(rows: DataFrame, spec: CaseSpec, keys: Sequence[str]) -> DataFrame:
    return conditional_rate(
        rows, keys, is_timely(spec), "pct_timely", count="total", weight=spec.weight
    )


def two_rate_counts(rows: DataFrame, spec: CaseSpec, keys: Sequence[str | Column]) -> DataFrame:
    hits = {"n_timely": is_timely(spec), "n_relief": is_favourable(spec)}
    return rate_counts(rows, keys, hits, spec.weight)


def two_rates(counts: DataFrame) -> DataFrame:
    """Replace the hit counts of ``two_rate_counts`` by percentages."""
    return counts.select(
        *[c for c in counts.columns if c not in ("n_timely", "n_relief")],
        pct(F.col("n_timely"), F.col("n")).alias("pct_timely"),
        pct(F.col("n_relief"), F.col("n")).alias("pct_relief"),
    )


def category_scorecard(core: DataFrame, spec: CaseSpec, category: str) -> DataFrame:
    """Both rates of every large enough entity of one category."""
    one = core.where(F.col(spec.category) == category)
    return two_rates(at_least(two_rate_counts(one, spec, [spec.entity]), spec.min_n))


def pooled_entity_rate(core: DataFrame, spec: CaseSpec) -> DataFrame:
    """Rate per entity across categories. Context only: never a ground for a flag."""
    rated = favourable_rate(core, spec, [spec.entity]).withColumnRenamed(
        "pct_relief", "pct_any_relief"
    )
    return at_least(rated, spec.pooled_min_n)


def pooled_from_counts(counts: DataFrame, spec: CaseSpec) -> DataFrame:
    """Both pooled rates from the finer counts of ``two_rate_counts``."""
    pooled = counts.groupBy(spec.entity).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_timely", "n_relief")]
    )
    return at_least(pooled, spec.pooled_min_n).select(
        spec.entity,
        "n",
        pct(F.col("n_timely"), F.col("n")).alias("pct_any_timely"),
        pct(F.col("n_relief"), F.col("n")).alias("pct_any_relief"),
    )


def share_of_total(rows: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Rows per group and their percentage of all rows."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("n").alias("total"))
    return groups.withColumn("pct", pct(F.col("n"), total.scalar()))


def with_group_stats(groups: DataFrame, keys: Sequence[str], *stats: Column) -> DataFrame:
    """Add to every row statistics of all rows that share its keys, null keys included.

    Same result as window functions over the whole partition, but the
    statistics are aggregated in two steps and joined back. The join broadcasts
    them if their measured size allows it; else it is a shuffled join whose
    large keys adaptive execution splits.
    """
    own, other = groups.alias("own"), groups.groupBy(*keys).agg(*stats).alias("stats")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"own.{key}").eqNullSafe(F.col(f"stats.{key}"))
    added = [c for c in other.columns if c not in keys]
    return own.join(other, same, "left").select("own.*", *[F.col(f"stats.{c}") for c in added])


def share_within(
    rows: DataFrame, within: str, keys: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Cases per (``within``, keys) and their percentage of the ``within`` group."""
    groups = rows.groupBy(within, *keys).agg(case_count(weight).alias("n"))
    shared = with_group_stats(groups, [within], F.sum("n").alias("_total"))
    return shared.withColumn("pct", pct(F.col("n"), F.col("_total"))).drop("_total")


def subject_against_rest(core: DataFrame, spec: CaseSpec, subject: str) -> DataFrame:
    """Outcome shares of one entity next to everybody else's, pooled.

    Confounded by the mix of categories: it shows what comparison not to make.
    """
    labelled = core.select(
        subject_or_rest(spec.entity, subject).alias("grp"),
        spec.outcome,
        *([spec.weight] if spec.weight else []),
    )
    return share_within(labelled, "grp", [spec.outcome], spec.weight)


def lead_time(rows: DataFrame, spec: CaseSpec, keys: Sequence[str]) -> DataFrame:
    """Median, 90th percentile and same-day share of the days from receipt to routing.

    Rows are first counted per (group, day difference); the exact percentiles
    then work on those few weighted values.
    """
    days = day_gap(F.col(spec.received), F.col(spec.routed))
    histogram = rows.groupBy(*keys, days.alias("_days")).agg(F.count(F.lit(1)).alias("_rows"))
    same_day = F.when(F.col("_days") == 0, F.col("_rows")).otherwise(0)
    return (
        histogram.groupBy(*keys)
        .agg(
            F.percentile("_days", [0.5, 0.9], F.col("_rows")).alias("_q"),
            F.sum(same_day).alias("_zero"),
            F.sum("_rows").alias("n"),
        )
        .select(
            *keys,
            F.col("_q")[0].alias("median_route_days"),
            F.col("_q")[1].alias("p90_route_days"),
            pct(F.col("_zero"), F.col("n")).alias("pct_same_day"),
            "n",
        )
    )


def rate_spread(rated: DataFrame, rate: str, group: str) -> DataFrame:
    """Lowest and highest group rate and their ratio; ties go by group name."""
    return (
        rated.where(F.col(rate).isNotNull())
        .agg(
            F.min(F.struct(rate, group)).alias("_low"),
            F.max(F.struct(F.col(rate), F.col(group))).alias("_high"),
            F.count(F.lit(1)).alias("n_groups"),
        )
        .select(
            F.col(f"_low.{group}").alias("lowest"),
            F.col(f"_low.{rate}").alias("lowest_rate"),
            F.col(f"_high.{group}").alias("highest"),
            F.col(f"_high.{rate}").alias("highest_rate"),
            rounded(F.try_divide(F.col(f"_high.{rate}"), F.col(f"_low.{rate}")), 1).alias("spread"),
            "n_groups",
        )
    )
