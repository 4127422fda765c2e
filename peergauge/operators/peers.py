"""The within-category comparison and its acceptance checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.functions.dates import period_start
from peergauge.functions.rates import rounded
from peergauge.operators.rates import (
    pooled_from_counts,
    two_rate_counts,
    two_rates,
    with_group_stats,
)
from peergauge.operators.scope import at_least
from peergauge.spec import STDDEV, CaseSpec

# What the review column says.
NO_PEERS = "NO PEER SET - not comparable"
FLAGGED = "FLAG - bottom quartile in category"
FLAGGED_STDDEV = "FLAG - far below category median"
OK = "ok"


def entity_rates(core: DataFrame, spec: CaseSpec, period: str | None = None) -> DataFrame:
    """Both rates of every (category, entity) pair of ``min_n`` cases or more."""
    return two_rates(at_least(_pair_counts(core, spec, period), spec.min_n))


def _pair_counts(core: DataFrame, spec: CaseSpec, period: str | None) -> DataFrame:
    keys: list[str | Column] = [spec.category, spec.entity]
    if period:
        keys.insert(0, period_start(F.col(spec.received), period).alias(period))
    return two_rate_counts(core, spec, keys)


def compare_with_peers(rates: DataFrame, spec: CaseSpec, category: Sequence[str]) -> DataFrame:
    """Deviation from the category median, and the review flag.

    ``rates`` has one row per entity and category. The rates are compared as
    rounded, and strictly, so that a mass of equal rates flags nobody.
    """
    stats = [
        F.count(F.lit(1)).alias("peer_count"),
        F.percentile("pct_relief", [0.25, 0.5]).alias("_relief"),
        F.percentile("pct_timely", [0.25, 0.5]).alias("_timely"),
    ]
    if spec.flag_rule == STDDEV:
        stats += [
            F.stddev_samp("pct_relief").alias("_sd_relief"),
            F.stddev_samp("pct_timely").alias("_sd_timely"),
        ]
    return with_group_stats(rates, category, *stats).select(
        *category,
        spec.entity,
        "n",
        "peer_count",
        "pct_relief",
        F.col("_relief")[1].alias("cat_median_relief"),
        rounded(F.col("pct_relief") - F.col("_relief")[1], 1).alias("relief_deviation"),
        "pct_timely",
        F.col("_timely")[1].alias("cat_median_timely"),
        rounded(F.col("pct_timely") - F.col("_timely")[1], 1).alias("timely_deviation"),
        _review_flag(spec).alias("review_flag"),
    )


def _review_flag(spec: CaseSpec) -> Column:
    if spec.flag_rule == STDDEV:
        low, label = (
            lambda m: F.col(f"_{m}")[1] - F.lit(spec.flag_stddevs) * F.col(f"_sd_{m}"),
            FLAGGED_STDDEV,
        )
    else:
        low, label = (lambda m: F.col(f"_{m}")[0]), FLAGGED
    below = (F.col("pct_relief") < low("relief")) | (F.col("pct_timely") < low("timely"))
    return F.when(F.col("peer_count") < 2, NO_PEERS).when(below, label).otherwise(OK)


def within_category_deviation(
    core: DataFrame, spec: CaseSpec, period: str | None = None
) -> DataFrame:
    """Score every large enough entity against the peers of its category.

    With ``period`` (such as ``"quarter"``) both the size threshold and the
    peer set are taken per category and period.
    """
    category = ([period] if period else []) + [spec.category]
    return compare_with_peers(entity_rates(core, spec, period), spec, category)


def stratified_next_to_naive(core: DataFrame, spec: CaseSpec) -> DataFrame:
    """The scorecard with the pooled rates of each entity beside it.

    Both come from one count per (category, entity), and use all of it, so
    that one scan and one shuffle of the raw rows serve both.
    """
    counts = _pair_counts(core, spec, None)
    card = compare_with_peers(two_rates(at_least(counts, spec.min_n)), spec, [spec.category])
    pooled = pooled_from_counts(counts, spec).withColumnRenamed("n", "pooled_n")
    return card.alias("c").join(
        pooled.alias("p"), F.col(f"c.{spec.entity}").eqNullSafe(F.col(f"p.{spec.entity}")), "left"
    ).select("c.*", "p.pooled_n", "p.pct_any_timely", "p.pct_any_relief")


def acceptance_checks(card: DataFrame, spec: CaseSpec) -> DataFrame:
    """One row per rule of a valid scorecard, with the number of rows that break it."""
    flagged = F.col("review_flag").startswith("FLAG")
    broken = {
        "category_excluded": F.col(spec.category).isin(*spec.excluded_categories),
        "flag_without_peer_median": flagged
        & (F.col("cat_median_relief").isNull() | F.col("cat_median_timely").isNull()),
        "flag_above_both_medians": flagged
        & (F.col("pct_relief") >= F.col("cat_median_relief"))
        & (F.col("pct_timely") >= F.col("cat_median_timely")),
        "flag_without_peers": flagged & (F.col("peer_count") < 2),
        "group_below_minimum": F.coalesce(F.col("n") < spec.min_n, F.lit(True)),
        "no_peers_but_judged": (F.col("peer_count") < 2) & (F.col("review_flag") != NO_PEERS),
    }
    counts = card.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        *[F.count_if(rule).alias(name) for name, rule in broken.items()],
    )
    found = [F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in broken]
    return counts.select(F.inline(F.array(*found)), "rows_checked")
