"""Predicates and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peergauge.spec import CaseSpec


def case_count(weight: str | None = None) -> Column:
    """Cases in a group: its rows, or the sum of what its rows stand for (null: none)."""
    return F.coalesce(F.sum(weight), F.lit(0)) if weight else F.count(F.lit(1))


def count_where(predicate: Column, weight: str | None = None) -> Column:
    """Cases for which the predicate is true; null counts as not true."""
    if not weight:
        return F.count_if(predicate)
    return F.coalesce(F.sum(F.when(predicate, F.col(weight))), F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """A double to so many decimals, as ``round(value * 10^digits) / 10^digits``.

    The built-in rounds the shortest decimal form of the value, which takes
    differences such as 75.0 - 46.45 the other way than most SQL engines do.
    """
    scale = F.lit(10.0**digits)
    return F.round(value * scale, 0) / scale


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """Rounded percentage as a double; null if there is nothing to divide by."""
    return rounded(F.try_divide(F.lit(100.0) * part, whole), digits)


def is_favourable(spec: CaseSpec) -> Column:
    return F.col(spec.outcome).isin(*spec.favourable)


def is_timely(spec: CaseSpec) -> Column:
    return F.col(spec.timely) == F.lit(spec.timely_value)


def subject_or_rest(column: str, subject: str, rest: str = "all others") -> Column:
    """The subject's own name, and one name for everybody else, nulls included."""
    return F.when(F.col(column) == F.lit(subject), F.lit(subject)).otherwise(F.lit(rest))
