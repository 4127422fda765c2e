"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Of an array of doubles: 0 and the sums of its first one, two, ... elements."""
    return F.aggregate(
        numbers,
        F.array(F.lit(0.0)),
        lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)),
    )
