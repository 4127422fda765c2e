"""Exact quantiles of measures with many distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.session import write_shared

# Values of a group that are sorted in one place, and parts that a range is cut into.
HELD = 4096
CELLS = 1024


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Sequence[float],
    held: int = HELD,
    cells: int = CELLS,
) -> DataFrame:
    """keys, ``n`` and a column p50, p90, ... per point: what ``percentile`` gives, to the last bit.

    ``percentile`` keeps every distinct value of a group in one task. Here each wanted rank is
    narrowed down: the range it lies in is cut into cells, the cells are counted in every task, and
    the one that holds the rank is the next range, until it has ``held`` values or fewer, or a single
    one. Only those are brought together and sorted. A round reads the rows once; few rounds are
    needed unless values cluster at very different scales. Nulls are left out, a group without
    values has no row, and values that are not finite fail.
    """
    number = F.col(value).cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    checked = F.when(finite, number).otherwise(F.raise_error(F.lit(f"{value} is not finite")))
    given = rows.where(F.col(value).isNotNull()).select(
        F.struct(*keys).alias("key"), checked.cast("double").alias("v")
    )
    sizes = given.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    positions = [(F.col("n") - 1) * F.lit(float(p)) for p in points]
    ranks = F.array_distinct(
        F.array(*(f(at).cast("long") for at in positions for f in (F.floor, F.ceil)))
    )
    # ``below`` values lie under the range, ``inside`` in it.
    search = sizes.select(
        "key",
        "n",
        F.explode(ranks).alias("rank"),
        "low",
        "high",
        F.lit(0).cast("long").alias("below"),
        F.col("n").alias("inside"),
    )
    search = write_shared(search, "ranks")
    wide = (F.col("inside") > held) & (F.col("low") < F.col("high"))
    while not search.where(wide).isEmpty():
        counted = write_shared(_cells(given, _ranges(search.where(wide)), cells), "cells")
        narrowed = search.where(wide).join(counted, ["key", "low", "high", "below"])
        found = _cell_of(F.col("cells"), F.col("rank") - F.col("below"))
        narrowed = narrowed.select("key", "n", "rank", "below", found.alias("found")).select(
            "key",
            "n",
            "rank",
            F.col("found.cell.low").alias("low"),
            F.col("found.cell.high").alias("high"),
            (F.col("below") + F.col("found.before")).alias("below"),
            F.col("found.cell.n").alias("inside"),
        )
        search = write_shared(search.where(~wide).unionByName(narrowed), "ranks")
    ranges = _ranges(search.where("low < high"))
    sorted_values = (
        _inside(given, ranges)
        .groupBy("key", "low", "high", "below")
        .agg(F.sort_array(F.collect_list("v")).alias("values"))
    )
    single = search.where("low = high").select("key", "n", "rank", F.col("low").alias("v"))
    several = search.join(sorted_values, ["key", "low", "high", "below"]).select(
        "key", "n", "rank", F.get("values", (F.col("rank") - F.col("below")).cast("int")).alias("v")
    )
    # Two ranks per point at most.
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("by_rank")
    found = single.unionByName(several).groupBy("key", "n").agg(by_rank)
    named = [_between(at).alias(f"p{100 * p:g}") for p, at in zip(points, positions, strict=True)]
    return found.select(*(F.col("key").getField(k).alias(k) for k in keys), "n", *named)


def _ranges(search: DataFrame) -> DataFrame:
    return search.select("key", "low", "high", "below").distinct()


def _inside(given: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of each range, with it."""
    named = ranges.withColumnRenamed("key", "of")
    inside = F.col("key").eqNullSafe(F.col("of")) & F.col("v").between(F.col("low"), F.col("high"))
    return given.join(named, inside).drop("of")


def _cells(given: DataFrame, ranges: DataFrame, cells: int) -> DataFrame:
    """Per range an array of its cells that hold values: number, first and last value, count."""
    # Halved, so that no difference of doubles overflows.
    low, high = F.col("low") / 2, F.col("high") / 2
    share = (F.col("v") / 2 - low) / (high - low)
    cell = F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")
    counted = (
        _inside(given, ranges)
        .groupBy("key", "low", "high", "below", cell.alias("cell"))
        .agg(
            F.min("v").alias("first"), F.max("v").alias("last"), F.count(F.lit(1)).alias("n")
        )
    )
    entry = F.struct("cell", F.col("first").alias("low"), F.col("last").alias("high"), "n")
    return counted.groupBy("key", "low", "high", "below").agg(
        F.sort_array(F.collect_list(entry)).alias("cells")
    )


def _cell_of(cells: Column, rank: Column) -> Column:
    """The cell with the value of this rank (from 0), and the values ``before`` it."""
    none = F.lit(None).cast("struct<cell:int,low:double,high:double,n:bigint>")
    start = F.struct(F.lit(0).cast("long").alias("before"), none.alias("cell"))

    def step(state: Column, x: Column) -> Column:
        here = state["before"] + x["n"] > rank
        return (
            F.when(state["cell"].isNotNull(), state)
            .when(here, F.struct(state["before"].alias("before"), x.alias("cell")))
            .otherwise(
                F.struct((state["before"] + x["n"]).alias("before"), state["cell"].alias("cell"))
            )
        )

    return F.aggregate(cells, start, step)


def _between(at: Column) -> Column:
    """The value at a position between two ranks, on the straight line between theirs."""
    low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
    a, b = F.element_at("by_rank", low), F.element_at("by_rank", high)
    return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)
