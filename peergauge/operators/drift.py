"""Changes over time: categories that go on under another name, and steps in volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.functions.arrays import let, running_sums
from peergauge.functions.rates import rounded
from peergauge.session import write_shared


def category_successors(
    rows: DataFrame,
    category: str,
    feature: str,
    ts: str,
    margin_days: int = 31,
    gap_days: int = 31,
    least_overlap: float = 0.5,
) -> DataFrame:
    """Categories that end inside the window, each with the one that seems to carry it on.

    A category's profile is the share of its rows per feature value. Two profiles overlap by the sum
    of the smaller shares. An ended category is matched with one that begins within ``gap_days`` of
    its end if they overlap by ``least_overlap`` or more and each is the other's best match; ties go
    by name. Rows without category, feature or time are left out. Returns ended, last_seen, begun,
    first_seen and overlap, to six decimals.

    Not all pairs are compared. Of an ended category only the features of largest share are looked
    up: so many that the others together fall short of the overlap asked for, so that a pair which
    shares none of them cannot reach it. Shares are classed by powers of two for that, which takes a
    few counters per category.
    """
    known = rows.where(F.col(category).isNotNull() & F.col(feature).isNotNull() & F.col(ts).isNotNull())
    counts = known.groupBy(F.col(category).alias("c"), F.col(feature).alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    counts = write_shared(counts, "profile-counts")
    seen = write_shared(
        counts.groupBy("c").agg(
            F.sum("n").alias("total"), F.min("first").alias("first"), F.max("last").alias("last")
        ),
        "categories",
    )
    edges = seen.agg(F.struct(F.min("first").alias("opens"), F.max("last").alias("closes")).alias("w"))
    window = edges.scalar()
    ended = seen.where(F.datediff(window.getField("closes"), "last") > margin_days)
    begun = seen.where(F.datediff("first", window.getField("opens")) > margin_days)
    profiles = write_shared(
        counts.join(seen.select("c", "total"), "c").select(
            "c", "f", (F.col("n") / F.col("total")).alias("share")
        ),
        "profiles",
    )
    old = profiles.join(ended.select("c", "last"), "c").select(
        F.col("c").alias("ended"), "f", F.col("share").alias("old_share"), "last"
    )
    new = profiles.join(begun.select("c", "first"), "c").select(
        F.col("c").alias("begun"), "f", F.col("share").alias("new_share"), "first"
    )
    near = F.abs(F.datediff("first", "last")) <= gap_days
    posted = _largest_shares(old, least_overlap)
    candidates = (
        posted.join(new, "f")
        .where(near & (F.col("ended") != F.col("begun")))
        .select("ended", "begun")
        .distinct()
    )
    shared = write_shared(candidates, "candidates").join(old, "ended").join(new, ["begun", "f"])
    overlap = F.round(F.sum(F.least("old_share", "new_share")), 6)
    pairs = shared.groupBy("ended", "begun", "last", "first").agg(overlap.alias("overlap"))
    pairs = write_shared(pairs.where(F.col("overlap") >= least_overlap), "overlaps")

    def best(of: str, other: str) -> DataFrame:
        first = F.min(F.struct((-F.col("overlap")).alias("o"), F.col(other).alias("name")))
        return pairs.groupBy(of).agg(first.getField("name").alias(other))

    mutual = best("ended", "begun").join(best("begun", "ended"), ["ended", "begun"])
    return pairs.join(mutual, ["ended", "begun"]).select(
        "ended", F.col("last").alias("last_seen"), "begun", F.col("first").alias("first_seen"), "overlap"
    )


def _largest_shares(profiles: DataFrame, least: float) -> DataFrame:
    """The features of each category but the smallest, whose shares sum to less than ``least``."""
    size = F.floor(-F.log2("old_share")).cast("int")
    classed = profiles.withColumn("size", size)
    masses = classed.groupBy("ended", "size").agg(F.sum("old_share").alias("mass"))
    # At most as many classes as a double has powers of two.
    of_category = masses.groupBy("ended").agg(F.collect_list(F.struct("size", "mass")).alias("m"))

    def smaller(x: Column) -> Column:
        below = F.filter("m", lambda y: y["size"] > x["size"])
        return F.aggregate(below, F.lit(0.0), lambda total, y: total + y["mass"])

    # A hair below, for sums of doubles.
    enough = F.filter("m", lambda x: smaller(x) < least - 1e-9)
    last = F.array_min(F.transform(enough, lambda x: x["size"])).alias("last_size")
    kept = classed.join(of_category.select("ended", last), "ended")
    return kept.where(F.col("size") <= F.col("last_size")).select("ended", "f", "last")


def volume_segments(
    rows: DataFrame, category: str, ts: str, penalty: float = 3.0
) -> DataFrame:
    """Stretches of months in which a category's volume is steady, and so the months where it steps.

    The months of the whole table, empty ones included, are cut into the segments with the least
    sum of squared deviations from their means plus a charge per segment: ``penalty`` times the
    category's mean month times the logarithm of the number of months. The optimum is exact, found
    by dynamic programming over running sums; of equal ones the earliest cut. Rows without a category
    or a time are left out. Returns category, segment (from 1), month_from, month_to, n_months and
    mean_n, to two decimals.

    A category is one row with an array of its months, whatever its number of cases.
    """
    month = F.trunc(F.col(ts).cast("date"), "month")
    known = rows.where(F.col(category).isNotNull() & F.col(ts).isNotNull())
    counts = known.groupBy(F.col(category), month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    counts = write_shared(counts, "monthly")
    edges = counts.agg(F.min("month").alias("first"), F.max("month").alias("last"))
    bounds = edges.withColumn("months", (F.months_between("last", "first") + 1).cast("int"))
    bounds = write_shared(bounds.where("first is not null"), "months")
    # As many entries as the window has months.
    of_category = counts.groupBy(category).agg(
        F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("by_month")
    )
    at = F.lit(0)
    joined = of_category.withColumn("_one", at).join(bounds.withColumn("_one", at), "_one")
    series = F.transform(
        F.sequence(F.lit(0), F.col("months") - 1),
        lambda i: F.coalesce(
            F.try_element_at("by_month", F.add_months("first", i)), F.lit(0)
        ).cast("double"),
    )
    series = write_shared(joined.select(category, "first", "months", series.alias("x")), "series")
    sums = series.select(
        category,
        "first",
        "months",
        running_sums(F.col("x")).alias("p"),
        running_sums(F.transform("x", lambda v: v * v)).alias("q"),
    )
    sums = write_shared(sums, "sums")
    mean = F.get("p", F.col("months")) / F.col("months")
    charge = penalty * mean * F.log(F.col("months").cast("double"))
    ends = _ends(F.col("months"), F.col("p"), F.col("q"), charge)
    cut = write_shared(sums.select(category, "first", "p", ends.alias("ends")), "segments")
    segments = F.transform(
        "ends",
        lambda end, i: F.struct(
            (i + 1).alias("segment"),
            F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1)).alias("start"),
            end.alias("end"),
        ),
    )
    size = F.col("end") - F.col("start")
    mean_n = (F.get("p", F.col("end")) - F.get("p", F.col("start"))) / size
    return cut.select(category, "first", "p", F.inline(segments)).select(
        category,
        F.col("segment").cast("int").alias("segment"),
        F.add_months("first", F.col("start")).alias("month_from"),
        F.add_months("first", F.col("end") - 1).alias("month_to"),
        size.cast("int").alias("n_months"),
        rounded(mean_n, 2).alias("mean_n"),
    )


def _ends(months: Column, p: Column, q: Column, charge: Column) -> Column:
    """The ends of the best segments, from running sums of the values and of their squares."""

    def step(state: Column, t: Column) -> Column:
        def cost(best: Column, s: Column) -> Column:
            total = F.get(p, t) - F.get(p, s)
            spread = (F.get(q, t) - F.get(q, s)) - total * total / (t - s)
            return best + spread + charge

        costs = F.transform(state["best"], cost)
        return let(
            costs,
            lambda c: F.struct(
                F.concat(state["best"], F.array(F.array_min(c))).alias("best"),
                F.concat(
                    state["cuts"], F.array((F.array_position(c, F.array_min(c)) - 1).cast("int"))
                ).alias("cuts"),
            ),
        )

    start = F.struct(
        F.array(F.lit(0.0)).alias("best"), F.array().cast("array<int>").alias("cuts")
    )
    cuts = F.aggregate(F.sequence(F.lit(1), months), start, step, lambda state: state["cuts"])

    def back(cuts: Column) -> Column:
        begin = F.struct(months.alias("at"), F.array().cast("array<int>").alias("ends"))

        def earlier(state: Column, _: Column) -> Column:
            return F.when(
                state["at"] > 0,
                F.struct(
                    F.get(cuts, state["at"] - 1).alias("at"),
                    F.concat(F.array(state["at"]), state["ends"]).alias("ends"),
                ),
            ).otherwise(state)

        return F.aggregate(cuts, begin, earlier, lambda state: state["ends"])

    return let(cuts, back)
