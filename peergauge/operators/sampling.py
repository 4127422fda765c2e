"""Repeatable stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Size of the sample per stratum, and its seed.
PER_STRATUM = 50
SEED = 20260709

_LANES = 1024


def draw_order(id_column: str, seed: int) -> Column:
    """A fixed random-looking order of the ids, the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_column).cast("string")))


def stratified_sample(
    rows: DataFrame, stratum: str, id_column: str, k: int = PER_STRATUM, seed: int = SEED
) -> DataFrame:
    """The first ``k`` rows of every stratum in the seeded order; all rows of smaller strata.

    Runs as two rank limits. The first ranks within (stratum, lane), where the
    lane is a group of input tasks: each task passes on at most ``k`` rows per
    stratum, and a large stratum is spread over many reducers. The second ranks
    the survivors. The lanes do not affect the result; a task that is run again
    has the same number and so the same lane.
    """
    order, lane = "_draw_order", "_lane"
    drawn = rows.withColumn(order, draw_order(id_column, seed)).withColumn(
        lane, F.spark_partition_id() % _LANES
    )
    for keys in ([stratum, lane], [stratum]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, id_column))
        drawn = drawn.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    return drawn.drop(order, lane)


def attach_text(sample: DataFrame, texts: DataFrame, id_column: str) -> DataFrame:
    """Look up the text of every sampled id; ids without one drop.

    Pass the sample through ``write_shared`` first: the planner then knows its
    size, broadcasts it if small, and scans the texts without shuffling them.
    """
    return texts.join(sample, id_column, "inner")
