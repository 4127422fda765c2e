"""Audit tables: one row per run, and key/value facts about the latest load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peergauge.sources.schemas import RUN_LOG, RUN_META
from peergauge.sources.tables import Landed, read_table

ALL_REGIONS = "ALL"

# The facts a load replaces; other keys stay.
LOAD_KEYS = ("pulled_on", "date_from", "date_to", "row_count")


def append_run_log(
    spark: SparkSession,
    path: str,
    snapshot: str,
    date_from: str,
    date_to: str,
    landed: Landed,
    region: str | None = None,
    batch: str | None = None,
) -> None:
    """Record a run. ``row_count`` counts what was fetched, duplicates included.

    A ``batch`` of a stream is recorded once: a replay finds its row and adds none.
    """
    if batch and not read_run_log(spark, path).where(F.col("batch") == batch).isEmpty():
        return
    row = (snapshot, date_from, date_to, region or ALL_REGIONS)
    counts = (landed.fetched, landed.inserted, landed.skipped, None, batch)
    (
        spark.createDataFrame([row + counts], RUN_LOG)
        .withColumn("run_at", F.current_timestamp())
        .coalesce(1)
        .write.mode("append")
        .parquet(path)
    )


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, RUN_LOG)


def put_run_meta(spark: SparkSession, path: str, facts: dict[str, str]) -> None:
    """Set the given keys; the table is append-only and the latest value counts."""
    (
        spark.createDataFrame([(k, v, None) for k, v in facts.items()], RUN_META)
        .withColumn("run_at", F.current_timestamp())
        .coalesce(1)
        .write.mode("append")
        .parquet(path)
    )


def load_facts(pulled_on: str, date_from: str, date_to: str, row_count: int) -> dict[str, str]:
    return dict(zip(LOAD_KEYS, (pulled_on, date_from, date_to, str(row_count)), strict=True))


def read_run_meta(spark: SparkSession, path: str) -> DataFrame:
    """Every key with its latest value."""
    return current_meta(read_table(spark, path, RUN_META))


def current_meta(history: DataFrame) -> DataFrame:
    return history.groupBy("key").agg(
        F.max(F.struct("run_at", "value")).getField("value").alias("value")
    )
