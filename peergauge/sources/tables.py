"""The case table on disk: full reload, and landing of batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peergauge.operators.landing import first_per_key, keys_in_both
from peergauge.operators.scope import MONTH_COLUMN
from peergauge.session import (
    list_folders,
    move_path,
    new_shared_path,
    remove_path,
    write_and_read,
)
from peergauge.sources.key_filters import MOST_TRIED, add_filters, near_files
from peergauge.sources.ledgers import data_files


# Folder of a table's months that a purge has replaced.
PURGED = "_purged-"


@dataclass(frozen=True)
class Landed:
    """What one batch did to the target."""

    fetched: int
    inserted: int

    @property
    def skipped(self) -> int:
        return self.fetched - self.inserted


def read_table(
    spark: SparkSession, path: str, schema: StructType, must_exist: bool = False
) -> DataFrame:
    """The table at ``path``; empty if nothing was written there yet, unless it must exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if must_exist or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def by_month(cases: DataFrame, received: str) -> DataFrame:
    """Cases gathered by month for writing.

    The rebalance lets adaptive execution split a month that holds most of the
    rows over several tasks and files, and merge small ones.
    """
    month = F.trunc(F.col(received).cast("date"), "month")
    return cases.withColumn(MONTH_COLUMN, month).hint("rebalance", MONTH_COLUMN)


def replace_cases(cases: DataFrame, path: str, received: str = "date_received") -> None:
    """Full reload, laid out by month of receipt so that date windows prune.

    The rows are written once, to a folder next to the table, which then takes
    the table's place. If computing or writing fails the old table stays, and the
    rows may come from the table they replace.
    """
    spark, label = cases.sparkSession, uuid.uuid4().hex
    base = path.rstrip("/")
    new, old = f"{base}.new-{label}", f"{base}.old-{label}"
    try:
        rows = by_month(cases.drop(MONTH_COLUMN), received)
        rows.write.partitionBy(MONTH_COLUMN).parquet(new)
        replaced = move_path(spark, base, old)
        if not move_path(spark, new, base):
            if replaced:
                move_path(spark, old, base)
            raise OSError(f"could not put the new table at {base}")
    finally:
        remove_path(spark, new)
    remove_path(spark, old)


def purge_cases(spark: SparkSession, path: str, keep: Column) -> int:
    """Remove the rows that ``keep`` is not true of; returns how many months were rewritten.

    Only the month folders that hold such rows are written anew, aside, and then take the place of the
    old ones, which stay until all new ones stand; the files of other months are not touched. A
    purge that was stopped while folders were exchanged is undone by the next one.
    """
    _undo_purge(spark, path)
    cases, kept = spark.read.parquet(path), F.coalesce(keep, F.lit(False))
    months = [r[0] for r in cases.where(~kept).select(MONTH_COLUMN).distinct().collect()]
    if not months:
        return 0
    label = uuid.uuid4().hex
    base = path.rstrip("/")
    new, old = f"{base}/_new-{label}", f"{base}/{PURGED}{label}"
    touched = F.col(MONTH_COLUMN).isin([m for m in months if m is not None])
    if None in months:
        touched = F.coalesce(touched, F.lit(True)) | F.col(MONTH_COLUMN).isNull()
    rows = cases.where(touched & kept).hint("rebalance", MONTH_COLUMN)
    try:
        rows.write.partitionBy(MONTH_COLUMN).parquet(new)
        for month in months:
            folder = f"{MONTH_COLUMN}={month or '__HIVE_DEFAULT_PARTITION__'}"
            if not move_path(spark, f"{base}/{folder}", f"{old}/{folder}"):
                raise OSError(f"could not put {folder} aside")
            move_path(spark, f"{new}/{folder}", f"{base}/{folder}")
        remove_path(spark, old)
    except Exception:
        _undo_purge(spark, path)
        raise
    finally:
        remove_path(spark, new)
    return len(months)


def _undo_purge(spark: SparkSession, path: str) -> None:
    """Put months that a stopped purge had set aside back in their places."""
    base = path.rstrip("/")
    for aside in list_folders(spark, base):
        if aside.startswith(PURGED):
            for folder in list_folders(spark, f"{base}/{aside}"):
                remove_path(spark, f"{base}/{folder}")
                move_path(spark, f"{base}/{aside}/{folder}", f"{base}/{folder}")
            remove_path(spark, f"{base}/{aside}")


def insert_new(
    batch: DataFrame,
    path: str,
    key: str,
    order: tuple[str, ...],
    received: str | None = None,
    stamp: str | None = None,
    on_counted: Callable[[Landed], None] | None = None,
) -> Landed:
    """Append the rows of ``batch`` whose key is new to the table at ``path``.

    Of several rows of a key the first by ``order`` is taken. Rows without a
    key fail the batch, as they would break the primary key. Running a batch
    again, after a failure or on purpose, adds nothing twice. ``on_counted`` is told
    what will be inserted just before it is.

    Batch and overlap are written to the shared folder in between: their
    lineage ends there, and their known sizes decide whether keys are broadcast.
    Of the target only those files are read that may hold a key of the batch (see
    ``key_filters``), and of these the range of the batch's keys: rows are sorted by
    key within files. A batch of more than ``MOST_TRIED`` keys reads all files.
    """
    spark = batch.sparkSession
    stored = [c for c in batch.columns if not c.startswith("_")]
    keys = batch.select(key).schema

    staging, overlap = new_shared_path(spark, "batch"), new_shared_path(spark, "overlap")
    firsts = first_per_key(batch, key, order, copies="_copies")
    others = [c for c in stored if c != key]
    checked = firsts.select(_required(key), *others, "_copies")
    try:
        staged = write_and_read(checked, staging)
        totals = staged.agg(F.sum("_copies").alias("fetched"), F.count(F.lit(1)).alias("ids"))
        counted = totals.first()
        if counted.ids <= MOST_TRIED:
            near = near_files(spark, path, staged, key)
        else:
            near = list(data_files(spark, path).values())
        fresh, repeated = staged, 0
        if near:
            target = spark.read.schema(keys).parquet(*near)
            known = write_and_read(keys_in_both(target, staged, key), overlap)
            repeated = known.count()
            fresh = staged.join(known, key, "left_anti")
        landed = Landed(counted.fetched or 0, counted.ids - repeated)
        if on_counted:
            on_counted(landed)

        fresh = fresh.select(*stored)
        if stamp:
            fresh = fresh.withColumn(stamp, F.current_timestamp())
        if received:
            rows = by_month(fresh, received).sortWithinPartitions(MONTH_COLUMN, key)
            writer = rows.write.partitionBy(MONTH_COLUMN)
        else:
            writer = fresh.sortWithinPartitions(key).write
        if landed.inserted or not data_files(spark, path):
            writer.mode("append").parquet(path)
        add_filters(spark, path, keys[key])
    finally:
        remove_path(spark, staging)
        remove_path(spark, overlap)
    return landed


def _required(key: str) -> Column:
    missing = F.raise_error(F.lit(f"null {key} in batch"))
    return F.when(F.col(key).isNull(), missing).otherwise(F.col(key)).alias(key)
