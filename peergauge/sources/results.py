"""Samples, scores and extracts in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def export_extract(
    extract: DataFrame, path: str, *order: str, single_file: bool = True
) -> None:
    """Write an aggregate as CSV with header, sorted, in one file.

    An extract too long for one task is written with ``single_file=False``: several
    files which hold the same sorted rows in the order of their names.
    """
    if single_file:
        # One shuffle to one task: the aggregate itself keeps its own tasks.
        rows = extract.repartition(1).sortWithinPartitions(*order)
    else:
        rows = extract.orderBy(*order)
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def write_results(rows: DataFrame, path: str, as_csv: bool = False) -> None:
    """Write a sample or scored rows as Parquet, or as CSV on request."""
    if as_csv:
        rows.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)
    else:
        rows.write.mode("overwrite").parquet(path)


def read_results_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read a results CSV; fields may hold newlines and quotes."""
    return spark.read.csv(
        path,
        schema=schema,
        header=True,
        enforceSchema=False,
        multiLine=True,
        quote='"',
        escape='"',
        mode="FAILFAST",
    )
