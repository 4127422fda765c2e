"""What is known of each data file of a table, kept beside it.

A ledger is a folder inside the table's folder whose name begins with an underscore, so that readers of
the table pass over it. Its rows name data files of the table. Files do not change once written, so a
file's rows stay true; rows of files that are gone are passed over, and files without rows are
caught up with. An entry appears whole or not at all: it is written aside and then renamed.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peergauge.session import list_folders, move_path, path_exists, qualified, remove_path


def data_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Data files of the table at ``path``: place within the table, and whole name."""
    if not path_exists(spark, path):
        return {}
    base = qualified(spark, path).rstrip("/") + "/"
    # Files are listed, not opened, so any schema will do.
    names = map(unquote, spark.read.schema("any string").parquet(path).inputFiles())
    return {_plain(name).removeprefix(_plain(base)): name for name in names}


def _plain(name: str) -> str:
    """Local names are written with one or three slashes."""
    return name.replace("file:///", "file:/", 1)


def file_place(spark: SparkSession, path: str) -> Column:
    """The place within the table of the file a row is read from."""
    base = _plain(qualified(spark, path).rstrip("/") + "/")
    name = F.regexp_replace("_metadata.file_path", "^file:///", "file:/")
    return F.substring(name, F.lit(len(base) + 1), F.length(name))


def read_ledger(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    entries = [f"{path.rstrip('/')}/{name}/{e}" for e in list_folders(spark, f"{path}/{name}")]
    entries = [entry for entry in entries if entry.rsplit("/", 1)[1].startswith("entry-")]
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*entries)


def add_entry(rows: DataFrame, path: str, name: str) -> None:
    spark, label = rows.sparkSession, uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/{name}"
    aside = f"{folder}/aside-{label}"
    try:
        rows.write.parquet(aside)
        if not move_path(spark, aside, f"{folder}/entry-{label}"):
            raise OSError(f"could not add to {folder}")
    finally:
        remove_path(spark, aside)
