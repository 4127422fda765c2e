"""The bulk CSV export."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peergauge.functions.text import non_empty
from peergauge.sources.csv_splits import read_records
from peergauge.sources.schemas import CASES, CSV_COLUMNS


def read_csv_export(
    spark: SparkSession,
    path: str | Sequence[str],
    date_from: str | None = None,
    date_to: str | None = None,
    snapshot: str | None = None,
    keep_narrative: bool = False,
    split_files: bool = True,
) -> DataFrame:
    """Cases of an inclusive range of received days, in the canonical schema.

    Columns are found by header, so their order and extra columns do not
    matter; every field is text until cast. The files of one path must have one
    header, and a file with another fails the job: give each layout a path of its
    own. A malformed row, or a date that does not parse, fails the job; null dates
    drop when a range is given. Large files are split over tasks although narratives
    hold newlines (see ``csv_splits``), for which the files are read three times.
    ``split_files=False`` reads each file once, in one task; it also takes quotes
    inside fields that are not quoted as a whole.
    """
    layouts = [path] if isinstance(path, str) else path
    read = _split if split_files else _named
    named = reduce(DataFrame.unionByName, (read(spark, layout) for layout in layouts))
    received = F.col("date_received").cast("date")
    if date_from:
        named = named.where(received >= F.lit(date_from).cast("date"))
    if date_to:
        named = named.where(received <= F.lit(date_to).cast("date"))
    derived = {
        "date_received": received.cast("timestamp_ntz"),
        "date_sent_to_company": F.col("date_sent_to_company").cast("date").cast("timestamp_ntz"),
        "has_narrative": non_empty(F.col("narrative")),
        "zip_code": F.lit(None).cast("string"),
        "snapshot": F.lit(snapshot).cast("string"),
    }
    columns = [derived.get(f.name, F.col(f.name)).alias(f.name) for f in CASES.fields]
    return named.select(*columns, *(["narrative"] if keep_narrative else []))


def _split(spark: SparkSession, path: str) -> DataFrame:
    """Files of one layout, each read by as many tasks as it has splits."""
    records = read_records(spark, path)
    fields = [f"_{i} string" for i in range(len(records.header))] or ["_0 string"]
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
    parsed = records.texts.select(F.from_csv("text", ", ".join(fields), options).alias("r"))
    place = {name: f"r._{i}" for i, name in enumerate(records.header)}
    missing = [header for header in CSV_COLUMNS if header not in place]
    if missing:
        raise ValueError(f"the CSV header at {path} lacks {missing}")
    return parsed.select([F.col(place[h]).alias(name) for h, name in CSV_COLUMNS.items()])


def _named(spark: SparkSession, path: str) -> DataFrame:
    """Files of one layout. Spark takes the header of one of them; the others are compared with it."""
    raw = spark.read.csv(
        path,
        header=True,
        enforceSchema=False,
        multiLine=True,
        quote='"',
        escape='"',
        mode="FAILFAST",
    )
    return raw.select([F.col(f"`{header}`").alias(name) for header, name in CSV_COLUMNS.items()])
