"""Landed pages of the search service, as files or as a stream of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peergauge.functions.text import non_empty
from peergauge.sources.schemas import CASES, PAGE, PAGE_ERRORS

# When and where a row was landed; orders the copies of one id. Pages of one moment follow each
# other by name, numbers in names by their value.
ARRIVAL = ("_landed", "_page", "_file", "_position")


def read_search_pages(
    spark: SparkSession, path: str, snapshot: str | None = None, one_per_file: bool = True
) -> DataFrame:
    """All hits of the landed pages, with their place of arrival.

    A page that is cut off or that reports an error fails the job.
    ``one_per_file=False`` reads files with one page per line, which split.
    """
    reader = spark.read.schema(PAGE).options(multiLine=one_per_file, mode="FAILFAST")
    return hits_of(reader.json(path), snapshot)


def stream_search_pages(
    spark: SparkSession,
    path: str,
    snapshot: str | None = None,
    one_per_file: bool = True,
    files_per_batch: int | None = None,
) -> DataFrame:
    """The same rows as ``read_search_pages``, page files being taken up as they land."""
    reader = spark.readStream.schema(PAGE).options(multiLine=one_per_file, mode="FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return hits_of(reader.json(path), snapshot)


def hits_of(pages: DataFrame, snapshot: str | None) -> DataFrame:
    """One canonical row per hit; a field the page lacks is null."""
    error = F.coalesce(*PAGE_ERRORS)
    sound = F.when(
        error.isNotNull(), F.raise_error(F.concat(F.lit("page reports an error: "), error))
    ).otherwise(F.col("hits.hits._source"))
    hits = pages.select(
        F.col("_metadata.file_modification_time").alias("_landed"),
        numbered(F.col("_metadata.file_name")).alias("_page"),
        F.col("_metadata.file_path").alias("_file"),
        F.posexplode(sound).alias("_position", "_hit"),
    ).select(*ARRIVAL, "_hit.*")
    derived = {
        "date_received": F.col("date_received").cast("timestamp_ntz"),
        "date_sent_to_company": F.col("date_sent_to_company").cast("timestamp_ntz"),
        "has_narrative": non_empty(F.col("complaint_what_happened")),
        "consumer_consent_provided": F.lit(None).cast("string"),
        "tags": F.lit(None).cast("string"),
        "snapshot": F.lit(snapshot).cast("string"),
    }
    columns = [derived.get(f.name, F.col(f.name)).alias(f.name) for f in CASES.fields]
    return hits.select(*columns, F.col("complaint_what_happened").alias("narrative"), *ARRIVAL)


def numbered(name: Column) -> Column:
    """The name with its numbers filled up to twenty digits, so that page 10 follows page 2."""
    filled = F.regexp_replace(name, r"(\d+)", "0" * 20 + "$1")
    return F.regexp_replace(filled, r"0*(\d{20,})(?!\d)", "$1")


def without_text(hits: DataFrame) -> DataFrame:
    """Hits as the case table stores them: only whether there is a narrative is kept."""
    return hits.drop("narrative")
