"""The two landing routes from end to end, each with its audit record."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from peergauge.operators.scope import source_filter
from peergauge.plans.evaluation import census
from peergauge.sources.counts import update_counts
from peergauge.sources.csv_export import read_csv_export
from peergauge.sources.results import write_results
from peergauge.sources.runs import append_run_log, load_facts, put_run_meta
from peergauge.sources.schemas import CENSUS
from peergauge.sources.search_pages import (
    ARRIVAL,
    read_search_pages,
    stream_search_pages,
    without_text,
)
from peergauge.sources.tables import Landed, insert_new, replace_cases
from peergauge.spec import CaseSpec
from peergauge.streaming.landing import land_stream

KEY, RECEIVED, STAMP = "complaint_id", "date_received", "ingested_at"


def load_csv_export(
    spark: SparkSession,
    export: str,
    table: str,
    meta: str,
    date_from: str,
    date_to: str,
    snapshot: str | None = None,
) -> int:
    """Replace the table by the export's rows of the range; returns how many."""
    replace_cases(read_csv_export(spark, export, date_from, date_to, snapshot), table, RECEIVED)
    loaded = spark.read.parquet(table).count()
    pulled_on = snapshot or date.today().isoformat()
    put_run_meta(spark, meta, load_facts(pulled_on, date_from, date_to, loaded))
    return loaded


def _asked_for(
    hits: DataFrame, date_from: str, date_to: str, region: str | None
) -> DataFrame:
    return source_filter(without_text(hits), CaseSpec(), date_from, date_to, region)


def pull_census(
    spark: SparkSession,
    pages: str,
    path: str,
    date_from: str,
    date_to: str,
    category: str | None = None,
    region: str | None = None,
    one_per_file: bool = True,
) -> DataFrame:
    """Write every text of the landed pages that the request names, each id once.

    The request narrows the hits to those with a text first; then the earliest hit
    of an id counts, and drops if its text is too short.
    """
    hits = read_search_pages(spark, pages, None, one_per_file)
    asked = source_filter(hits, CaseSpec(), date_from, date_to, region, category, has_text=True)
    rows = census(asked, ARRIVAL)
    write_results(rows.select(*[F.col(f.name).cast(f.dataType) for f in CENSUS.fields]), path)
    return spark.read.schema(CENSUS).parquet(path)


def land_search_pages(
    spark: SparkSession,
    pages: str,
    table: str,
    log: str,
    snapshot: str,
    date_from: str,
    date_to: str,
    region: str | None = None,
    one_per_file: bool = True,
    counted: CaseSpec | None = None,
) -> Landed:
    """Insert the hits of all landed pages whose id is new. Safe to run again.

    With ``counted`` the counts of that spec's quarterly scorecard are kept up to date.
    """
    hits = read_search_pages(spark, pages, snapshot, one_per_file)
    batch = _asked_for(hits, date_from, date_to, region)
    landed = insert_new(batch, table, KEY, ARRIVAL, RECEIVED, STAMP)
    if counted:
        update_counts(spark, table, counted)
    append_run_log(spark, log, snapshot, date_from, date_to, landed, region)
    return landed


def follow_search_pages(
    spark: SparkSession,
    pages: str,
    table: str,
    log: str,
    checkpoint: str,
    snapshot: str,
    date_from: str,
    date_to: str,
    region: str | None = None,
    one_per_file: bool = True,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Insert the hits of the pages that landed since the last call, one log row per batch."""
    hits = stream_search_pages(spark, pages, snapshot, one_per_file, files_per_batch)
    batch = _asked_for(hits, date_from, date_to, region)

    def record(landed: Landed, batch_id: int) -> None:
        batch = f"{checkpoint}#{batch_id}"
        append_run_log(spark, log, snapshot, date_from, date_to, landed, region, batch)

    return land_stream(batch, table, checkpoint, KEY, ARRIVAL, RECEIVED, STAMP, record)
