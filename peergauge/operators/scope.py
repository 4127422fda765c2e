"""Which rows take part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.functions.text import clip, strip
from peergauge.spec import CaseSpec

# Partition column of a case table on disk.
MONTH_COLUMN = "received_month"

# Texts below the first are near-empty; a classifier reads up to the second.
MIN_TEXT_CHARS = 50
MAX_TEXT_CHARS = 6000


def core_scope(cases: DataFrame, spec: CaseSpec, view: str | None = None) -> DataFrame:
    """Cases outside the excluded categories; a null category drops too.

    With ``view`` the result is also registered under that name for SQL users.
    """
    core = cases.where(F.col(spec.category).isNotNull())
    for excluded in spec.excluded_categories:
        core = core.where(F.col(spec.category) != excluded)
    if view:
        core.createOrReplaceTempView(view)
    return core


def date_window(cases: DataFrame, spec: CaseSpec, date_from: str, date_to: str) -> DataFrame:
    """Cases received on the days of an inclusive range; null dates drop.

    Compares the bare column with constants so that the test reaches the scan,
    and adds the month bounds if the table is laid out by month.
    """
    received = F.col(spec.received)
    after = F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp_ntz")
    rows = cases.where((received >= F.lit(date_from).cast("timestamp_ntz")) & (received < after))
    if MONTH_COLUMN in cases.columns:
        month = F.col(MONTH_COLUMN)
        rows = rows.where(
            month.between(
                F.trunc(F.lit(date_from).cast("date"), "month"),
                F.trunc(F.lit(date_to).cast("date"), "month"),
            )
        )
    return rows


def source_filter(
    cases: DataFrame,
    spec: CaseSpec,
    date_from: str | None = None,
    date_to: str | None = None,
    region: str | None = None,
    category: str | None = None,
    has_text: bool | None = None,
) -> DataFrame:
    """Narrow a pull the way its request would: each condition is optional."""
    rows = cases
    if date_from or date_to:
        rows = date_window(rows, spec, date_from or "0001-01-01", date_to or "9999-12-30")
    if region is not None:
        rows = rows.where(F.col(spec.region) == region)
    if category is not None:
        rows = rows.where(F.col(spec.category) == category)
    if has_text is not None:
        rows = rows.where(F.col(spec.has_text) == has_text)
    return rows


def keep_snapshot(cases: DataFrame, spec: CaseSpec, tag: str) -> DataFrame:
    """Only the rows of one pull, dropping leftovers of earlier ones."""
    return cases.where(F.col(spec.snapshot) == tag)


def at_least(groups: DataFrame, min_n: int, count: str = "n") -> DataFrame:
    """Groups of ``min_n`` rows or more."""
    return groups.where(F.col(count) >= min_n)


def text_gate(
    rows: DataFrame,
    text: str,
    min_chars: int = MIN_TEXT_CHARS,
    max_chars: int | None = None,
) -> DataFrame:
    """Strip the text, drop rows where too little is left, cut what a classifier would not read."""
    stripped = rows.withColumn(text, strip(F.col(text))).where(F.length(text) >= min_chars)
    return stripped.withColumn(text, clip(F.col(text), max_chars)) if max_chars else stripped


def top_k(rows: DataFrame, k: int, by: str, ties: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ties go by name, so the cut is repeatable."""
    return ordered(rows, F.desc(by), *ties).limit(k)


def ordered(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Sort with nulls last, ascending unless a key says otherwise."""
    return rows.orderBy(*[F.asc_nulls_last(k) if isinstance(k, str) else k for k in keys])
