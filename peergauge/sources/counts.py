"""Counts of a case table that landing keeps up to date, and the scorecard made from them.

Counts of cases add up, so each data file of the table is counted once, when it is new, by period,
category and entity. A ledger beside the table holds them by file. The scorecard sums the counts of
the files that stand: what a purge or a reload has removed no longer counts, and a landing that runs
again, or is cut short, counts nothing twice.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peergauge.functions.dates import period_start
from peergauge.operators.peers import compare_with_peers
from peergauge.operators.rates import two_rate_counts, two_rates
from peergauge.operators.scope import at_least, core_scope, ordered
from peergauge.sources.ledgers import add_entry, data_files, file_place, read_ledger
from peergauge.spec import CaseSpec

SUMS = ("n", "n_timely", "n_relief")


def _ledger(spec: CaseSpec, period: str) -> str:
    """Counts depend on the spec: each has a ledger of its own."""
    used = (
        *(spec.category, spec.entity, spec.received, spec.outcome, spec.timely),
        *(spec.timely_value, sorted(spec.favourable), sorted(spec.excluded_categories), period),
        *_weight(spec),
    )
    return "_counts-" + hashlib.sha256(repr(used).encode()).hexdigest()[:16]


def _weight(spec: CaseSpec) -> tuple[str, ...]:
    return (spec.weight,) if spec.weight else ()


def _schema(cases: DataFrame, spec: CaseSpec, period: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("file", T.StringType()),
            T.StructField(period, T.TimestampNTZType()),
            *(T.StructField(c, cases.schema[c].dataType) for c in (spec.category, spec.entity)),
            *(T.StructField(c, T.LongType()) for c in SUMS),
        ]
    )


def update_counts(
    spark: SparkSession, path: str, spec: CaseSpec, period: str = "quarter"
) -> int:
    """Count the data files of the table that have not been counted; returns how many."""
    files = data_files(spark, path)
    if not files:
        return 0
    schema, ledger = _schema(spark.read.parquet(path), spec, period), _ledger(spec, period)
    done = {r.file for r in read_ledger(spark, path, ledger, schema).select("file").distinct().collect()}
    new = [name for place, name in files.items() if place not in done]
    if new:
        read = (spec.category, spec.entity, spec.received, spec.outcome, spec.timely)
        read += _weight(spec)
        cases = spark.read.schema(spark.read.parquet(path).select(*read).schema).parquet(*new)
        start = period_start(F.col(spec.received), period).alias(period)
        place = file_place(spark, path).alias("file")
        # A file outside the scope is counted too: one row without a category says so.
        scoped = core_scope(cases.select(place, *read), spec)
        counts = two_rate_counts(scoped, spec, ["file", start, spec.category, spec.entity])
        seen = spark.createDataFrame([(p,) for p in files if files[p] in set(new)], "file string")
        rows = seen.join(counts, "file", "left").select(*schema.names)
        add_entry(rows, path, ledger)
    return len(new)


def read_counts(
    spark: SparkSession, path: str, spec: CaseSpec, period: str = "quarter"
) -> DataFrame:
    """period, category, entity and the sums over the table's present files."""
    standing = spark.createDataFrame([(p,) for p in data_files(spark, path)], "file string")
    schema = _schema(spark.read.parquet(path), spec, period)
    rows = read_ledger(spark, path, _ledger(spec, period), schema).where("n is not null")
    return (
        rows.join(standing, "file", "left_semi")
        .groupBy(period, spec.category, spec.entity)
        .agg(*(F.sum(c).alias(c) for c in SUMS))
    )


def scorecard_from_counts(
    spark: SparkSession, path: str, spec: CaseSpec, period: str = "quarter"
) -> DataFrame:
    """The scorecard per period of all files counted so far, from counts only."""
    rates = two_rates(at_least(read_counts(spark, path, spec, period), spec.min_n))
    card = compare_with_peers(rates, spec, [period, spec.category])
    return ordered(card, period, spec.category, "pct_relief", "pct_timely", spec.entity)
