"""The order tables seen as a case table, and the document tables as texts and answers."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peergauge.functions import period_start
from peergauge.operators.scoring import attach_predictions
from peergauge.session import beyond_broadcast
from peergauge.spec import CaseSpec

# Order lines are cases, part types categories, suppliers entities. Groups
# hold about 100 rows whatever the scale of the tables, hence the minimum.
ORDER_CASES = CaseSpec(excluded_categories=("MEDIUM",), min_n=95, pooled_min_n=500)
WEIGHT = "n_cases"
ORDER_COUNTS = replace(ORDER_CASES, weight=WEIGHT)
QUARTER_MIN_N = 4
PULL_CEILING = 40

ONE_CATEGORY = "PROMO"
SUBJECT = "Supplier#000000007"
HOME_REGION = "NATION_1"
PROMPT_DAYS = 30
NARRATIVE_QUANTITY = 35

HOME_LABEL = "Debt or credit management"
OTHER_LABEL = "Debt collection"


# Columns the queries use, so that no file is opened to find out the schema.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_brand string, p_type string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "documents": "doc_id bigint, text string, lang string, source string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _outcome() -> Column:
    """Outcome of an order line by its status and return flag."""
    final, flag = F.col("l_linestatus") == "F", F.col("l_returnflag")
    return (
        F.when(final & (flag == "R"), "Closed with monetary relief")
        .when(final & (flag == "A"), "Closed with non-monetary relief")
        .when(flag == "N", "Untimely response")
        .otherwise("Closed with explanation")
    )


def _timely() -> Column:
    prompt = F.datediff("l_shipdate", "o_orderdate") <= PROMPT_DAYS
    return F.when(prompt, "Yes").otherwise("No")


# Canonical column -> (its expression, the dimension table it needs).
_COLUMNS: dict[str, tuple[Callable[[], Column], str | None]] = {
    "complaint_id": (lambda: F.concat_ws("-", "l_orderkey", "l_linenumber"), None),
    "product": (lambda: F.col("p_type"), "part"),
    "sub_product": (lambda: F.col("p_brand"), "part"),
    "company": (lambda: F.col("s_name"), "supplier"),
    "state": (lambda: F.col("n_name"), "nation"),
    "date_received": (lambda: F.col("o_orderdate"), "orders"),
    "date_sent_to_company": (lambda: F.col("l_shipdate"), None),
    "company_response": (_outcome, None),
    "timely": (_timely, "orders"),
    "has_narrative": (lambda: F.col("l_quantity") >= NARRATIVE_QUANTITY, None),
    "part": (lambda: F.col("l_partkey"), None),
    "amount": (lambda: F.col("l_extendedprice"), None),
    "consumer_disputed": (lambda: F.lit(None).cast("string"), None),
}

# Dimension -> join keys (from what is joined so far, from the dimension).
_JOINS = {
    "orders": ("l_orderkey", "o_orderkey"),
    "part": ("l_partkey", "p_partkey"),
    "supplier": ("l_suppkey", "s_suppkey"),
    "nation": ("s_nationkey", "n_nationkey"),
}


# Dimensions whose joins wait until the lines are counted by supplier.
COUNTED_FIRST = ("supplier", "nation")


def order_cases(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """The asked-for columns of the case table; joins only the tables they need.

    Left joins to unique keys: the rows are the order lines whichever columns
    are asked for. How each join runs is left to the planner, since parts,
    suppliers and orders all grow with the data.
    """
    rows = _join(spark, sf_dir, table(spark, sf_dir, "lineitem"), _needed(columns))
    return rows.select(*[_COLUMNS[c][0]().alias(c) for c in columns])


def order_case_counts(
    spark: SparkSession, sf_dir: str, columns: Sequence[str], period: str | None = None
) -> DataFrame:
    """The asked-for columns of the case table and, as ``WEIGHT``, the cases a row stands for.

    Where suppliers are too large to be broadcast, the lines are counted by supplier key and
    the other columns before suppliers and nations are joined, so those joins shuffle counts.
    Otherwise a row is a line: the broadcast join shuffles nothing, and counting first would
    add a shuffle. With ``period`` the date of receipt is the start of its period, as dates by
    the day would leave little to count.
    """
    needed = _needed(columns)
    later = [name for name in COUNTED_FIRST if name in needed]
    if not any(beyond_broadcast(table(spark, sf_dir, name)) for name in later):
        later = []
    exprs = {c: _COLUMNS[c][0]() for c in columns}
    if period and "date_received" in exprs:
        exprs["date_received"] = period_start(exprs["date_received"], period)
    rows = _join(spark, sf_dir, table(spark, sf_dir, "lineitem"), needed - set(later))
    if not later:
        one = F.lit(1).cast("bigint").alias(WEIGHT)
        return rows.select(*[exprs[c].alias(c) for c in columns], one)
    first = [c for c in columns if _COLUMNS[c][1] not in later]
    keys = [*(exprs[c].alias(c) for c in first), "l_suppkey"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(WEIGHT))
    return _join(spark, sf_dir, counts, later).select(
        *[F.col(c) if c in first else exprs[c].alias(c) for c in columns], WEIGHT
    )


def _needed(columns: Sequence[str]) -> set[str]:
    """The dimensions the columns come from."""
    needed = {_COLUMNS[c][1] for c in columns} - {None}
    return needed | {"supplier"} if "nation" in needed else needed


def _join(spark: SparkSession, sf_dir: str, rows: DataFrame, names: Collection[str]) -> DataFrame:
    for name, (left, right) in _JOINS.items():
        if name in names:
            rows = rows.join(table(spark, sf_dir, name), F.col(left) == F.col(right), "left")
    return rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with an official label (from toxicity) and a predicted one (from quality).

    Documents without a label row have no prediction and take their language
    as official label.
    """
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels")
    return attach_predictions(docs, labels, "doc_id").select(
        "doc_id",
        F.coalesce(_label(F.col("toxic") == 0), F.col("lang")).alias("product_official"),
        _label(F.col("quality") == 1).alias("product_predicted"),
    )


def _label(home: Column) -> Column:
    """Null for an unknown condition."""
    return F.when(home, HOME_LABEL).when(~home, OTHER_LABEL)


def probe_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw answers of two probes as a model would give them, with uneven case and blanks."""
    labels = table(spark, sf_dir, "labels")
    a = labels.select(
        "doc_id",
        F.when(F.col("doc_id") % 50 == 0, "no idea")
        .otherwise(F.concat(F.lit(" "), F.upper(_label(F.col("quality") == 1))))
        .alias("answer_a"),
    )
    b = labels.select(
        "doc_id",
        F.when(F.col("toxic") == 1, "no.").when(F.col("toxic") == 0, " Yes ").alias("answer_b"),
    )
    return a, b
