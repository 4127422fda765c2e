import datetime as dt

from helpers import cases, tuples
from pyspark.sql import functions as F

from peergauge.functions import pct, period_start, rounded
from peergauge.operators import peers, rates, scope
from peergauge.spec import CaseSpec

SPEC = CaseSpec(min_n=2, pooled_min_n=2)
MONEY, OTHER = "Closed with monetary relief", "Closed with non-monetary relief"


def test_both_relief_outcomes_count(spark):
    df = cases(spark, [{"company_response": r} for r in (MONEY, OTHER, "Untimely response", None)])
    assert tuples(rates.favourable_rate(df, SPEC, ["product"])) == [("Mortgage", 4, 50.0)]


def test_timely_rate(spark):
    df = cases(spark, [{"timely": t} for t in ("Yes", "No", None)])
    assert tuples(rates.timely_rate(df, SPEC, ["company"])) == [("A", 3, 33.3)]


def test_rounding_follows_the_scaled_value(spark):
    df = spark.createDataFrame([(75.0, 46.45), (1.0, 0.0)], "a double, b double")
    got = df.select(rounded(F.col("a") - F.col("b"), 1).alias("x")).collect()
    assert [r.x for r in got] == [28.6, 1.0]


def test_percentage_of_nothing_is_null(spark):
    assert spark.range(1).select(pct(F.lit(0), F.lit(0)).alias("x")).first().x is None


def test_shares_sum_to_the_whole(spark):
    outcomes = (MONEY, MONEY, OTHER, None, None, None, "x")
    df = cases(spark, [{"company_response": r} for r in outcomes])
    got = rates.share_of_total(df, ["company_response"]).collect()
    assert sum(r.n for r in got) == 7
    assert abs(sum(r.pct for r in got) - 100) < 0.2
    assert {r.company_response: r.pct for r in got}[None] == 42.9


def test_share_of_total_of_nothing(spark):
    empty = cases(spark, [{}]).where("false")
    assert rates.share_of_total(empty, ["product"]).count() == 0


def test_subject_against_rest_counts_null_entities_as_rest(spark):
    df = cases(
        spark,
        [
            {"company": "S", "company_response": MONEY},
            {"company": "S", "company_response": OTHER},
            {"company": None, "company_response": MONEY},
            {"company": "B", "company_response": MONEY},
        ],
    )
    assert tuples(rates.subject_against_rest(df, SPEC, "S")) == [
        ("S", MONEY, 1, 50.0),
        ("S", OTHER, 1, 50.0),
        ("all others", MONEY, 2, 100.0),
    ]


def test_scorecard_and_pooled_rate(spark):
    df = cases(
        spark,
        [{"company": "A", "company_response": MONEY}, {"company": "A", "timely": "No"}]
        + [{"company": "B"}]
        + [{"company": "B", "product": "Prepaid card"}],
    )
    assert tuples(rates.category_scorecard(df, SPEC, "Mortgage")) == [("A", 2, 50.0, 50.0)]
    assert tuples(rates.pooled_entity_rate(df, SPEC)) == [("A", 2, 50.0), ("B", 2, 0.0)]


def test_lead_time_counts_midnights(spark):
    day = "2024-03-{:02d} {}"
    gaps = [("23:59:59", 2, "00:00:01")] + [("08:00:00", 1, "20:00:00")] * 3
    df = cases(
        spark,
        [
            {"date_received": day.format(1, a), "date_sent_to_company": day.format(d, b)}
            for a, d, b in gaps
        ],
    )
    row = rates.lead_time(df, SPEC, ["product"]).first()
    assert (row.median_route_days, row.n, row.pct_same_day) == (0.0, 4, 75.0)
    assert abs(row.p90_route_days - 0.7) < 1e-9


def test_lead_time_keeps_rows_without_a_date_in_n(spark):
    df = cases(spark, [{}, {"date_sent_to_company": None}])
    row = rates.lead_time(df, SPEC, ["product"]).first()
    assert (row.median_route_days, row.n, row.pct_same_day) == (0.0, 2, 50.0)


def test_spread_with_a_zero_rate_has_no_ratio(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 5.0)], "g string, r double")
    row = rates.rate_spread(df, "r", "g").first()
    assert (row.lowest, row.highest, row.spread) == ("a", "b", None)


def test_period_starts_ignore_the_session_zone(spark, conf):
    conf(spark__sql__session__timeZone="America/Santiago")
    df = cases(spark, [{"date_received": "2024-09-08 00:30:00"}])
    got = df.select(
        *[period_start(F.col("date_received"), u).cast("string").alias(u)
          for u in ("day", "month", "quarter")]
    ).first()
    assert got == ("2024-09-08 00:00:00", "2024-09-01 00:00:00", "2024-07-01 00:00:00")


def test_core_scope_drops_null_and_excluded_and_registers_a_view(spark):
    df = cases(
        spark, [{}, {"product": None}, {"product": SPEC.excluded_categories[0]}]
    )
    scope.core_scope(df, SPEC, "core_for_test")
    assert spark.table("core_for_test").count() == 1


def test_core_view_answers_sql(spark):
    df = cases(spark, [{"company": "A", "timely": t} for t in ("Yes", "No")])
    scope.core_scope(df, SPEC, "core_for_sql")
    row = spark.sql(
        "SELECT company, round(100.0d * count(*) FILTER (WHERE timely = 'Yes') / count(*), 1) AS p "
        "FROM core_for_sql GROUP BY company HAVING count(*) >= 2"
    ).first()
    assert row == ("A", 50.0)


def test_source_filter(spark):
    df = cases(
        spark,
        [
            {"date_received": "2024-01-01 00:00:00"},
            {"date_received": "2024-01-31 23:59:59"},
            {"date_received": "2024-02-01 00:00:00"},
            {"date_received": None},
            {"date_received": "2024-01-15 00:00:00", "state": "NY"},
            {"date_received": "2024-01-15 00:00:00", "has_narrative": True},
        ],
    )
    def ids(**kw):
        return [r[0] for r in tuples(scope.source_filter(df, SPEC, **kw), "complaint_id")]

    january = {"date_from": "2024-01-01", "date_to": "2024-01-31"}
    assert ids(**january) == ["0", "1", "4", "5"]
    assert ids(**january, region="CA") == ["0", "1", "5"]
    assert ids(**january, has_text=True) == ["5"]
    assert ids(date_from="2024-01-31") == ["1", "2"]
    assert ids(date_to="2024-01-01") == ["0"]
    assert ids(category="Prepaid card") == []
    assert ids() == ["0", "1", "2", "3", "4", "5"]


def test_snapshot_purge(spark):
    df = cases(spark, [{}, {"snapshot": "old"}, {"snapshot": None}])
    assert scope.keep_snapshot(df, SPEC, "s1").count() == 1


def test_order_puts_nulls_last_and_top_k_breaks_ties(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), (None, 2), ("c", 1)], "k string, n int")
    assert [r.k for r in scope.ordered(df, "k").collect()] == ["a", "b", "c", None]
    assert [r.k for r in scope.top_k(df, 2, "n", ["k"]).collect()] == ["a", "b"]


def test_dates_of_a_window_prune_month_folders(spark, tmp_path):
    from helpers import plan

    from peergauge.sources.tables import replace_cases

    df = cases(spark, [{"date_received": f"2024-{m:02d}-15 12:00:00"} for m in range(1, 13)])
    path = str(tmp_path / "cases")
    replace_cases(df, path)
    window = scope.date_window(spark.read.parquet(path), SPEC, "2024-03-15", "2024-04-14")
    assert [r.date_received for r in window.collect()] == [dt.datetime(2024, 3, 15, 12)]
    text = plan(window)
    assert "PartitionFilters: [isnotnull(received_month" in text
    assert "GreaterThanOrEqual(date_received" in text


def test_rows_counted_beforehand_give_the_same_rates(spark):
    from dataclasses import replace

    rows = cases(
        spark,
        [
            {
                "product": ("Mortgage", "Student loan", None)[i % 3],
                "company": ("A", "B", None, "C")[i % 4],
                "company_response": (SPEC.favourable[0], "Closed with explanation", None)[i % 7 % 3],
                "timely": ("Yes", "No", None)[i % 5 % 3],
            }
            for i in range(120)
        ],
    )
    spec = replace(SPEC, min_n=3, pooled_min_n=5)
    weighted = replace(spec, weight="copies")
    kept = ["product", "company", "company_response", "timely"]
    counted = rows.groupBy(*kept).agg(F.count(F.lit(1)).alias("copies"))
    assert counted.count() < 120
    for report in (
        lambda df, s: rates.favourable_rate(df, s, ["product"]),
        lambda df, s: rates.timely_rate(df, s, ["company"]),
        lambda df, s: rates.category_scorecard(df, s, "Mortgage"),
        rates.pooled_entity_rate,
        lambda df, s: rates.subject_against_rest(df, s, "B"),
        lambda df, s: peers.within_category_deviation(df, s),
        lambda df, s: peers.stratified_next_to_naive(df, s),
    ):
        plain, fast = report(rows, spec), report(counted, weighted)
        assert fast.dtypes == plain.dtypes
        assert tuples(fast) == tuples(plain) != []


def test_weights_that_are_null_or_of_no_row_count_nothing(spark):
    from dataclasses import replace

    spec = replace(SPEC, weight="copies")
    rows = spark.createDataFrame(
        [("a", "Yes", 2), ("a", "No", None), ("b", "Yes", None), ("b", None, None)],
        "product string, timely string, copies long",
    )
    rated = rates.timely_rate(rows, spec, ["product"])
    assert tuples(rated) == [("a", 2, 100.0), ("b", 0, None)]
    assert tuples(rates.timely_rate(rows.limit(0), spec, ["product"])) == []
