import statistics
from dataclasses import replace

import pytest
from helpers import cases, final_plan, tuples
from pyspark.sql import Window
from pyspark.sql import functions as F

from peergauge.operators import peers, rates, scope
from peergauge.spec import CaseSpec

SPEC = CaseSpec(min_n=2, pooled_min_n=1)
RELIEF = "Closed with monetary relief"


def company(name, n, relief=0, late=0, product="Mortgage", **other):
    return [
        {
            "company": name,
            "product": product,
            "company_response": RELIEF if i < relief else "Closed with explanation",
            "timely": "No" if i < late else "Yes",
            **other,
        }
        for i in range(n)
    ]


def flags(card):
    return {(r.product, r.company): r.review_flag for r in card.collect()}


def test_one_entity_category_has_no_peers(spark):
    rows = company("A", 3, late=3) + company("B", 3, product="Prepaid card", relief=1)
    card = peers.within_category_deviation(cases(spark, rows), SPEC)
    assert set(flags(card).values()) == {peers.NO_PEERS}


def test_ties_at_the_quartile_flag_nobody(spark):
    rows = sum((company(c, 4) for c in "ABCD"), [])
    assert set(flags(peers.within_category_deviation(cases(spark, rows), SPEC)).values()) == {"ok"}


def test_flag_on_either_rate(spark):
    rows = (
        company("late", 4, relief=2, late=4)
        + company("stingy", 4)
        + company("fine", 4, relief=2)
        + company("good", 4, relief=3)
        + company("best", 4, relief=4)
    )
    found = flags(peers.within_category_deviation(cases(spark, rows), SPEC))
    flagged = {c for (_, c), flag in found.items() if flag == peers.FLAGGED}
    assert flagged == {"late", "stingy"}


def test_small_groups_drop_at_the_threshold(spark):
    rows = company("A", 1) + company("B", 2) + company("C", 3)
    card = peers.within_category_deviation(cases(spark, rows), SPEC)
    assert {c for _, c in flags(card)} == {"B", "C"}
    assert {r.peer_count for r in card.collect()} == {2}


def test_null_outcomes_stay_in_the_denominator(spark):
    rows = company("A", 2, relief=2) + company("A", 2, company_response=None, timely=None)
    rows = [dict(r, company_response=None, timely=None) if i > 1 else r for i, r in enumerate(rows)]
    row = peers.entity_rates(cases(spark, rows), SPEC).first()
    assert (row.n, row.pct_relief, row.pct_timely) == (4, 50.0, 50.0)


def test_null_category_and_null_entity(spark):
    rows = company("A", 2, product=None) + company(None, 2) + company("B", 2)
    core = scope.core_scope(cases(spark, rows), SPEC)
    found = {r.company: r.peer_count for r in peers.within_category_deviation(core, SPEC).collect()}
    assert found == {None: 2, "B": 2}


def test_empty_input(spark):
    empty = cases(spark, company("A", 1)).where("false")
    assert peers.within_category_deviation(empty, SPEC).count() == 0
    checks = peers.acceptance_checks(peers.within_category_deviation(empty, SPEC), SPEC)
    assert {r.violations for r in checks.collect()} == {0}


def test_threshold_and_peers_per_quarter(spark):
    first, second = "2024-02-01 00:00:00", "2024-04-01 00:00:00"
    rows = (
        company("A", 2, date_received=first)
        + company("B", 2, date_received=first)
        + company("A", 1, date_received=second)
        + company("B", 2, date_received=second)
    )
    card = peers.within_category_deviation(cases(spark, rows), SPEC, "quarter")
    found = {(r.quarter.month, r.company): r.peer_count for r in card.collect()}
    assert found == {(1, "A"): 2, (1, "B"): 2, (4, "B"): 1}


def test_stddev_rule(spark):
    rows = sum((company(f"ok{i}", 4, relief=2) for i in range(9)), []) + company("low", 4)
    spec = replace(SPEC, flag_rule="stddev")
    found = flags(peers.within_category_deviation(cases(spark, rows), spec))
    assert {c for (_, c), f in found.items() if f == peers.FLAGGED_STDDEV} == {"low"}


def test_unknown_rule_is_refused():
    with pytest.raises(ValueError):
        CaseSpec(flag_rule="mean")


def test_group_stats_equal_windows_over_hot_and_null_groups(spark):
    rows = [("hot", float(i % 7)) for i in range(60)] + [(None, 1.0), (None, 4.0), ("rare", 3.0)]
    groups = spark.createDataFrame(rows, "k string, x double")
    w = Window.partitionBy("k")
    windowed = groups.select(
        "k", "x", F.count("*").over(w).alias("n"), F.median("x").over(w).alias("m")
    )
    joined = rates.with_group_stats(
        groups, ["k"], F.count("*").alias("n"), F.median("x").alias("m")
    )
    assert tuples(joined) == tuples(windowed)


def test_against_brute_force(spark):
    rows = []
    for p, product in enumerate(("Mortgage", "Prepaid card", "Debt collection")):
        for c in range(5 + p):
            relief, late = (c * 7 + p) % 6, (c * 5 + p) % 4
            rows += company(f"c{c}", 6, relief=relief, late=late, product=product)
    card = peers.within_category_deviation(cases(spark, rows), SPEC).collect()
    pct = lambda k, n: round(100.0 * k / n + 1e-9, 1)
    for product in {r["product"] for r in rows}:
        mine = [r for r in rows if r["product"] == product]
        rate = {
            c: pct(
                sum(r["company_response"] == RELIEF for r in mine if r["company"] == c),
                sum(r["company"] == c for r in mine),
            )
            for c in {r["company"] for r in mine}
        }
        median = statistics.median(rate.values())
        for row in (r for r in card if r.product == product):
            assert row.peer_count == len(rate)
            assert row.pct_relief == rate[row.company]
            assert row.cat_median_relief == pytest.approx(median)


def test_naive_view_beside_the_scorecard(spark):
    rows = company("A", 2, relief=1) + company("A", 4, product="Prepaid card") + company("B", 2)
    spec = replace(SPEC, pooled_min_n=3)
    got = tuples(
        peers.stratified_next_to_naive(cases(spark, rows), spec),
        "product", "company", "n", "pct_relief", "pooled_n", "pct_any_relief",
    )
    assert got == [
        ("Mortgage", "A", 2, 50.0, 6, 16.7),
        ("Mortgage", "B", 2, 0.0, None, None),
        ("Prepaid card", "A", 4, 0.0, 6, 16.7),
    ]


def test_checks_report_violations(spark):
    bad = spark.createDataFrame(
        [
            ("Mortgage", "A", 1, 1, 50.0, 50.0, 50.0, 60.0, peers.FLAGGED),
            (SPEC.excluded_categories[0], "B", 5, 3, 50.0, 50.0, 70.0, 70.0, "ok"),
        ],
        "product string, company string, n long, peer_count long, cat_median_relief double, "
        "cat_median_timely double, pct_relief double, pct_timely double, review_flag string",
    )
    found = {r.check: r.violations for r in peers.acceptance_checks(bad, SPEC).collect()}
    assert found == {
        "category_excluded": 1,
        "flag_above_both_medians": 1,
        "flag_without_peer_median": 0,
        "flag_without_peers": 1,
        "group_below_minimum": 1,
        "no_peers_but_judged": 1,
    }


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_result_does_not_depend_on_partitions(spark, conf, partitions):
    rows = sum((company(f"c{i}", 3, relief=i % 4, late=i % 3) for i in range(12)), [])
    expected = tuples(peers.within_category_deviation(cases(spark, rows), SPEC))
    conf(spark__sql__shuffle__partitions=partitions, spark__sql__autoBroadcastJoinThreshold="-1")
    assert tuples(peers.within_category_deviation(cases(spark, rows), SPEC)) == expected


def test_a_category_of_most_entities_is_split_over_tasks(spark, conf):
    """Too large to broadcast: the shuffled join splits the hot category."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2.0",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="8",
    )
    core = spark.range(0, 40_000, 1, 8).selectExpr(
        "if(id % 3 > 0, 'hot', concat('p', id % 7)) AS product",
        "concat('c', id % 9973) AS company",
        "if(id % 5 = 0, 'Closed with monetary relief', 'Untimely response') AS company_response",
        "if(id % 4 = 0, 'No', 'Yes') AS timely",
    )
    card = peers.within_category_deviation(core, replace(SPEC, min_n=1))
    assert "skew=true" in final_plan(card)
    w = Window.partitionBy("product")
    windowed = peers.entity_rates(core, replace(SPEC, min_n=1)).select(
        "product", "company", F.count("*").over(w), F.median("pct_relief").over(w)
    )
    assert tuples(card, "product", "company", "peer_count", "cat_median_relief") == tuples(windowed)
