"""Every report on a complaint table, as landed by ``plans/routes.py``.

Use it with your own table::

    cases = read_cases(spark, "/data/complaints")
    reports = complaint_reports(cases)
    reports["scorecard"].show()
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peergauge.operators import peers, quality, rates, scope
from peergauge.sources.schemas import STORED_CASES
from peergauge.sources.tables import read_table
from peergauge.spec import CaseSpec

# The category of the pilot, and the entity of the pooled comparison.
PILOT_CATEGORY = "Student loan"
PILOT_SUBJECT = "MOHELA"

CASES_VIEW, CORE_VIEW = "complaints_raw", "complaints_core"

# Name of the null count -> the field it is about.
KPI_FIELDS = {
    "null_date_received": "date_received",
    "null_date_sent": "date_sent_to_company",
    "null_product": "product",
    "null_company": "company",
    "null_response": "company_response",
    "null_timely": "timely",
}


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The case table as landed; a path that does not exist is an error."""
    return read_table(spark, path, STORED_CASES, must_exist=True)


def register_views(cases: DataFrame, spec: CaseSpec | None = None) -> None:
    """Name the table and its analysis scope for SQL."""
    cases.createOrReplaceTempView(CASES_VIEW)
    scope.core_scope(cases, spec or CaseSpec(), CORE_VIEW)


def complaint_reports(
    cases: DataFrame,
    spec: CaseSpec | None = None,
    pilot: str = PILOT_CATEGORY,
    subject: str = PILOT_SUBJECT,
    home_region: str = "CA",
) -> dict[str, DataFrame]:
    """All reports by name; none runs before it is asked for rows."""
    spec = spec or CaseSpec()
    core = scope.core_scope(cases, spec)
    by_name, by_size = scope.ordered, F.desc("n")
    category, entity, received = spec.category, spec.entity, spec.received
    named_sub = cases.where(F.col(spec.sub_category).isNotNull())
    named_region = cases.where(F.col(spec.region).isNotNull())
    sub_keys = [category, spec.sub_category]
    relief = rates.favourable_rate(core, spec, [category])
    card = peers.within_category_deviation(core, spec)
    pilot_card = by_name(rates.category_scorecard(core, spec, pilot), "pct_relief", entity)
    return {
        # Data quality
        "coverage": quality.coverage(cases, spec),
        "monthly_volume": by_name(quality.volume_by_period(cases, received), "month"),
        "null_counts": quality.null_counts(cases, KPI_FIELDS),
        "populated": quality.populated_pct(cases, cases.columns),
        "dead_columns": quality.dead_columns(core, ["consumer_disputed"]),
        "duplicate_ids": by_name(
            quality.duplicate_keys(cases, spec.case_id), by_size, spec.case_id
        ),
        "duplicate_id_count": quality.duplicate_key_count(cases, spec.case_id),
        "bursts": quality.burst_clusters(cases, [entity, category], received),
        "narrative_share": rates.share_of_total(cases, [spec.has_text]),
        "narrative_by_category": by_name(
            quality.text_share(cases, spec, [category]), F.desc("total"), category
        ),
        "narrative_by_region": scope.top_k(
            quality.text_share(named_region, spec, [spec.region]).drop("with_narrative"),
            15,
            "total",
            [spec.region],
        ),
        "first_last_seen": by_name(
            quality.first_last_seen(cases, [category], received), "first_seen", category
        ),
        "sub_first_last_seen": by_name(
            quality.first_last_seen(named_sub, sub_keys, received), category, "first_seen"
        ),
        "cutover": quality.category_cutover(named_sub, sub_keys, received),
        "gaps": quality.volume_gaps(cases, received),
        "capped_weeks": quality.capped_slices(cases, received),
        "scope_violations": quality.scope_violations(cases, spec.region, home_region),
        # Outcomes
        "outcomes": by_name(rates.share_of_total(core, [spec.outcome]), by_size, spec.outcome),
        "relief_by_category": by_name(relief, "pct_relief", category),
        "relief_spread": rates.rate_spread(relief, "pct_relief", category),
        "subject_vs_rest": by_name(
            rates.subject_against_rest(core, spec, subject), "grp", by_size, spec.outcome
        ),
        "pilot_scorecard": pilot_card,
        "pooled_relief_by_entity": by_name(
            rates.pooled_entity_rate(core, spec), "pct_any_relief", entity
        ),
        "timely_by_category": by_name(
            rates.timely_rate(core, spec, [category]), "pct_timely", category
        ),
        "lead_time": by_name(
            rates.lead_time(core, spec, [category]), F.desc("median_route_days"), category
        ),
        # Comparison with peers
        "scorecard": by_name(card, category, "pct_relief", "pct_timely", entity),
        "scorecard_by_quarter": peers.within_category_deviation(core, spec, "quarter"),
        "scorecard_next_to_pooled": peers.stratified_next_to_naive(core, spec),
        "acceptance_checks": peers.acceptance_checks(card, spec),
    }
