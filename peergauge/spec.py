"""What a case table looks like and which rules the comparison follows."""

from __future__ import annotations

from dataclasses import dataclass

# Outcomes that count as relief for the consumer.
RELIEF_OUTCOMES = (
    "Closed with monetary relief",
    "Closed with non-monetary relief",
)

# Fixed value: the product whose volume drowns all others.
DOMINANT_PRODUCT = "Credit reporting or other personal consumer reports"

# The closed set of product labels a classifier may answer with.
PRODUCT_LABELS = (
    "Checking or savings account",
    "Credit card",
    "Debt collection",
    "Debt or credit management",
    "Money transfer, virtual currency, or money service",
    "Mortgage",
    "Payday loan, title loan, personal loan, or advance loan",
    "Prepaid card",
    "Student loan",
    "Vehicle loan or lease",
)

QUARTILE = "quartile"
STDDEV = "stddev"


@dataclass(frozen=True)
class CaseSpec:
    """Column names, thresholds and outcome sets of one case table.

    The defaults describe the complaint table; any other table of cases is
    served by naming its columns here (see ``plans/bindings.py``).
    """

    case_id: str = "complaint_id"
    category: str = "product"
    sub_category: str = "sub_product"
    entity: str = "company"
    region: str = "state"
    received: str = "date_received"
    routed: str = "date_sent_to_company"
    outcome: str = "company_response"
    timely: str = "timely"
    timely_value: str = "Yes"
    has_text: str = "has_narrative"
    snapshot: str = "snapshot"
    # Column of the number of cases a row stands for; None: every row is one case.
    weight: str | None = None

    favourable: tuple[str, ...] = RELIEF_OUTCOMES
    excluded_categories: tuple[str, ...] = (DOMINANT_PRODUCT,)

    min_n: int = 20
    pooled_min_n: int = 200
    flag_rule: str = QUARTILE
    flag_stddevs: float = 2.0

    def __post_init__(self) -> None:
        if self.flag_rule not in (QUARTILE, STDDEV):
            raise ValueError(f"unknown flag rule {self.flag_rule!r}")
        if not self.favourable:
            raise ValueError("favourable outcome set is empty")
        if self.min_n < 1 or self.pooled_min_n < 1:
            raise ValueError("minimum group sizes start at 1")
