"""Fixed schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, STAMP = T.StringType(), T.TimestampNTZType()


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(name, TEXT) for name in names]


# Canonical case table; both landing routes end in it.
# Names of the columns.
CASES = T.StructType(
    [
        *_texts("complaint_id", "product", "sub_product", "issue", "sub_issue"),
        *_texts("company", "state", "zip_code"),
        T.StructField("date_received", STAMP),
        T.StructField("date_sent_to_company", STAMP),
        *_texts("company_response", "timely", "consumer_disputed", "submitted_via"),
        T.StructField("has_narrative", T.BooleanType()),
        *_texts("consumer_consent_provided", "tags", "snapshot"),
    ]
)

# As stored: stamped with the time of the write.
STORED_CASES = T.StructType([*CASES.fields, T.StructField("ingested_at", T.TimestampType())])

# Headers of the bulk CSV export, with our column names.
CSV_COLUMNS = {
    "Complaint ID": "complaint_id",
    "Date received": "date_received",
    "Date sent to company": "date_sent_to_company",
    "Product": "product",
    "Sub-product": "sub_product",
    "Issue": "issue",
    "Sub-issue": "sub_issue",
    "Company": "company",
    "State": "state",
    "Company response to consumer": "company_response",
    "Timely response?": "timely",
    "Consumer disputed?": "consumer_disputed",
    "Consumer consent provided?": "consumer_consent_provided",
    "Consumer complaint narrative": "narrative",
    "Tags": "tags",
    "Submitted via": "submitted_via",
}

# Fields of one hit on a search page.
PAGE_FIELDS = (
    "complaint_id",
    "product",
    "sub_product",
    "issue",
    "sub_issue",
    "company",
    "state",
    "zip_code",
    "date_received",
    "date_sent_to_company",
    "company_response",
    "timely",
    "consumer_disputed",
    "submitted_via",
    "complaint_what_happened",
)

# Fields by which a page says that the request failed.
PAGE_ERRORS = ("error", "non_field_errors")

_HITS = T.ArrayType(T.StructType().add("_source", T.StructType(_texts(*PAGE_FIELDS))))
PAGE = T.StructType(
    [T.StructField("hits", T.StructType().add("hits", _HITS)), *_texts(*PAGE_ERRORS)]
)

RUN_LOG = T.StructType(
    [
        *_texts("snapshot", "date_from", "date_to", "state_filter"),
        T.StructField("row_count", T.LongType()),
        T.StructField("inserted", T.LongType()),
        T.StructField("skipped", T.LongType()),
        T.StructField("run_at", T.TimestampType()),
        *_texts("batch"),
    ]
)

RUN_META = T.StructType([*_texts("key", "value"), T.StructField("run_at", T.TimestampType())])

SAMPLE = T.StructType(_texts("complaint_id", "product", "narrative"))

# Names of the columns.
SCORED = T.StructType(
    [
        *_texts("complaint_id", "product_official", "product_predicted"),
        T.StructField("match", T.BooleanType()),
    ]
)

# Names of the columns.
CENSUS = T.StructType(
    _texts("complaint_id", "date_received", "company", "issue", "sub_product", "narrative")
)

JUDGED = T.StructType(
    _texts("complaint_id", "date_received", "probe_a_category", "probe_b_belongs", "verdict")
)
