"""Small case tables and plan inspection."""

import contextlib
import io

from pyspark.sql import functions as F

CASE_SCHEMA = (
    "complaint_id string, product string, sub_product string, company string, state string, "
    "date_received timestamp_ntz, date_sent_to_company timestamp_ntz, company_response string, "
    "timely string, has_narrative boolean, consumer_disputed string, snapshot string"
)
DEFAULTS = {
    "complaint_id": "1",
    "product": "Mortgage",
    "sub_product": "FHA",
    "company": "A",
    "state": "CA",
    "date_received": "2024-01-10 08:00:00",
    "date_sent_to_company": "2024-01-10 09:00:00",
    "company_response": "Closed with explanation",
    "timely": "Yes",
    "has_narrative": False,
    "consumer_disputed": None,
    "snapshot": "s1",
}


def cases(spark, rows):
    """A case table; each row names only what differs from the defaults."""
    full = [{**DEFAULTS, "complaint_id": str(i), **row} for i, row in enumerate(rows)]
    text = CASE_SCHEMA.replace("timestamp_ntz", "string")
    df = spark.createDataFrame([tuple(r[k] for k in DEFAULTS) for r in full], text)
    return df.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("date_received", "date_sent_to_company")}
    )


def tuples(df, *columns):
    return sorted(
        (tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr
    )


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def final_plan(df):
    """The executed plan, subqueries included, without the plans adaptive execution began with."""
    df.collect()
    kept, hidden = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if hidden is not None and depth > hidden:
            continue
        hidden = depth - 1 if "== Initial Plan ==" in line else None
        if hidden is None:
            kept.append(line)
    return "\n".join(kept)
