"""The named queries once more in plain SQL, to check the results against another engine."""

from __future__ import annotations

from peergauge.functions.text import BLANKS
from peergauge.plans.bindings import (
    HOME_LABEL,
    HOME_REGION,
    NARRATIVE_QUANTITY,
    ONE_CATEGORY,
    ORDER_CASES,
    OTHER_LABEL,
    PROMPT_DAYS,
    PULL_CEILING,
    QUARTER_MIN_N,
    SUBJECT,
)
from peergauge.spec import RELIEF_OUTCOMES

_CASES = f"""
cases AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS complaint_id,
         p_type AS product, p_brand AS sub_product, s_name AS company, n_name AS state,
         o_orderdate AS date_received, l_shipdate AS date_sent_to_company,
         CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'Closed with monetary relief'
              WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'Closed with non-monetary relief'
              WHEN l_returnflag = 'N' THEN 'Untimely response'
              ELSE 'Closed with explanation' END AS company_response,
         CASE WHEN date_diff('day', o_orderdate, l_shipdate) <= {PROMPT_DAYS}
              THEN 'Yes' ELSE 'No' END AS timely,
         l_quantity >= {NARRATIVE_QUANTITY} AS has_narrative,
         CAST(NULL AS VARCHAR) AS consumer_disputed
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
)"""
_CORE = f"""{_CASES},
core AS (SELECT * FROM cases WHERE product <> '{ORDER_CASES.excluded_categories[0]}')"""

_LANDED_CORE = f"""{_CASES},
landed AS (
  SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY date_received, product,
                               company, company_response, timely) AS place
  FROM cases
),
core AS (
  SELECT * FROM landed
  WHERE place = 1 AND product <> '{ORDER_CASES.excluded_categories[0]}'
)"""

_RELIEF_SET = ", ".join(f"'{outcome}'" for outcome in RELIEF_OUTCOMES)
_RELIEF = f"count(*) FILTER (WHERE company_response IN ({_RELIEF_SET}))"
_TIMELY = "count(*) FILTER (WHERE timely = 'Yes')"


def _pct(part: str, whole: str = "count(*)") -> str:
    return f"round(100.0 * {part} / {whole}, 1)"


_BY_RATE = f"{_pct(_TIMELY)} AS pct_timely, {_pct(_RELIEF)} AS pct_relief"


def _scorecard(
    min_n: int = ORDER_CASES.min_n,
    period: str = "",
    rule: str = "quartile",
    where: str = "",
    core: str = _CORE,
) -> str:
    lead = f"{period}, " if period else ""
    truncated = f"date_trunc('{period}', date_received) AS {period}, " if period else ""
    peers = f"PARTITION BY {lead}product"
    if rule == "quartile":
        relief_limit = f"quantile_cont(pct_relief, 0.25) OVER ({peers})"
        timely_limit = f"quantile_cont(pct_timely, 0.25) OVER ({peers})"
        label = "FLAG - bottom quartile in category"
    else:
        relief_limit, timely_limit = (
            f"median({rate}) OVER ({peers}) - 2.0 * stddev_samp({rate}) OVER ({peers})"
            for rate in ("pct_relief", "pct_timely")
        )
        label = "FLAG - far below category median"
    return f"""
WITH {core},
pairs AS (
  SELECT {truncated}product, company, count(*) AS n, {_BY_RATE}
  FROM core GROUP BY ALL HAVING count(*) >= {min_n}
),
judged AS (
  SELECT *, count(*) OVER ({peers}) AS peer_count,
         median(pct_relief) OVER ({peers}) AS cat_median_relief,
         median(pct_timely) OVER ({peers}) AS cat_median_timely,
         {relief_limit} AS relief_limit, {timely_limit} AS timely_limit
  FROM pairs
)
SELECT {lead}product, company, n, peer_count, pct_relief, cat_median_relief,
       round(pct_relief - cat_median_relief, 1) AS relief_deviation,
       pct_timely, cat_median_timely,
       round(pct_timely - cat_median_timely, 1) AS timely_deviation,
       CASE WHEN peer_count < 2 THEN 'NO PEER SET - not comparable'
            WHEN pct_relief < relief_limit OR pct_timely < timely_limit THEN '{label}'
            ELSE 'ok' END AS review_flag
FROM judged {where}"""


_LINES = """
lines AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS complaint_id, l_shipdate, l_partkey,
         l_suppkey, l_quantity, l_extendedprice, l_linestatus
  FROM lineitem
)"""
_LINE_RANK = """row_number() OVER (PARTITION BY complaint_id ORDER BY l_shipdate, l_partkey,
         l_suppkey, l_quantity, l_extendedprice, l_linestatus)"""
_LINE_COLUMNS = (
    "complaint_id, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linestatus"
)
_BATCHES = f"""{_LINES},
finished AS (
  SELECT * FROM (SELECT *, {_LINE_RANK} AS place FROM lines WHERE l_linestatus = 'F')
  WHERE place = 1
),
fresh AS (
  SELECT * FROM (SELECT *, {_LINE_RANK} AS place FROM lines WHERE l_linestatus = 'O')
  WHERE place = 1 AND complaint_id NOT IN (SELECT complaint_id FROM finished)
)"""

_BLANKS = " || ".join(f"chr({ord(c)})" for c in BLANKS)


def _strip(column: str) -> str:
    return f"trim({column}, {_BLANKS})"


_SCORED = f"""
scored AS (
  SELECT d.doc_id,
         coalesce(CASE WHEN toxic = 0 THEN '{HOME_LABEL}' WHEN toxic <> 0 THEN '{OTHER_LABEL}' END,
                  lang) AS product_official,
         CASE WHEN quality = 1 THEN '{HOME_LABEL}'
              WHEN quality <> 1 THEN '{OTHER_LABEL}' END AS product_predicted
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
_MATCH = "product_official IS NOT DISTINCT FROM product_predicted"

_JUDGED = f"""
answers AS (
  SELECT d.doc_id,
         CASE WHEN l.doc_id IS NULL THEN 'API_FAILURE'
              WHEN l.doc_id % 50 = 0 THEN 'UNPARSEABLE::no idea'
              WHEN quality = 1 THEN '{HOME_LABEL}'
              ELSE '{OTHER_LABEL}' END AS probe_a_category,
         CASE WHEN toxic = 1 THEN 'NO' WHEN toxic = 0 THEN 'YES'
              ELSE 'API_FAILURE' END AS probe_b_belongs
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
judged AS (
  SELECT *, CASE
      WHEN probe_a_category LIKE 'UNPARSEABLE%' OR probe_a_category = 'API_FAILURE'
        OR probe_b_belongs = 'API_FAILURE' THEN 'unusable'
      WHEN probe_a_category <> '{HOME_LABEL}' AND probe_b_belongs = 'NO'
        THEN 'misroute_both_probes'
      WHEN probe_a_category <> '{HOME_LABEL}' OR probe_b_belongs = 'NO'
        THEN 'misroute_one_probe'
      ELSE 'belongs' END AS verdict
  FROM answers
)"""

_GATED = f"""
gated AS (
  SELECT doc_id, lang, source, {_strip("text")} AS text FROM documents
  WHERE length({_strip("text")}) >= 50
)"""
_SAMPLE = f"""{_GATED},
sample AS (
  SELECT doc_id, lang FROM (
    SELECT doc_id, lang, row_number() OVER (
      PARTITION BY lang ORDER BY md5(concat('20260709-', doc_id)), doc_id) AS place FROM gated)
  WHERE place <= 50
)"""

_WEEKS = """
bounds AS (
  SELECT CAST(min({ts}) AS DATE) AS d0, CAST(max({ts}) AS DATE) AS d1 FROM {source}
),
spine AS (
  SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 7 DAY)) AS DATE) AS slice_from, d1
  FROM bounds
),
weeks AS (
  SELECT slice_from, least(CAST(slice_from + INTERVAL 6 DAY AS DATE), d1) AS slice_to FROM spine
),
weekly AS (
  SELECT slice_from, slice_to, count({ts}) AS n
  FROM weeks LEFT JOIN {source}
    ON CAST({ts} AS DATE) >= slice_from AND CAST({ts} AS DATE) <= slice_to
  GROUP BY slice_from, slice_to
)"""


def _weeks(source: str, ts: str) -> str:
    return _WEEKS.format(source=source, ts=ts)


_CHECKS = {
    "category_excluded": f"product = '{ORDER_CASES.excluded_categories[0]}'",
    "flag_without_peer_median": "review_flag LIKE 'FLAG%' AND (cat_median_relief IS NULL "
    "OR cat_median_timely IS NULL)",
    "flag_above_both_medians": "review_flag LIKE 'FLAG%' AND pct_relief >= cat_median_relief "
    "AND pct_timely >= cat_median_timely",
    "flag_without_peers": "review_flag LIKE 'FLAG%' AND peer_count < 2",
    "group_below_minimum": f"n < {ORDER_CASES.min_n}",
    "no_peers_but_judged": "peer_count < 2 AND review_flag NOT LIKE 'NO PEER%'",
}
_PROBED = ("product", "company", "date_received", "company_response", "consumer_disputed")
_DOC_DAY = "CAST(DATE '1995-01-01' + CAST(doc_id % 3650 AS INTEGER) AS DATE)"
_LANDED = f"""CAST(doc_id AS VARCHAR) AS complaint_id, lang AS product, source AS company,
  CAST({_DOC_DAY} AS TIMESTAMP) AS date_received,
  CAST({_DOC_DAY} + 1 AS TIMESTAMP) AS date_sent_to_company,
  length(text) > 0 AS has_narrative, CAST(NULL AS VARCHAR) AS state,
  CAST(NULL AS VARCHAR) AS tags"""
_SUBJECT = f"CASE WHEN company = '{SUBJECT}' THEN '{SUBJECT}' ELSE 'all others' END"

_SHARES = ", ".join(
    f"{_pct(c, 'nullif(usable, 0)')} AS pct_{c}" for c in ("both_probes", "one_probe", "belongs")
)

ORACLE: dict[str, str] = {
    "kpi_within_category": _scorecard(),
    "kpi_within_category_quarter": _scorecard(QUARTER_MIN_N, "quarter"),
    "kpi_quarter_maintained": _scorecard(QUARTER_MIN_N, "quarter", core=_LANDED_CORE),
    "kpi_stddev_rule": _scorecard(rule="stddev"),
    "kpi_pilot_category": _scorecard(where=f"WHERE product = '{ONE_CATEGORY}'"),
    "acceptance_checks": f"WITH card AS ({_scorecard()})\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"check\", count(*) FILTER (WHERE {rule}) AS violations, "
        "count(*) AS rows_checked FROM card"
        for name, rule in _CHECKS.items()
    ),
    "naive_next_to_stratified": f"""
WITH card AS ({_scorecard()}),
{_CORE.strip()},
pooled AS (
  SELECT company AS pooled_company, count(*) AS pooled_n, {_pct(_TIMELY)} AS pct_any_timely,
         {_pct(_RELIEF)} AS pct_any_relief
  FROM core GROUP BY company HAVING count(*) >= {ORDER_CASES.pooled_min_n}
)
SELECT card.*, pooled_n, pct_any_timely, pct_any_relief
FROM card LEFT JOIN pooled ON company = pooled_company""",
    "naive_subject_vs_rest": f"""
WITH {_CORE}
SELECT {_SUBJECT} AS grp, company_response, count(*) AS n,
       round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {_SUBJECT}), 1) AS pct
FROM core GROUP BY 1, 2""",
    "outcome_distribution": f"""
WITH {_CORE}
SELECT company_response, count(*) AS n, {_pct("count(*)", "sum(count(*)) OVER ()")} AS pct
FROM core GROUP BY 1""",
    "favourable_rate_by_category": f"""
WITH {_CORE} SELECT product, count(*) AS n, {_pct(_RELIEF)} AS pct_relief FROM core GROUP BY 1""",
    "timely_rate_by_category": f"""
WITH {_CORE} SELECT product, count(*) AS total, {_pct(_TIMELY)} AS pct_timely
FROM core GROUP BY 1""",
    "timely_rate_by_entity": f"""
WITH {_CORE} SELECT company, count(*) AS total, {_pct(_TIMELY)} AS pct_timely
FROM core GROUP BY 1""",
    "rate_spread": f"""
WITH {_CORE},
rated AS (SELECT product, {_pct(_RELIEF)} AS r FROM core GROUP BY 1),
ends AS (SELECT *, row_number() OVER (ORDER BY r, product) AS up,
                row_number() OVER (ORDER BY r DESC, product DESC) AS down FROM rated)
SELECT a.product AS lowest, a.r AS lowest_rate, b.product AS highest, b.r AS highest_rate,
       round(b.r / nullif(a.r, 0), 1) AS spread, (SELECT count(*) FROM rated) AS n_groups
FROM ends a, ends b WHERE a.up = 1 AND b.down = 1""",
    "category_scorecard": f"""
WITH {_CORE} SELECT company, count(*) AS n, {_BY_RATE} FROM core
WHERE product = '{ONE_CATEGORY}' GROUP BY 1 HAVING count(*) >= {ORDER_CASES.min_n}""",
    "pooled_entity_rate": f"""
WITH {_CORE} SELECT company, count(*) AS n, {_pct(_RELIEF)} AS pct_any_relief
FROM core GROUP BY 1 HAVING count(*) >= {ORDER_CASES.pooled_min_n}""",
    "lead_time_by_category": f"""
WITH {_CORE},
gaps AS (SELECT product, date_diff('day', date_received, date_sent_to_company) AS d FROM core)
SELECT product, CAST(median(d) AS DOUBLE) AS median_route_days,
       CAST(quantile_cont(d, 0.9) AS DOUBLE) AS p90_route_days,
       {_pct("count(*) FILTER (WHERE d = 0)")} AS pct_same_day, count(*) AS n
FROM gaps GROUP BY 1""",
    "core_scope": f"WITH {_CORE} SELECT complaint_id, product, company FROM core",
    "source_filter": f"""
WITH {_CASES}
SELECT complaint_id, product, state, date_received, has_narrative FROM cases
WHERE date_received >= TIMESTAMP '1996-01-01' AND date_received < TIMESTAMP '1997-07-01'
  AND state = '{HOME_REGION}' AND product = '{ONE_CATEGORY}' AND has_narrative""",
    "snapshot_purge": "SELECT doc_id, lang, source FROM documents WHERE source = 'src7'",
    "snapshot_purge_stored": "SELECT doc_id, lang, source FROM documents WHERE source = 'src7'",
    "dq_coverage": f"""
WITH {_CASES}
SELECT min(date_received) AS earliest, max(date_received) AS latest, count(*) AS total_rows,
       count(DISTINCT complaint_id) AS distinct_ids FROM cases""",
    "dq_null_counts": f"""
WITH {_CASES}
SELECT count(*) FILTER (WHERE date_received IS NULL) AS null_date_received,
       count(*) FILTER (WHERE date_sent_to_company IS NULL) AS null_date_sent,
       count(*) FILTER (WHERE product IS NULL) AS null_product,
       count(*) FILTER (WHERE company IS NULL) AS null_company,
       count(*) FILTER (WHERE company_response IS NULL) AS null_response,
       count(*) FILTER (WHERE timely IS NULL) AS null_timely
FROM cases""",
    "dq_populated_pct": f"WITH {_CASES}\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS field, count({c}) AS populated, {_pct(f'count({c})')} AS pct_populated "
        "FROM cases"
        for c in _PROBED
    ),
    "dq_dead_columns": f"WITH {_CASES}\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS field, count({c}) AS populated, count({c}) = 0 AS dead, "
        f"count(DISTINCT {c}) = 1 AS constant FROM cases"
        for c in _PROBED
    ),
    "dq_monthly_volume": f"""
WITH {_CASES} SELECT date_trunc('month', date_received) AS month, count(*) AS n
FROM cases GROUP BY 1""",
    "dq_duplicate_ids": f"""
WITH {_CASES} SELECT complaint_id, count(*) AS n FROM cases GROUP BY 1 HAVING count(*) > 1""",
    "dq_duplicate_id_count": f"""
WITH {_CASES} SELECT count(*) AS duplicate_id_count FROM (
  SELECT complaint_id FROM cases GROUP BY 1 HAVING count(*) > 1)""",
    "dq_bursts": f"""
WITH {_CASES} SELECT company, product, date_received, count(*) AS n FROM cases
GROUP BY 1, 2, 3 HAVING count(*) > 2 ORDER BY n DESC, company, product, date_received LIMIT 20""",
    "dq_bursts_by_day": """
SELECT user_id, event_type, date_trunc('day', ts) AS ts, count(*) AS n FROM events
GROUP BY ALL HAVING count(*) > 2 ORDER BY n DESC, user_id, event_type, 3 LIMIT 20""",
    "dq_narrative_share": f"""
WITH {_CASES} SELECT has_narrative, count(*) AS n,
       {_pct("count(*)", "sum(count(*)) OVER ()")} AS pct FROM cases GROUP BY 1""",
    "dq_narrative_by_category": f"""
WITH {_CASES} SELECT product, count(*) AS total,
       count(*) FILTER (WHERE has_narrative) AS with_narrative,
       {_pct("count(*) FILTER (WHERE has_narrative)")} AS pct_with_narrative
FROM cases GROUP BY 1""",
    "dq_narrative_by_state": f"""
WITH {_CASES} SELECT state, count(*) AS total,
       {_pct("count(*) FILTER (WHERE has_narrative)")} AS pct_with_narrative
FROM cases WHERE state IS NOT NULL GROUP BY 1 ORDER BY total DESC, state LIMIT 15""",
    "dq_first_last_seen": f"""
WITH {_CASES} SELECT product, min(date_received) AS first_seen, max(date_received) AS last_seen,
       count(*) AS n FROM cases GROUP BY 1""",
    "dq_sub_first_last_seen": f"""
WITH {_CASES} SELECT product, sub_product, min(date_received) AS first_seen,
       max(date_received) AS last_seen, count(*) AS n
FROM cases WHERE sub_product IS NOT NULL GROUP BY 1, 2""",
    "dq_cutover": f"""
WITH {_CASES},
seen AS (
  SELECT product, sub_product, min(date_received) AS first_seen,
         max(date_received) AS last_seen, count(*) AS n
  FROM cases GROUP BY 1, 2
),
months AS (
  SELECT product, sub_product, date_trunc('month', date_received) AS month, count(*) AS full_n
  FROM cases GROUP BY 1, 2, 3
),
usual AS (SELECT product, sub_product, median(full_n) AS usual_n FROM months GROUP BY 1, 2),
edges AS (
  SELECT seen.*, usual_n, coalesce(full_n, 0) AS full_n,
         date_diff('day', min(first_seen) OVER (), first_seen) > 14 AS late,
         date_diff('day', last_seen, max(last_seen) OVER ()) > 14 AS early,
         date_trunc('month', last_seen) > date_trunc('month', first_seen) AS has_full
  FROM seen JOIN usual USING (product, sub_product)
  LEFT JOIN months ON months.product = seen.product AND months.sub_product = seen.sub_product
    AND month = date_trunc('month', last_seen) - INTERVAL 1 MONTH
)
SELECT product, sub_product, first_seen, last_seen, n,
       CASE WHEN late AND early THEN 'appears and disappears'
            WHEN late THEN 'appears mid-window' WHEN early THEN 'disappears mid-window'
            ELSE 'spans window' END AS drift,
       CASE WHEN early AND has_full AND full_n < usual_n / 2 THEN 'tapers'
            WHEN early THEN 'cut off' END AS ending
FROM edges""",
    "dq_successors": """
WITH rows AS (
  SELECT CASE WHEN p_brand LIKE '%1' AND o_orderdate >= TIMESTAMP '1997-06-01'
                OR p_brand LIKE '%2' AND o_orderdate >= TIMESTAMP '1998-01-01'
              THEN p_brand || ' new' ELSE p_brand END AS c,
         l_partkey AS f, o_orderdate AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
profile AS (SELECT c, f, count(*) AS n FROM rows GROUP BY 1, 2),
seen AS (SELECT c, count(*) AS total, min(t) AS first, max(t) AS last FROM rows GROUP BY 1),
edges AS (SELECT min(first) AS opens, max(last) AS closes FROM seen),
ended AS (SELECT seen.* FROM seen, edges WHERE date_diff('day', last, closes) > 60),
begun AS (SELECT seen.* FROM seen, edges WHERE date_diff('day', opens, first) > 60),
alike AS (
  SELECT e.c AS ended, e.last AS last_seen, b.c AS begun, b.first AS first_seen,
         round(sum(least(x.n / e.total, y.n / b.total)), 6) AS overlap
  FROM ended e JOIN begun b ON e.c <> b.c AND abs(date_diff('day', e.last, b.first)) <= 60
  JOIN profile x ON x.c = e.c JOIN profile y ON y.c = b.c AND y.f = x.f
  GROUP BY 1, 2, 3, 4
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ended ORDER BY overlap DESC, begun) AS of_ended,
         row_number() OVER (PARTITION BY begun ORDER BY overlap DESC, ended) AS of_begun
  FROM alike WHERE overlap >= 0.3
)
SELECT ended, last_seen, begun, first_seen, overlap FROM ranked
WHERE of_ended = 1 AND of_begun = 1""",
    "dq_volume_segments": f"""
WITH RECURSIVE {_CASES},
counts AS (
  SELECT product, date_trunc('month', date_received) AS m, count(*) AS n FROM cases
  WHERE product IS NOT NULL AND date_received IS NOT NULL GROUP BY 1, 2
),
span AS (SELECT min(m) AS f, date_diff('month', min(m), max(m)) + 1 AS months FROM counts),
grid AS (
  SELECT c.product, g.i, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT product FROM counts) c, span, generate_series(0, months - 1) AS g(i)
  LEFT JOIN counts ON counts.product = c.product AND m = f + to_months(CAST(g.i AS INT))
),
running AS (
  SELECT product, i, CAST(sum(n) OVER w AS DOUBLE) AS p, CAST(sum(n * n) OVER w AS DOUBLE) AS q
  FROM grid WINDOW w AS (PARTITION BY product ORDER BY i)
),
setup AS (
  SELECT product, f, months, p, q,
         3.0::DOUBLE * (p[months + 1] / months) * ln(CAST(months AS DOUBLE)) AS charge
  FROM (SELECT product, [0.0::DOUBLE] || list(p ORDER BY i) AS p,
               [0.0::DOUBLE] || list(q ORDER BY i) AS q FROM running GROUP BY 1), span
),
steps AS (
  SELECT product, 0 AS t, [0.0::DOUBLE] AS best, CAST([] AS INT[]) AS cuts FROM setup
  UNION ALL
  SELECT product, t + 1, best || [list_min(costs)],
         cuts || [CAST(list_position(costs, list_min(costs)) - 1 AS INT)]
  FROM (
    SELECT steps.product, t, best, cuts, list_transform(range(0, t + 1), lambda s:
             best[s + 1] + ((q[t + 2] - q[s + 1])
               - (p[t + 2] - p[s + 1]) * (p[t + 2] - p[s + 1]) / (t + 1 - s)) + charge) AS costs
    FROM steps JOIN setup ON steps.product = setup.product WHERE t < months
  )
),
back AS (
  SELECT steps.product, CAST(months AS INT) AS ending, cuts FROM steps, span WHERE t = months
  UNION ALL
  SELECT product, cuts[ending], cuts FROM back WHERE ending > 0
)
SELECT back.product,
       CAST(row_number() OVER (PARTITION BY back.product ORDER BY ending) AS INT) AS segment,
       CAST(f + to_months(cuts[ending]) AS DATE) AS month_from,
       CAST(f + to_months(ending - 1) AS DATE) AS month_to,
       ending - cuts[ending] AS n_months,
       round((p[ending + 1] - p[cuts[ending] + 1]) / (ending - cuts[ending]), 2) AS mean_n
FROM back JOIN setup ON back.product = setup.product WHERE ending > 0""",
    "dq_sliding_bursts": """
WITH ends AS (SELECT DISTINCT event_type, date_trunc('second', ts) AS s FROM events)
SELECT e.event_type, s - INTERVAL 3599 SECOND AS window_from, s AS window_to, count(*) AS n
FROM ends e JOIN events v ON v.event_type = e.event_type
  AND date_trunc('second', v.ts) BETWEEN s - INTERVAL 3599 SECOND AND s
GROUP BY 1, 2, 3 HAVING count(*) > 5 ORDER BY n DESC, 1, s LIMIT 20""",
    "amount_quantiles_by_category": """
SELECT p_type AS product, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 2) AS p50,
       round(quantile_cont(l_extendedprice, 0.9), 2) AS p90
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "classified_with_retries": """
SELECT doc_id, CASE WHEN contains(text, 'the') THEN ' en' || chr(10)
                    WHEN contains(text, 'ou') THEN 'FR' ELSE 'API_FAILURE' END AS answer
FROM documents""",
    "dq_gaps": f"""
WITH {_CASES},
months AS (
  SELECT unnest(generate_series(date_trunc('month', min(date_received)),
                                date_trunc('month', max(date_received)),
                                INTERVAL 1 MONTH)) AS month FROM cases
),
volumes AS (
  SELECT CAST(month AS TIMESTAMP) AS month, coalesce(v.n, 0) AS n FROM months LEFT JOIN (
    SELECT date_trunc('month', date_received) AS m, count(*) AS n FROM cases GROUP BY 1) v
  ON month = m
)
SELECT month, n, round(n / median(n) OVER (), 2) AS ratio_to_median,
       CASE WHEN n = 0 THEN 'missing' WHEN n / median(n) OVER () < 0.8 THEN 'low'
            ELSE 'ok' END AS volume
FROM volumes""",
    "dq_week_gaps": f"""
WITH {_weeks("events", "ts")}
SELECT slice_from, n, round(n / median(n) OVER (), 2) AS ratio_to_median,
       CASE WHEN n = 0 THEN 'missing' WHEN n / median(n) OVER () < 0.5 THEN 'low'
            ELSE 'ok' END AS volume
FROM weekly""",
    "dq_capped_weeks": f"""
WITH {_weeks("events", "ts")}
SELECT slice_from, slice_to, n, n >= 2330 AS capped FROM weekly""",
    "dq_pull_plan": f"""
WITH RECURSIVE
moments AS (
  SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, count(*) AS n FROM events
  WHERE ts IS NOT NULL GROUP BY 1
),
days AS (
  SELECT min(t) // 86400 * 86400 AS first, max(t) // 86400 * 86400 + 86399 AS last FROM moments
),
weeks AS (
  SELECT low, least(low + 7 * 86400 - 1, last) AS high
  FROM days, generate_series(first, last, 7 * 86400) AS s(low)
),
halves AS (
  SELECT low, high, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
  FROM weeks LEFT JOIN moments ON t BETWEEN low AND high GROUP BY low, high
  UNION ALL
  SELECT h.low, h.high, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS n
  FROM (
    SELECT low, (low + high) // 2 AS high FROM halves WHERE n >= {PULL_CEILING} AND low < high
    UNION ALL
    SELECT (low + high) // 2 + 1, high FROM halves WHERE n >= {PULL_CEILING} AND low < high
  ) h LEFT JOIN moments m ON t BETWEEN h.low AND h.high GROUP BY h.low, h.high
)
SELECT TIMESTAMP '1970-01-01' + to_seconds(low) AS slice_from,
       TIMESTAMP '1970-01-01' + to_seconds(high) AS slice_to, n,
       CASE WHEN n >= {PULL_CEILING} THEN 'cannot be split' ELSE 'ok' END AS status
FROM halves WHERE n < {PULL_CEILING} OR low = high""",
    "dq_provisional": """
SELECT date_trunc('day', ts) AS day,
       ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS provisional, count(*) AS n
FROM events GROUP BY ALL""",
    "dq_scope_violations": f"""
WITH {_CASES} SELECT state, count(*) AS n FROM cases WHERE state <> '{HOME_REGION}' GROUP BY 1""",
    "distinct_categories": f"WITH {_CORE} SELECT DISTINCT product FROM core",
    "week_slices": f"""
WITH {_weeks("orders", "o_orderdate")}
SELECT slice_from, slice_to, date_diff('day', slice_from, slice_to) + 1 AS days FROM weeks""",
    "rows_per_week": f"""
WITH {_weeks("orders", "o_orderdate")} SELECT slice_from, slice_to, n FROM weekly""",
    "ingest_first_wins": f"""
WITH {_LINES}
SELECT {_LINE_COLUMNS}, copies FROM (
  SELECT *, count(*) OVER (PARTITION BY complaint_id) AS copies, {_LINE_RANK} AS place FROM lines)
WHERE place = 1""",
    "ingest_anti_join": f"WITH {_BATCHES} SELECT {_LINE_COLUMNS} FROM fresh",
    "ingest_landed": f"""
WITH {_BATCHES} SELECT {_LINE_COLUMNS} FROM finished
UNION ALL SELECT {_LINE_COLUMNS} FROM fresh""",
    "ingest_run_log": f"""
WITH {_BATCHES},
runs AS (
  SELECT 'finished' AS snapshot, (SELECT count(*) FROM lines WHERE l_linestatus = 'F') AS fetched,
         (SELECT count(*) FROM finished) AS inserted
  UNION ALL
  SELECT 'open', (SELECT count(*) FROM lines WHERE l_linestatus = 'O'),
         (SELECT count(*) FROM fresh)
)
SELECT snapshot, '1995-01-01' AS date_from, '2001-12-31' AS date_to, 'ALL' AS state_filter,
       fetched AS row_count, inserted, fetched - inserted AS skipped FROM runs""",
    "ingest_run_meta": """
SELECT * FROM (VALUES ('owner', 'orders'), ('pulled_on', 'second'), ('date_from', '1995-01-01'),
                      ('date_to', '2001-12-31')) t(key, value)
UNION ALL SELECT 'row_count', CAST(count(*) AS VARCHAR) FROM orders""",
    "full_reload_by_month": f"""
WITH {_CASES} SELECT complaint_id, company, date_received FROM cases
WHERE date_received >= TIMESTAMP '1996-02-10' AND date_received < TIMESTAMP '1996-04-21'""",
    "stream_landing_keyed": """
SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
WHERE place = 1""",
    "stream_landing": """
SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
WHERE place = 1""",
    "csv_export_load": f"""
SELECT {_LANDED} FROM documents WHERE {_DOC_DAY} BETWEEN DATE '1995-06-01' AND DATE '2001-06-30'""",
    "search_page_load": f"SELECT {_LANDED} FROM documents",
    "census_route": f"""
WITH firsts AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) AS place FROM documents
  WHERE lang = 'en' AND text <> ''
    AND {_DOC_DAY} BETWEEN DATE '1995-06-01' AND DATE '2001-06-30'
)
SELECT CAST(doc_id // 2 AS VARCHAR) AS complaint_id,
       CAST(CAST({_DOC_DAY} AS TIMESTAMP) AS VARCHAR) AS date_received, source AS company,
       CAST(NULL AS VARCHAR) AS issue, CAST(NULL AS VARCHAR) AS sub_product,
       {_strip("text")} AS narrative
FROM firsts WHERE place = 1 AND length({_strip("text")}) >= 50""",
    "dq_page_drift": """
WITH hits AS (SELECT *, doc_id // 100 AS page FROM documents),
fields AS (
  SELECT page, unnest([
    {'field': 'complaint_id', 'kind': 'text', 'there': TRUE},
    {'field': 'product', 'kind': 'text', 'there': lang IS NOT NULL},
    {'field': 'company', 'kind': 'text', 'there': source IS NOT NULL},
    {'field': 'date_received', 'kind': 'text', 'there': TRUE},
    {'field': 'date_sent_to_company', 'kind': 'text', 'there': TRUE},
    {'field': 'complaint_what_happened', 'kind': 'text', 'there': text IS NOT NULL},
    {'field': 'zip_code', 'kind': CASE WHEN page % 2 = 1 THEN 'number' ELSE 'text' END, 'there': TRUE},
    {'field': 'reviewer', 'kind': 'object', 'there': page >= 2}
  ]) AS f FROM hits
)
SELECT f.field AS field, f.kind AS kind, f.field <> 'reviewer' AS known, count(*) AS n_hits,
       min(page) AS first_page, max(page) AS last_page
FROM fields WHERE f.there GROUP BY f.field, f.kind""",
    "text_gate": f"WITH {_GATED} SELECT doc_id, lang, substring(text, 1, 6000) AS text FROM gated",
    "narrative_census": f"""
WITH firsts AS (
  SELECT concat_ws('/', source, lang) AS id, doc_id, {_strip("text")} AS text,
         count(*) OVER (PARTITION BY source, lang) AS copies,
         row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS place
  FROM documents
)
SELECT id, doc_id, text, copies FROM firsts WHERE place = 1 AND length(text) >= 50""",
    "stratified_sample": f"WITH {_SAMPLE} SELECT doc_id, lang FROM sample",
    "sample_with_text": f"""
WITH {_SAMPLE} SELECT s.doc_id, s.lang, d.text, d.source
FROM sample s JOIN documents d ON s.doc_id = d.doc_id""",
    "score_rows": f"""
WITH {_SCORED} SELECT doc_id, product_official, product_predicted, {_MATCH} AS match FROM scored""",
    "score_overall": f"""
WITH {_SCORED} SELECT count(*) FILTER (WHERE {_MATCH}) AS agree, count(*) AS n,
       {_pct(f"count(*) FILTER (WHERE {_MATCH})")} AS pct_agree FROM scored""",
    "score_by_category": f"""
WITH {_SCORED} SELECT product_official, count(*) AS n, count(*) FILTER (WHERE {_MATCH}) AS agree,
       {_pct(f"count(*) FILTER (WHERE {_MATCH})")} AS pct_agree FROM scored GROUP BY 1""",
    "confusion": f"""
WITH {_SCORED} SELECT product_official, product_predicted, count(*) AS n FROM scored
WHERE NOT ({_MATCH}) GROUP BY 1, 2""",
    "results_csv": f"""
WITH {_SCORED} SELECT CAST(doc_id AS VARCHAR) AS complaint_id, product_official,
       product_predicted, {_MATCH} AS match FROM scored""",
    "extract_export": f"""
WITH {_CORE} SELECT product, count(*) AS n, {_pct(_RELIEF)} AS pct_relief FROM core GROUP BY 1""",
    "probe_verdicts": f"""
WITH {_JUDGED} SELECT doc_id, probe_a_category, probe_b_belongs, verdict FROM judged""",
    "probe_summary": f"""
WITH {_JUDGED},
counts AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE verdict <> 'unusable') AS usable,
         count(*) FILTER (WHERE verdict = 'misroute_both_probes') AS both_probes,
         count(*) FILTER (WHERE verdict = 'misroute_one_probe') AS one_probe,
         count(*) FILTER (WHERE verdict = 'belongs') AS belongs
  FROM judged
)
SELECT *, {_SHARES} FROM counts""",
    "probe_distribution": f"""
WITH {_JUDGED} SELECT probe_a_category, count(*) AS n FROM judged GROUP BY 1""",
    "label_normalise": """
SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'purchase' THEN 'Purchase'
         WHEN 'signup' THEN 'Signup' WHEN 'view' THEN 'View'
         ELSE 'UNPARSEABLE::' || CASE WHEN event_id % 2 = 1 THEN upper(event_type)
                                      ELSE event_type END END AS label
FROM events""",
    "yes_no_normalise": """
SELECT event_id, CASE event_type WHEN 'click' THEN 'YES' WHEN 'purchase' THEN 'YES'
         WHEN 'view' THEN 'NO' WHEN 'signup' THEN concat('UNPARSEABLE::perhaps ', event_id)
         ELSE 'API_FAILURE' END AS belongs
FROM events""",
    "evaluation_by_category": f"""
WITH {_SAMPLE},
answered AS (
  SELECT lang AS product_official, CASE WHEN contains(d.text, 'the') THEN 'en'
         WHEN contains(d.text, 'ou') THEN 'fr' END AS product_predicted
  FROM sample JOIN gated d USING (doc_id, lang)
)
SELECT product_official, count(*) AS n, count(*) FILTER (WHERE {_MATCH}) AS agree,
       {_pct(f"count(*) FILTER (WHERE {_MATCH})")} AS pct_agree FROM answered GROUP BY 1""",
    "audit_summary": f"""
WITH answers AS (
  SELECT CASE WHEN contains(text, 'the') THEN 'home' WHEN contains(text, 'ou') THEN 'away' END AS a,
         CASE WHEN contains(text, 'en') THEN 'YES' WHEN contains(text, 'an') THEN 'NO' END AS b
  FROM documents
),
counts AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS usable,
         count(*) FILTER (WHERE a = 'away' AND b = 'NO') AS both_probes,
         count(*) FILTER (WHERE (a = 'away' AND b = 'YES')
                             OR (a = 'home' AND b = 'NO')) AS one_probe,
         count(*) FILTER (WHERE a = 'home' AND b = 'YES') AS belongs
  FROM answers
)
SELECT *, {_SHARES} FROM counts""",
    "apply_classifier": f"""
SELECT doc_id, CASE WHEN contains(text, 'the') THEN '{HOME_LABEL}'
                    WHEN contains(text, 'ou') THEN '{OTHER_LABEL}' END AS label
FROM documents""",
}
