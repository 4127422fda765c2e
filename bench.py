"""Time the headline queries and print one JSON line.

Settings come from the environment: BENCH_SF_DIR (directory of the tables) and
BENCH_CPUS (local threads). Every query runs to its end into a sink that
discards the rows. The first round over all queries is cold; of the following
rounds each query's best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from peergauge.plans.reports import REPORTS
from peergauge.session import build_session

HEADLINE = (
    "kpi_within_category",
    "kpi_within_category_quarter",
    "naive_next_to_stratified",
    "naive_subject_vs_rest",
    "outcome_distribution",
    "favourable_rate_by_category",
    "timely_rate_by_category",
    "category_scorecard",
    "lead_time_by_category",
    "dq_coverage",
    "dq_null_counts",
    "dq_monthly_volume",
    "dq_duplicate_ids",
    "dq_bursts",
    "dq_narrative_by_state",
    "dq_sub_first_last_seen",
    "dq_gaps",
    "ingest_first_wins",
    "ingest_anti_join",
    "text_gate",
    "stratified_sample",
    "sample_with_text",
    "score_by_category",
    "confusion",
    "probe_summary",
    "label_normalise",
    "apply_classifier",
    "ingest_landed",
    "full_reload_by_month",
    "stream_landing",
    "csv_export_load",
    "evaluation_by_category",
    "audit_summary",
)
WARM_ROUNDS = 2


def run_once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    REPORTS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    rounds = []
    for _ in range(1 + WARM_ROUNDS):
        rounds.append({name: round(run_once(spark, name, sf_dir), 3) for name in HEADLINE})
    spark.stop()
    cold, *warm = rounds
    seconds = {name: min(times[name] for times in warm) for name in HEADLINE}
    for name in HEADLINE:
        print(f"{name}: cold {cold[name]} warm {seconds[name]}", file=sys.stderr)
    result = {
        "metric": "total_warm_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
