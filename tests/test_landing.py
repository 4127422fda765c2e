import datetime as dt
import json
import random
from pathlib import Path

import pytest
from helpers import final_plan, tuples
from pyspark.sql import functions as F

from peergauge.operators.landing import keys_in_both, new_rows
from peergauge.operators.scope import keep_snapshot
from peergauge.plans import routes
from peergauge.plans.complaints import complaint_reports, read_cases, register_views
from peergauge.session import shared_dir, write_shared
from peergauge.sources import results, runs, schemas
from peergauge.sources.csv_export import read_csv_export
from peergauge.sources.search_pages import read_search_pages
from peergauge.sources.tables import Landed, by_month, insert_new, read_table, replace_cases
from peergauge.spec import CaseSpec
from peergauge.streaming.landing import dedupe_recent


def write_csv(path, rows, headers=None):
    """A hand-written export: each row maps column names to raw CSV fields."""
    names = schemas.CSV_COLUMNS
    headers = headers or list(names)
    lines = [",".join(headers)]
    for row in rows:
        lines.append(",".join(row.get(names.get(h, h), "") for h in headers))
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def row(i, received="2024-01-15", narrative="", **other):
    return {
        "complaint_id": str(i),
        "date_received": received,
        "date_sent_to_company": received,
        "product": '"Payday loan, title loan"',
        "company": '"Nelnet, Inc."',
        "narrative": narrative,
        **other,
    }


def test_csv_narratives_with_newlines_quotes_and_blanks(spark, tmp_path):
    path = write_csv(
        tmp_path / "a.csv",
        [
            row(1, narrative='"first line\nsecond ""quoted"", with comma"'),
            row(2, narrative=""),
            row(3, narrative='""'),
            row(4, narrative='"   "'),
        ],
    )
    df = read_csv_export(spark, path, keep_narrative=True)
    assert tuples(df, "complaint_id", "has_narrative") == [
        ("1", True), ("2", False), ("3", False), ("4", True),
    ]
    first = df.where("complaint_id = '1'").first()
    assert first.narrative == 'first line\nsecond "quoted", with comma'
    assert (first.product, first.company) == ("Payday loan, title loan", "Nelnet, Inc.")
    assert first.date_received == dt.datetime(2024, 1, 15)


def test_csv_date_range_is_inclusive_and_drops_null_dates(spark, tmp_path):
    days = ["2023-12-31", "2024-01-01", "2024-01-31", "2024-02-01", ""]
    path = write_csv(tmp_path / "a.csv", [row(i, d) for i, d in enumerate(days)])
    df = read_csv_export(spark, path, "2024-01-01", "2024-01-31", snapshot="s")
    assert tuples(df, "complaint_id", "snapshot") == [("1", "s"), ("2", "s")]


def test_csv_columns_are_found_by_header(spark, tmp_path):
    headers = ["ZIP code", *reversed(schemas.CSV_COLUMNS)]
    path = write_csv(tmp_path / "a.csv", [row(7, **{"ZIP code": "90210"})], headers)
    got = read_csv_export(spark, path)
    assert tuples(got, "complaint_id", "company") == [("7", "Nelnet, Inc.")]
    assert [f.name for f in got.schema] == schemas.CASES.names


def test_csv_files_of_another_layout_have_their_own_path(spark, tmp_path):
    turned = ["Extra", *reversed(schemas.CSV_COLUMNS)]
    a = write_csv(tmp_path / "a.csv", [row(1)])
    b = write_csv(tmp_path / "b.csv", [row(2, Extra="e", product="Mortgage")], turned)
    got = read_csv_export(spark, [a, b])
    assert tuples(got, "complaint_id", "product", "company") == [
        ("1", "Payday loan, title loan", "Nelnet, Inc."),
        ("2", "Mortgage", "Nelnet, Inc."),
    ]


@pytest.mark.parametrize("extra", [[], ["Extra"]])
def test_csv_files_of_one_path_must_share_their_header(spark, tmp_path, extra):
    folder = tmp_path / "export"
    folder.mkdir()
    write_csv(folder / "a.csv", [row(1)])
    headers = list(schemas.CSV_COLUMNS)
    headers[1], headers[3] = headers[3], headers[1]
    write_csv(folder / "b.csv", [row(2, Extra="e")], headers + extra)
    with pytest.raises(Exception, match="CSV header|does not conform|MALFORMED|FAILFAST"):
        read_csv_export(spark, str(folder)).collect()


def test_csv_date_that_does_not_parse_fails(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [row(1, "not a date")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv_export(spark, path).collect()


def test_csv_row_with_missing_fields_fails(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [row(1)])
    with open(path, "a") as f:
        f.write("2,2024-01-15\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_csv_export(spark, path).collect()


def hit(i, company="A", text=None, **other):
    source = {
        "complaint_id": i,
        "company": company,
        "state": "CA",
        "date_received": "2024-01-15T12:00:00",
        "complaint_what_happened": text,
        **other,
    }
    return {"_source": {k: v for k, v in source.items() if v is not None}}


def write_page(folder, name, *hits):
    folder.mkdir(exist_ok=True)
    page = {"hits": {"hits": list(hits)}, "_meta": {"break_points": {"2": [1, "x"]}}}
    (folder / name).write_text(json.dumps(page, indent=1))


def test_pages(spark, tmp_path):
    pages = tmp_path / "pages"
    write_page(pages, "p1.json", hit("1", text="t"), hit("2", text=""), hit("3"))
    write_page(pages, "p2.json")
    write_page(pages, "p3.json", hit("1", company="B", text="  "))
    df = read_search_pages(spark, str(pages), "snap")
    assert tuples(df, "complaint_id", "company", "has_narrative", "_position") == [
        ("1", "A", True, 0), ("1", "B", True, 0), ("2", "A", False, 1), ("3", "A", False, 2),
    ]
    assert df.select("date_received", "zip_code", "snapshot").first() == (
        dt.datetime(2024, 1, 15, 12), None, "snap",
    )


@pytest.mark.parametrize(
    "content", ['{"hits": {"hits": [{"_source": {"complaint_id": "1"', '{"error": {"code": 500}}']
)
def test_a_broken_page_fails_the_job(spark, tmp_path, content):
    pages = tmp_path / "pages"
    write_page(pages, "p1.json", hit("1"))
    (pages / "p2.json").write_text(content)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|reports an error"):
        read_search_pages(spark, str(pages)).collect()


def test_landing_pages_first_write_wins_and_reruns_add_nothing(spark, tmp_path):
    pages, table, log = tmp_path / "pages", str(tmp_path / "table"), str(tmp_path / "log")
    write_page(pages, "p1.json", hit("1", company="first"), hit("2"), hit("2", company="later"))
    write_page(pages, "p2.json", hit("1", company="second"))
    window = ("2024-01-01", "2024-01-31")

    landed = routes.land_search_pages(spark, str(pages), table, log, "pull-1", *window)
    assert (landed.fetched, landed.inserted, landed.skipped) == (4, 2, 2)
    kept = tuples(read_cases(spark, table), "complaint_id", "company")
    assert kept == [("1", "first"), ("2", "A")]

    write_page(pages, "p0.json", hit("1", company="too late"), hit("3"), hit("4", state="NY"))
    again = routes.land_search_pages(spark, str(pages), table, log, "pull-2", *window, region="CA")
    assert (again.fetched, again.inserted) == (6, 1)
    assert tuples(read_cases(spark, table), "complaint_id", "company", "snapshot") == [
        ("1", "first", "pull-1"), ("2", "A", "pull-1"), ("3", "A", "pull-2"),
    ]
    assert read_cases(spark, table).where("ingested_at IS NULL").count() == 0

    entries = runs.read_run_log(spark, log)
    assert tuples(entries, "snapshot", "state_filter", "row_count", "inserted", "skipped") == [
        ("pull-1", "ALL", 4, 2, 2), ("pull-2", "CA", 6, 1, 5),
    ]
    assert entries.where("run_at IS NULL").count() == 0


def test_a_null_id_fails_the_batch(spark, tmp_path):
    batch = spark.createDataFrame([(None, 1), ("a", 2)], "id string, place int")
    with pytest.raises(Exception, match="null id in batch"):
        insert_new(batch, str(tmp_path / "t"), "id", ("place",))


def test_a_hot_id_lands_once(spark, tmp_path):
    rows = [("hot", i) for i in range(200)] + [(f"k{i}", i) for i in range(100)]
    batch = spark.createDataFrame(rows, "id string, place int").repartition(6)
    path = str(tmp_path / "t")
    assert insert_new(batch, path, "id", ("place",)).inserted == 101
    assert insert_new(batch, path, "id", ("place",)).inserted == 0
    assert read_table(spark, path, batch.schema).where("id = 'hot'").collect() == [("hot", 0)]


def test_an_empty_batch_lands_nothing(spark, tmp_path):
    batch = spark.createDataFrame([], "id string, place int")
    landed = insert_new(batch, str(tmp_path / "t"), "id", ("place",))
    assert (landed.fetched, landed.inserted, landed.skipped) == (0, 0, 0)


def test_a_month_of_most_rows_is_written_by_several_tasks(spark, conf):
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB")
    stamp = "timestamp_ntz'2024-01-01' + make_dt_interval(if(id % 3 = 0, id % 300, 0))"
    df = spark.range(0, 60_000, 1, 8).selectExpr("id", f"{stamp} AS date_received")
    spread = by_month(df, "date_received")
    assert "skewed" in final_plan(spread)
    sizes = [n for n in spread.rdd.glom().map(len).collect() if n]
    assert max(sizes) < 60_000 / 3


def test_staging_folders_are_removed(spark, tmp_path):
    root = Path(shared_dir(spark).removeprefix("file:")) / "peergauge"
    before = set(root.iterdir()) if root.exists() else set()
    batch = spark.createDataFrame([("a", 1)], "id string, place int")
    insert_new(batch, str(tmp_path / "t"), "id", ("place",))
    assert set(root.iterdir()) == before


def test_a_failed_batch_leaves_no_staging(spark, tmp_path):
    root = Path(shared_dir(spark).removeprefix("file:")) / "peergauge"
    root.mkdir(parents=True, exist_ok=True)
    before = set(root.iterdir())
    batch = spark.createDataFrame([("a", 1), (None, 2)], "id string, place int")
    with pytest.raises(Exception, match="null id"):
        insert_new(batch, str(tmp_path / "t"), "id", ("place",))
    assert set(root.iterdir()) == before


def test_the_target_is_read_in_the_range_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"{i:04}", i) for i in range(900)]
    target = spark.createDataFrame(rows, "id string, place int")
    insert_new(target.repartition(3), path, "id", ("place",))
    batch = spark.createDataFrame(rows[300:310] + [("0315x", 1)], "id string, place int")
    known = keys_in_both(spark.read.parquet(path), write_shared(batch, "batch"), "id")
    assert known.count() == 10
    pushed = known._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,0300), LessThanOrEqual(id,0315x)" in pushed
    assert insert_new(batch, path, "id", ("place",)).inserted == 1
    import pyarrow.parquet as pq

    for file in Path(path).glob("*.parquet"):
        ids = pq.read_table(file, columns=["id"]).column(0).to_pylist()
        assert ids == sorted(ids)
    empty = batch.limit(0)
    assert insert_new(empty, path, "id", ("place",)).fetched == 0


def test_the_target_is_filtered_before_any_shuffle(spark):
    """The batch's keys are broadcast to the target, whichever of the two is larger."""
    target = write_shared(spark.range(200_000).selectExpr("cast(id AS string) AS id"), "target")
    rows = [("5", 1), ("x", 2)]
    batch = write_shared(spark.createDataFrame(rows, "id string, v int"), "batch")
    known = keys_in_both(target, batch, "id")
    assert tuples(known) == [("5",)]
    assert "LeftSemi, BuildRight" in final_plan(known)
    assert "SortMergeJoin" not in final_plan(known)
    fresh = new_rows(batch, target, "id")
    assert tuples(fresh) == [("x", 2)]


def test_a_batch_too_large_to_broadcast_gives_the_same(spark, conf):
    target = spark.range(500).selectExpr("cast(id AS string) AS id")
    batch = spark.range(400, 600).selectExpr("cast(id AS string) AS id", "id AS v")
    expected = [(str(i), i) for i in range(500, 600)]
    assert tuples(new_rows(batch, target, "id")) == expected
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )
    fresh = new_rows(batch, target, "id")
    assert tuples(fresh) == expected
    assert "Broadcast" not in final_plan(fresh)


def test_stream_equals_batch(spark, tmp_path):
    pages = tmp_path / "pages"
    for n in range(4):
        hits = [hit(str(i % 7), company=f"{n}-{i}") for i in range(n, n + 6)]
        write_page(pages, f"p{n}.json", *hits)
    log = str(tmp_path / "log")
    batch, stream = str(tmp_path / "batch"), str(tmp_path / "stream")
    routes.land_search_pages(spark, str(pages), batch, log, "s", "2024-01-01", "2024-12-31")

    def follow(per_batch):
        paths = (str(pages), stream, log + "-stream", str(tmp_path / "state"))
        routes.follow_search_pages(
            spark, *paths, "s", "2024-01-01", "2024-12-31", files_per_batch=per_batch
        ).awaitTermination()

    follow(None)
    columns = ("complaint_id", "company", "snapshot")
    assert tuples(read_cases(spark, stream), *columns) == tuples(read_cases(spark, batch), *columns)
    write_page(pages, "p9.json", hit("1", company="late"), hit("new"))
    follow(1)
    got = {r.complaint_id: r.company for r in read_cases(spark, stream).collect()}
    assert got["new"] == "A" and got["1"] != "late" and len(got) == 8
    follow(1)
    assert read_cases(spark, stream).count() == 8
    entries = runs.read_run_log(spark, log + "-stream")
    assert tuples(entries, "row_count", "inserted") == [(2, 1), (24, 7)]


def test_earlier_pages_win_however_they_are_named(spark, tmp_path):
    """By time of landing, then by number; a stream of one page per batch agrees."""
    import os

    pages = tmp_path / "pages"
    write_page(pages, "page-10.json", hit("1", company="ten"), hit("2", company="ten"))
    write_page(pages, "page-2.json", hit("1", company="two"), hit("1", company="again"))
    write_page(pages, "page-1.json", hit("2", company="late"))
    for name, when in (("page-10.json", 1000), ("page-2.json", 1000), ("page-1.json", 2000)):
        os.utime(pages / name, (when, when))
    window = ("s", "2024-01-01", "2024-12-31")
    batch, stream, log = (str(tmp_path / x) for x in ("batch", "stream", "log"))
    routes.land_search_pages(spark, str(pages), batch, log, *window)
    expected = [("1", "two"), ("2", "ten")]
    assert tuples(read_cases(spark, batch), "complaint_id", "company") == expected
    paths = (str(pages), stream, log, str(tmp_path / "state"))
    routes.follow_search_pages(spark, *paths, *window).awaitTermination()
    assert tuples(read_cases(spark, stream), "complaint_id", "company") == expected


def test_a_replayed_batch_is_logged_once_with_its_true_counts(spark, tmp_path):
    log = str(tmp_path / "log")
    for landed in (Landed(5, 3), Landed(5, 0)):
        runs.append_run_log(spark, log, "s", "a", "b", landed, batch="state#0")
    runs.append_run_log(spark, log, "s", "a", "b", Landed(2, 2), batch="state#1")
    entries = runs.read_run_log(spark, log)
    assert tuples(entries, "batch", "row_count", "inserted", "skipped") == [
        ("state#0", 5, 3, 2),
        ("state#1", 2, 2, 0),
    ]


def test_a_missing_case_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_cases(spark, str(tmp_path / "nowhere")).collect()


def test_replayed_stream_adds_nothing(spark, tmp_path):
    pages, table = tmp_path / "pages", str(tmp_path / "table")
    write_page(pages, "p1.json", hit("1"), hit("2"))
    for state in ("state-a", "state-b"):
        paths = (str(pages), table, str(tmp_path / "log"), str(tmp_path / state))
        routes.follow_search_pages(
            spark, *paths, "s", "2024-01-01", "2024-12-31"
        ).awaitTermination()
    assert read_cases(spark, table).count() == 2


def test_recent_duplicates_of_a_stream(spark, tmp_path):
    pages = tmp_path / "in"
    df = spark.createDataFrame(
        [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")],
        "id string, ts string",
    ).select("id", F.col("ts").cast("timestamp").alias("ts"))
    df.write.parquet(str(pages))
    stream = spark.readStream.schema(df.schema).parquet(str(pages))
    query = (
        dedupe_recent(stream, "id", "ts", "1 hour")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_csv_route_replaces_table_and_facts(spark, tmp_path):
    table, meta = str(tmp_path / "table"), str(tmp_path / "meta")
    path = write_csv(tmp_path / "a.csv", [row(i, "2024-01-0" + str(i)) for i in range(1, 5)])
    runs.put_run_meta(spark, meta, {"owner": "me"})
    args = (spark, path, table, meta)
    assert routes.load_csv_export(*args, "2024-01-01", "2024-01-04", "first") == 4
    assert routes.load_csv_export(*args, "2024-01-01", "2024-01-02", "second") == 2
    assert tuples(runs.read_run_meta(spark, meta)) == [
        ("date_from", "2024-01-01"),
        ("date_to", "2024-01-02"),
        ("owner", "me"),
        ("pulled_on", "second"),
        ("row_count", "2"),
    ]
    routes.load_csv_export(*args, "2024-01-01", "2024-01-02")
    facts = dict(tuples(runs.read_run_meta(spark, meta)))
    assert facts["pulled_on"] == dt.date.today().isoformat()


def test_a_failed_reload_keeps_the_old_table(spark, tmp_path):
    table, meta = str(tmp_path / "table"), str(tmp_path / "meta")
    good = write_csv(tmp_path / "a.csv", [row(1), row(2)])
    bad = write_csv(tmp_path / "b.csv", [row(3), row(4, "2024-13-99")])
    window = ("2024-01-01", "2024-12-31")
    routes.load_csv_export(spark, good, table, meta, *window, "good")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        routes.load_csv_export(spark, bad, table, meta, *window, "bad")
    assert spark.read.parquet(table).count() == 2
    assert dict(tuples(runs.read_run_meta(spark, meta)))["pulled_on"] == "good"


def test_a_reload_that_fails_while_writing_keeps_the_old_table(spark, tmp_path):
    table = tmp_path / "table"
    rows = spark.range(10).withColumn("date_received", F.lit("2024-01-15").cast("timestamp_ntz"))
    replace_cases(rows, str(table))
    bad = F.when(F.col("id") == 7, F.raise_error(F.lit("broken row"))).otherwise(F.col("id"))
    with pytest.raises(Exception, match="broken row"):
        replace_cases(rows.withColumn("id", bad), str(table))
    assert spark.read.parquet(str(table)).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["table"]
    replace_cases(rows.where("id < 3"), str(table))
    assert spark.read.parquet(str(table)).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_a_purge_rewrites_its_own_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("1", "keep"), ("2", "old"), ("3", "keep")]
    df = spark.createDataFrame(rows, "id string, snapshot string").withColumn(
        "date_received", F.lit("2024-01-15").cast("timestamp_ntz")
    )
    replace_cases(df, path)
    replace_cases(keep_snapshot(spark.read.parquet(path), CaseSpec(), "keep"), path)
    assert tuples(spark.read.parquet(path), "id") == [("1",), ("3",)]


def test_export_is_one_sorted_file_with_header(spark, tmp_path):
    out = tmp_path / "extract"
    rows = [("b, x", 2.5), ('a "q"', 2.5), ("c", 1.0)]
    df = spark.createDataFrame(rows, "product string, r double")
    results.export_extract(df.repartition(3), str(out), "r", "product")
    files = list(out.glob("*.csv"))
    assert len(files) == 1
    assert files[0].read_text() == 'product,r\nc,1.0\n"a ""q""",2.5\n"b, x",2.5\n'


@pytest.mark.parametrize("single_file", [True, False])
def test_the_caller_says_whether_an_export_is_one_file(spark, tmp_path, conf, single_file):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    out = tmp_path / "extract"
    rows = spark.range(0, 5000, 1, 4)
    results.export_extract(rows, str(out), "id", single_file=single_file)
    parts = [p.read_text().splitlines()[1:] for p in sorted(out.glob("*.csv"))]
    assert (len(parts) == 1) == single_file
    assert [int(x) for part in parts for x in part] == list(range(5000))


def test_results_round_trip(spark, tmp_path):
    rows = [("1", 'a "b", c', "x\ny", True), ("2", "d", None, False)]
    df = spark.createDataFrame(rows, schemas.SCORED)
    for as_csv in (True, False):
        path = str(tmp_path / f"r{as_csv}")
        results.write_results(df, path, as_csv)
        back = (
            results.read_results_csv(spark, path, schemas.SCORED)
            if as_csv
            else spark.read.parquet(path)
        )
        assert tuples(back) == tuples(df)


def test_results_with_another_header_are_refused(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("complaint_id,product_predicted,product_official,match\n1,a,b,True\n")
    with pytest.raises(Exception, match="CSV header"):
        results.read_results_csv(spark, str(path), schemas.SCORED).collect()


def test_reports_on_a_landed_table(spark, tmp_path):
    pages, table = tmp_path / "pages", str(tmp_path / "table")
    relief = "Closed with monetary relief"
    hits = [
        hit(
            f"{c}{i}",
            company=c,
            text="t" if i % 2 else None,
            product="Student loan",
            sub_product="Federal",
            timely="Yes" if c == "MOHELA" or i % 2 else "No",
            company_response=relief if i < 4 else "Closed with explanation",
            date_sent_to_company="2024-01-16T00:00:00",
        )
        for c in ("MOHELA", "B", "C")
        for i in range(20)
    ]
    write_page(pages, "p.json", *hits)
    log = str(tmp_path / "log")
    routes.land_search_pages(spark, str(pages), table, log, "s", "2024-01-01", "2024-12-31")
    df = read_cases(spark, table)
    register_views(df)
    assert spark.table("complaints_core").count() == 60
    reports = complaint_reports(df)
    rows = {name: report.collect() for name, report in reports.items()}
    assert {r.company: (r.n, r.pct_timely, r.pct_relief) for r in rows["pilot_scorecard"]} == {
        "MOHELA": (20, 100.0, 20.0), "B": (20, 50.0, 20.0), "C": (20, 50.0, 20.0),
    }
    assert [r.review_flag for r in rows["scorecard"]] == ["ok"] * 3
    assert rows["lead_time"][0].median_route_days == 1.0
    assert rows["duplicate_id_count"][0][0] == 0
    assert all(r.violations == 0 for r in rows["acceptance_checks"])
    assert {r.grp for r in rows["subject_vs_rest"]} == {"MOHELA", "all others"}


def test_random_batches_land_like_a_dictionary(spark, tmp_path):
    """First write wins within and across batches, whatever the tasks and the hot key."""
    rng = random.Random(3)
    path, expected = str(tmp_path / "t"), {}
    for batch_no in range(4):
        rows = [
            ("hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}", place, f"{batch_no}-{place}")
            for place in range(120)
        ]
        new = {}
        for key, _, value in rows:
            new.setdefault(key, value)
        fresh = {k: v for k, v in new.items() if k not in expected}
        batch = spark.createDataFrame(rows, "id string, place int, v string").repartition(3)
        landed = insert_new(batch, path, "id", ("place",))
        assert (landed.fetched, landed.inserted) == (120, len(fresh))
        expected.update(fresh)
    got = read_table(spark, path, batch.schema)
    assert {r.id: r.v for r in got.collect()} == expected
    assert got.count() == len(expected)
