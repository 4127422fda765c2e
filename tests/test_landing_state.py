"""What landing keeps beside the table: key filters, counts, keyed state; purges and pull plans."""

import datetime as dt
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import cases, plan, tuples
from pyspark.sql import functions as F

from peergauge.operators.peers import within_category_deviation
from peergauge.operators.scope import core_scope
from peergauge.operators.slices import pull_plan
from peergauge.plans import reports
from peergauge.session import list_folders
from peergauge.sources import key_filters, tables
from peergauge.sources.counts import read_counts, scorecard_from_counts, update_counts
from peergauge.sources.key_filters import add_filters, any_in, filter_of, near_files
from peergauge.sources.ledgers import data_files
from peergauge.sources.tables import insert_new, purge_cases, read_table, replace_cases
from peergauge.spec import CaseSpec
from peergauge.streaming.landing import land_keyed_stream


def random_ids(rng, n):
    return [f"{rng.getrandbits(64):016x}" for _ in range(n)]


def id_table(spark, ids):
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, place int")


def test_filters_miss_no_key_and_pass_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        bits = filter_of(keys)
        assert all(any_in(bits, n, keys[i : i + 1]) for i in range(n))
        others = rng.integers(0, 2**63, 2000).astype(np.uint64)
        assert sum(any_in(bits, n, others[i : i + 1]) for i in range(2000)) <= 1


def test_filters_are_built_and_tried_in_little_memory():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 2**20).astype(np.int64)
    files = pa.array(["f"] * 2**14)
    batches = [
        pa.RecordBatch.from_arrays([files, pa.array(part)], ["file", "hash"])
        for part in np.split(hashes, 64)
    ]
    bits = filter_of(hashes[:1000].view(np.uint64))
    tracemalloc.start()
    try:
        counts = [b.column("keys")[0].as_py() for b in key_filters._build()(iter(batches))]
        built = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        assert any_in(bits, 1000, hashes[::-1].view(np.uint64))
        tried = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(counts) == len(hashes)
    assert built < 32 * 2**20 and tried < 12 * 2**20


def test_a_batch_of_random_ids_reads_the_files_of_its_repeats_only(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "t")
    table = id_table(spark, random_ids(rng, 6000))
    table.repartition(15).write.parquet(path)
    files = data_files(spark, path)
    assert add_filters(spark, path, table.schema["id"]) == len(files) == 15
    assert add_filters(spark, path, table.schema["id"]) == 0
    one = sorted(files.values())[7]
    repeats = [r.id for r in spark.read.parquet(one).limit(3).collect()]
    batch = id_table(spark, repeats + random_ids(rng, 300))
    near = near_files(spark, path, batch, "id")
    every, read = (spark.read.parquet(*f).count() for f in (files.values(), near))
    assert every >= 10 * read > 0
    result = insert_new(batch, path, "id", ("place",))
    assert (result.inserted, result.skipped) == (300, 3)
    assert near_files(spark, path, id_table(spark, random_ids(rng, 50)), "id") == []


def test_filters_only_save_reading(spark, tmp_path, monkeypatch):
    """Files without filters are read, large batches read all, small filters are several per file."""
    rng, path = random.Random(6), str(tmp_path / "t")
    ids = random_ids(rng, 500)
    id_table(spark, ids[:200]).repartition(3).write.parquet(path)
    assert len(near_files(spark, path, id_table(spark, ["x"]), "id")) == len(data_files(spark, path))
    monkeypatch.setattr(key_filters, "FILTER_KEYS", 16)
    assert insert_new(id_table(spark, ids[100:300]), path, "id", ("place",)).inserted == 100
    assert near_files(spark, path, id_table(spark, ["x"]), "id") == []
    monkeypatch.setattr(tables, "MOST_TRIED", 10)
    assert insert_new(id_table(spark, ids), path, "id", ("place",)).inserted == 200
    got = [r.id for r in spark.read.parquet(path).collect()]
    assert sorted(got) == sorted(ids)


SPEC = CaseSpec(min_n=2, excluded_categories=("Noise",))
RELIEF = "Closed with monetary relief"


def random_cases(spark, rng, n, first=0, snapshot="s"):
    rows = [
        {
            "complaint_id": str(first + rng.randrange(n)),
            "product": rng.choice(["Card", "Loan", "Noise", None]),
            "company": rng.choice(["A", "B", "C"]),
            "date_received": f"2024-{rng.randrange(1, 13):02}-15 10:00:00",
            "company_response": rng.choice([RELIEF, "x", None]),
            "timely": rng.choice(["Yes", "No"]),
            "snapshot": snapshot,
        }
        for _ in range(n)
    ]
    return cases(spark, rows)


def recomputed(spark, path):
    core = core_scope(spark.read.parquet(path), SPEC)
    return tuples(within_category_deviation(core, SPEC, "quarter"))


def test_kept_counts_equal_a_full_recount(spark, tmp_path):
    rng, path = random.Random(7), str(tmp_path / "t")
    assert update_counts(spark, path, SPEC) == 0
    batches = [random_cases(spark, rng, 80, 50 * i, f"pull-{i}") for i in range(3)]
    for batch in (*batches, batches[1]):
        insert_new(batch, path, "complaint_id", ("date_received",), "date_received")
        update_counts(spark, path, SPEC)
        assert update_counts(spark, path, SPEC) == 0
    assert tuples(scorecard_from_counts(spark, path, SPEC)) == recomputed(spark, path)
    assert len(recomputed(spark, path)) > 5
    other = CaseSpec(min_n=2, excluded_categories=())
    update_counts(spark, path, other)
    assert tuples(scorecard_from_counts(spark, path, SPEC)) == recomputed(spark, path)

    purge_cases(spark, path, F.col("snapshot") != "pull-1")
    update_counts(spark, path, SPEC)
    assert tuples(scorecard_from_counts(spark, path, SPEC)) == recomputed(spark, path)
    replace_cases(batches[2], path)
    update_counts(spark, path, SPEC)
    assert tuples(scorecard_from_counts(spark, path, SPEC)) == recomputed(spark, path)


def test_counts_of_a_table_out_of_scope_are_none(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_cases(cases(spark, [{"product": "Noise"}, {"product": None}]), path)
    assert update_counts(spark, path, SPEC) > 0
    assert update_counts(spark, path, SPEC) == 0
    assert read_counts(spark, path, SPEC).collect() == []


def dated(spark, rows):
    df = spark.createDataFrame(rows, "id string, day string, snapshot string")
    return df.withColumn("date_received", F.col("day").cast("timestamp_ntz")).drop("day")


MONTHS = [
    ("1", "2024-01-10", "old"),
    ("2", "2024-01-11", "keep"),
    ("3", "2024-02-10", "keep"),
    ("4", "2024-03-10", "old"),
    ("5", None, None),
    ("6", None, "keep"),
]


def files_by_month(path):
    found = {}
    for file in Path(path).rglob("*.parquet"):
        found.setdefault(file.parent.name, set()).add(file.name)
    return found


def test_a_purge_rewrites_the_months_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_cases(dated(spark, MONTHS), path)
    before = files_by_month(path)
    keep = F.col("snapshot") == "keep"
    assert purge_cases(spark, path, keep) == 3
    after = files_by_month(path)
    february = "received_month=2024-02-01"
    assert after[february] == before[february]
    assert not after["received_month=2024-01-01"] & before["received_month=2024-01-01"]
    assert "received_month=2024-03-01" not in after
    assert tuples(spark.read.parquet(path), "id") == [("2",), ("3",), ("6",)]
    assert purge_cases(spark, path, keep) == 0
    assert all(f.startswith("received_month=") for f in list_folders(spark, path))


def test_a_purge_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    replace_cases(dated(spark, MONTHS), path)
    before = files_by_month(path)
    bad = F.when(F.col("id") == "2", F.raise_error(F.lit("broken"))).otherwise(True)
    with pytest.raises(Exception, match="broken"):
        purge_cases(spark, path, bad)
    assert files_by_month(path) == before
    moves, move = [], tables.move_path

    def stops(spark, source, target):
        moves.append(source)
        if len(moves) == 3:
            raise OSError("stopped")
        return move(spark, source, target)

    monkeypatch.setattr(tables, "move_path", stops)
    with pytest.raises(OSError, match="stopped"):
        purge_cases(spark, path, F.col("snapshot") == "keep")
    assert files_by_month(path) == before


def test_the_next_purge_undoes_one_that_was_killed(spark, tmp_path):
    path = tmp_path / "t"
    replace_cases(dated(spark, MONTHS), str(path))
    (path / "_purged-x").mkdir()
    (path / "received_month=2024-01-01").rename(path / "_purged-x" / "received_month=2024-01-01")
    assert purge_cases(spark, str(path), F.col("snapshot") == "keep") == 3
    assert tuples(spark.read.parquet(str(path)), "id") == [("2",), ("3",), ("6",)]


def test_a_keyed_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, at timestamp_ntz, v string, n long, _file string"

    def land(*rows):
        made = [(i, dt.datetime(2024, m, 1), v, n, f) for i, m, v, n, f in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = land_keyed_stream(
            stream, path, str(tmp_path / "state"), "id", ("_file",), "at", "stamped"
        )
        query.awaitTermination()
        assert query.exception() is None
        got = read_table(spark, path, spark.read.parquet(path).schema)
        assert got.where("stamped is null").count() == 0
        return tuples(got, "id", "v", "n")

    land(("a", 1, "late", 1, "p2"), ("a", 1, "first", 2, "p1"), ("b", 2, "x", 2**52 + 1, "p1"))
    got = land(("a", 1, "again", 1, "p0"), ("c", 3, None, 5, "p9"), ("c", 3, "z", 4, "p9"))
    assert got == [("a", "first", 2), ("b", "x", 2**52 + 1), ("c", None, 5)]
    assert land(("b", 1, "more", 1, "p0")) == got
    state = list((tmp_path / "state" / "state").rglob("*.zip"))
    assert state, "keys are kept by RocksDB"
    with pytest.raises(Exception, match="null id"):
        land((None, 1, "x", 1, "p"))


def events(spark, stamps):
    df = spark.createDataFrame([(s,) for s in stamps], "ts string")
    return df.select(F.col("ts").cast("timestamp_ntz").alias("ts"))


def test_pull_plans_cover_the_time_below_the_ceiling(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 3, 1)
    stamps = [start + dt.timedelta(seconds=int(rng.expovariate(1 / 90_000))) for _ in range(300)]
    stamps += [dt.datetime(2024, 3, 20, 5, 6, 7, 800_000)] * 9 + [dt.datetime(2024, 3, 29)]
    plan = pull_plan(events(spark, [*map(str, stamps), None]), "ts", ceiling=8)
    rows = plan.orderBy("slice_from").collect()
    assert rows[0].slice_from == dt.datetime.combine(min(stamps).date(), dt.time())
    assert rows[-1].slice_to == dt.datetime(2024, 3, 29, 23, 59, 59)
    for a, b in zip(rows, rows[1:], strict=False):
        assert b.slice_from == a.slice_to + dt.timedelta(seconds=1)
    for row in rows:
        inside = [s for s in stamps if row.slice_from <= s < row.slice_to + dt.timedelta(seconds=1)]
        assert row.n == len(inside)
        assert (row.n < 8) == (row.status == "ok")
        assert row.n < 8 or row.slice_from == row.slice_to
    assert [r.slice_from for r in rows if r.status != "ok"] == [dt.datetime(2024, 3, 20, 5, 6, 7)]


def test_pull_plan_without_rows(spark):
    assert pull_plan(events(spark, [None]), "ts", ceiling=5).collect() == []


def test_the_maintained_scorecard_joins_its_cases_once(spark, tmp_path, monkeypatch):
    """Four landings take their days from rows that were joined and written before."""
    lines = spark.range(400).selectExpr(
        "id AS l_orderkey", "id % 5 AS l_partkey", "id % 3 AS l_suppkey", "1 AS l_linenumber",
        "1D AS l_quantity", "1D AS l_extendedprice", "'N' AS l_returnflag", "'F' AS l_linestatus",
        "timestamp_ntz'1998-06-01' AS l_shipdate",
    )
    orders = spark.range(400).selectExpr(
        "id AS o_orderkey", "CAST(date_add(date'1996-01-01', CAST(id * 4 AS INT)) AS timestamp_ntz) AS o_orderdate"
    )
    parts = spark.range(5).selectExpr("id AS p_partkey", "'b' AS p_brand", "concat('T', id % 2) AS p_type")
    suppliers = spark.range(3).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "1 AS s_nationkey")
    tables_of = {"lineitem": lines, "orders": orders, "part": parts, "supplier": suppliers}
    for name, rows in tables_of.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    plans, insert = [], reports.insert_new

    def landed(batch, *args):
        plans.append(plan(batch))
        result.append(insert(batch, *args))

    result = []
    monkeypatch.setattr(reports, "insert_new", landed)
    reports.kpi_quarter_maintained(spark, str(tmp_path)).collect()
    assert len(plans) == 4 and not any("Join" in text for text in plans)
    assert sum(r.inserted for r in result) == 400 and result[3].inserted == 0
