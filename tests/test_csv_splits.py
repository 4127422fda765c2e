"""One large CSV file read by many tasks, against the reader that gives a file to one task."""

import os
import random

import pytest
from helpers import plan, tuples
from test_landing import row, write_csv

from peergauge.plans.reports import REPORTS
from peergauge.session import recorded_paths
from peergauge.sources.csv_export import read_csv_export
from peergauge.sources.csv_splits import read_records

COLUMNS = ("complaint_id", "product", "company", "date_received", "narrative", "has_narrative")


@pytest.fixture
def small_splits(conf):
    def set_bytes(n):
        conf(
            spark__sql__files__maxPartitionBytes=str(n),
            spark__sql__files__openCostInBytes="0",
            spark__sql__files__minPartitionNum="1",
        )

    return set_bytes


def both(spark, path):
    one = read_csv_export(spark, path, keep_narrative=True, split_files=False)
    many = read_csv_export(spark, path, keep_narrative=True)
    return tuples(one, *COLUMNS), tuples(many, *COLUMNS)


NARRATIVES = [
    "",
    "plain",
    '"line one\nline two"',
    '"a ""quote"" and, comma"',
    '"\n\n""\n"",""\n"',
    '"' + "long text, with breaks\n" * 30 + '"',
    '""',
    '"é – “x”\r\nnext"',
    '"   "',
]


@pytest.mark.parametrize("size, n", [(60, 12), (400, 60), (7000, 400), (10**9, 400)])
def test_splits_give_the_rows_of_one_task(spark, tmp_path, small_splits, size, n):
    rng = random.Random(size)
    rows = [row(i, narrative=rng.choice(NARRATIVES)) for i in range(n)]
    path = write_csv(tmp_path / "a.csv", rows)
    small_splits(size)
    one, many = both(spark, path)
    assert len(one) == len(rows)
    assert many == one


def test_one_file_has_many_tasks(spark, tmp_path, small_splits):
    path = write_csv(tmp_path / "a.csv", [row(i, narrative=NARRATIVES[5]) for i in range(300)])
    small_splits(60_000)
    df = read_csv_export(spark, path)
    texts = read_records(spark, path).texts
    assert texts.rdd.getNumPartitions() >= 4
    assert "MapInArrow" in plan(df) and "Window" not in plan(df)
    assert read_csv_export(spark, path, split_files=False).rdd.getNumPartitions() == 1
    assert df.count() == 300


def test_a_field_longer_than_several_splits(spark, tmp_path, small_splits):
    text = '"' + "\n".join(f"line {i}" for i in range(2000)) + '"'
    path = write_csv(tmp_path / "a.csv", [row(1), row(2, narrative=text), row(3, narrative=text)])
    small_splits(4000)
    one, many = both(spark, path)
    assert many == one and len(one) == 3


def test_line_ends_headers_and_files(spark, tmp_path, small_splits):
    """Carriage returns, a mark at the start, no line end at the end, a header across splits."""
    folder = tmp_path / "export"
    folder.mkdir()
    path = write_csv(folder / "a.csv", [row(i, narrative=NARRATIVES[i % 5]) for i in range(9)])
    text = open(path, encoding="utf-8").read()
    with open(folder / "a.csv", "w", encoding="utf-8", newline="") as f:
        f.write(text.replace("\n", "\r\n").removesuffix("\r\n"))
    with open(folder / "b.csv", "w", encoding="utf-8", newline="") as f:
        f.write("﻿" + text.replace("\r", ""))
    small_splits(300)
    records = read_records(spark, str(folder))
    assert records.header[0] == "Complaint ID" and records.texts.count() == 18
    small_splits(150)
    got = read_csv_export(spark, str(folder / "a.csv"), keep_narrative=True)
    expected = read_csv_export(spark, str(folder / "a.csv"), keep_narrative=True, split_files=False)
    assert tuples(got, *COLUMNS) == tuples(expected, *COLUMNS)


def test_empty_files_and_lines(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [])
    assert read_csv_export(spark, path).collect() == []
    with open(path, "a") as f:
        f.write("\n\r\n\n")
    assert read_csv_export(spark, path).collect() == []
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="lacks"):
        read_csv_export(spark, str(tmp_path / "none.csv"))


def test_quotes_that_do_not_close_fail(spark, tmp_path, small_splits):
    path = write_csv(tmp_path / "a.csv", [row(1), row(2, narrative='"open')])
    small_splits(40)
    with pytest.raises(ValueError, match="not closed"):
        read_csv_export(spark, path)


def test_fields_quoted_in_part_fail_rather_than_swallow_lines(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [row(1, company='5" pipe'), row(2, company='6" pipe')])
    with pytest.raises(Exception, match="quoted in part"):
        read_csv_export(spark, path).collect()


@pytest.mark.parametrize("size", [333, 800, 10**6])
def test_other_split_settings_before_reading_fail(spark, tmp_path, small_splits, size):
    path = write_csv(tmp_path / "a.csv", [row(i, narrative=NARRATIVES[2]) for i in range(50)])
    small_splits(400)
    df = read_csv_export(spark, path)
    small_splits(size)
    with pytest.raises(Exception, match="settings of file splits"):
        df.collect()


def test_an_export_of_many_documents_is_not_written_by_one_task(spark, tmp_path, small_splits):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id",
        "concat('a \"b\", ', id, '\n', sha2(string(id), 512), sha2(string(-id), 512)) AS text",
        "'en' AS lang",
        "'s' AS source",
    )
    docs.repartition(24).write.parquet(f"{tmp_path}/documents.parquet")
    small_splits(40_000)
    with recorded_paths() as made:
        loaded = REPORTS["csv_export_load"](spark, str(tmp_path))
        days = "date_received BETWEEN '1995-06-01' AND '2001-06-30'"
        got = {r.complaint_id for r in loaded.where(days).select("complaint_id").collect()}
    exports = [path for path in made if "/export-" in path]
    written = [[f for f in os.listdir(path) if f.endswith(".csv")] for path in exports]
    assert len(written) == 2 and all(len(files) > 3 for files in written)
    # Day 151 after the first one begins the range.
    assert got == {str(i) for i in range(151, 2373)}
