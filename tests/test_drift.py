"""Successors, volume segments, sliding bursts, exact quantiles and resumable answers."""

import datetime as dt
import math
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from helpers import plan, tuples
from pyspark.sql import functions as F

from peergauge.operators import quantiles
from peergauge.operators.drift import category_successors, volume_segments
from peergauge.operators.quality import sliding_bursts
from peergauge.operators.quantiles import exact_quantiles
from peergauge.plans.answers import answer_all


def dated(spark, rows):
    df = spark.createDataFrame(rows, "c string, f string, ts string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_a_renamed_category_is_found(spark):
    rng, rows = random.Random(1), []
    for month in range(1, 13):
        day = f"2024-{month:02}-15"
        rows += [("steady", rng.choice("abcdefgh"), day) for _ in range(20)]
        old, lookalike = ("Loan", "Payday"), ("Card", "Prepaid")
        rows += [(old[month > 6], rng.choice("klm"), day) for _ in range(12)]
        rows += [(lookalike[month > 6], rng.choice("xyz" if month <= 6 else "uvwx"), day) for _ in range(9)]
    rows += [(None, "k", "2024-01-15"), ("Loan", None, "2024-02-15"), ("Loan", "k", None)]
    got = category_successors(dated(spark, rows), "c", "f", "ts", 31, 40, 0.5).collect()
    assert [(r.ended, r.begun) for r in got] == [("Loan", "Payday")]
    assert got[0].last_seen == dt.datetime(2024, 6, 15) and got[0].overlap > 0.8
    loose = category_successors(dated(spark, rows), "c", "f", "ts", 31, 40, 0.1).collect()
    assert {(r.ended, r.begun) for r in loose} == {("Loan", "Payday"), ("Card", "Prepaid")}
    assert category_successors(dated(spark, rows).limit(0), "c", "f", "ts").collect() == []


def test_only_large_shares_are_looked_up(spark):
    from peergauge.operators.drift import _largest_shares

    shares = [("a", f"f{i}", 0.5**i) for i in range(1, 12)] + [("b", "f1", 1.0)]
    df = spark.createDataFrame([(*s, "x") for s in shares], "ended string, f string, old_share double, last string")
    kept = tuples(_largest_shares(df, 0.3), "ended", "f")
    assert kept == [("a", "f1"), ("a", "f2"), ("b", "f1")]


def plain_segments(x, penalty):
    """The best of all segmentations, by trying every earlier cut; also its cost."""
    n, charge = len(x), penalty * (sum(x) / len(x)) * math.log(len(x))
    best = [(0.0, [])]
    for t in range(1, n + 1):
        options = []
        for s in range(t):
            part = np.array(x[s:t], float)
            options.append((best[s][0] + ((part - part.mean()) ** 2).sum() + charge, best[s][1] + [t]))
        best.append(min(options, key=lambda o: o[0]))
    return best[n]


def test_segments_are_the_best_ones(spark):
    rng, rows, series = random.Random(2), [], {}
    for name, levels in {"a": (5, 40, 12), "b": (9,), "c": (0, 30), "d": (3, 3, 50, 2)}.items():
        months = [max(0, int(rng.gauss(level, 1.5))) for level in levels for _ in range(60 // len(levels))]
        series[name] = months
        for i, n in enumerate(months):
            rows += [(name, "x", f"{2019 + i // 12}-{i % 12 + 1:02}-03")] * n
    series["d"][0] = max(series["d"][0], 0)
    rows += [("a", "x", None), (None, "x", "2019-01-01")]
    got = {}
    for r in volume_segments(dated(spark, rows), "c", "ts", penalty=3.0).orderBy("c", "segment").collect():
        got.setdefault(r.c, []).append(r)
    for name, x in series.items():
        ends = np.cumsum([r.n_months for r in got[name]]).tolist()
        assert ends == plain_segments(x, 3.0)[1], name
        assert got[name][0].month_from == dt.date(2019, 1, 1)
        assert got[name][-1].month_to == dt.date(2023, 12, 1)
        starts = [0, *ends]
        assert [r.mean_n for r in got[name]] == [
            pytest.approx(sum(x[a:b]) / (b - a), abs=0.006) for a, b in zip(starts, ends, strict=False)
        ]
    assert len(got["b"]) == 1 and len(got["a"]) == 3
    assert volume_segments(dated(spark, []), "c", "ts").collect() == []


def test_sliding_bursts_equal_all_windows(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 5, 1)
    stamps = [("hot", start + dt.timedelta(seconds=rng.randrange(3000))) for _ in range(500)]
    stamps += [(rng.choice(["x", None]), start + dt.timedelta(seconds=rng.randrange(900))) for _ in range(80)]
    stamps += [("edge", start - dt.timedelta(microseconds=1))] * 4 + [("edge", start)] * 4
    df = dated(spark, [(c, "f", str(t)) for c, t in stamps] + [("hot", "f", None)])
    expected = {}
    for c, t in stamps:
        end = t.replace(microsecond=0)
        inside = sum(o == c and end - dt.timedelta(seconds=59) <= u.replace(microsecond=0) <= end for o, u in stamps)
        if inside > 5:
            expected[c, end - dt.timedelta(seconds=59), end] = inside
    for buckets in (1, 3):
        got = sliding_bursts(df, ["c"], "ts", 60, 5, 10_000, buckets)
        assert {(r.c, r.window_from, r.window_to): r.n for r in got.collect()} == expected
    top = sliding_bursts(df, ["c"], "ts", 60, 5, show=3).collect()
    ranked = sorted(expected.items(), key=lambda e: (-e[1], str(e[0][0]), e[0][2]))
    assert [r.n for r in top] == [n for _, n in ranked[:3]]


def test_a_hot_key_is_many_groups(spark):
    df = spark.range(40_000).selectExpr("substring(concat(id, 'hot'), -3) AS c", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts")
    found = sliding_bursts(df, ["c"], "ts", 60, 59, 5)
    text = plan(found)
    assert "hashpartitioning(c" in text and "_bucket" in text
    assert [r.n for r in found.collect()] == [60] * 5


def test_windows_of_bursts_are_not_added_up_row_by_row(spark):
    """A frame that slides is added up anew for every second; running totals are not."""
    df = spark.range(20_000).selectExpr(
        "'hot' AS c", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts"
    )
    found = sliding_bursts(df, ["c"], "ts", 3600, 3599, 5)
    frames = re.findall(r"RangeFrame, ([^,]+),", plan(found))
    assert frames and set(frames) == {"unboundedpreceding$()"}
    assert [r.n for r in found.collect()] == [3600] * 5


def test_quantiles_equal_percentile(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for i in range(1500):
        rows.append(("wide", rng.lognormvariate(0, 3)))
        rows.append(("signed", rng.gauss(0, 1) * 10 ** rng.randrange(0, 3)))
        rows.append(("ties", float(rng.randrange(3))))
        rows.append((None, float(i)))
    rows += [("one", 7.5), ("two", -1.0), ("two", 2.0), ("none", None), ("same", 3.25)] * 1
    rows += [("ends", 1.7e308), ("ends", -1.7e308), ("ends", 0.1)] * 120
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    sizes, written = [], quantiles.write_shared

    def recorded(frame, label):
        table = written(frame, label)
        if label == "cells":
            sizes.append(table.selectExpr("coalesce(max(size(cells)), 0)").first()[0])
        return table

    monkeypatch.setattr(quantiles, "write_shared", recorded)
    got = exact_quantiles(df, ["k"], "v", (0.0, 0.25, 0.5, 0.9, 1.0), held=300, cells=64)
    names = ["p0", "p25", "p50", "p90", "p100"]
    expected = df.where("v is not null").groupBy("k").agg(
        F.count("v").alias("n"), F.percentile("v", [0.0, 0.25, 0.5, 0.9, 1.0]).alias("p")
    ).select("k", "n", *(F.col("p")[i].alias(name) for i, name in enumerate(names)))
    assert got.columns == ["k", "n", *names]
    assert tuples(got) == tuples(expected)
    assert len(sizes) > 1 and max(sizes) <= 64
    with pytest.raises(Exception, match="not finite"):
        exact_quantiles(spark.createDataFrame([("a", math.inf)], "k string, v double"), ["k"], "v", (0.5,)).collect()
    assert exact_quantiles(df.limit(0), ["k"], "v", (0.5,)).collect() == []


def test_answers_go_on_where_they_stopped(spark, tmp_path):
    """Files of work; a model that fails, a job that is killed, and the calls that were made."""
    calls, work = tmp_path / "calls", str(tmp_path / "work")
    calls.mkdir()
    folder = str(calls)

    def model(texts):
        import os
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        if os.path.exists(f"{folder}-down"):
            raise OSError("no service")
        return pd.Series([None if "odd" in t else t.upper() for t in texts], index=texts.index)

    rows = [(i, f"t{i}" + ("odd" if i % 7 == 0 else "")) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    from peergauge.plans import answers

    taken, work_off = [], answers.apply_classifier

    def killed(*args):
        taken.append(1)
        if len(taken) == 3:
            raise RuntimeError("killed")
        return work_off(*args)

    answers.apply_classifier = killed
    try:
        with pytest.raises(Exception, match="killed"):
            answer_all(df, model, "id", "text", work, files=5)
    finally:
        answers.apply_classifier = work_off
    got = dict(tuples(answer_all(df, model, "id", "text", work, files=5)))
    assert got == {i: "API_FAILURE" if t is None or "odd" in t else t.upper() for i, t in rows}
    asked = [t for f in calls.iterdir() for t in f.read_text().split("\n") if t]
    for _, text in rows[:40]:
        assert asked.count(text) == (3 if "odd" in text else 1)
    (tmp_path / "calls-down").touch()
    down = answer_all(df, model, "id", "text", str(tmp_path / "other"), tries=1, files=2)
    assert {r.answer for r in down.collect()} == {"API_FAILURE"}


def test_files_of_work_are_bounded(spark, tmp_path, monkeypatch):
    """More files where they would be large, and still no more batches than asked for."""
    from peergauge.plans import answers

    monkeypatch.setattr(answers, "FILE_BYTES", 1000)
    df = spark.range(400).selectExpr("id", "concat(repeat('t', 90), id % 3) AS text")

    def model(texts):
        return pd.Series([None if t.endswith("2") else t[-1] for t in texts], index=texts.index)

    work = f"{tmp_path}/work"
    got = dict(tuples(answer_all(df, model, "id", "text", work, tries=2, files=2)))
    assert got == {i: "API_FAILURE" if i % 3 == 2 else str(i % 3) for i in range(400)}
    for attempt, rows in enumerate((400, 133)):
        pending = spark.read.parquet(f"{work}/pending-{attempt}")
        sizes = pending.groupBy(F.input_file_name()).agg(F.sum(F.octet_length("text"))).collect()
        assert pending.count() == rows and len(sizes) >= rows // 16
        assert max(size for _, size in sizes) < 3000
        batches = [b for b in os.listdir(f"{work}/ledger/attempt={attempt}") if b.startswith("file=")]
        assert len(batches) == 2
