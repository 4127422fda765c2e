import hashlib
import random

import pandas as pd
import pytest
from helpers import tuples
from pyspark.sql import functions as F

from peergauge.functions import normalise_label, normalise_yes_no, strip
from peergauge.operators import landing, sampling, scope, scoring
from peergauge.plans import evaluation
from peergauge.spec import CaseSpec

SPEC = CaseSpec()
LABELS = ("Mortgage", "Debt collection")


def normalised(spark, fn, values, *args, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    done = df.select("i", fn(F.col("v"), *args, **kw).alias("x"))
    return [r.x for r in done.orderBy("i").collect()]


def test_strip_takes_all_white_space_like_python(spark):
    values = [" \t text  \n", "\x1c\x85x　", "a \n b", "", "  ", "​zero"]
    assert normalised(spark, strip, values) == [v.strip() for v in values]


def test_labels(spark):
    answers = [" mortgage\n", "DEBT COLLECTION", "none of these", "x" * 80, "", None]
    assert normalised(spark, normalise_label, answers, LABELS) == [
        "Mortgage",
        "Debt collection",
        "UNPARSEABLE::none of these",
        "UNPARSEABLE::" + "x" * 60,
        "UNPARSEABLE::",
        "API_FAILURE",
    ]
    assert normalised(spark, normalise_label, [None], LABELS, missing=None) == [None]


def test_yes_no(spark):
    answers = ["yes", " No.. ", "YES .", "maybe", None]
    assert normalised(spark, normalise_yes_no, answers) == [
        "YES",
        "NO",
        "UNPARSEABLE::YES .",
        "UNPARSEABLE::maybe",
        "API_FAILURE",
    ]


def test_text_gate(spark):
    rows = [(1, " " + "a" * 50 + " "), (2, " " + "a" * 49 + " "), (3, None), (4, "é" * 7000)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: len(r.text) for r in scope.text_gate(df, "text", max_chars=6000).collect()}
    assert got == {1: 50, 4: 6000}
    assert scope.text_gate(df, "text").where("id = 4").first().text == "é" * 7000


def draw(rows, k, seed):
    """Expected sample, in plain Python."""
    groups = {}
    for stratum, i in rows:
        groups.setdefault(stratum, []).append(i)
    digest = lambda i: hashlib.md5(f"{seed}-{i}".encode()).hexdigest()
    return sorted((s, i) for s, ids in groups.items() for i in sorted(ids, key=digest)[:k])


@pytest.mark.parametrize("tasks", [1, 5])
def test_sample_equals_brute_force_with_a_hot_stratum(spark, tasks):
    rows = [("hot", i) for i in range(400)] + [("small", i) for i in range(400, 407)]
    df = spark.createDataFrame(rows, "s string, id long").repartition(tasks)
    got = tuples(sampling.stratified_sample(df, "s", "id", k=20, seed=7), "s", "id")
    assert got == sorted(draw(rows, 20, 7), key=repr)


def test_sample_depends_on_the_seed_only(spark):
    df = spark.range(500).selectExpr("'a' AS s", "id")
    one = tuples(sampling.stratified_sample(df, "s", "id", 10, seed=1))
    assert one == tuples(sampling.stratified_sample(df, "s", "id", 10, seed=1))
    assert one != tuples(sampling.stratified_sample(df, "s", "id", 10, seed=2))


def test_attach_text_drops_ids_without_one(spark):
    sample = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    texts = spark.createDataFrame([(1, "t"), (3, "u")], "id int, text string")
    assert tuples(sampling.attach_text(sample, texts, "id"), "id", "text") == [(1, "t")]


def test_census_takes_the_first_text_even_if_too_short(spark):
    long = "y" * 60
    rows = [("a", 1, "short"), ("a", 2, long), ("b", 1, long), ("", 1, long), (None, 1, long)]
    df = spark.createDataFrame(rows, "complaint_id string, place int, narrative string")
    for c in ("date_received", "company", "issue", "sub_product"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    assert tuples(evaluation.census(df, ["place"]), "complaint_id") == [("b",)]


def test_first_per_key_counts_copies_of_a_hot_key(spark):
    rows = [("hot", i, "x") for i in range(50)] + [("cold", 3, None), ("cold", 3, "b")]
    df = spark.createDataFrame(rows, "k string, place int, v string").repartition(5)
    got = tuples(landing.first_per_key(df, "k", ["place"], copies="n"))
    assert got == [("cold", 3, None, 2), ("hot", 0, "x", 50)]


SCORED = [
    ("Mortgage", "Mortgage"),
    ("Mortgage", None),
    ("Mortgage", "UNPARSEABLE::?"),
    ("Debt", "Mortgage"),
]


def test_missing_predictions_stay_in_the_denominator(spark):
    df = spark.createDataFrame(SCORED, "o string, p string")
    row = scoring.agreement(df, "o", "p").first()
    assert (row.agree, row.n, row.pct_agree) == (1, 4, 25.0)
    assert tuples(scoring.agreement_by_category(df, "o", "p")) == [
        ("Debt", 1, 0, 0.0),
        ("Mortgage", 3, 1, 33.3),
    ]
    assert tuples(scoring.confusion(df, "o", "p")) == [
        ("Debt", "Mortgage", 1),
        ("Mortgage", "UNPARSEABLE::?", 1),
        ("Mortgage", None, 1),
    ]
    matches = [r.match for r in scoring.with_match(df, "o", "p").collect()]
    assert matches == [True, False, False, False]


def test_agreement_on_nothing(spark):
    df = spark.createDataFrame([], "o string, p string")
    assert scoring.agreement(df, "o", "p").first().pct_agree is None


def test_predictions_attach_by_id(spark):
    sample = spark.createDataFrame([(1, "a"), (2, "b")], "id int, o string")
    predictions = spark.createDataFrame([(1, "a"), (9, "z")], "id int, p string")
    assert tuples(scoring.attach_predictions(sample, predictions, "id")) == [
        (1, "a", "a"),
        (2, "b", None),
    ]


def test_verdicts_and_summary(spark):
    home = "Mortgage"
    rows = [
        (1, "mortgage", "yes", scoring.BELONGS),
        (2, "Debt collection", "NO", scoring.BOTH),
        (3, "Debt collection", "YES", scoring.ONE),
        (4, "Mortgage", "no.", scoring.ONE),
        (5, "junk", "NO", scoring.UNUSABLE),
        (6, "Debt collection", None, scoring.UNUSABLE),
        (7, None, "YES", scoring.UNUSABLE),
    ]
    df = spark.createDataFrame(rows, "id int, a string, b string, expected string")
    judged = scoring.probe_verdicts(df, "a", "b", LABELS, home)
    assert judged.where("verdict <> expected").count() == 0
    row = scoring.verdict_summary(judged).first()
    assert (row.n, row.usable, row.both_probes, row.one_probe, row.belongs) == (7, 4, 1, 2, 1)
    assert (row.pct_both_probes, row.pct_one_probe, row.pct_belongs) == (25.0, 50.0, 25.0)
    assert tuples(scoring.label_distribution(judged, "probe_a_category"))[0] == ("API_FAILURE", 1)


def test_summary_without_usable_rows(spark):
    df = spark.createDataFrame([("unusable",)], "verdict string")
    assert scoring.verdict_summary(df).first().pct_belongs is None


def by_word(words):
    def classify(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: next((a for w, a in words.items() if w in t), None))

    return classify


def test_classifier_reads_clipped_texts(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ba")], "id int, t string")
    got = scoring.apply_classifier(df, by_word({"b": "yes"}), "t", "answer", max_chars=1)
    assert tuples(got, "id", "answer") == [(1, None), (2, "yes")]


def test_a_worker_keeps_no_texts_it_has_classified(spark):
    """What earlier batches took, with a classifier whose series refer to themselves."""

    def alive(texts: pd.Series) -> pd.Series:
        import gc

        texts.str.contains("x", regex=False)
        held = sum(isinstance(o, pd.Series) and o.dtype == object for o in gc.get_objects())
        return pd.Series([f"{len(texts)} {held}"] * len(texts), index=texts.index)

    rows = spark.range(0, 60_000, 1, 1).selectExpr("id", "concat(repeat('t', 1000), id) AS t")
    found = scoring.apply_classifier(rows, alive, "t", "answer").select("answer").distinct()
    seen = [tuple(map(int, r.answer.split())) for r in found.collect()]
    # Batches of 8 MB, and no more series in the last one than in the first.
    assert max(n for n, _ in seen) < 9000 and max(held for _, held in seen) <= 3


@pytest.fixture(scope="module")
def narratives(spark):
    rows = [
        (f"{p[0]}{i}", p, f"{p} text number {i} " + "word " * 12)
        for p in ("Mortgage", "Student loan")
        for i in range(30)
    ]
    return spark.createDataFrame(rows, "complaint_id string, product string, narrative string")


def test_sample_to_scores(spark, narratives):
    core = narratives.select("complaint_id", "product").withColumn("has_narrative", F.lit(True))
    sample = evaluation.build_sample(core, narratives, SPEC, k=10)
    assert tuples(sample.groupBy("product").count()) == [("Mortgage", 10), ("Student loan", 10)]
    scores = evaluation.evaluate(sample, by_word({"Mortgage": "mortgage ", "loan": "??"}), SPEC)
    assert scores.overall.first().agree == 10
    assert [tuple(r) for r in scores.disagreements.collect()] == [
        ("Student loan", "UNPARSEABLE::??", 10)
    ]
    assert [r.pct_agree for r in scores.by_category.collect()] == [0.0, 100.0]


def test_sample_is_not_short_while_texts_are_left(spark, narratives):
    core = narratives.select("complaint_id", "product").withColumn("has_narrative", F.lit(True))
    drawn = sampling.stratified_sample(core, "product", "complaint_id", 10)
    first = [r.complaint_id for r in drawn.where("product = 'Mortgage'").collect()]
    blanked = narratives.withColumn(
        "narrative", F.when(F.col("complaint_id").isin(first[:8]), "").otherwise(F.col("narrative"))
    )
    sample = evaluation.build_sample(core, blanked, SPEC, k=5)
    assert tuples(sample.groupBy("product").count()) == [("Mortgage", 5), ("Student loan", 5)]
    assert not {r.complaint_id for r in sample.collect()} & set(first[:8])


def test_a_null_category_is_sampled_in_full(spark):
    rows = [(f"n{i}", None, "x" if i % 3 else "usable text " * 9) for i in range(150)]
    rows += [(f"a{i}", "A", "usable text " * 9) for i in range(90)]
    texts = spark.createDataFrame(rows, "complaint_id string, product string, narrative string")
    core = texts.select("complaint_id", "product").withColumn("has_narrative", F.lit(True))
    sample = evaluation.build_sample(core, texts, SPEC, k=40)
    assert tuples(sample.groupBy("product").count()) == [("A", 40), (None, 40)]
    assert sample.select("complaint_id").distinct().count() == 80


def test_audit(spark, narratives):
    got = evaluation.audit(
        narratives,
        by_word({"Mortgage": "Mortgage", "loan": "Student loan"}),
        by_word({"Mortgage": "YES", "loan": "no."}),
        home="Mortgage",
    )
    row = got.summary.first()
    assert (row.usable, row.both_probes, row.belongs) == (60, 30, 30)
    assert "narrative" not in got.rows.columns
    assert tuples(got.categories) == [("Mortgage", 30), ("Student loan", 30)]


def test_random_answers_equal_python(spark):
    rng = random.Random(7)
    pieces = ["mortgage", "DEBT", "collection", "Yes", "no", ".", "..", " ", "\t", "\n", "\xa0"]
    pieces += [" ", "　", "\x1f", "é", "?"]
    answers = ["".join(rng.choices(pieces, k=rng.randrange(5))) for _ in range(400)]

    def label(text):
        text = text.strip()
        known = {x.lower(): x for x in LABELS}
        return known.get(text.lower(), f"UNPARSEABLE::{text[:60]}")

    def yes_no(text):
        word = text.strip().upper().rstrip(".")
        return word if word in ("YES", "NO") else f"UNPARSEABLE::{text.strip()[:60]}"

    assert normalised(spark, strip, answers) == [a.strip() for a in answers]
    assert normalised(spark, normalise_label, answers, LABELS) == [label(a) for a in answers]
    assert normalised(spark, normalise_yes_no, answers) == [yes_no(a) for a in answers]
