"""From free texts to scores: sample, classify, compare; and the two-probe audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergauge.functions.labels import normalise_label
from peergauge.operators import landing, sampling, scope, scoring
from peergauge.session import new_shared_path, remove_path, write_and_read, write_shared
from peergauge.sources.schemas import CENSUS
from peergauge.spec import PRODUCT_LABELS, CaseSpec

Classifier = Callable[[pd.Series], pd.Series]

@dataclass(frozen=True)
class Scores:
    rows: DataFrame
    overall: DataFrame
    by_category: DataFrame
    disagreements: DataFrame


@dataclass(frozen=True)
class Audit:
    rows: DataFrame
    summary: DataFrame
    categories: DataFrame


def build_sample(
    core: DataFrame,
    texts: DataFrame,
    spec: CaseSpec,
    text: str = "narrative",
    k: int = sampling.PER_STRATUM,
    seed: int = sampling.SEED,
) -> DataFrame:
    """Up to ``k`` cases per category whose text passes the gate, with the text.

    Twice as many ids are drawn as needed and only their texts looked up. A
    category for which that was not enough is sampled again from all its texts,
    so it comes out short only if it has too few.
    """
    cases = core.where(F.col(spec.has_text)).select(spec.case_id, spec.category)
    texts = texts.select(spec.case_id, text)
    spark, staging = core.sparkSession, new_shared_path(core.sparkSession, "drawn")
    try:
        drawn = sampling.stratified_sample(cases, spec.category, spec.case_id, 2 * k, seed)
        drawn = write_and_read(drawn, staging)
        kept = write_shared(_sample_of(drawn, texts, spec, text, k, seed), "kept")
        short = write_shared(_too_few(drawn, kept, spec.category, k), "short")
    finally:
        remove_path(spark, staging)

    if short.isEmpty():
        return kept
    again = cases.join(short, cases[spec.category].eqNullSafe(short["_stratum"]), "left_semi")
    enough = kept.join(short, kept[spec.category].eqNullSafe(short["_stratum"]), "left_anti")
    return enough.unionByName(_sample_of(again, texts, spec, text, k, seed))


def _sample_of(
    cases: DataFrame, texts: DataFrame, spec: CaseSpec, text: str, k: int, seed: int
) -> DataFrame:
    found = scope.text_gate(sampling.attach_text(cases, texts, spec.case_id), text)
    kept = sampling.stratified_sample(found, spec.category, spec.case_id, k, seed)
    return kept.select(spec.case_id, spec.category, text)


def _too_few(drawn: DataFrame, kept: DataFrame, category: str, k: int) -> DataFrame:
    """Categories, also a null one, that had more ids to draw from, yet kept fewer than ``k``."""
    counts = drawn.groupBy(F.col(category).alias("_stratum")).count()
    full = counts.where(F.col("count") >= 2 * k).select("_stratum")
    enough = kept.groupBy(category).count().where(F.col("count") >= k).select(category)
    return full.join(enough, full["_stratum"].eqNullSafe(enough[category]), "left_anti")


def evaluate(
    sample: DataFrame,
    classify: Classifier,
    spec: CaseSpec,
    text: str = "narrative",
    labels: Sequence[str] = PRODUCT_LABELS,
    max_chars: int | None = scope.MAX_TEXT_CHARS,
    tasks: int | None = None,
) -> Scores:
    """Classify every sampled text once and score the answers.

    A sample is small, so it is spread over ``tasks`` first, by default over all
    cores.

    The answers are written to the shared folder first: a model that is called
    again may answer differently, and every figure must describe the same answers.
    """
    tasks = tasks or sample.sparkSession.sparkContext.defaultParallelism
    answered = scoring.apply_classifier(
        sample, classify, text, "_answer", max_chars, tasks, spec.case_id
    )
    official, predicted = "product_official", "product_predicted"
    labelled = answered.select(
        spec.case_id,
        F.col(spec.category).alias(official),
        normalise_label(F.col("_answer"), labels, missing=None).alias(predicted),
    )
    rows = write_shared(scoring.with_match(labelled, official, predicted), "answers")
    return Scores(
        rows,
        scoring.agreement(rows, official, predicted),
        scope.ordered(
            scoring.agreement_by_category(rows, official, predicted), "pct_agree", official
        ),
        scope.ordered(
            scoring.confusion(rows, official, predicted), F.desc("n"), official, predicted
        ),
    )


def census(hits: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every id once, with its first text, if that is long enough."""
    rows = hits.select(*CENSUS.names, *order)
    return scope.text_gate(landing.distinct_ids(rows, "complaint_id", order), "narrative").select(
        *CENSUS.names
    )


def audit(
    texts: DataFrame,
    probe_a: Classifier,
    probe_b: Classifier,
    home: str,
    labels: Sequence[str] = PRODUCT_LABELS,
    text: str = "narrative",
    max_chars: int | None = scope.MAX_TEXT_CHARS,
) -> Audit:
    """Judge every text by a closed-set probe and an independent yes/no probe."""
    answered = scoring.apply_classifier(texts, probe_a, text, "_answer_a", max_chars)
    answered = scoring.apply_classifier(answered, probe_b, text, "_answer_b", max_chars)
    judged = scoring.probe_verdicts(answered, "_answer_a", "_answer_b", labels, home)
    rows = write_shared(judged.drop(text, "_answer_a", "_answer_b"), "judged")
    return Audit(
        rows,
        scoring.verdict_summary(rows),
        scope.ordered(
            scoring.label_distribution(rows, "probe_a_category"), F.desc("n"), "probe_a_category"
        ),
    )
