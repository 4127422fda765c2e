"""Put labels on texts and score them against the recorded ones."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.functions.labels import normalise_label, normalise_yes_no, usable
from peergauge.functions.rates import count_where, pct
from peergauge.functions.text import clip
from peergauge.operators.rates import conditional_rate
from peergauge.operators.scope import MAX_TEXT_CHARS
from peergauge.session import bounded_batches, give_back

# What two independent probes together say about a case.
UNUSABLE = "unusable"
BOTH = "misroute_both_probes"
ONE = "misroute_one_probe"
BELONGS = "belongs"


def apply_classifier(
    rows: DataFrame,
    classify: Callable[[pd.Series], pd.Series],
    text: str,
    answer: str,
    max_chars: int | None = MAX_TEXT_CHARS,
    tasks: int | None = None,
    spread_by: str | None = None,
) -> DataFrame:
    """Add the raw answer of a user-given classifier to every row.

    ``classify`` gets a batch of texts and returns as many answers, null where
    there is none. Only the text column travels to the Python workers, cut to
    what the classifier reads (``None`` sends whole texts). With ``tasks`` the
    rows are first spread by the hash of ``spread_by``, for a slow classifier on
    few rows. Declared non-deterministic, so that no answer is asked for twice. Batches
    are bounded in bytes and what they took is given back, so that the memory of the workers
    does not grow with the texts.
    """
    bounded_batches(rows.sparkSession)

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield classify(batch)
            # A series whose texts were searched (``.str``) refers to itself.
            del batch
            gc.collect()
            give_back()

    if tasks:
        rows = rows.repartition(tasks, spread_by or text)
    sent = clip(F.col(text), max_chars) if max_chars else F.col(text)
    return rows.withColumn(answer, answers.asNondeterministic()(sent))


def attach_predictions(
    sample: DataFrame, predictions: DataFrame, id_column: str
) -> DataFrame:
    """Every sampled row with its prediction; null where there is no answer."""
    return sample.join(predictions, id_column, "left")


def with_match(scored: DataFrame, official: str, predicted: str) -> DataFrame:
    return scored.withColumn("match", F.col(predicted).eqNullSafe(F.col(official)))


def agreement(scored: DataFrame, official: str, predicted: str) -> DataFrame:
    """Exact matches, rows and percentage; a missing prediction counts as a miss."""
    match = F.col(predicted).eqNullSafe(F.col(official))
    return scored.agg(
        count_where(match).alias("agree"), F.count(F.lit(1)).alias("n")
    ).withColumn("pct_agree", pct(F.col("agree"), F.col("n")))


def agreement_by_category(scored: DataFrame, official: str, predicted: str) -> DataFrame:
    match = F.col(predicted).eqNullSafe(F.col(official))
    return conditional_rate(scored, [official], match, "pct_agree", hits="agree")


def confusion(scored: DataFrame, official: str, predicted: str) -> DataFrame:
    """Disagreements per (official, predicted) pair, missing predictions included."""
    apart = ~F.col(predicted).eqNullSafe(F.col(official))
    return scored.where(apart).groupBy(official, predicted).agg(F.count(F.lit(1)).alias("n"))


def join_probes(cases: DataFrame, a: DataFrame, b: DataFrame, id_column: str) -> DataFrame:
    """Both probes' answers beside every case; null where a probe gave none."""
    return cases.join(a, id_column, "left").join(b, id_column, "left")


def probe_verdicts(
    answers: DataFrame,
    answer_a: str,
    answer_b: str,
    labels: Sequence[str],
    home: str,
) -> DataFrame:
    """Judge each case by a closed-set probe and a yes/no probe.

    Probe A objects when its label is not ``home``, probe B when it says NO. If
    either gave no usable answer the case is not judged.
    """
    a, b = F.col("probe_a_category"), F.col("probe_b_belongs")
    a_objects, b_objects = a != home, b == "NO"
    return (
        answers.withColumn("probe_a_category", normalise_label(F.col(answer_a), labels))
        .withColumn("probe_b_belongs", normalise_yes_no(F.col(answer_b)))
        .withColumn(
            "verdict",
            F.when(~(usable(a) & usable(b)), UNUSABLE)
            .when(a_objects & b_objects, BOTH)
            .when(a_objects | b_objects, ONE)
            .otherwise(BELONGS),
        )
    )


def verdict_summary(judged: DataFrame) -> DataFrame:
    """One row: counts per verdict and their shares of the usable cases."""

    def having(verdict: str) -> Column:
        return count_where(F.col("verdict") == verdict)

    counts = judged.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - having(UNUSABLE)).alias("usable"),
        having(BOTH).alias("both_probes"),
        having(ONE).alias("one_probe"),
        having(BELONGS).alias("belongs"),
    )
    return counts.select(
        "*",
        *[
            pct(F.col(c), F.col("usable")).alias(f"pct_{c}")
            for c in ("both_probes", "one_probe", "belongs")
        ],
    )


def label_distribution(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
