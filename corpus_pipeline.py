"""A training corpus from raw documents: filtered, deduplicated, masked and packed.

Every stage works on all rows that its predecessor kept. A stage is a function of the session, the
documents so far and the folder of the other tables; its result is written and read again before the
next one. All but the last return the columns of the documents they were given, with their values.

A stage's tables in the shared folder are needed until its result is written. The next stage removes
those that its own documents are not read from, and ``run`` those of the last one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peergauge.llm.common import read_table
from peergauge.llm.near_dups import near_duplicates
from peergauge.llm.packing import pack_documents
from peergauge.llm.queries import vocabulary
from peergauge.llm.rules import count_text, fit_cutoffs, judge
from peergauge.llm.secrets import find_secrets, masked
from peergauge.llm.weak_labels import fit_quality, keep_accepted, read_documents
from peergauge.session import recorded_paths, remove_path, write_shared

END_ID = 1

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Shared paths that the stages so far have made and not removed.
_made: list[str] = []


def _free(spark: SparkSession, docs: DataFrame | None = None) -> None:
    """Remove the tables of earlier stages, but those that ``docs`` are read from."""
    used = docs.inputFiles() if docs else []
    for path in list(_made):
        if not any(path.rsplit("/", 1)[1] in file for file in used):
            remove_path(spark, path)
            _made.remove(path)


def stage(function: Stage) -> Stage:
    @functools.wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _free(spark, docs)
        with recorded_paths() as made:
            try:
                return function(spark, docs, sf_dir)
            finally:
                _made.extend(made)

    return staged


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _given(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, with all others in ``_given``: no name of an operator clashes with them."""
    others = [_named(c) for c in docs.columns if c not in used] or [F.lit(0).alias("_")]
    return docs.select(F.struct(*others).alias("_given"), *used)


def _back(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from rows of ``_given``, some of them changed."""

    def value(column: str) -> Column:
        if column in changed:
            return changed[column].alias(column)
        top = column in rows.columns and column not in rows.schema["_given"].dataType.names
        return _named(column) if top else F.col("_given").getField(column).alias(column)

    return rows.select(*map(value, docs.columns))


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without labels: documents that the weakly supervised scorer rejects go."""
    return _back(keep_accepted(_given(docs, "text"), fit_quality(read_documents(docs))), docs)


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or exceed a certified cutoff of their language, go.

    Cutoffs are fitted on all labelled documents of the table: few that are labelled bad are left among
    those given. Documents are counted where they are, and only counts meet the labels; those given
    are written with their counts, once, rather than counted again.
    """
    labels = read_table(spark, sf_dir, "labels")
    texts = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counts = write_shared(count_text(texts).drop("text"), "label-counts")
    labelled = counts.join(labels.where("quality is not null"), "doc_id", "left_semi")
    cutoffs = fit_cutoffs(labelled, labels)
    counted = write_shared(count_text(_given(docs, "text", "lang")), "counted")
    return _back(judge(counted, cutoffs).where("kept"), docs)


@stage
def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest doc_id stays.

    Where ids repeat or are null, rows are numbered first, so that one row of a group stays: one with
    the smallest id, and one without an id only if the group has none with one.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        groups = near_duplicates(docs, size=5, percent=80)
        gone = write_shared(groups.where("not kept").select("doc_id"), "duplicates")
        return docs.join(gone, "doc_id", "left_anti").select(*map(_named, docs.columns))
    numbered = _given(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    numbered = write_shared(numbered, "numbered")
    groups = near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text"), 5, 80)
    groups = groups.select(F.col("doc_id").alias("_row"), "component_id")
    members = groups.join(numbered.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = members.groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    kept = write_shared(first.select("_row"), "kept-rows")
    return _back(numbered.join(kept, "_row", "left_semi"), docs)


@stage
def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked, and n_chars follows."""
    found = find_secrets(_given(docs, "text"))
    spans = F.sort_array(F.concat("strong", "linked"))
    text = masked(F.col("text"), spans)
    changed = {"text": text}
    if "n_chars" in docs.columns:
        n_chars = F.length(text).cast(docs.schema["n_chars"].dataType)
        given = F.col("_given").getField("n_chars")
        changed["n_chars"] = F.when(F.size(spans) > 0, n_chars).otherwise(given)
    return _back(found, docs, **changed)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 2048, as pieces with their places."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("secret_scan", secret_masks),
    ("packing", packing),
]
# SQL can express neither the learned scorer nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = write_shared(step(spark, docs, sf_dir), name)
    _free(spark, docs)
    return docs
