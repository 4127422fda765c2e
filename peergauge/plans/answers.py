"""Classification that can be interrupted: a ledger of answers, files of work, and retries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peergauge.functions.labels import FAILURE
from peergauge.operators.scope import MAX_TEXT_CHARS
from peergauge.operators.scoring import apply_classifier
from peergauge.plans.evaluation import Classifier
from peergauge.session import path_exists, remove_path
from peergauge.sources.ledgers import data_files

# Bytes of text in a file of work; a task writes or reads one.
FILE_BYTES = 128 * 1024**2


def _forgiving(classify: Classifier) -> Classifier:
    """No answers for a batch of texts on which the classifier fails: they are tried again."""

    def attempt(texts: pd.Series) -> pd.Series:
        try:
            return classify(texts)
        except Exception:
            return pd.Series([None] * len(texts), index=texts.index, dtype=object)

    return attempt


def answer_all(
    rows: DataFrame,
    classify: Classifier,
    id_column: str,
    text: str,
    work: str,
    tries: int = 3,
    files: int = 64,
    max_chars: int | None = MAX_TEXT_CHARS,
) -> DataFrame:
    """(id, answer) of every row; the mark of a failure where ``tries`` attempts gave no answer.

    ``work`` is a folder of this job. For each attempt the rows without an answer are written there
    as ``files`` files, or as more where these would hold over ``FILE_BYTES`` of text. A stream takes
    them up one at a time, or so many together that there are ``files`` batches at most, and adds
    the answers of each batch to the ledger, so a job that was stopped goes on with the next batch
    when it is called again with the same folder: what has been answered is not asked again. A batch
    of texts on which the classifier fails counts as not answered. Ids must be unique and not null;
    a null text is not answered.
    """
    spark, base = rows.sparkSession, work.rstrip("/")
    kind = rows.schema[id_column]
    ledger = T.StructType([kind, T.StructField("answer", T.StringType())])
    wanted = rows.select(id_column, text)
    for attempt in range(tries):
        pending = f"{base}/pending-{attempt}"
        # Whole or not there: the marker is written last.
        if not path_exists(spark, f"{pending}/_SUCCESS"):
            remove_path(spark, pending)
            left = wanted.join(_answers(spark, base, ledger), id_column, "left_anti")
            left = left.where(F.col(text).isNotNull())
            size = left.agg(F.sum(F.octet_length(text))).first()[0] or 0
            parts = max(files, -(-size // FILE_BYTES))
            left.repartition(parts, id_column).write.parquet(pending)
        at_once = max(1, -(-len(data_files(spark, pending)) // files))
        _work_off(spark, base, attempt, at_once, wanted.schema, classify, id_column, text, max_chars)
    answered = _answers(spark, base, ledger)
    return wanted.select(id_column).join(answered, id_column, "left").select(
        id_column, F.coalesce("answer", F.lit(FAILURE)).alias("answer")
    )


def _answers(spark: SparkSession, base: str, ledger: T.StructType) -> DataFrame:
    if not path_exists(spark, f"{base}/ledger"):
        return spark.createDataFrame([], ledger)
    answers = spark.read.schema(ledger).parquet(f"{base}/ledger").select(*ledger.names)
    return answers.where("answer is not null")


def _work_off(
    spark: SparkSession,
    base: str,
    attempt: int,
    at_once: int,
    schema: T.StructType,
    classify: Classifier,
    id_column: str,
    text: str,
    max_chars: int | None,
) -> None:
    def ask(batch: DataFrame, number: int) -> None:
        answered = apply_classifier(batch, _forgiving(classify), text, "answer", max_chars)
        # A batch of files that is taken up again replaces what it had left.
        path = f"{base}/ledger/attempt={attempt}/file={number}"
        answered.select(id_column, "answer").write.mode("overwrite").parquet(path)

    pending = spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once)
    query = (
        pending.parquet(f"{base}/pending-{attempt}")
        .writeStream.foreachBatch(ask)
        .option("checkpointLocation", f"{base}/state-{attempt}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
