"""Land a stream of cases with insert-only deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from peergauge.operators.scope import MONTH_COLUMN
from peergauge.sources.tables import Landed, insert_new

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    order: tuple[str, ...],
    received: str | None = None,
    stamp: str | None = None,
    on_counted: Callable[[Landed, int], None] | None = None,
) -> StreamingQuery:
    """Insert every micro-batch into the table at ``path``; ends when all input is read.

    An id is compared with all rows ever landed, not with a window of recent
    ones. A batch that is replayed after a failure finds its own rows in the
    table and adds nothing. ``on_counted`` is told what each batch will insert, and
    its number, before it does: of a batch that is replayed, the first call has the
    true counts. One query at a time may write to a table.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        def counted(landed: Landed) -> None:
            if on_counted:
                on_counted(landed, batch_id)

        insert_new(batch, path, key, order, received, stamp, counted)

    return (
        stream.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedupe_recent(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Drop repeats of an id that arrive within ``delay`` of each other.

    Keeps state for the delay only, unlike ``land_stream``: a repeat that comes
    later passes.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def firsts_of_stream(stream: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of every key the first row that ever arrives; among rows of one micro-batch, by ``order``.

    The state store remembers each key for good, one flag per key, so no table is read. Ties in
    ``order`` go by all other columns and nulls come first, as in ``first_per_key``. Rows
    without a key fail. Rows pass through pandas: integers in columns with nulls are exact up to
    2 ** 53.
    """
    ranked = [*order, *[c for c in stream.columns if c != key and c not in order]]

    def first(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        rows = pd.concat(list(parts))
        if len(rows) > 1:
            rows = rows.sort_values(ranked, na_position="first")
        state.update((True,))
        yield rows.head(1)

    missing = F.raise_error(F.lit(f"null {key} in stream"))
    required = F.when(F.col(key).isNull(), missing).otherwise(F.col(key))
    return (
        stream.withColumn(key, required)
        .groupBy(key)
        .applyInPandasWithState(
            first, stream.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout
        )
    )


def land_keyed_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    order: Sequence[str],
    received: str | None = None,
    stamp: str | None = None,
) -> StreamingQuery:
    """Append the first row of every key to the table at ``path``; ends when all input is read.

    As ``land_stream``, with the keys that have landed in the state store instead of the table: a
    micro-batch costs what it holds, however long the table is. Keys live in RocksDB on the
    executors and in the checkpoint. The table has a log of its files, by which a batch that is
    replayed adds nothing; it is this stream's own, and nothing else may write to it. Columns that
    begin with an underscore take part in ``order`` and are not stored.
    """
    rows = firsts_of_stream(stream, key, order)
    rows = rows.select(*[c for c in rows.columns if not c.startswith("_")])
    if stamp:
        rows = rows.withColumn(stamp, F.current_timestamp())
    if received:
        rows = rows.withColumn(MONTH_COLUMN, F.trunc(F.col(received).cast("date"), "month"))
    writer = rows.writeStream.format("parquet").option("path", path)
    if received:
        writer = writer.partitionBy(MONTH_COLUMN)
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        # The query keeps the settings it is started with.
        return (
            writer.option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(PROVIDER, before)
