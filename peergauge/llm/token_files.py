"""Token ids in Parquet files that can be read by column, row range and document.

The files hold one row per document in ascending order of the id: the ids as a list column, next to
their number, where they begin in the file's shard, and any metadata columns. The ids are
dictionary-coded, as a vocabulary is far smaller than a row group; numbers and starts are
delta-coded by the second version of the page format. Row groups and pages have set sizes, and
Parquet's page index lets a reader that looks for documents or metadata skip the other pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peergauge.llm.common import BATCH_BYTES, bounded_batches, packed_lists, slices, whole_text
from peergauge.llm.text_ids import encoder
from peergauge.session import write_shared

ROW_GROUP_BYTES = 64 * 1024**2
PAGE_BYTES = 256 * 1024
PAGE_ROWS = 5_000


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    metadata: tuple[str, ...] = (),
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode ``text`` of every row, with ``end_id`` behind it, and write it in order of ``doc_id``.

    Documents are dealt out by ranges of (doc_id, hash of the text), so that rows which share an id
    do not have to share a task; rows alike in id and text follow each other in any order. A null
    text is empty and gives only the end id; a null doc_id sorts first. Only the named columns are
    read, so other columns may have any name; metadata columns may not be called as the written
    ones, and get an error from Spark if they are. An empty table gives an empty set of files.
    """
    bounded_batches(docs.sparkSession)
    spread = docs.select("doc_id", whole_text().alias("text"), *metadata)
    ordered = (
        spread.withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash", "text")
        .drop("_hash")
    )
    fields = {f.name: f.dataType.simpleString() for f in ordered.schema}
    kept = ", ".join(f"`{c}` {fields[c]}" for c in ("doc_id", *metadata))
    schema = f"{kept}, shard int, start_in_shard long, n_tokens int, ids array<int>"
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        texts, start = encoder(vocabulary), 0
        for batch in slices(batches, "text", BATCH_BYTES):
            ids = packed_lists(texts.encode_array(batch.column("text"), end))
            ends = ids.offsets.to_numpy().astype("int64")
            columns = [batch.column(c) for c in ("doc_id", *metadata)]
            columns += [pa.array([task] * len(ids), pa.int32()), pa.array(start + ends[:-1])]
            columns += [ids.value_lengths(), ids]
            start += int(ends[-1])
            names = ["doc_id", *metadata, "shard", "start_in_shard", "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    (
        ordered.mapInArrow(encode, schema)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The files' rows with ``start``: the ids of all documents before, over all files.

    ``columns`` are read besides doc_id, start and n_tokens; without ``ids`` no token page is read.
    """
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("_size"))
    # One row per shard, which is a task of the writing job.
    before = F.sum("_size").over(Window.orderBy("shard")) - F.col("_size")
    # Written, so that the planner knows that it is small.
    bases = write_shared(
        sizes.select(F.col("shard").alias("_shard"), before.alias("_base")), "token-bases"
    )
    return rows.join(bases, F.col("shard") == F.col("_shard")).select(
        "doc_id",
        (F.col("_base") + F.col("start_in_shard")).alias("start"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        *columns,
    )


def with_ids_crc32(rows: DataFrame) -> DataFrame:
    """Replace the list column ``ids`` by the crc32 of its ids as little-endian 32-bit integers."""
    others = [c for c in rows.columns if c != "ids"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", ids_crc32 long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy().tolist()
            values = pc.cast(lists.values, pa.int32()).to_numpy().astype("<i4", copy=False)
            packed = memoryview(values).cast("B")
            crcs = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            columns = [batch.column(c) for c in others] + [pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "ids_crc32"])

    return rows.mapInArrow(digest, schema)
