"""What the operators share: tables, Arrow batches of bounded size, exact running numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peergauge.session import BATCH_BYTES as BATCH_BYTES
from peergauge.session import bounded_batches as bounded_batches
from peergauge.session import give_back

# Texts handled together inside a Python task.
SLICE_BYTES = 4 * 1024**2


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slices(
    batches: Iterator[pa.RecordBatch], column: str, slice_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``slice_bytes`` in each, or one row.

    At the end free memory goes back to the system: Spark keeps a task's Python worker for later stages.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(False)
        start = size = 0
        for row, length in enumerate(lengths):
            if size and size + length > slice_bytes:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += int(length)
        yield batch.slice(start)
    give_back()


def packed_lists(packed: pa.Array) -> pa.ListArray:
    """Ids packed as 4 bytes each in a whole binary array without nulls, one list per value."""
    import numpy as np

    _, bounds, data = packed.buffers()
    ends = np.frombuffer(bounds, np.int32, len(packed) + 1) // 4
    values = np.frombuffer(data or b"", "<i4", ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def input_bytes(df: DataFrame) -> int:
    """The planner's size of a table; for files, what they take on disk."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
