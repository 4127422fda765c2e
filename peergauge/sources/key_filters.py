"""Membership filters over the keys of a table's files, to tell which files a batch may repeat.

Beside the table, in a folder that readers of the table pass over, each of its data files has Bloom
filters of its keys. A batch's keys are tried against all filters; files that none of them can be in
are not read. The filters only save reading: a file without one is always read, and one that
may hold a key is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peergauge.session import bounded_batches, give_back
from peergauge.sources.ledgers import add_entry, data_files, file_place, read_ledger

LEDGER = "_key_filters"
# Per key of a file; with as many probes a key that is not there passes about once in a million.
BITS, PROBES = 32, 12
# Keys of one filter, so that a row has 1 MB and a task holds some 20 MB at most.
FILTER_KEYS = 2**18
# Hashes that are tried at once; a probe takes several times their size.
TRIED_AT_ONCE = 2**17
# Keys of a batch that are tried, 8 bytes each; a larger batch reads the whole table.
MOST_TRIED = 4 * 2**20

FILTERS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("keys", T.LongType()),
        T.StructField("bits", T.BinaryType()),
    ]
)


def _places(hashes: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The bit of each hash for one probe, in a filter of ``size`` bits."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    mixed = (hashes + np.uint64(probe) * step) * np.uint64(0x9E3779B97F4A7C15)
    # The upper half, scaled: a filter has at most 2 ** 32 bits.
    return ((mixed >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def _size(keys: int) -> int:
    return max(64, keys * BITS)


def filter_of(hashes: np.ndarray) -> bytes:
    bits = np.zeros(_size(len(hashes)), bool)
    for probe in range(PROBES):
        bits[_places(hashes, probe, len(bits))] = True
    return np.packbits(bits, bitorder="little").tobytes()


def any_in(bits: bytes, keys: int, hashes: np.ndarray) -> bool:
    """Whether one of the hashes may be in a filter of so many keys."""
    table = np.frombuffer(bits, np.uint8)
    for start in range(0, len(hashes), TRIED_AT_ONCE):
        left = hashes[start : start + TRIED_AT_ONCE]
        for probe in range(PROBES):
            places = _places(left, probe, _size(keys))
            found = table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1
            left = left[found == 1]
        if len(left):
            return True
    return False


def _hashes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _build() -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, count = None, [], 0

        def row() -> pa.RecordBatch:
            made = filter_of(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([count], pa.int64()), pa.array([made], pa.binary())],
                ["file", "keys", "bits"],
            )

        for batch in batches:
            # The rows of a file follow each other in its task.
            runs = batch.column("file").dictionary_encode()
            codes, names = runs.indices.to_numpy(), runs.dictionary.to_pylist()
            cuts = (codes[1:] != codes[:-1]).nonzero()[0] + 1
            hashes = _hashes(batch.column("hash"))
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                name = names[codes[start]]
                if count and (name != file or count + end - start > FILTER_KEYS):
                    yield row()
                    held, count = [], 0
                file = name
                held.append(hashes[start:end])
                count += end - start
        if count:
            yield row()
        held.clear()
        give_back()

    return build


def _try(hashes: np.ndarray) -> Callable:
    def attempt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys").to_pylist()
            bits = batch.column("bits").to_pylist()
            found = [any_in(b, k, hashes) for b, k in zip(bits, keys, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), pa.array(found, pa.bool_())], ["file", "near"]
            )
        give_back()

    return attempt


def near_files(spark: SparkSession, path: str, batch: DataFrame, key: str) -> list[str]:
    """The table's data files that may hold a key of the batch; those without filters all may.

    The hashes of the batch's keys go to every task: it must have ``MOST_TRIED`` keys at most.
    """
    files = data_files(spark, path)
    if not files:
        return []
    bounded_batches(spark)
    hashes = _hashes(batch.select(F.xxhash64(key).alias("h")).toArrow().column("h").combine_chunks())
    tried = read_ledger(spark, path, LEDGER, FILTERS).mapInArrow(
        _try(hashes), "file string, near boolean"
    )
    near = dict(tried.groupBy("file").agg(F.bool_or("near")).collect())
    return [name for place, name in files.items() if near.get(place, True)]


def add_filters(spark: SparkSession, path: str, key: T.StructField) -> int:
    """Write filters for the table's data files that have none; returns how many had none.

    Reads the keys of those files only.
    """
    schema = T.StructType([key])
    files = data_files(spark, path)
    rows = read_ledger(spark, path, LEDGER, FILTERS).select("file").distinct().collect()
    have = {row.file for row in rows}
    new = [name for place, name in files.items() if place not in have]
    if new:
        bounded_batches(spark)
        keys = spark.read.schema(schema).parquet(*new).select(
            file_place(spark, path).alias("file"), F.xxhash64(key.name).alias("hash")
        )
        add_entry(keys.mapInArrow(_build(), FILTERS), path, LEDGER)
    return len(new)
