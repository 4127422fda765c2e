"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# A shuffle partition of this size is sorted in memory by an executor core with 2 GB.
PARTITION_BYTES = 200 * 1024**2

# What Spark hands to Python at once; by default it may be 64 MB.
BATCH_BYTES = 8 * 1024**2


def shuffle_partitions(
    shuffled_bytes: int, cores: int, partition_bytes: int = PARTITION_BYTES
) -> int:
    """Partitions of ``partition_bytes`` for a shuffle of so many bytes; at least one per core."""
    return max(cores, -(-shuffled_bytes // partition_bytes))


def build_session(
    master: str | None = None,
    app: str = "peergauge",
    shuffled_bytes: int | None = None,
    cores: int = 1,
    partition_bytes: int = PARTITION_BYTES,
    **conf: str,
) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution merges shuffle partitions that turn out small, and splits
    skewed ones in joins, but does not raise their number. For large input say
    how much the largest shuffle moves, and it starts from partitions of
    ``partition_bytes``, by default such that fit in memory. Where hundreds of
    thousands of them are too many, ask for larger ones and give executors the memory.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # All reports together compile more classes than the cache holds by default.
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        # Saves a stack trace per column expression while plans are built.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if shuffled_bytes:
        partitions = str(shuffle_partitions(shuffled_bytes, cores, partition_bytes))
        builder = builder.config("spark.sql.shuffle.partitions", partitions)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python in batches of at most BATCH_BYTES, or one row.

    By default a batch may hold 64 MB, and a task with two Python steps holds several at a time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return a Python worker's free memory to the system: Spark keeps the worker for later tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read, as the cluster names it.

    Only a local-mode session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="peergauge-")
    spark.sparkContext.setCheckpointDir(own)
    return own


_recorders: list[list[str]] = []


@contextmanager
def recorded_paths() -> Iterator[list[str]]:
    """The list of the shared paths that are made inside the block, for a caller to remove later."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def new_shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/peergauge/{label}-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(path)
    return path


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    planner the true byte size: a later join broadcasts the table only if its
    files are below ``spark.sql.autoBroadcastJoinThreshold``, and shuffles it
    otherwise.
    """
    return write_and_read(df, new_shared_path(df.sparkSession, label))


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beyond_broadcast(df: DataFrame) -> bool:
    """Whether the planner, by its own estimate of the size, would not broadcast these rows."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > limit


def move_path(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; false if there is none, or it cannot be renamed."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(source)):
        return False
    files.mkdirs(path(target).getParent())
    return files.rename(path(source), path(target))


def path_exists(spark: SparkSession, path: str) -> bool:
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()).exists(named)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as file names of that system begin."""
    local = spark._jvm.org.apache.hadoop.fs.Path(path)
    return local.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(local).toString()


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in ``path``; none if it is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote, on whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
