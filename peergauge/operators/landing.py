"""Insert-only deduplication: the first write of an id wins, later ones add nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(
    rows: DataFrame, keys: str | Sequence[str], order: Sequence[str], copies: str | None = None
) -> DataFrame:
    """One row per key: the first by ``order``, then by all other columns.

    An aggregate with a map-side part: of a key that holds most of the rows,
    each task passes on one. ``copies`` names a column with the number of rows
    the key had.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranked = [*order, *[c for c in rows.columns if c not in keys and c not in order]]
    counted = [F.count(F.lit(1)).alias(copies)] if copies else []
    firsts = rows.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_first"), *counted)
    return firsts.select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns],
        *([copies] if copies else []),
    )


def distinct_ids(
    rows: DataFrame, key: str, order: Sequence[str], copies: str | None = None
) -> DataFrame:
    """First row of each id; rows with a null or empty id drop.

    Apply ``text_gate`` afterwards, not before: an id whose first text is too
    short must not come back with a later one.
    """
    named = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return first_per_key(named, key, order, copies)


def keys_in_both(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Keys of the batch that the target holds already, each once.

    The target grows without bound, so it is the streamed side: it is filtered
    by the batch's keys, and not shuffled while those fit a broadcast. Only the
    range of the batch's keys is read of it, as far as the files' statistics tell;
    for that the range is computed at once.
    """
    ends = batch.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    near = target.select(key).where(F.col(key).between(F.lit(ends.low), F.lit(ends.high)))
    return near.join(batch.select(key), key, "left_semi").distinct()


def new_rows(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of a deduplicated batch whose key the target lacks.

    The batch is read twice: pass it through ``write_shared`` if it is costly to
    compute, which also lets the planner know its size.
    """
    return batch.join(keys_in_both(target, batch, key), key, "left_anti")
