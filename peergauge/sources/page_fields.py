"""Fields of landed hits as they come: what the fixed schema drops, and how fields change by page.

Pages are read as VARIANT, so no schema is inferred and no field is lost, whatever a page adds or
retypes. The fixed reader of ``search_pages`` stays the way into the case table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peergauge.sources.schemas import PAGE_ERRORS, PAGE_FIELDS
from peergauge.sources.search_pages import ARRIVAL, numbered

# Type names of VARIANT, by the kind of JSON value they stand for. Names are cut at
# the first bracket; any other name is a number of some width.
KINDS = {"STRING": "text", "BOOLEAN": "truth", "ARRAY": "list", "OBJECT": "object", "VOID": "null"}


def _open_hits(spark: SparkSession, path: str, one_per_file: bool, at: Column | None) -> DataFrame:
    """ARRIVAL, ``_at`` and the fields of every hit as a map of VARIANT values."""
    options = {"singleVariantColumn": "page", "multiLine": one_per_file, "mode": "FAILFAST"}
    pages = spark.read.options(**options).json(path)
    name = numbered(F.col("_metadata.file_name"))
    error = F.coalesce(*[F.try_variant_get("page", f"$.{e}", "string") for e in PAGE_ERRORS])
    sound = F.when(
        error.isNotNull(), F.raise_error(F.concat(F.lit("page reports an error: "), error))
    ).otherwise(F.variant_get("page", "$.hits.hits", "array<variant>"))
    hits = pages.select(
        F.col("_metadata.file_modification_time").alias("_landed"),
        name.alias("_page"),
        F.col("_metadata.file_path").alias("_file"),
        (name if at is None else at).alias("_at"),
        F.posexplode(sound).alias("_position", "_hit"),
    )
    fields = F.variant_get("_hit", "$._source", "map<string,variant>")
    return hits.select(*ARRIVAL, "_at", fields.alias("fields"))


def read_unknown_fields(
    spark: SparkSession,
    path: str,
    known: tuple[str, ...] = PAGE_FIELDS,
    one_per_file: bool = True,
) -> DataFrame:
    """ARRIVAL, complaint_id and ``unknown``: a VARIANT object of the fields ``known`` does not name.

    One row per hit; ``unknown`` is null where a hit has no such field. A field named twice in one
    hit is malformed and fails the job, as do pages that are cut off or report an error.
    """
    others = F.map_filter("fields", lambda name, _: ~name.isin(*known))
    identity = F.try_variant_get(F.col("fields")["complaint_id"], "$", "string")
    return _open_hits(spark, path, one_per_file, None).select(
        *ARRIVAL,
        identity.alias("complaint_id"),
        F.when(F.size(others) > 0, F.to_variant_object(others)).alias("unknown"),
    )


def field_drift(
    spark: SparkSession,
    path: str,
    known: tuple[str, ...] = PAGE_FIELDS,
    one_per_file: bool = True,
    at: Column | None = None,
) -> DataFrame:
    """Per field and kind of value: known, n_hits, first_page and last_page.

    ``at`` places a page in the order of pages, from the VARIANT column ``page``; by default it is
    the file's name, with numbers by value. A field that a later page adds has a late first page, one
    that goes has an early last page, and one that is retyped has several kinds. Only counts per
    field and kind are shuffled.
    """
    entries = _open_hits(spark, path, one_per_file, at).select(
        "_at", F.explode("fields").alias("field", "value")
    )
    name = F.regexp_extract(F.schema_of_variant("value"), r"^(\w+)", 1)
    kind = F.coalesce(F.create_map(*[F.lit(x) for k in KINDS.items() for x in k])[name], F.lit("number"))
    return (
        entries.groupBy("field", kind.alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("n_hits"),
            F.min("_at").alias("first_page"),
            F.max("_at").alias("last_page"),
        )
        .select("field", "kind", F.col("field").isin(*known).alias("known"), "n_hits", "first_page", "last_page")
    )
