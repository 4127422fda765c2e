"""Nearest neighbours by inner product: multi-index hashing of learned binary codes.

A few rotations are learned on a bounded sample so that the signs of rotated vectors lose little of
them; together the signs are a vector's code. How often codes of true neighbours differ in how many
bits is measured on the sample too, and sets the search radius. Codes are cut into substrings, and
each substring position has its own index from value to rows. A code within the radius of a query's
must, by the pigeonhole principle, come within radius / substrings of it in one of them; so probing
all such values in every index finds every code within the radius. What is found is compared by whole
codes, and what lies within the radius is ranked by inner products of the original vectors.

Vectors of any length are made equally long by one more component, so that the angle orders them by
inner product. Equal vectors are searched once. Vectors lie in shards of bounded size by their hash,
each with its indexes in a task's memory; queries are a stated set and go to all shards, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergauge.llm.common import bounded_batches
from peergauge.session import write_shared

# Vectors that the codes are learned on, and those of them that the radius is measured with.
FIT_VECTORS = 20_000
FIT_QUERIES = 500
ROTATIONS = 4
# Share of true neighbours that the radius should hold, on the sample.
WITHIN = 0.97
SHARD_VECTORS = 8_192
BLOCK_QUERIES = 65_536
_BITS = 8
_SEED = 7


@dataclass
class CodeModel:
    """Planes whose sides are the bits, the length that all vectors are brought to, the radius."""

    planes: np.ndarray
    longest: float
    radius: int

    @property
    def substrings(self) -> int:
        return self.planes.shape[1] // _BITS

    def codes(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """One byte per substring."""
        short = np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0)
        extra = np.zeros(len(vectors)) if query else np.sqrt(short)
        sides = np.column_stack([vectors, extra]) @ self.planes > 0
        return np.packbits(sides, axis=1)


def _rotation(sample: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """A rotation under which the sample is close to its signs (iterative quantization)."""
    rotation = np.linalg.qr(rng.standard_normal((sample.shape[1], sample.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(sample.T @ np.sign(sample @ rotation))
        rotation = u @ v
    return rotation


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits in which codes differ, row by row."""
    return np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)


def fit_codes(sample: np.ndarray, longest: float, total: int, k: int) -> CodeModel:
    """Learn planes and radius; ``total`` is the number of vectors that the sample stands for."""
    dims = sample.shape[1] + 1
    rng = np.random.default_rng(_SEED)
    model = CodeModel(np.zeros((dims, 0)), longest, 0)
    short = np.sqrt(np.maximum(longest**2 - (sample**2).sum(axis=1), 0))
    wide = np.column_stack([sample, short])
    planes = np.column_stack([_rotation(wide, rng) for _ in range(ROTATIONS)])
    bits = -(-planes.shape[1] // _BITS) * _BITS
    # Random planes fill the last substring.
    fill = rng.standard_normal((dims, bits - planes.shape[1]))
    model.planes = np.column_stack([planes, fill])
    queries = np.arange(min(FIT_QUERIES, len(sample)))
    near = max(1, math.ceil(k * len(sample) / max(total, 1)))
    codes, asked = model.codes(sample), model.codes(sample[queries], query=True)
    found = [np.zeros(1, np.int64)]
    for q in queries:
        scores = sample @ sample[q]
        scores[q] = -np.inf
        best = np.argsort(-scores)[: min(near, len(sample) - 1)]
        found.append(_distances(codes[best], asked[q]))
    model.radius = int(np.quantile(np.concatenate(found), WITHIN, method="higher"))
    return model


class SubstringIndexes:
    """The indexes of one shard: for each substring, rows in order of its value."""

    def __init__(self, codes: np.ndarray):
        self._codes = codes
        n, self._substrings = codes.shape
        self._rows = np.argsort(codes.T, axis=1, kind="stable").ravel()
        ordered = np.sort(codes.T, axis=1)
        values = np.arange(257)
        starts = [np.searchsorted(row, values) + j * n for j, row in enumerate(ordered)]
        self._starts = np.array(starts, np.int64).reshape(self._substrings, 257)
        self._seen = np.zeros(n, bool)
        differing = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
        self._by_distance = [
            np.array([np.flatnonzero(row <= a) for row in differing]) for a in range(_BITS + 1)
        ]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in at most ``radius`` bits."""
        reach = min(radius // self._substrings, _BITS)
        values = self._by_distance[reach][code].astype(np.int64)
        at = np.arange(self._substrings)[:, None]
        begin = self._starts[at, values].ravel()
        count = self._starts[at, values + 1].ravel() - begin
        shift = np.repeat(begin - (np.cumsum(count) - count), count)
        self._seen[self._rows[shift + np.arange(len(shift))]] = True
        rows = np.flatnonzero(self._seen)
        self._seen[rows] = False
        return rows[_distances(self._codes[rows], code) <= radius]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products added up from the first component on, the same for equal vectors."""
    total = np.zeros(len(vectors))
    for i, x in enumerate(query):
        total += vectors[:, i] * x
    return total


def _search(model: CodeModel, k: int) -> Callable:
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not shard.num_rows or not queries.num_rows:
            return schema.empty_table()
        vectors, asked = _matrix(shard.column("vector")), _matrix(queries.column("vector"))
        ids = shard.column("ids").to_pylist()
        indexes, most = SubstringIndexes(model.codes(vectors)), 8 * model.substrings
        out: tuple[list, list, list] = ([], [], [])
        for query, vector, code in zip(
            queries.column("query").to_pylist(), asked, model.codes(asked, query=True), strict=True
        ):
            radius = model.radius
            rows = indexes.within(code, radius)
            # Too few for the rank asked for: look further, in the end at all.
            while len(rows) < min(k, len(vectors)) and radius < most:
                radius += model.substrings
                rows = indexes.within(code, radius)
            scores = _inner(vectors[rows], vector)
            if len(rows) > k:
                keep = scores >= np.partition(scores, -k)[-k]
                rows, scores = rows[keep], scores[keep]
            found = sorted((-s, i) for r, s in zip(rows, scores, strict=True) for i in ids[r])[:k]
            out[0].extend([query] * len(found))
            out[1].extend(i for _, i in found)
            out[2].extend(-s for s, _ in found)
        return pa.table([pa.array(c) for c in out], schema=schema)

    return search


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, fit_vectors: int = FIT_VECTORS
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found of every query.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Candidates are all
    rows but those with the query's own vec_id; nearest is the largest inner product, in double
    precision, ties go to the smaller vec_id. Rows without vec_id, and vectors that are null, empty,
    zero, or have null or non-finite components, take no part; nor do those of another length than
    most (of several equally frequent lengths, than the smallest). A row repeated exactly counts
    once. An empty table, or one vector alone, gives no rows. The codes are fitted on at most
    ``fit_vectors`` vectors, those with the smallest hashes; every vector is indexed.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.where("vec_id is not null").where(usable(F.col("embedding")))
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        is_query.alias("asks"),
    )
    sizes = rows.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "dims").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == most.dims).distinct()
    # Of equal vectors, k + 1 ids are enough for every query; tasks cut before the shuffle.
    ordered = Window.partitionBy("vector").orderBy("vec_id")
    firsts = rows.withColumn("no", F.row_number().over(ordered)).where(F.col("no") <= k + 1)
    ids = F.sort_array(F.collect_list("vec_id")).alias("ids")
    indexed = write_shared(
        firsts.groupBy("vector").agg(ids).withColumn("pick", F.xxhash64("vector")), "vectors"
    )
    queries = rows.where("asks").select("vec_id", "vector")
    asked = write_shared(
        queries.select("vector")
        .distinct()
        .withColumn("query", F.monotonically_increasing_id()),
        "query-vectors",
    )
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    size = indexed.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest")).first()
    model = _fit(indexed, size.n, math.sqrt(size.longest), k, fit_vectors)
    shards = -(-size.n // SHARD_VECTORS)
    blocks = -(-asked.count() // BLOCK_QUERIES)
    left = indexed.select(
        "vector", "ids", _part("pick", shards).alias("shard"), _every(blocks).alias("block")
    )
    right = asked.select(
        "vector", "query", _every(shards).alias("shard"), _part("query", blocks).alias("block")
    )
    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(_search(model, k + 1), "query long, vec_id long, score double")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("no", F.row_number().over(best)).where(F.col("no") <= k + 1)
    listed = ranked.groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("no", "vec_id", "score"))).alias("found")
    )
    answers = listed.join(asked, "query").select("vector", "found")
    others = F.filter("found", lambda f: f["vec_id"] != F.col("query_id"))
    return (
        queries.withColumnRenamed("vec_id", "query_id")
        .join(answers, "vector")
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "f"))
        .select(
            "query_id",
            (F.col("at") + 1).alias("rank"),
            F.col("f.vec_id").alias("vec_id"),
            F.col("f.score").alias("score"),
        )
    )


def _part(number: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(max(parts, 1)).cast("long"))


def _every(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(parts, 1) - 1).cast("long")))


def _fit(indexed: DataFrame, total: int, longest: float, k: int, fit_vectors: int) -> CodeModel:
    # Twice as many by hash as needed, so that only few rows are sorted.
    least = int(2**64 * min(1.0, 2 * (fit_vectors + 100) / total)) - 2**63
    few = indexed.where(F.col("pick") <= F.lit(min(least, 2**63 - 1)))
    chosen = few.orderBy("pick", "vector").limit(fit_vectors).select("vector").toArrow()
    return fit_codes(_matrix(chosen.column("vector")), longest, total, k)
