"""Multi-index hashing: exact retrieval within the radius, recall, and awkward vectors."""

from collections import defaultdict

import numpy as np
from helpers_llm import SF
from pyspark.sql import functions as F

from peergauge.llm import mih, queries
from peergauge.llm.mih import SubstringIndexes, fit_codes, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k):
    out = {}
    for q, x in rows:
        if is_query(q):
            scores = {(-float(np.dot(x, y)), i) for i, y in rows if i != q}
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, expected):
    hits = [len({i for i, _ in got[q]} & {i for i, _ in e}) / len(e) for q, e in expected.items()]
    return sum(hits) / len(hits)


def test_query_finds_nine_of_ten(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = [(r.vec_id, np.array(r.embedding, float)) for r in rows]
    got, expected = found(queries.op1_mih(spark, SF)), brute(vectors, lambda i: i % 20 == 0, 20)
    assert set(got) == set(expected)
    assert recall(got, expected) >= 0.9
    place = dict(vectors)
    for q, near in got.items():
        assert len(near) == 20 and q not in {i for i, _ in near}
        assert near == sorted(near, key=lambda n: (-n[1], n[0]))
        assert all(abs(place[q] @ place[i] - s) < 1e-12 for i, s in near)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (700, 6), dtype=np.uint8)
    codes[300:400] = codes[0] ^ (rng.random((100, 6)) < 0.2).astype(np.uint8)
    indexes = SubstringIndexes(codes)
    for i in (0, 5, 310):
        distance = np.bitwise_count(codes ^ codes[i]).sum(axis=1)
        for radius in (0, 1, 5, 6, 13, 20, 48):
            assert indexes.within(codes[i], radius).tolist() == np.flatnonzero(
                distance <= radius
            ).tolist()


def test_vectors_of_any_length_and_shards(spark, monkeypatch):
    monkeypatch.setattr(mih, "SHARD_VECTORS", 150)
    monkeypatch.setattr(mih, "BLOCK_QUERIES", 9)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((700, 12)) * rng.uniform(0.2, 3, (700, 1))
    vectors = [(i, x.astype(np.float32).astype(float)) for i, x in enumerate(base)]
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in vectors], SCHEMA)
    got = found(nearest(df, F.col("vec_id") % 20 == 0, k=10))
    expected = brute(vectors, lambda i: i % 20 == 0, 10)
    assert set(got) == set(expected) and recall(got, expected) >= 0.9


def test_many_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0, 1.0], 0) for i in range(100)] + [(100 + i, [0.0, 1.0, 0.0], 0) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = found(nearest(df, F.col("vec_id").isin(0, 3, 99, 100), k=4))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4]
    assert [i for i, _ in got[3]] == [0, 1, 2, 4]
    assert [i for i, _ in got[99]] == [0, 1, 2, 3]
    assert got[100] == [(101, 1.0), (102, 1.0), (0, 0.0), (1, 0.0)]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 0),
        (1, [0.0, 1.0], None),
        (1, [0.0, 1.0], None),
        (2, None, 0),
        (3, [0.0, 0.0], 0),
        (4, [nan, 1.0], 0),
        (5, [inf, 1.0], 0),
        (6, [None, 1.0], 0),
        (7, [1.0, 2.0, 3.0], 0),
        (8, [], 0),
        (None, [1.0, 1.0], 0),
        (9, [-1.0, 0.5], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("vector", "query", "ids")})
    got = found(nearest(df, F.col("vec_id") >= 0, k=20))
    assert got == {
        0: [(1, 0.0), (9, -1.0)],
        1: [(9, 0.5), (0, 0.0)],
        9: [(1, 0.5), (0, -1.0)],
    }


def test_no_vectors_no_queries_and_one_vector(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest(empty, F.col("vec_id") >= 0).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)
    assert nearest(one, F.col("vec_id") >= 0).collect() == []
    two = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 1.0], 0)], SCHEMA)
    assert nearest(two, F.col("vec_id") > 5).collect() == []


def test_codes_are_learned_on_the_sample():
    rng = np.random.default_rng(3)
    sample = rng.standard_normal((400, 8))
    longest = float(np.sqrt((sample**2).sum(axis=1).max()))
    model = fit_codes(sample, longest, 400, 5)
    rotation = model.planes[:, :9]
    assert np.allclose(rotation.T @ rotation, np.eye(9))
    assert 0 < model.radius < 8 * model.substrings
