"""Near duplicates against all pairs of exact shingle sets."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import AWKWARD, SF, awkward, documents, sf_documents

from peergauge.llm import near_dups, queries
from peergauge.llm.components import connected_components
from peergauge.llm.near_dups import least_matches, near_duplicates


def shingles(text, size):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    for white in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(white, " ")
    words = [w for w in lowered.split(" ") if w]
    width = min(size, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def roots(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def brute(rows, size=2, percent=80):
    sets = {r.doc_id: shingles(r.text, size) for r in rows if r.doc_id is not None}
    links = []
    for (a, x), (b, y) in combinations(sets.items(), 2):
        if not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            continue
        common = len(x & y)
        if 100 * common >= percent * (len(x) + len(y) - common):
            links.append((a, b))
    root = roots(links, sets)
    return Counter(
        (r.doc_id, len(shingles(r.text, size)), root.get(r.doc_id), root.get(r.doc_id) == r.doc_id or r.doc_id is None)
        for r in rows
    )


def test_query_equals_all_pairs(spark):
    got = queries.op6_minhash(spark, SF)
    assert dict(got.dtypes)["component_id"] == "bigint"
    assert Counter(map(tuple, got.collect())) == brute(sf_documents(spark).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = near_duplicates(docs, size=2)
    assert Counter(map(tuple, got.collect())) == brute(docs.collect())


def test_no_rows(spark):
    assert near_duplicates(documents(spark, [])).collect() == []


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("tile", [4, 2000])
def test_groups_with_chains_hot_passages_and_copies(spark, monkeypatch, tile):
    """Small tiles make every list span several; chains link what is not alike itself."""
    monkeypatch.setattr(near_dups, "LIST_CLASSES", tile)
    monkeypatch.setattr(near_dups, "TILE_SHINGLES", 1000 * tile // 8)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        texts += [edited(rng, base, rng.randint(0, 9)) for _ in range(15)]
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, 3).split(" ")
            texts.append(" ".join(chain))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(k)]) for k in range(0, 60, 2)]
    texts += [texts[0].upper()] * 20
    rng.shuffle(texts)
    docs = documents(spark, texts)
    got = near_duplicates(docs, size=2)
    assert Counter(map(tuple, got.collect())) == brute(docs.collect())


def test_rows_in_tiles_of_a_hot_group_grow_with_it(spark, monkeypatch):
    """Near copies by the thousand: twice as many give at most about twice the rows."""
    monkeypatch.setattr(near_dups, "LIST_CLASSES", 100)
    monkeypatch.setattr(near_dups, "TILE_SHINGLES", 10_000)
    rows, tiles = [], near_dups._Search.tiles

    def counted(self, *args):
        found, links = tiles(self, *args)
        rows[-1] += found.count()
        return found, links

    monkeypatch.setattr(near_dups._Search, "tiles", counted)
    rng = random.Random(4)
    base = [f"w{rng.randrange(4000)}" for _ in range(80)]
    for n in (600, 1200):
        rows.append(0)
        texts = [edited(rng, base, rng.randint(0, 3)) for _ in range(n)]
        got = near_duplicates(documents(spark, texts), size=2).collect()
        assert {r.component_id for r in got} == {0} and len(got) == n
    assert rows[1] <= 2.3 * rows[0]


def test_lists_of_the_same_classes_are_searched_once(spark, monkeypatch):
    """Near copies share most of their postings: a group of two costs two rows, not two per posting."""
    rows, tiles = [], near_dups._Search.tiles

    def counted(self, *args):
        if args[1] == "posting":
            rows.append(args[0].count())
        return tiles(self, *args)

    monkeypatch.setattr(near_dups._Search, "tiles", counted)
    rng = random.Random(5)
    texts = []
    for i in range(30):
        base = [f"w{i}x{j}" for j in range(100)]
        texts += [" ".join(base), edited(rng, base, 2)]
    got = near_duplicates(documents(spark, texts), size=2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 2) for i in range(60)}
    assert rows == [60]


@pytest.mark.parametrize("hashed", [5, 32_768])
@pytest.mark.parametrize("size", [1, 2, 5])
def test_sets_and_signatures_of_many_texts_are_those_of_each(monkeypatch, size, hashed):
    """Texts are handled together; sets that begin or end inside a part are whole."""
    monkeypatch.setattr(near_dups, "HASHED_SHINGLES", hashed)
    texts, keys = AWKWARD + ["A a b " * 9, "", "B a"], near_dups._keys(3)
    found, counts = near_dups.Shingler(size).shingles(pa.array([None, *texts]).slice(1))
    assert counts.tolist() == [len(shingles(t, size)) for t in texts]
    sets = [x.tolist() for x in np.split(found, np.cumsum(counts)[:-1])]
    assert all(x == sorted(set(x)) for x in sets)
    alone = [near_dups.Shingler(size).shingles(pa.array([t]))[0].tolist() for t in texts]
    assert sets == alone

    def least(values, key):
        low = (1 << 64) - 1
        hashed = [(v * (key | 1)) & low for v in values]
        return min(((h ^ h >> 32) * 0x9E3779B97F4A7C15) & low for h in hashed) >> 32

    expected = [[least(x, k) for k in keys.tolist()] for x in sets if x]
    assert near_dups._signatures(found, counts, keys).tolist() == expected


def test_least_matches_miss_little():
    assert least_matches(0.8, 64) == 38
    assert least_matches(1.0, 64) == 64


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i + 1, i) for i in range(200, 260)] + [(5, i) for i in range(10, 90)]
    links += [(3, 3), (7, None), (90, 10), (90, 10)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    expected = {i: 200 for i in range(200, 261)} | {i: 5 for i in [5, *range(10, 91)]} | {3: 3}
    assert {r.node: r.component for r in got.collect()} == expected


def test_components_of_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
