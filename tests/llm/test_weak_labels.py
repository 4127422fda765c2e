"""The weakly supervised quality model: held-out labels, the vote model, and awkward rows."""

import random
import unicodedata
import zlib
from collections import Counter
from math import prod, sqrt

import numpy as np
from helpers_llm import SF, awkward, documents, sf_documents

from peergauge.llm import queries
from peergauge.llm.weak_labels import (
    BUCKETS,
    TRAITS,
    VOTERS,
    fit_quality,
    fit_votes,
    keep_accepted,
    read_documents,
    score_documents,
    votes,
)


def test_verdicts_agree_with_labels_that_were_not_used(spark):
    got = {r.doc_id: r for r in queries.op10_quality(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = Counter(got[r.doc_id].accepted == bool(r.quality) for r in labels)
    assert right[True] >= 0.97 * len(labels)
    assert all(got[r.doc_id].accepted for r in labels if r.quality)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got.values())


def test_expectation_maximisation_recovers_accuracies():
    """Votes drawn from known accuracies; the heuristics overlap at random."""
    rng = random.Random(1)
    truth = [0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.9, 0.85, 0.8, 0.7, 0.95]
    assert len(truth) == len(VOTERS)
    counts = Counter()
    for _ in range(30_000):
        good = rng.random() < 0.7
        pattern = ""
        for right in truth:
            correct = (rng.random() < right) == good
            pattern += "-" if rng.random() < 0.4 else "g" if correct else "b"
        counts[pattern] += 1
    model = fit_votes(counts)
    assert abs(model.good - 0.7) < 0.02
    assert all(abs(a - b) < 0.02 for a, b in zip(model.accuracies, truth, strict=True))


def test_no_votes_and_no_documents(spark):
    assert votes("", []) == "-" * len(VOTERS)
    assert fit_votes({}).good == 0.5
    read = read_documents(documents(spark, []))
    model = fit_quality(read)
    assert score_documents(read, model).collect() == []
    assert keep_accepted(documents(spark, []), model).collect() == []


def test_awkward_rows(spark):
    docs = awkward(spark)
    read = read_documents(docs)
    model = fit_quality(read, fit_documents=5)
    scored = score_documents(read, model).collect()
    assert Counter(r.doc_id for r in scored) == Counter(r.doc_id for r in docs.collect())
    kept = keep_accepted(docs, model)
    assert kept.columns == docs.columns
    accepted = sum(r.accepted for r in scored)
    assert kept.count() == accepted


def test_fit_uses_at_most_the_documented_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(
        "peergauge.llm.weak_labels.fit_scorer", lambda rows: seen.append(len(rows)) or [0.0]
    )
    read = read_documents(documents(spark, [f"some words {i}" for i in range(400)]))
    fit_quality(read, fit_documents=50)
    fit_quality(read, fit_documents=1000)
    assert seen == [50, 400]


def plain_votes(text):
    words = text.split()
    n = len(words)
    if n == 0:
        return "-" * 11
    lines = [x for x in text.split("\n") if x.strip()]
    seen_pairs = {(words[i], words[i + 1]) for i in range(n - 1)}
    raw = text.encode()
    traits = {
        "symbols_per_word": len([c for c in text if c in "#*$%&|<>"]) / n,
        "marks_per_word": len([c for c in text if c == "!"]) / n,
        "bars_per_word": len([c for c in text if c == "|"]) / n,
        "odd_words": len([w for w in words if not (w.isalnum() or w[:-1].isalnum())]) / n,
        "upper_words": len([w for w in words if w.isupper()]) / n,
        "repeated_neighbours": len([i for i in range(1, n) if words[i] == words[i - 1]]) / n,
        "repeated_pairs": (n - 1 - len(seen_pairs)) / n,
        "repeated_lines": (len(lines) - len(set(lines))) / len(lines),
        "compressed_away": (len(raw) - len(zlib.compress(raw, 1))) / len(raw),
    }
    out = "".join("b" if n >= 8 and traits[t] > TRAITS[t][1] else "-" for t in TRAITS)
    out += "b" if n < 8 else "-"
    return out + ("g" if all(traits[t] <= TRAITS[t][0] for t in TRAITS) else "-")


def plain_shape(word):
    out, i = "", 0
    kinds = [unicodedata.category(c) for c in word]
    while i < len(word):
        if kinds[i] == "Lu":
            sign, same = "X", lambda k: k == "Lu"
        elif kinds[i][0] == "L":
            sign, same = "x", lambda k: k[0] == "L"
        elif kinds[i][0] == "N":
            sign, same = "d", lambda k: k[0] == "N"
        else:
            sign, same = word[i], None
        i += 1
        while same and i < len(word) and same(kinds[i]):
            i += 1
        out += sign
    return zlib.crc32(out.encode())


def plain_features(text):
    words = text.split()
    shapes = [plain_shape(w) for w in words]
    keys = list(shapes)
    for i in range(len(words) - 1):
        keys.append(shapes[i] * 0x9E3779B1 + shapes[i + 1] * 2 + (words[i] == words[i + 1]))
    hashed = Counter((k * 0x9E3779B97F4A7C15 % 2**64 >> 40) % BUCKETS for k in keys)
    row = np.zeros(BUCKETS + 1)
    for bucket, times in hashed.items():
        row[bucket] = sqrt(times / len(keys))
    row[BUCKETS] = 1
    return row


def plain_posterior(pattern, good, right):
    """By the rule of Bayes, from products of probabilities."""
    cast = [(v, r) for v, r in zip(pattern, right, strict=True) if v != "-"]
    if_good = good * prod(r if v == "g" else 1 - r for v, r in cast)
    if_bad = (1 - good) * prod(r if v == "b" else 1 - r for v, r in cast)
    return if_good / (if_good + if_bad)


def test_every_column_equals_a_plain_version(spark):
    """Votes, posterior, score and verdict of every document, computed anew row by row."""
    texts = {r.doc_id: r.text or "" for r in sf_documents(spark).collect()}
    cast = {i: plain_votes(t) for i, t in texts.items()}
    good, right = 0.5, [0.9] * len(VOTERS)
    for _ in range(500):
        belief = {p: plain_posterior(p, good, right) for p in set(cast.values())}
        before = [good, *right]
        good = (sum(belief[p] for p in cast.values()) + 1) / (len(cast) + 2)
        right = []
        for h in range(len(VOTERS)):
            of = [belief[p] if p[h] == "g" else 1 - belief[p] for p in cast.values() if p[h] != "-"]
            right.append((sum(of) + 9) / (len(of) + 10))
        if max(abs(a - b) for a, b in zip(before, [good, *right], strict=True)) < 1e-9:
            break
    belief = {i: plain_posterior(p, good, right) for i, p in cast.items()}

    rows = np.array([plain_features(t) for t in texts.values()])
    target = np.array([belief[i] for i in texts])
    weights, momentum = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for i in range(300):
        ahead = weights + momentum * i / (i + 3)
        error = 1 / (1 + np.exp(-rows @ ahead)) - target
        new = ahead - 2.0 * (rows.T @ error / len(rows) + 1e-4 * ahead)
        weights, momentum = new, new - weights
    score = dict(zip(texts, 1 / (1 + np.exp(-rows @ weights)), strict=True))

    read = read_documents(sf_documents(spark))
    got = score_documents(read, fit_quality(read)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.votes == cast[r.doc_id]
        assert abs(r.posterior - belief[r.doc_id]) < 1e-6
        assert abs(r.score - score[r.doc_id]) < 1e-4
        assert r.accepted == (score[r.doc_id] >= 0.5)
