"""Quality scores learnt without labels, from heuristics that vote.

Each heuristic looks at one trait of a text and votes bad, votes good or abstains. The heuristics
overlap and err, and nobody says how much: a latent-class model does. By expectation-maximisation over
the numbers of documents per combination of votes, which are few, it estimates how often each
heuristic is right where it votes, and from that the probability that a document with given votes is
good. The traits are chosen so that bad text of any kind shows in two of them at least, for accuracies
are learnt from agreement. The posterior labels then train a linear scorer over hashed pairs of
neighbouring word shapes, which sees the text itself, and so also texts on which no heuristic votes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergauge.llm.common import bounded_batches, slices, whole_text
from peergauge.llm.text_ids import release_encoders
from peergauge.session import write_shared

BUCKETS = 4096
# Documents that the scorer is fitted on: those with the smallest hashes of id and text.
FIT_DOCUMENTS = 20_000
_SYMBOLS = "#*$%&|<>"
_MEMO = 100_000
# Trait -> (nothing odd up to, bad above).
TRAITS: dict[str, tuple[float, float]] = {
    "symbols_per_word": (0.05, 0.1),
    "marks_per_word": (0.1, 0.3),
    "bars_per_word": (0.05, 0.1),
    "odd_words": (0.1, 0.3),
    "upper_words": (0.15, 0.3),
    "repeated_neighbours": (0.05, 0.2),
    "repeated_pairs": (0.3, 0.5),
    "repeated_lines": (0.35, 0.4),
    "compressed_away": (0.7, 0.8),
}
VOTERS = (*TRAITS, "very_short", "nothing_odd")
_SHORT = 8


def _traits(text: str, words: list[str]) -> list[float]:
    n = len(words)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    pairs = list(zip(words, words[1:], strict=False))
    raw = text.encode("utf-8", "surrogatepass")
    return [
        sum(map(text.count, _SYMBOLS)) / n,
        text.count("!") / n,
        text.count("|") / n,
        sum(not w.isalnum() and not w[:-1].isalnum() for w in words) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - (len(set(pairs)) + 1) / n,
        1 - len(set(lines)) / len(lines),
        1 - len(zlib.compress(raw, 1)) / len(raw),
    ]


def votes(text: str, words: list[str]) -> str:
    """A letter per heuristic: b(ad), g(ood) or - ; a text without words gets no vote.

    The shares of a very short text say little; only its length votes against it.
    """
    n = len(words)
    if not n:
        return "-" * len(VOTERS)
    traits = list(zip(_traits(text, words), TRAITS.values(), strict=True))
    calm = all(x <= low for x, (low, _) in traits)
    return (
        "".join("b" if x > high and n >= _SHORT else "-" for x, (_, high) in traits)
        + ("b" if n < _SHORT else "-")
        + ("g" if calm else "-")
    )


class ShapeHasher:
    """Hashed pairs of neighbouring words' shapes: runs of upper, lower, digits and other signs."""

    def __init__(self):
        import regex

        release_encoders()
        shapes = regex.compile(r"(?P<X>\p{Lu}+)|(?P<x>\p{L}+)|(?P<d>\p{N}+)|(?P<s>.)", regex.S)
        self._runs, self._memo = shapes.finditer, {}

    def _shape(self, word: str) -> int:
        runs = self._runs(word)
        parts = [m[0] if m.lastgroup == "s" else m.lastgroup for m in runs]
        return zlib.crc32("".join(parts).encode("utf-8", "surrogatepass"))

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and weights; the weights' squares sum to one unless there are no words."""
        memo = self._memo
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        for word in set(words).difference(memo):
            memo[word] = self._shape(word)
        shapes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(memo) > _MEMO:
            memo.clear()
        same = np.fromiter(map(eq, words, words[1:]), np.uint64, len(words) - 1)
        pairs = shapes[:-1] * np.uint64(0x9E3779B1) + shapes[1:] * np.uint64(2) + same
        mixed = (np.concatenate([shapes, pairs]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        counts = np.bincount((mixed % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        return used, np.sqrt(counts[used] / counts.sum())


@dataclass
class VoteModel:
    """Share of good documents, and how often each heuristic is right where it votes."""

    good: float
    accuracies: list[float]

    def posterior(self, pattern: str) -> float:
        """Probability that a document with these votes is good."""
        odds = math.log(self.good / (1 - self.good))
        for vote, right in zip(pattern, self.accuracies, strict=True):
            if vote != "-":
                weight = math.log(right / (1 - right))
                odds += weight if vote == "g" else -weight
        return 1 / (1 + math.exp(-odds))


def fit_votes(counts: dict[str, int], rounds: int = 500) -> VoteModel:
    """Expectation-maximisation from patterns of votes and how many documents have them.

    Heuristics start as right nine times of ten, and ten imagined votes of that kind keep the
    estimates inside (0, 1); half of the documents are good at first.
    """
    patterns = sorted(counts)
    weights = np.array([counts[p] for p in patterns], float)
    model = VoteModel(0.5, [0.9] * len(VOTERS))
    votes_by = [np.array(list(column)) for column in zip(*patterns, strict=True)]
    for _ in range(rounds):
        good = np.array([model.posterior(p) for p in patterns])
        accuracies = []
        for cast in votes_by or [np.array([])] * len(VOTERS):
            voted = cast != "-"
            right = np.where(cast == "g", good, 1 - good)
            accuracies.append(
                ((weights * right)[voted].sum() + 9) / (weights[voted].sum() + 10)
            )
        share = ((weights * good).sum() + 1) / (weights.sum() + 2)
        moved = max(map(abs, np.subtract([share, *accuracies], [model.good, *model.accuracies])))
        model = VoteModel(float(share), [float(a) for a in accuracies])
        if moved < 1e-9:
            break
    return model


def fit_scorer(
    rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 300, ridge: float = 1e-4
) -> np.ndarray:
    """Weights by bucket, the constant last: logistic regression on soft labels."""
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        return weights
    sizes = [len(buckets) + 1 for buckets, _, _ in rows]
    at = np.repeat(np.arange(len(rows)), sizes)
    columns = np.concatenate([np.append(buckets, BUCKETS) for buckets, _, _ in rows])
    values = np.concatenate([np.append(values, 1.0) for _, values, _ in rows])
    target = np.array([label for _, _, label in rows])
    momentum, step = np.zeros_like(weights), 2.0
    for i in range(rounds):
        ahead = weights + momentum * (i / (i + 3))
        z = np.bincount(at, values * ahead[columns], len(rows))
        error = 1 / (1 + np.exp(-z)) - target
        slope = np.bincount(columns, values * error[at], BUCKETS + 1) / len(rows)
        new = ahead - step * (slope + ridge * ahead)
        momentum, weights = new - weights, new
    return weights


@dataclass
class QualityModel:
    votes: VoteModel
    weights: np.ndarray

    def score(self, buckets: np.ndarray, values: np.ndarray) -> float:
        z = self.weights[buckets] @ values + self.weights[-1]
        return float(1 / (1 + np.exp(-z)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = ShapeHasher()
    for batch in slices(batches, "text"):
        patterns, buckets, values = [], [], []
        for text in batch.column("text").to_pylist():
            words = text.split()
            patterns.append(votes(text, words))
            used, weights = hasher.features(words)
            buckets.append(used.astype("<u2").tobytes())
            values.append(weights.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("pick"),
                pa.array(patterns),
                pa.array(buckets, pa.binary()),
                pa.array(values, pa.binary()),
            ],
            ["doc_id", "pick", "votes", "buckets", "weights"],
        )


def _unpacked(buckets: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(buckets, "<u2").astype(np.int64), np.frombuffer(weights, "<f4")


def read_documents(docs: DataFrame) -> DataFrame:
    """doc_id, votes and hashed features of every whole text, as a written table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", whole_text().alias("text"))
    picked = texts.withColumn("pick", F.xxhash64("doc_id", "text"))
    schema = f"doc_id {kind}, pick long, votes string, buckets binary, weights binary"
    return write_shared(picked.mapInArrow(_read, schema), "quality-features")


def fit_quality(read: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> QualityModel:
    """Vote model over all documents, and scorer on at most ``fit_documents`` of them."""
    # At most three votes to the power of the heuristics.
    counts = {r.votes: r.n for r in read.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit_votes(counts)
    total = max(sum(counts.values()), 1)
    # About half as many again as needed, so that only few rows are sorted.
    least = int(2**64 * min(1.0, 1.5 * (fit_documents + 100) / total)) - 2**63
    few = read.where(F.col("pick") <= F.lit(min(least, 2**63 - 1)))
    rows = few.orderBy("pick", "votes", "buckets", "weights").limit(fit_documents)
    chosen = rows.select("votes", "buckets", "weights").collect()
    fitted = [(*_unpacked(r.buckets, r.weights), model.posterior(r.votes)) for r in chosen]
    return QualityModel(model, fit_scorer(fitted))


def score_documents(read: DataFrame, model: QualityModel, cutoff: float = 0.5) -> DataFrame:
    """doc_id, votes, posterior (of the votes), score (of the scorer) and accepted.

    Every row of the table read by ``read_documents`` gets a score. A null text is empty; a text
    without words has the score that the scorer's constant gives. Rows alike have the same score.
    An empty table gives no rows.
    """
    kind = read.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = zip(
                batch.column("buckets").to_pylist(),
                batch.column("weights").to_pylist(),
                strict=True,
            )
            scores = np.array([model.score(*_unpacked(b, w)) for b, w in packed], float)
            patterns = batch.column("votes")
            posterior = [model.votes.posterior(p) for p in patterns.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    patterns,
                    pa.array(posterior, pa.float64()),
                    pa.array(scores),
                    pa.array(scores >= cutoff),
                ],
                ["doc_id", "votes", "posterior", "score", "accepted"],
            )

    return read.mapInArrow(
        score,
        f"doc_id {kind}, votes string, posterior double, score double, accepted boolean",
    )


def keep_accepted(docs: DataFrame, model: QualityModel, cutoff: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text the scorer accepts, with all their columns."""
    bounded_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShapeHasher()
        for batch in slices(batches, "text"):
            texts = (t or "" for t in batch.column("text").to_pylist())
            good = [model.score(*hasher.features(t.split())) >= cutoff for t in texts]
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
