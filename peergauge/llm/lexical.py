"""Ranked search by terms that scans the documents and needs no index of them.

The terms of all items make one Aho-Corasick automaton, each guarded by the blanks around it. It is
built in every task and run over every whole text, so a document's counts of all items' terms come
out of one scan. A second step weighs them: documents times items, in blocks, as a matrix product of
term values and item weights; each task keeps the best of every item, and these are merged.

The automaton is bounded: items are searched in passes of ``PASS_BYTES`` of item texts, and only the
items of one pass, with the statistics of their terms, are on the driver and in a task.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peergauge.llm.common import bounded_batches, slices, whole_text
from peergauge.session import write_shared

# Texts of the items of one pass together, about; or one item.
PASS_BYTES = 16 * 1024**2
# Entries of the matrices of a block.
ITEM_CELLS, VALUE_CELLS = 1_000_000, 2_000_000
# Rows that a task keeps before it drops all but the best of each item.
HELD_ROWS = 200_000
# Code points of a term that go into the automaton.
HEAD = 256
EXACT = 2**53

# Every ASCII character but letters and digits ends a term; A-Z are lower-cased.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def folded(text: str) -> bytes:
    """The text's terms between blanks, as UTF-8."""
    return text.encode().translate(_LETTERS)


def terms_of(text: str) -> list[str]:
    return [term.decode() for term in folded(text).split(b" ") if term]


@dataclass(frozen=True)
class Items:
    """The items of one pass: their ids, and per item the numbers and counts of its terms."""

    ids: list
    terms: list[str]
    numbers: list[list[int]]
    counts: list[list[int]]

    @staticmethod
    def of(rows: list[tuple[object, str]]) -> Items:
        found = [Counter(terms_of(text)) for _, text in rows]
        terms = sorted(set().union(*found))
        number = {term: i for i, term in enumerate(terms)}
        return Items(
            [item_id for item_id, _ in rows],
            terms,
            [[number[term] for term in own] for own in found],
            [list(own.values()) for own in found],
        )


class _Finder:
    """Counts the terms in a text. Each is a pattern between blanks, so it is matched whole.

    Of a very long term only the head is a pattern, as deep tries cannot be freed; what follows
    the head is compared in the text.
    """

    def __init__(self, terms: tuple[str, ...]):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        self._terms, self._headed = terms, []
        heads: dict[str, int] = {}
        for number, term in enumerate(terms):
            if len(term) <= HEAD:
                self._automaton.add_word(f" {term} ", number)
                continue
            head = term[:HEAD]
            if head not in heads:
                heads[head] = len(heads)
                self._headed.append([])
                self._automaton.add_word(f" {head}", -1 - heads[head])
            self._headed[heads[head]].append(number)
        self._automaton.make_automaton()

    def count(self, text: str) -> Counter:
        """Of a text whose terms stand between single blanks or more, and blanks at both ends."""
        if not self._terms:
            return Counter()
        found = Counter([number for _, number in self._automaton.iter(text)])
        if self._headed and any(number < 0 for number in found):
            found = Counter({number: n for number, n in found.items() if number >= 0})
            for end, number in self._automaton.iter(text):
                for long in self._headed[-1 - number] if number < 0 else ():
                    if text.startswith(f"{self._terms[long]} ", end + 1 - HEAD):
                        found[long] += 1
        return found


@functools.lru_cache(maxsize=1)
def _finder(digest: str, terms: tuple[str, ...]) -> _Finder:
    """One automaton per worker process."""
    return _Finder(terms)


def _scan(terms: list[str]) -> Callable:
    digest = hashlib.sha256("\n".join(terms).encode()).hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _finder(digest, tuple(terms)).count
        for batch in slices(batches, "text"):
            sizes, numbers, times = [], [], []
            for text in batch.column("text").to_pylist():
                words = folded(text)
                sizes.append(len(words.split()))
                found = count(f" {words.decode()} ")
                numbers.append(list(found))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(numbers, pa.list_(pa.int32())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                ["doc_id", "n", "terms", "times"],
            )

    return scan


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_blocks(items: Items, weights: np.ndarray) -> list[tuple]:
    """Items in blocks: their numbers, their terms, and the matrix of weights, term by item."""
    blocks, start = [], 0
    while start < len(items.ids):
        end, own = start, set()
        while end < len(items.ids):
            more = own.union(items.numbers[end])
            if end > start and len(more) * (end - start + 1) > ITEM_CELLS:
                break
            own, end = more, end + 1
        terms = np.array(sorted(own), np.int64)
        matrix = np.zeros((len(terms), end - start), np.int64)
        for column, item in enumerate(range(start, end)):
            rows = np.searchsorted(terms, items.numbers[item])
            matrix[rows, column] = np.array(items.counts[item], np.int64) * weights[
                items.numbers[item]
            ]
        # A term's value is at most a million; sums of integers below 2 ** 53 are exact in doubles.
        most = int(matrix.sum(axis=0).max(initial=0)) * 10**6
        blocks.append((start, terms, matrix.astype(float) if most < EXACT else matrix))
        start = end
    return blocks


class _Best:
    """The k best documents of every item so far."""

    def __init__(self, items: int, k: int):
        self._k, self._least = k, np.ones(items, np.int64)
        self._held, self._rows = [], 0

    def add(self, start: int, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        least = self._least[start : start + scores.shape[1]]
        row, item = np.nonzero(scores >= least)
        self._held.append((item + start, scores[row, item].astype(np.int64), ids[row], named[row]))
        self._rows += len(row)
        if self._rows > HELD_ROWS:
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        if not self._held:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))
        item, score, ids, named = map(np.concatenate, zip(*self._held, strict=True))
        order = np.lexsort((ids, ~named, -score, item))
        item, score, ids, named = item[order], score[order], ids[order], named[order]
        first = np.searchsorted(item, item)
        kept = np.arange(len(item)) - first < self._k
        last = np.arange(len(item)) - first == self._k - 1
        self._least[item[last]] = score[last]
        found = item[kept], score[kept], ids[kept], named[kept]
        self._held, self._rows = [found], 0
        return found


def _score(items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, best = _item_blocks(items, weights), _Best(len(items.ids), k)
        place = np.full(len(items.terms), -1, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            lengths = [75 + (25 * n * n_docs) // n_terms for n in batch.column("n").to_pylist()]
            lengths = np.array(lengths, np.int64)
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            ends = np.cumsum([0, *sizes])
            terms = batch.column("terms").flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            docs = np.repeat(np.arange(batch.num_rows), sizes)
            values = 10**9 * times // (1000 * times + 12 * lengths[docs])
            for start, own, matrix in blocks:
                place[own] = np.arange(len(own))
                step = max(VALUE_CELLS // max(len(own), 1), 1)
                for low in range(0, batch.num_rows, step):
                    high = min(low + step, batch.num_rows)
                    part = slice(ends[low], ends[high])
                    column = place[terms[part]]
                    used = column >= 0
                    table = np.zeros((high - low, len(own)), matrix.dtype)
                    table[docs[part][used] - low, column[used]] = values[part][used]
                    best.add(start, table @ matrix, ids[low:high], named[low:high])
                place[own] = -1
        item, found, ids, named = best.rows()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item, pa.int64()),
                pa.array(ids, pa.int64(), mask=~named),
                pa.array(found, pa.int64()),
            ],
            ["item", "doc_id", "score"],
        )

    return score


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of one pass; ``item`` numbers its items."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    scanned = write_shared(
        texts.mapInArrow(
            _scan(items.terms), "doc_id long, n long, terms array<int>, times array<int>"
        ),
        "term-counts",
    )
    totals = scanned.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    schema = "item long, doc_id long, score long"
    if not totals.terms:
        best = spark.createDataFrame([], schema)
    else:
        # One row per term of the pass.
        found = scanned.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        df = {row.term: row["count"] for row in found}
        weights = [weight(totals.docs, df.get(t, 0)) for t in range(len(items.terms))]
        best = scanned.where(F.size("terms") > 0).mapInArrow(
            _score(items, np.array(weights, np.int64), totals.docs, totals.terms, k), schema
        )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_items(
    docs: DataFrame, items: DataFrame, k: int = 20, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every item.

    Documents with score 0 are not returned; equal scores rank by doc_id, null ids last. A null text
    has no terms: as an item it finds nothing, as a document it is never found and counts nowhere.
    Rows of documents that share an id, or have none, are documents of their own. Rows of items alike
    are one item; an id with several texts is ranked for each of them. Empty tables give no rows.
    Only the ids and the texts are read.
    """
    bounded_batches(docs.sparkSession)
    distinct = items.select("item_id", whole_text().alias("text")).distinct()
    distinct = write_shared(distinct, "items")
    size = distinct.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    passes = -(-size // pass_bytes) or 1
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    kind = items.schema["item_id"].dataType.simpleString()
    ranked = []
    for i in range(passes):
        # Bounded by the size of a pass.
        rows = distinct.where(number == i).orderBy("item_id", "text").collect()
        own = Items.of([(row.item_id, row.text) for row in rows])
        names = docs.sparkSession.createDataFrame(
            list(enumerate(own.ids)), f"item long, item_id {kind}"
        )
        found = _search(docs, own, k).join(names, "item")
        ranked.append(found.select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, ranked)


ORACLE_SQL = r"""
WITH doc_terms AS (
    SELECT doc_id, t.term, count(*) AS tf
    FROM documents,
        unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t(term)
    GROUP BY doc_id, t.term
),
item_terms AS (
    SELECT item_id, t.term, count(*) AS c
    FROM benchmark,
        unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t(term)
    GROUP BY item_id, t.term
),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM doc_terms, totals
    WHERE term IN (SELECT term FROM item_terms)
    GROUP BY term, docs
),
measured AS (
    SELECT doc_id, 100 - 25 + ((25 * n * docs) // terms) AS m FROM lengths, totals
),
scored AS (
    SELECT item_id, d.doc_id,
        CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM item_terms i
    JOIN weights USING (term)
    JOIN doc_terms d USING (term)
    JOIN measured ON measured.doc_id = d.doc_id
    GROUP BY item_id, d.doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0
)
WHERE rank <= 20
"""
