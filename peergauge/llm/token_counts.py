"""Token counts of whole texts, from the number of pieces of each distinct pre-token.

Texts are split into pre-tokens. A block of documents is one row: its distinct pre-tokens by number,
and per document which of them it has and how often. Only the distinct pre-tokens are shuffled: over
the corpus each is encoded once, for the number of its pieces, and that number is joined back to the
blocks that have it. A document's count is the sum of pieces times occurrences, so no ids of texts
are ever made.

A pre-token is in a block at most once and a block holds bounded text, so a pre-token that every
document has weighs one row per block, and rows grow with the text. They are sorted by pre-token, so
the copies of other blocks follow each other where it is encoded, and go on from there to the blocks.
"""

from __future__ import annotations

import functools
import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergauge.llm.common import bounded_batches, slices, whole_text
from peergauge.session import write_shared

# Text of a block together, or one text.
BLOCK_BYTES = 32 * 1024**2


class PreTokens:
    """Cuts texts into pre-tokens as the library does, and counts the pieces of one.

    The strings of added tokens are cut out first, as the library's plain call does; each is a
    pre-token of its own, of one piece.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            stated = json.load(file)
        _check_stated(stated)
        added = sorted((t["content"] for t in stated["added_tokens"]), key=len, reverse=True)
        self._added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self._latin = regex.compile(public_tokenizers.PATTERN).findall
        self._library = self._tokenizer.pre_tokenizer.pre_tokenize_str

    def split(self, text: str) -> list[str]:
        if self._added is None or not self._added.search(text):
            return self._plain(text)
        found, start = [], 0
        for match in self._added.finditer(text):
            found += [*self._plain(text[start : match.start()]), match.group()]
            start = match.end()
        return found + self._plain(text[start:])

    def _plain(self, text: str) -> list[str]:
        # Latin-1 characters are of one class in every Unicode version; others are the library's.
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [text[a:b] for _, (a, b) in self._library(text)]
        return self._latin(text)

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        encoded = self._tokenizer.encode_batch(pre_tokens, add_special_tokens=False)
        return [len(e.ids) for e in encoded]


def _check_stated(stated: dict) -> None:
    """Refuse vocabularies whose texts cannot be cut before they are encoded."""
    wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    found = stated.get("pre_tokenizer") or {}
    odd = [t for t in stated["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if stated.get("normalizer") or odd or any(found.get(k) != v for k, v in wanted.items()):
        raise ValueError("not a plain byte-level vocabulary")


@functools.lru_cache(maxsize=1)
def _pre_tokens(vocabulary: str) -> PreTokens:
    return PreTokens(vocabulary)


def _packed(numbers: list[np.ndarray]) -> bytes:
    """Numbers byte plane by byte plane, compressed: the higher planes are nearly constant."""
    joined = np.concatenate([*numbers, np.empty(0, np.uint32)]).astype("<u4")
    planes = np.ascontiguousarray(joined.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], size, "zstd", asbytes=True)
    columns = np.frombuffer(planes, np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(columns).view("<u4").ravel()


def _blocks(vocabulary: str, kind: pa.DataType) -> Callable:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, task, made = _pre_tokens(vocabulary).split, TaskContext.get().partitionId(), 0
        numbers: dict[str, int] = {}
        ids, sizes, widths, words, times = [], [], [], [], []

        def block() -> pa.RecordBatch:
            # Frequent pre-tokens get low numbers, and a document's numbers are steps upwards.
            uses = np.bincount(np.concatenate([*words, np.empty(0, np.int64)]), minlength=len(numbers))
            order = np.argsort(-uses, kind="stable")
            renumbered = np.empty(len(numbers), np.int64)
            renumbered[order] = np.arange(len(numbers))
            names = list(numbers)
            steps, counts = [], []
            for own, often in zip(words, times, strict=True):
                ranks = renumbered[own]
                by_rank = np.argsort(ranks)
                steps.append(np.diff(ranks[by_rank], prepend=0))
                counts.append(often[by_rank])
            row = {
                "block": pa.array([(task << 32) + made], pa.int64()),
                "words": pa.array([[names[i] for i in order]], pa.list_(pa.string())),
                "doc_ids": pa.array([ids], pa.list_(kind)),
                "n_bytes": pa.array([sizes], pa.list_(pa.int64())),
                "widths": pa.array([widths], pa.list_(pa.int64())),
                "steps": pa.array([_packed(steps)], pa.binary()),
                "times": pa.array([_packed(counts)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in slices(batches, "text"):
            lengths = pc.binary_length(batch.column("text")).to_pylist()
            texts = batch.column("text").to_pylist()
            for doc_id, text, size in zip(
                batch.column("doc_id").to_pylist(), texts, lengths, strict=True
            ):
                found = Counter(cut(text))
                for word in found:
                    numbers.setdefault(word, len(numbers))
                words.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                times.append(np.fromiter(found.values(), np.uint32, len(found)))
                ids.append(doc_id)
                sizes.append(size)
                widths.append(len(found))
            if sum(sizes) >= BLOCK_BYTES:
                yield block()
                made += 1
                numbers, ids, sizes, widths, words, times = {}, [], [], [], [], []
        if ids:
            yield block()

    return split


def _counted(vocabulary: str) -> Callable:
    """The pieces of each row's pre-token; rows come in order of it, and each is encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = _pre_tokens(vocabulary).pieces, {}
        for batch in slices(batches, "word"):
            words = batch.column("word").to_pylist()
            fresh = list(dict.fromkeys(word for word in words if word not in known))
            known.update(zip(fresh, pieces(fresh), strict=True))
            found = [known[word] for word in words]
            known = {words[-1]: found[-1]}
            yield pa.RecordBatch.from_arrays(
                [batch.column("of_block"), batch.column("number"), pa.array(found, pa.int32())],
                ["of_block", "number", "pieces"],
            )

    return count


def _summed(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """One block's documents with their sums."""
    pieces = np.zeros(words.num_rows, np.int64)
    pieces[words.column("number").to_numpy()] = words.column("pieces").to_numpy()
    kind = blocks.schema.field("doc_ids").type.value_type
    ids, sizes, totals = [], [], []
    for row in blocks.to_pylist():
        widths = np.array(row["widths"], np.int64)
        ends = np.cumsum(widths)
        # Steps start anew in every document.
        ranks = np.concatenate([[0], np.cumsum(_unpacked(row["steps"]).astype(np.int64))])
        base = np.repeat(ranks[ends - widths], widths)
        of_word = pieces[ranks[1:] - base] * _unpacked(row["times"]).astype(np.int64)
        running = np.concatenate([[0], np.cumsum(of_word)])
        totals += (running[ends] - running[ends - widths]).tolist()
        ids += row["doc_ids"]
        sizes += row["n_bytes"]
    return pa.table(
        {
            "doc_id": pa.array(ids, kind),
            "n_bytes": pa.array(sizes, pa.int64()),
            "n_tokens": pa.array(totals, pa.int64()),
        }
    )


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row.

    ``n_tokens`` is the number of ids that the tokenizers library gives for the whole text without
    special tokens around it; the string of an added token inside a text counts as that token. A
    null text is empty and an empty text has no tokens. Rows that share an id, or have none, stay
    rows of their own. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select("doc_id", whole_text().alias("text"))
    kind = docs.schema["doc_id"].dataType
    empty = spark.createDataFrame([], f"doc_id {kind.simpleString()}").toArrow()
    blocks = write_shared(
        texts.mapInArrow(
            _blocks(vocabulary, empty.schema.field("doc_id").type),
            f"block long, words array<string>, doc_ids array<{kind.simpleString()}>, "
            "n_bytes array<long>, widths array<long>, steps binary, times binary",
        ),
        "pre-tokens",
    )
    words = blocks.select(F.col("block").alias("of_block"), F.posexplode("words").alias("number", "word"))
    counted = (
        words.repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(_counted(vocabulary), "of_block long, number int, pieces int")
    )
    places = blocks.select("block", "doc_ids", "n_bytes", "widths", "steps", "times")
    summed = (
        places.groupBy("block")
        .cogroup(counted.groupBy("of_block"))
        .applyInArrow(_summed, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
    )
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
