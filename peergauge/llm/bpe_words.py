"""Byte-level BPE of a corpus that encodes each distinct word once, and its decoding.

Texts are split into words (pre-tokens) by the vocabulary's pattern. The words of a block of
documents are numbered, so that the block is the list of its words' numbers by position, and only
its *distinct* words go into the global shuffle: dealt out by hash, each distinct word of the corpus
meets its copies of other blocks in one place, is encoded there once, and its ids go back to the
blocks that have it. The blocks themselves are not shuffled: they are written as a table bucketed by
block, and the ids are joined to them.

Words travel packed, in one message per block and share of the hash space. A block holds bounded text
and a word is at most once in a block, so frequent words weigh no more than others. A block sends
messages only to shares it has words for, and a message of one word is a few bytes longer than the
word: whatever the number of shares, messages weigh no more than the blocks' distinct words.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergauge.llm.common import bounded_batches, input_bytes, slices, whole_text
from peergauge.session import new_shared_path

# Texts of a block together, or one text.
BLOCK_BYTES = 10 * 1024**2
# Text on disk for which there is one share of the words, and one bucket of blocks. A task holds its
# share's distinct words, and the blocks' messages with them.
SHARE_BYTES = 128 * 1024**2
# The planner's size of a table of unknown size is beyond any real one.
_UNKNOWN_BYTES = 2**60
# Spark's own limit.
MAX_BUCKETS = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a token's bytes in base64 and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines)}


@functools.lru_cache(maxsize=2)
def _word_encoder(ranks: str, pattern: str):
    import tiktoken

    encoding = tiktoken.Encoding(
        "words", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={}
    )
    return encoding.encode_ordinary


@functools.lru_cache(maxsize=2)
def _token_bytes(ranks: str) -> list[bytes]:
    """The token-byte table by id; as long as the vocabulary."""
    table = read_ranks(ranks)
    tokens = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        tokens[i] = token
    return tokens


def _pack(data: bytes) -> bytes:
    """The size and the compressed data; size 0 and the data itself where they are few bytes."""
    if len(data) < 64:
        return bytes(4) + data
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:4], "little")
    if not size:
        return packed[4:]
    return pa.decompress(packed[4:], decompressed_size=size, codec="zstd", asbytes=True)


def _planes(numbers: np.ndarray) -> bytes:
    """First all numbers' lowest bytes, then the next ones: the higher planes are nearly constant."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return np.ascontiguousarray(planes).tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(planes).view("<u4").ravel()


def _pack_lists(sizes: np.ndarray, items: bytes) -> bytes:
    """Lists as how many there are, their sizes, and their items one behind the other."""
    return _pack(len(sizes).to_bytes(4, "little") + _planes(sizes) + items)


def _unpack_lists(packed: bytes) -> tuple[np.ndarray, bytes]:
    data = _unpack(packed)
    end = 4 + 4 * int.from_bytes(data[:4], "little")
    return _of_planes(data[4:end]), data[end:]


def _pack_words(words: list[str]) -> bytes:
    encoded = [word.encode() for word in words]
    sizes = np.fromiter(map(len, encoded), np.uint32, len(encoded))
    return _pack_lists(sizes, b"".join(encoded))


def _unpack_words(packed: bytes) -> list[str]:
    sizes, data = _unpack_lists(packed)
    ends = np.cumsum([0, *sizes.tolist()], dtype=np.int32)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.string(), len(sizes), buffers).to_pylist()


def _blocks(pattern: str, shares: int) -> Callable:
    """Turns documents into blocks: one row of positions, and one row of words per share."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash

        find, hashed = regex.compile(pattern).findall, xxhash.xxh3_64_intdigest
        task, made = TaskContext.get().partitionId(), 0
        numbers: dict[str, int] = {}
        ids, counts, codes, size = [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list[str]] = {}
            for word in numbers:
                dealt.setdefault(hashed(word) % shares, []).append(word)
            # Words are numbered anew by share and name; neighbours alike compress well.
            lists = [(s, sorted(dealt[s])) for s in sorted(dealt)]
            renumbered = np.empty(len(numbers), np.uint32)
            ordered = (numbers[word] for _, words in lists for word in words)
            old = np.fromiter(ordered, np.int64, len(numbers))
            renumbered[old] = np.arange(len(numbers), dtype=np.uint32)
            positions = renumbered[np.concatenate([*codes, np.empty(0, np.uint32)])]
            lists = [(s, _pack_words(words)) for s, words in lists]
            key, n = (task << 32) + made, len(lists)
            schema = pa.schema(
                [
                    ("block", pa.int64()),
                    ("share", pa.int32()),
                    ("words", pa.binary()),
                    ("doc_ids", pa.list_(batch_kind)),
                    ("counts", pa.list_(pa.int64())),
                    ("positions", pa.binary()),
                ]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key] * (n + 1), pa.int64()),
                    pa.array([s for s, _ in lists] + [None], pa.int32()),
                    pa.array([w for _, w in lists] + [None], pa.binary()),
                    pa.array([None] * n + [ids], pa.list_(batch_kind)),
                    pa.array([None] * n + [counts], pa.list_(pa.int64())),
                    pa.array([None] * n + [_pack(_planes(positions))], pa.binary()),
                ],
                schema=schema,
            )

        batch_kind = None
        for batch in slices(batches, "text"):
            batch_kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                words = find(text)
                fresh = set(words).difference(numbers)
                numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh))))
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                ids.append(doc_id)
                counts.append(len(words))
                size += len(text)
            if size >= BLOCK_BYTES:
                yield from block()
                made += 1
                numbers, ids, counts, codes, size = {}, [], [], [], 0
        if ids:
            yield from block()

    return split


def _encode_share(ranks: str, pattern: str) -> Callable:
    """All blocks' words of one share; every distinct word is encoded once."""

    def encode(rows: pa.Table) -> pa.Table:
        encoder, known = _word_encoder(ranks, pattern), {}
        out = []
        for packed in rows.column("words").to_pylist():
            words = _unpack_words(packed)
            for w in words:
                if w not in known:
                    known[w] = encoder(w)
            lists = [known[w] for w in words]
            sizes = np.fromiter(map(len, lists), np.uint32, len(lists))
            values = np.fromiter((i for ids in lists for i in ids), np.uint32, int(sizes.sum()))
            out.append(_pack_lists(sizes, _planes(values)))
        return pa.table(
            {
                "block": rows.column("block"),
                "share": rows.column("share"),
                "encoded": pa.array(out, pa.binary()),
            }
        )

    return encode


def _reassemble(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """One block's documents as packed ids, from its words' ids by position."""
    kind = blocks.schema.field("doc_ids").type.value_type
    words = words.sort_by("share")
    lists = [_unpack_lists(data) for data in words.column("encoded").to_pylist()]
    values = np.concatenate([*(_of_planes(v) for _, v in lists), np.empty(0, np.uint32)])
    sizes = np.concatenate([*(n for n, _ in lists), np.empty(0, np.uint32)]).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    ids, out = [], []
    for doc_ids, counts, packed in zip(
        *(blocks.column(c).to_pylist() for c in ("doc_ids", "counts", "positions")), strict=True
    ):
        positions = _of_planes(_unpack(packed))
        ends = np.cumsum([0, *counts])
        for doc_id, a, b in zip(doc_ids, ends, ends[1:], strict=False):
            own = positions[a:b]
            length = sizes[own]
            total = int(length.sum())
            shift = np.repeat(starts[own] - (np.cumsum(length) - length), length)
            out.append(values[shift + np.arange(total)].astype("<u4").tobytes())
            ids.append(doc_id)
    return pa.table({"doc_id": pa.array(ids, kind), "ids": pa.array(out, pa.binary())})


def _parts(texts: DataFrame) -> int:
    """Shares of the hash space by the size of the text, as far as the planner knows it."""
    size = input_bytes(texts)
    return size // SHARE_BYTES + 1 if size < _UNKNOWN_BYTES else 1


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (packed, 4 little-endian bytes each) of every row's whole text.

    The ids are those that tiktoken's ``encode_ordinary`` gives for the whole text. A null text is
    empty, and an empty text has no ids. Rows that share an id, or have none, stay rows of their
    own. Other columns are not read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _parts(docs.select("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        _blocks(pattern, parts),
        f"block long, share int, words binary, doc_ids array<{kind}>, counts array<long>, "
        "positions binary",
    )
    table = f"word_blocks_{uuid.uuid4().hex}"
    (
        blocks.write.option("path", new_shared_path(spark, "word-blocks"))
        .bucketBy(min(parts, MAX_BUCKETS), "block")
        .saveAsTable(table)
    )
    written = spark.table(table)
    words = written.where("share is not null").select("block", "share", "words")
    encoded = words.groupBy("share").applyInArrow(
        lambda rows: _encode_share(ranks, pattern)(rows), "block long, share int, encoded binary"
    )
    places = written.where("share is null").select("block", "doc_ids", "counts", "positions")
    return (
        places.groupBy("block")
        .cogroup(encoded.groupBy("block"))
        .applyInArrow(_reassemble, f"doc_id {kind}, ids binary")
    )


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """Every row's ``ids`` followed by ``decoded``, the bytes they stand for.

    The token-byte table has one entry per id of the vocabulary, so each task keeps it whole. Null
    ids decode to no bytes; an id outside the table fails the job.
    """
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kinds) + ", decoded binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _token_bytes(ranks).__getitem__
        for batch in slices(batches, "ids"):
            texts = [
                b"".join(map(token, np.frombuffer(p or b"", "<u4").tolist()))
                for p in batch.column("ids").to_pylist()
            ]
            columns = [*batch.columns, pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*kinds, "decoded"])

    return encoded.mapInArrow(decode, schema)
