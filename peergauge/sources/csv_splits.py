"""Records of large CSV files whose quoted fields hold line breaks, read by many tasks.

A task reads the lines of its part of a file and cannot tell whether the first one begins a record
or continues a quoted field. The quotes decide: a line break ends a record if the number of quotes
before it in the file is even. So one job counts the quotes of every part, their running parity tells
each part how it begins, and then all parts are cut into records on their own. Only the records that
lie across the ends of parts are put together from their pieces.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peergauge.session import write_shared

# A sound record: fields are quoted as a whole, with doubled quotes inside, or hold no quote.
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",\n]*+)'
_SOUND = re.compile(f"{_FIELD}(?:,{_FIELD})*+")
# What a piece of a part's lines is: the end of a record, its middle, or its beginning.
_OTHER_PARTS = "the files, or the settings of file splits, changed after their quotes were counted"
HEAD, MIDDLE, TAIL = "head", "middle", "tail"


@dataclass(frozen=True)
class Records:
    """The fields of the header, and the texts of all other records."""

    header: tuple[str, ...]
    texts: DataFrame


def read_records(spark: SparkSession, path: str) -> Records:
    """All records of the files at ``path``, which must share their header.

    Records end in a line feed, or a carriage return and a line feed, outside quotes; empty ones are
    skipped. In a file whose lines all end in both, those inside fields become line feeds. A field that is quoted in part, or not closed at the end of its file, fails. Parts are
    those of Spark's file splits; the settings that decide about them must stay until the records
    are read, else reading fails.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        "value",
    )
    begins = _beginnings(lines)
    pieces = write_shared(
        lines.mapInArrow(
            _cutter(begins, wholes=False),
            "file long, part long, kind string, first boolean, text string",
        ),
        "csv-pieces",
    )
    joined = write_shared(_joined(pieces), "csv-joined")
    if not joined.where("not closed").isEmpty():
        raise ValueError(f"a quoted field is not closed at the end of a file of {path}")
    headers = pieces.where("first and kind is null").select("text").union(
        joined.where("first").select("text")
    )
    found = [r.text.removeprefix("﻿") for r in headers.distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"the CSV headers of the files of {path} differ")
    wholes = lines.mapInArrow(_cutter(begins, wholes=True), "text string")
    texts = wholes.union(joined.where("not first").select("text"))
    return Records(tuple(next(csv.reader(found), ())), texts)


@dataclass(frozen=True)
class _Start:
    """How a part of a file begins: inside quotes or not; its lines, and whether they end in a return."""

    is_open: bool
    lines: int
    returns: bool


def _beginnings(lines: DataFrame) -> dict[tuple[int, int], _Start]:
    """The start of every part: an entry per task of a scan."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "part").agg(
        F.sum(quotes).alias("quotes"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.endswith("value", F.lit("\r"))).alias("returns"),
    )
    parts = sorted(counts.collect())
    others: dict[int, int] = {}
    for row in parts:
        others[row.file] = others.get(row.file, 0) + row.lines - row.returns
    begins, file, is_open = {}, None, False
    for row in parts:
        if row.file != file:
            file, is_open = row.file, False
        # The last line need not end at all.
        begins[row.file, row.part] = _Start(is_open, row.lines, others[row.file] <= 1)
        is_open ^= bool(row.quotes % 2)
    return begins


def _joined(pieces: DataFrame) -> DataFrame:
    """(text, first, closed) of the records that lie across parts."""
    torn = pieces.where("kind is not null")
    # Two rows per part at most; a tail begins a record.
    order = (F.col("part"), F.col("kind") == TAIL)
    number = F.count_if(F.col("kind") == TAIL).over(
        Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    numbered = write_shared(torn.select("file", "part", "kind", number.alias("record")), "csv-torn")
    of_record = torn.join(numbered, ["file", "part", "kind"])
    in_order = F.sort_array(F.collect_list(F.struct("part", "text")))
    return of_record.groupBy("file", "record").agg(
        F.array_join(F.transform(in_order, lambda piece: piece["text"]), "\n").alias("text"),
        F.bool_or("first").alias("first"),
        F.bool_or(F.col("kind") == HEAD).alias("closed"),
    ).select(F.regexp_replace("text", r"\r$", "").alias("text"), "first", "closed")


class _Part:
    """Cuts the lines of one part, as they come, into records and torn pieces."""

    def __init__(self, file: int, part: int, start: _Start):
        self.file, self.part, self._start = file, part, start
        self._open, self._torn, self._left = start.is_open, start.is_open, start.lines
        self._first, self._held = part == 0, []

    def feed(self, lines: pa.Array) -> Iterator[tuple[str | None, bool, str]]:
        """(kind, first, text) of what ends in these lines; kind is null for whole records."""
        self._left -= len(lines)
        odd = (pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2).tolist()
        for line, flips in zip(lines.to_pylist(), odd, strict=True):
            self._held.append(line.removesuffix("\r") if self._start.returns else line)
            self._open ^= bool(flips)
            if not self._open:
                yield self._taken(HEAD if self._torn else None)
                self._torn = False

    def rest(self) -> Iterator[tuple[str | None, bool, str]]:
        if self._left:
            raise ValueError(_OTHER_PARTS)
        if self._held:
            yield self._taken(MIDDLE if self._torn else TAIL)

    def _taken(self, kind: str | None) -> tuple[str | None, bool, str]:
        text, first = "\n".join(self._held), self._first
        self._held, self._first = [], False
        return kind, first, text if kind else _sound(text.removesuffix("\r"))


def _sound(record: str) -> str:
    if '"' in record and not _SOUND.fullmatch(record.removeprefix("﻿")):
        raise ValueError(f"malformed CSV record, quoted in part: {record[:200]!r}")
    return record


def _cutter(begins: dict[tuple[int, int], _Start], wholes: bool) -> Callable:
    """For the texts of whole records, or for the pieces of others and the headers."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        current = None
        for batch in batches:
            file, part = (batch.column(c).to_numpy() for c in ("file", "part"))
            cuts = ((file[1:] != file[:-1]) | (part[1:] != part[:-1])).nonzero()[0] + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                key = int(file[start]), int(part[start])
                if current is None or (current.file, current.part) != key:
                    if current:
                        yield [(*row, current) for row in current.rest()]
                    if key not in begins:
                        raise ValueError(_OTHER_PARTS)
                    current = _Part(*key, begins[key])
                lines = batch.column("value").slice(start, end - start)
                yield [(*row, current) for row in current.feed(lines)]
        if current:
            yield [(*row, current) for row in current.rest()]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts(batches):
            texts = [t for kind, first, t, _ in rows if kind is None and not first and t]
            yield pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts(batches):
            kept = [row for row in rows if row[0] is not None or row[1]]
            kinds, firsts, texts, places = map(list, zip(*kept, strict=True)) if kept else [[]] * 4
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([p.file for p in places], pa.int64()),
                    "part": pa.array([p.part for p in places], pa.int64()),
                    "kind": pa.array(kinds, pa.string()),
                    "first": pa.array(firsts, pa.bool_()),
                    "text": pa.array(texts, pa.string()),
                }
            )

    return whole if wholes else pieces
