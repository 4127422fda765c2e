"""Packing of token ids into windows of fixed size with little padding.

A document of at least one window gives whole windows; what remains of it is shorter than a window.
Remainders are packed by minimum bin slack over the *numbers of remainders of each length*: the
longest one left opens a window, and a subset-sum over bitsets finds the multiset of other lengths
that fills it closest. A filling found is repeated as often as the numbers allow, so the plan has at
most as many entries as there are lengths, however many documents there are. Lengths that no multiset
fills up to ``max_slack`` are laid one behind the other and cut at the window's edge, which leaves
padding in the last window only.

Which remainder goes where follows from its number among those of its length: tasks count their own
while encoding, and the tasks' counts are added up afterwards. No row is sorted or gathered for it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peergauge.llm.common import bounded_batches, slices, whole_text
from peergauge.llm.text_ids import ID_BYTES, encoder
from peergauge.session import write_shared


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``, as length -> how many.

    Bit s of a bitset says that some multiset sums to s. Numbers are split into powers of two, so
    a length takes few steps; the bitsets of the steps are kept to walk back from the best sum.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << (length * many)) & full
            left -= many
            many *= 2
        if reach >> room & 1:
            break
    best, fill = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> best & 1:
            best -= length * many
            fill[length] = fill.get(length, 0) + many
    return fill


@dataclass
class WindowPlan:
    """Where the k-th remainder of a length goes.

    ``runs[length]`` holds (first k, pieces per window, first window, offset in the window), by first
    k; ``tail[length]`` is (first k, place of that remainder in the tail). Windows count from 0, and
    the tail begins with window ``tail_window``.
    """

    capacity: int
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    tail: dict[int, tuple[int, int]] = field(default_factory=dict)
    tail_window: int = 0

    def pieces(self, length: int, k: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, window, offset in the window) of each piece."""
        if length in self.tail and k >= self.tail[length][0]:
            first, place = self.tail[length]
            window, offset = divmod(place + (k - first) * length, self.capacity)
            window += self.tail_window
            here = min(length, self.capacity - offset)
            pieces = [(0, here, window, offset)]
            return pieces + [(here, length - here, window + 1, 0)] * (here < length)
        runs = self.runs[length]
        first, per_window, window, offset = runs[bisect_right(runs, k, key=lambda r: r[0]) - 1]
        repeat, slot = divmod(k - first, per_window)
        return [(0, length, window + repeat, offset + slot * length)]


def plan_windows(counts: dict[int, int], capacity: int, max_slack: int) -> WindowPlan:
    """Fill windows from remainders by length; ``counts`` has at most capacity - 1 lengths."""
    plan, left = WindowPlan(capacity), {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    tail: dict[int, int] = {}
    while left:
        longest = max(left)
        others = {n: c - (n == longest) for n, c in left.items()}
        fill = closest_fill(others, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        if capacity - sum(n * c for n, c in fill.items()) > max_slack:
            tail[longest] = left.pop(longest)
            continue
        repeats, offset = min(left[n] // c for n, c in fill.items()), 0
        for n, c in sorted(fill.items(), reverse=True):
            plan.runs.setdefault(n, []).append((used[n], c, plan.tail_window, offset))
            offset += n * c
            used[n] += repeats * c
            left[n] -= repeats * c
            if not left[n]:
                del left[n]
        plan.tail_window += repeats
    place = 0
    for n in sorted(tail, reverse=True):
        plan.tail[n] = (used[n], place)
        place += n * tail[n]
    return plan


def encode_and_count(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int
) -> DataFrame:
    """Each row's packed ids, with the numbers that its task gave out.

    ``rest`` is the length of the remainder, ``rest_no`` its number among those of its length in
    the task, and ``whole_no`` the number of the row's first whole window in the task.
    """
    end = end_id.to_bytes(ID_BYTES, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, texts = TaskContext.get().partitionId(), encoder(vocabulary)
        rests, windows = [0] * capacity, 0
        for batch in slices(batches, "text"):
            packed = texts.encode_array(batch.column("text"), end)
            numbers = []
            for size in pc.binary_length(packed).to_pylist():
                whole, rest = divmod(size // ID_BYTES, capacity)
                numbers.append((rest, rests[rest], windows))
                rests[rest] += 1
                windows += whole
            rest, rest_no, whole_no = map(list, zip(*numbers, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    packed,
                    pa.array([task] * len(packed), pa.int32()),
                    pa.array(rest, pa.int32()),
                    pa.array(rest_no, pa.int64()),
                    pa.array(whole_no, pa.int64()),
                ],
                ["doc_id", "ids", "task", "rest", "rest_no", "whole_no"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        encode,
        f"doc_id {kind}, ids binary, task int, rest int, rest_no long, whole_no long",
    )


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = 2048,
    max_slack: int = 2,
) -> DataFrame:
    """Pieces of all documents' ids and their places in sequences of ``capacity`` ids.

    Returns doc_id, start, length, ids (packed, 4 bytes each), doc_tokens, sequence_id, offset.
    ``ids`` of a document are those of its text and ``end_id``; a null text is empty, so every row
    has at least that id. Sequence ids count from 0 without gaps, and offsets in a sequence are
    gapless from 0. Rows alike, also with the same or a null doc_id, are packed each for itself.
    An empty table gives no pieces. Only doc_id and text are read, so other columns do not matter.
    The pieces come from a table in the shared folder, so they can be read again.
    """
    bounded_batches(docs.sparkSession)
    encoded = write_shared(encode_and_count(docs, vocabulary, end_id, capacity), "token-ids")
    counts = encoded.groupBy("task", "rest").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.floor(F.length("ids") / ID_BYTES / capacity)).alias("windows"),
    )
    counts = write_shared(counts, "token-counts")
    # At most ``capacity`` rows.
    totals = counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows"))
    found = totals.collect()
    windows = sum(row.windows for row in found)
    plan = plan_windows({r.rest: r.n for r in found if r.rest}, capacity, max_slack)

    by_rest = Window.partitionBy("rest").orderBy("task")
    before_rest = counts.select(
        "task", "rest", (F.sum("n").over(by_rest) - F.col("n")).alias("rests_before")
    )
    # One row per task of the encoding job.
    tasks = counts.groupBy("task").agg(F.sum("windows").cast("long").alias("own"))
    before_task = tasks.select(
        "task", (F.sum("own").over(Window.orderBy("task")) - F.col("own")).alias("windows_before")
    )
    # One row per task, with at most ``capacity`` numbers by length.
    by_task = before_rest.groupBy("task").agg(
        F.sort_array(F.collect_list(F.struct("rest", "rests_before"))).alias("found")
    )
    bases = write_shared(
        by_task.join(before_task, "task").select(
            "task",
            F.col("found.rest").alias("rests"),
            F.col("found.rests_before").alias("rests_before"),
            "windows_before",
        ),
        "token-bases",
    )
    own_base = F.element_at("rests_before", F.array_position("rests", F.col("rest")).cast("int"))
    numbered = encoded.join(bases, "task").select(
        "doc_id",
        "ids",
        (F.col("rest_no") + own_base).alias("rest_no"),
        (F.col("whole_no") + F.col("windows_before")).alias("whole_no"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(
        _cutter(plan, windows),
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long",
    )


def _cutter(plan: WindowPlan, windows: int):
    """Cuts rows into pieces; the plan is bounded by the number of lengths and goes with the task."""
    capacity = plan.capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            rows, pieces, ids = [], [], []
            packed = batch.column("ids").to_pylist()
            numbers = zip(
                packed, batch["rest_no"].to_pylist(), batch["whole_no"].to_pylist(), strict=True
            )
            for row, (data, rest_no, whole_no) in enumerate(numbers):
                total = len(data) // ID_BYTES
                whole, rest = divmod(total, capacity)
                own = [(i * capacity, capacity, whole_no + i, 0) for i in range(whole)]
                if rest:
                    own += [
                        (whole * capacity + start, length, windows + window, offset)
                        for start, length, window, offset in plan.pieces(rest, rest_no)
                    ]
                for start, length, sequence, offset in own:
                    rows.append(row)
                    ids.append(data[start * ID_BYTES : (start + length) * ID_BYTES])
                    pieces.append((start, length, total, sequence, offset))
            start, length, total, sequence, offset = zip(*pieces, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(total, pa.int64()),
                    pa.array(sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return cut
