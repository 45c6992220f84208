"""Operator 9: best-fit packing with exact-complement hashing.

Pieces differ, for packing, by length alone, so the plan works on the counts of each length (at most `limit` of them).
The longest piece at hand leaves a gap. Best fit fills it with the longest piece that it holds, and so on; where that leaves
room, the gap's exact complements are looked up among the sums of one, two and three lengths at hand, longest parts first,
and one is taken instead, as often as its counts last, if its longest part is shorter than best fit's by twice that room
at most: a filling of many short pieces would spend what later gaps need. The plan is a list of runs: the pieces of one length, numbered, from one number on, go to
these sequences at this offset. Each task numbers the pieces of each length that it makes; adding the counts of the
tasks before it gives numbers over the whole table, and each piece reads its place from the plan.

Only counts by (task, length) are shuffled and only counts by length reach the driver; the counts of the tasks before
meet the pieces by a join of (task, length), which shuffles pieces (no texts) where the counts are too many to broadcast. The plan's size is bounded by
the lengths, not by the documents.

Defined results: null text is empty (the end id alone); texts beyond the limit are cut into whole pieces and a last one; of equal
pieces the first numbered go first, and of exact complements the one of fewest parts, then of the longest; repeated rows are packed as so many documents; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import blocks
from .shared import stored
from .tokens import TOKEN_BLOCK, encoded, with_end

LIMIT = 4096
_PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, task int, number bigint"


class Sums:
    """Single, pair and triple sums of the lengths at hand; a gap's exact complements are looked up by sum."""

    def __init__(self, left: np.ndarray):
        self.left, self.size = left, 1 << (2 * len(left)).bit_length()

    def refresh(self) -> None:
        """Index again which sums two lengths at hand have: the products of the lengths' generating function with itself."""
        self.single = self.left > 0
        wave = np.fft.rfft(self.single.astype(float), self.size)
        self.pair = np.fft.irfft(wave * wave, self.size)[: len(self.left)] > 0.5

    def complements(self, gap: int, least: int, most: int) -> Iterator[tuple[int, ...]]:
        """One length, then two, then three that sum to `gap`, falling, the first of `least` to `most`; longest first."""
        if least <= gap <= most and self.single[gap]:
            yield (gap,)
        yield from self._pairs(gap, least, most)
        first = np.arange(max(least, -(-gap // 3)), min(most, gap - 2) + 1)
        for x in first[self.single[first] & self.pair[gap - first]][::-1].tolist():
            for rest in self._pairs(gap - x, 1, x):
                yield (x, *rest)

    def _pairs(self, total: int, least: int, most: int) -> Iterator[tuple[int, int]]:
        if total < 2 or not self.pair[total]:
            return
        x = np.arange(max(least, (total + 1) // 2), min(total - 1, most) + 1)
        for y in x[self.single[x] & self.single[total - x]][::-1].tolist():
            yield y, total - y


def planned(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns and how many sequences follow each; a pattern is a list of (length, how many of it)."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    left[0] = 0
    at_hand = np.flatnonzero(left).tolist()
    sums = Sums(left)
    plan: list[tuple[list[tuple[int, int]], int]] = []
    while at_hand:
        a = at_hand[-1]
        parts, room = _best_fit(left, at_hand, limit)
        if room and len(parts) > 1:
            sums.refresh()
            fit = list(parts)[1] if parts[a] == 1 else a
            for rest in sums.complements(limit - a, max(1, fit - 2 * room), a):
                exact = Counter((a, *rest))
                if all(left[x] >= m for x, m in exact.items()):
                    parts = exact
                    break
        n = int(min(left[x] // m for x, m in parts.items()))
        for x, m in parts.items():
            left[x] -= n * m
            if not left[x]:
                del at_hand[bisect.bisect_left(at_hand, x)]
        plan.append((list(parts.items()), n))
    return plan


def _best_fit(left: np.ndarray, at_hand: list[int], limit: int) -> tuple[dict[int, int], int]:
    """How many of each length the longest piece's sequence gets by best fit, longest first, and the room that stays."""
    parts: dict[int, int] = {}
    room, k = limit, len(at_hand)
    while k and room:
        x = at_hand[k - 1]
        parts[x] = min(room // x, int(left[x]))
        room -= parts[x] * x
        k = bisect.bisect_right(at_hand, room, 0, k - 1)
    return parts, room


class Runs:
    """The plan by length: from which number on, in which sequences and where, pieces of that length go."""

    def __init__(self, plan: list[tuple[list[tuple[int, int]], int]], limit: int = LIMIT):
        used, rows, sequence = np.zeros(limit + 1, np.int64), [], 0
        for parts, n in plan:
            at = 0
            for length, m in parts:
                rows.append((length, used[length], m, sequence, at))
                used[length] += n * m
                at += length * m
            sequence += n
        table = np.array(rows, np.int64).reshape(-1, 5)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.sequences, self.span = sequence, np.int64(max(int(used.max()), 0) + 1)
        self.key, self.table = table[:, 0] * self.span + table[:, 1], table

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(length):
            return number, number
        _, base, m, sequence, at = self.table[np.searchsorted(self.key, length * self.span + number, "right") - 1].T
        nth = number - base
        return sequence + nth // m, at + nth % m * length


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 1, limit: int = LIMIT) -> DataFrame:
    """doc_id and the pieces of at most `limit` ids of each document, numbered by length within each task."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()
        for batch, data, starts in blocks(batches, most=TOKEN_BLOCK):
            ids, at = with_end(*encoded(data, starts, tokenizer), end_id)
            raw, size = ids.astype("<u4"), np.diff(at)
            n = np.maximum(-(-size // limit), 0)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * limit
            length = np.minimum(size[doc] - start, limit)
            begin = at[:-1][doc] + start
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin, begin + length, strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=limit + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(number)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_PIECES}")


def packed(docs: DataFrame, tokenizer: str, end_id: int | None = 1, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    made = stored(pieces(docs, tokenizer, end_id, limit), "pieces")
    by_task = stored(made.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    runs = docs.sparkSession.sparkContext.broadcast(Runs(planned(counts, limit), limit))
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = runs.value.places(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = made.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))
    return numbered.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
