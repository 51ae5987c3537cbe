"""Packing by non-negative least squares over the histogram of piece lengths.

Documents are cut into windows; what is left over has a length below the window. Only the histogram
of lengths, one count for each, goes to the driver. There all sets of up to three lengths that fill a
window exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares, rounded, and kept within the counts; the rest is packed greedily, again as patterns of
lengths. Pieces then find their places from their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import bounded_batches, stored
from catalith.llm.vocabulary import JSON_VOCABULARY, tokenizer_coder

WINDOW = 1024
SEPARATOR_ID = 0


def fillings(window: int) -> np.ndarray:
    """Sets of one, two or three lengths that sum to the window, as rows of three, 0 for no length."""
    a = np.arange(window + 1)
    two = np.stack([0 * a, a, window - a], 1)[(a <= window - a)]
    out = [two]
    for first in range(1, window // 3 + 1):
        b = np.arange(first, (window - first) // 2 + 1)
        out.append(np.stack([np.full(len(b), first), b, window - first - b], 1))
    return np.concatenate(out)


def fitted_repeats(sets: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that bring the lengths used near the histogram, by accelerated projected gradient."""
    size = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(sets[:, k], x, size) for k in range(3))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[sets[:, 0]] + r[sets[:, 1]] + r[sets[:, 2]]

    v = np.ones(len(sets))
    for _ in range(30):
        v = back(used(v))
        v /= (norm := np.linalg.norm(v))
    x = y = np.zeros(len(sets))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - back(used(y) - histogram) / (1.01 * norm), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


@dataclass
class Plan:
    """Runs of ranks of pieces of one length: rank r of a run is in sequence base + (r - start) % repeats, at offset + (r - start) // repeats * length."""

    length: np.ndarray
    start: np.ndarray
    repeats: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given by length and rank among pieces of that length."""
        # the last run that starts at or before (length, rank)
        first = np.searchsorted(self.length, length, "left")
        last = np.searchsorted(self.length, length, "right") - 1
        while (open_ := first < last).any():
            mid = (first + last + 1) // 2
            right = open_ & (self.start[mid] <= rank)
            first, last = np.where(right, mid, first), np.where(open_ & ~right, mid - 1, last)
        k = rank - self.start[first]
        return self.base[first] + k % self.repeats[first], self.offset[first] + k // self.repeats[first] * length


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Place the counted lengths: histogram[n] pieces have length n, 1 <= n <= window."""
    left = histogram.astype(np.int64).copy()
    patterns: list[tuple[list[tuple[int, int]], int]] = []

    def take(lengths: list[int], repeats: int) -> None:
        parts = sorted(((n, lengths.count(n)) for n in set(lengths)), reverse=True)
        for n, m in parts:
            left[n] -= m * repeats
        patterns.append((parts, repeats))

    sets = fillings(window)
    present = (left > 0) | (np.arange(window + 1) == 0)
    sets = sets[present[sets].all(1)]
    if len(sets):
        repeats = np.rint(fitted_repeats(sets, left.astype(float))).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] <= 0:
                break
            lengths = [int(n) for n in sets[k] if n]
            n = min([int(repeats[k]), *(int(left[v]) // lengths.count(v) for v in lengths)])
            if n > 0:
                take(lengths, n)
    while (open_ := np.flatnonzero(left)).size:
        lengths, room = [int(open_[-1])], window - int(open_[-1])
        spare = left.copy()
        spare[lengths[0]] -= 1
        while room and (fit := np.flatnonzero(spare[1 : room + 1])).size:
            lengths.append(int(fit[-1]) + 1)
            spare[lengths[-1]] -= 1
            room -= lengths[-1]
        take(lengths, min(int(left[v]) // lengths.count(v) for v in lengths))
    runs, at, base = [], np.zeros(window + 1, np.int64), 0
    for parts, repeats in patterns:
        offset = 0
        for n, m in parts:
            runs.append((n, int(at[n]), repeats, base, offset))
            at[n] += m * repeats
            offset += m * n
        base += repeats
    runs.sort()
    columns = [np.array(c, np.int64) for c in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, base)


def pieces(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR_ID, json_path: str = JSON_VOCABULARY) -> DataFrame:
    """Tokenised documents, each with a separator at its end, cut into windows: a row for each piece, with its rank among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = tokenizer_coder(json_path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            names = batch.column(0)
            for lo, hi, ids, ends in coder.encode(batch.column(1)):
                full = np.insert(ids, ends, separator).astype("<u4", copy=False)
                begin = np.concatenate([[0], ends + np.arange(1, hi - lo + 1)])
                tokens = np.diff(begin)
                count = -(-tokens // window)
                doc = np.repeat(np.arange(hi - lo), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(tokens[doc] - start, window)
                order = np.argsort(length, kind="stable")
                n = np.bincount(length, minlength=window + 1)
                within = np.empty(len(doc), np.int64)
                within[order] = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                rank = seen[length] + within
                seen += n
                data = memoryview(full).cast("B")
                first = (begin[doc] + start) * 4
                sums = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                arrays = [names.take(pa.array(lo + doc)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(tokens[doc]), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "task_rank"])

    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, task_rank long")


def pack(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", json_path: str = JSON_VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence is padded to the window unless its length is a power of two; then it is used as it is.
    A null or empty text is the separator alone, one piece of length 1. Repeated rows are packed each,
    null ids stay null, an empty table gives no pieces, other columns are not read. The plan depends on
    the histogram alone; which piece of equal lengths goes where depends on the order of input files.
    """
    rows = stored(pieces(docs, window, id_col, text_col, json_path=json_path), "pieces")
    counts = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.withColumn("before", F.coalesce(before, F.lit(0))), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most one row a length
        histogram[length] = n
    found = docs.sparkSession.sparkContext.broadcast(plan(histogram, window))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = found.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # merged, not broadcast: the counts grow with the number of tasks
    ranked = rows.join(counts.select("length", "task", "before").hint("merge"), ["length", "task"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("task_rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
