"""Vectors as short codes: one codebook for each part position, searched through ball trees.

Components are integers, so that codes, sums and errors are exact whatever the order of summation. Each
codebook's entries lie in a ball tree; many parts go down it together. A branch is left out only if
its ball, with radii and distances rounded outwards, lies beyond the best distance so far; one that
touches it is visited, for ties. Entries reached are compared in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import attach, bounded_batches, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components of this size or more, as integers, are no valid input: sums of squares stay within 63 bits up to 8192 components.
LIMIT = 1 << 24
_LEAF = 8
#: Integers of a batch that are compared at once.
_VALUES = 1 << 19
_OUT, _IN = 1 + 1e-9, 1 - 1e-9


@dataclass
class Ball:
    """Entries within ``radius`` of ``centre``: either two balls of them or, in a leaf, their indexes in ascending order."""

    centre: np.ndarray
    radius: float
    entries: np.ndarray
    parts: list[Ball] = field(default_factory=list)


def ball_tree(codebook: np.ndarray, entries: np.ndarray | None = None, leaf: int = _LEAF) -> Ball:
    """Halve the entries by their distance to two far ones until a leaf is left; radii are rounded up."""
    entries = np.arange(len(codebook)) if entries is None else entries
    own = codebook[entries]
    centre = own.sum(0) // max(len(own), 1)
    far = ((own - centre) ** 2).sum(1)
    ball = Ball(centre, float(np.sqrt(far.max(initial=0))) * _OUT, entries)
    if len(entries) > leaf and far.any():
        a = own[far.argmax()]
        b = own[((own - a) ** 2).sum(1).argmax()]
        order = np.argsort(((own - a) ** 2).sum(1) - ((own - b) ** 2).sum(1), kind="stable")
        ball.parts = [ball_tree(codebook, np.sort(entries[half]), leaf) for half in np.array_split(order, 2)]
    return ball


def _squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, (rows, points)."""
    away = rows[:, None] - points[None]
    return np.einsum("ijk,ijk->ij", away, away)


def nearest_entries(codebook: np.ndarray, tree: Ball, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest at ties, and the squared distance, both exact.

    All rows first go down to the leaf with the nearer centres, which bounds their distance; then they
    go through the whole tree, and a ball is left by those whose bound doesn't reach it.
    """
    largest = int(max(np.abs(rows).max(initial=0), np.abs(codebook).max(initial=0)))
    if 4 * largest * largest * max(rows.shape[1], 1) < 1 << 31:
        rows, codebook = rows.astype(np.int32), codebook.astype(np.int32)
    index = np.full(len(rows), len(codebook), np.int64)
    best = np.full(len(rows), np.iinfo(np.int64).max, np.int64)
    reach = np.zeros(len(rows))
    first: dict[int, np.ndarray] = {}

    def compare(ball: Ball, at: np.ndarray) -> None:
        away = _squared(rows[at], codebook[ball.entries])
        k = away.argmin(1)
        d, entry = away[np.arange(len(at)), k], ball.entries[k]
        better = (d < best[at]) | ((d == best[at]) & (entry < index[at]))
        hit = at[better]
        best[hit], index[hit] = d[better], entry[better]
        reach[hit] = np.sqrt(best[hit].astype(np.float64)) * _OUT

    def centres(ball: Ball, at: np.ndarray) -> np.ndarray:
        points = np.stack([x.centre for x in ball.parts]).astype(rows.dtype)
        bound = np.sqrt(_squared(rows[at], points).astype(np.float64)) * _IN
        return bound - np.array([x.radius for x in ball.parts])

    def descend(ball: Ball, at: np.ndarray) -> None:
        if not at.size:
            return
        if not ball.parts:
            first[id(ball)] = at
            return compare(ball, at)
        nearer = centres(ball, at).argmin(1)
        for k, part in enumerate(ball.parts):
            descend(part, at[nearer == k])

    def visit(ball: Ball, at: np.ndarray) -> None:
        if not ball.parts:
            fresh = np.ones(len(rows), bool)
            fresh[first.get(id(ball), at[:0])] = False
            return compare(ball, at[fresh[at]]) if fresh[at].any() else None
        bound = centres(ball, at)
        for k, part in enumerate(ball.parts):
            # a ball that only touches the best distance is visited too
            if (open_ := at[bound[:, k] <= reach[at]]).size:
                visit(part, open_)

    if len(rows):
        descend(tree, np.arange(len(rows)))
        visit(tree, np.arange(len(rows)))
    return index, best


def whole_vectors(batch: pa.RecordBatch, column: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that are kept, and their integer components, as many as the longest multiple of PARTS asks for."""
    vectors = batch.column(column)
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    valid = np.asarray(vectors.is_valid())
    if width is not None:
        valid = valid & (size == width)
    flat = vectors.filter(pa.array(valid, pa.bool_())).flatten()
    # nulls read as NaN
    scaled = np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    good = np.isfinite(scaled) & (np.abs(scaled) < LIMIT)
    bounds = np.concatenate([[0], np.cumsum(size[valid])])
    bad = np.concatenate([[0], np.cumsum(~good)])
    sound = bad[bounds[1:]] == bad[bounds[:-1]]
    rows = np.flatnonzero(valid)[sound]
    return rows, scaled[np.repeat(sound, size[valid])]


def _integers(scaled: np.ndarray, rows: int, width: int) -> np.ndarray:
    """(rows, PARTS, length of a part); components missing to a multiple of PARTS are 0."""
    out = np.zeros((rows, -(-width // PARTS) * PARTS), np.int64)
    out[:, :width] = scaled.reshape(rows, width)
    return out.reshape(rows, PARTS, -1)


@dataclass
class Codebooks:
    """(PARTS, entries, length of a part) integers for vectors of ``width`` components."""

    entries: np.ndarray
    width: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def encode(self, trees: list[Ball], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part, (rows, PARTS), and squared distances."""
        found = [nearest_entries(self.entries[p], trees[p], np.ascontiguousarray(vectors[:, p])) for p in range(PARTS)]
        return np.stack([x for x, _ in found], 1), np.stack([d for _, d in found], 1)

    def trees(self) -> list[Ball]:
        return [ball_tree(x) for x in self.entries]


def _blocks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Kept rows of batches with their vectors, about _VALUES components at a time."""
    step = max(_VALUES // max(width, 1), 1)
    held: list[pa.RecordBatch] = []

    def parted() -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        whole = pa.concat_batches(held)
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            rows, scaled = whole_vectors(part, column, width)
            yield part, rows, _integers(scaled, len(rows), width)

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= step:
            yield from parted()
            held = []
    if held:
        yield from parted()


def first_codebooks(vectors: DataFrame) -> Codebooks | None:
    """Parts of the ENTRIES kept vectors with the least ids; None without a kept vector. ``vectors`` has id and vector.

    The one row with the least id gives the length that all kept vectors have.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = whole_vectors(batch, 1)
            yield pa.RecordBatch.from_arrays([x.take(pa.array(rows)) for x in batch.columns], ["id", "vector"])

    kept = vectors.select("id", "vector").mapInArrow(keep, "id long, vector array<double>")
    least = [F.col("id").asc_nulls_last(), F.col("vector")]
    width = kept.orderBy(*least).select(F.size("vector").alias("n")).first()
    if width is None:
        return None
    rows = kept.where(F.size("vector") == width.n).orderBy(*least).limit(ENTRIES).collect()
    scaled = np.floor(np.array([r.vector for r in rows], np.float64).reshape(len(rows), width.n) * SCALE)
    return Codebooks(np.ascontiguousarray(_integers(scaled.ravel(), len(rows), width.n).transpose(1, 0, 2)), width.n)


def refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: assign all parts, then replace each used entry by floor(sum / count) of its parts.

    Each task adds up its rows first; PARTS * ENTRIES rows of sums a task are shuffled, as many in all reach the driver.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    _, size, length = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        trees = own.trees()
        sums, counts = np.zeros((PARTS * size, length), np.int64), np.zeros(PARTS * size, np.int64)
        for _, rows, parts in _blocks(batches, 0, own.width):
            key = (own.encode(trees, parts)[0] + np.arange(PARTS) * size).ravel()
            counts += np.bincount(key, minlength=PARTS * size)
            order = np.argsort(key, kind="stable")
            used, first = np.unique(key[order], return_index=True)
            if len(rows):
                sums[used] += np.add.reduceat(parts.reshape(-1, length)[order], first, axis=0)
        used = np.flatnonzero(counts)
        arrays = [pa.array(used), pa.array(counts[used]), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * length), pa.array(sums[used].ravel()))]
        yield pa.RecordBatch.from_arrays(arrays, ["entry", "n", "sums"])

    found = vectors.select("vector").mapInArrow(add, "entry long, n long, sums array<long>")
    sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(length)]
    entries = books.entries.reshape(-1, length).copy()
    for entry, n, *total in found.groupBy("entry").agg(F.sum("n"), *sums).collect():
        entries[entry] = [x // n for x in total]
    return Codebooks(entries.reshape(books.entries.shape), books.width)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per kept row: its id, code, error, label_error, codebooks_sha256.

    Dropped are rows whose vector is null, holds a null or non-finite component or one of 65536 or more, or has
    another length than the kept vector with the least id (ties by the vector, null ids last). A length
    that is no multiple of 16 is filled up with zeros. Fewer than 64 kept rows make as many entries.
    Repeated rows are coded each; null labels count together; an empty table, or one without a kept
    row, gives an empty result. A label's sum that doesn't fit a long is null. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    label = vectors[label_col].cast("string")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector"), F.coalesce(label, F.lit("")).alias("label"), label.isNull().alias("no_label"))
    books = first_codebooks(rows)
    for _ in range(rounds if books and books.width else 0):
        books = refined(rows, books)
    if books is None:
        return spark.createDataFrame([], "id long, code string, error long, label_error long, codebooks_sha256 string").withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value.trees()
        for part, kept, parts in _blocks(batches, 1, shared.value.width):
            index, away = shared.value.encode(trees, parts)
            digits = index.astype(np.uint8).tobytes().hex()
            codes = [digits[a : a + 2 * PARTS] for a in range(0, len(digits), 2 * PARTS)]
            own = part.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(3), pa.array(codes, pa.string()), pa.array(away.sum(1), pa.int64())], ["id", "label", "no_label", "code", "error"])

    coded = stored(rows.mapInArrow(encode, "id long, label string, no_label boolean, code string, error long"), "codes")
    total = F.try_sum("error").alias("label_error")
    by_label = stored(coded.groupBy("label", "no_label").agg(total, F.count("*").alias("n")), "label-errors")
    n = by_label.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = attach(coded, by_label, ["label", "no_label"], "n", n)
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
