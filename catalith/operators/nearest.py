"""Nearest vectors: exact over all rows, and through inverted lists that are probed by distance.

Queries and vectors are packed into blocks of rows, one matrix each; a pair of blocks is scored by one product in
a task, which keeps k rows a query. Exact search pairs all blocks, an index those of one list. No query
or vector passes through the driver but for the sample that centroids are fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.sources.kept import kept

#: Rows of a block; 4096 rows of 1000 numbers are 32 MB.
BLOCK_ROWS = 4096
#: Queries that are scored or repeated for their lists at once: against a full block, 256 of them make 8 MB of scores.
QUERY_ROWS = 256
#: Rows that a task holds at most while it packs them by list.
HELD_ROWS = 1 << 15
#: Below so many vectors an exact search is as good.
INDEX_FROM = 2000
#: Vectors that centroids are fitted on, chosen by a hash of the id.
SAMPLE = 20_000
FIT_ROUNDS = 10
_BLOCK = "list int, ids binary, rows int, vectors binary"
_FOUND = "query_id long, id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column at length 1; a zero vector stays."""
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From list, id and vector: blocks of one list each."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[int, int] = {}

    def block(key: int) -> pa.RecordBatch:
        ids, x = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
        del sizes[key]
        order = np.argsort(ids, kind="stable")
        arrays = [pa.array([key], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([len(ids)], pa.int32()), pa.array([np.ascontiguousarray(x[order]).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["list", "ids", "rows", "vectors"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
        for key in np.unique(keys).tolist():
            own = np.flatnonzero(keys == key)
            for at in range(0, len(own), BLOCK_ROWS):
                part = own[at : at + BLOCK_ROWS]
                held.setdefault(key, []).append((ids[part].astype(np.int64), x[part]))
                sizes[key] = sizes.get(key, 0) + len(part)
                if sizes[key] >= BLOCK_ROWS:
                    yield block(key)
        if sum(sizes.values()) >= HELD_ROWS:
            yield from [block(key) for key in list(held)]
    yield from [block(key) for key in list(held)]


def _top(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of rows (query, id, score) of each query, ties by id."""
    order = np.lexsort((ids, -scores, query_ids))
    query_ids, ids, scores = query_ids[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], query_ids[1:] != query_ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return query_ids[place < k], ids[place < k], scores[place < k]


def _scored(k: int):
    """From pairs of blocks (query ids and vectors, ids and vectors) the k best of each query that the task has seen."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _top(*(np.concatenate(c) for c in zip(*held, strict=True)), k)

        for batch in batches:
            for query_ids, queries, ids, vectors in zip(*batch.columns, strict=True):
                asked, names = np.frombuffer(query_ids.as_py(), np.int64), np.frombuffer(ids.as_py(), np.int64)
                left, right = np.frombuffer(queries.as_py()).reshape(len(asked), -1), np.frombuffer(vectors.as_py()).reshape(len(names), -1).T
                for first in range(0, len(asked), QUERY_ROWS):
                    found = left[first : first + QUERY_ROWS] @ right
                    least = np.partition(found, -k, axis=1)[:, -k] if k < len(names) else np.full(len(found), -np.inf)
                    row, at = np.nonzero(found >= least[:, None])
                    held.append(_top(asked[first + row], names[at], found[row, at], k))
            if sum(len(x[0]) for x in held) > BLOCK_ROWS * max(k, 16) * 4:
                held = [best()]
                if len(held[0][0]) > BLOCK_ROWS * k:  # queries of many blocks
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["query_id", "id", "score"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best()], ["query_id", "id", "score"])

    return score


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    found = pairs.select("query_ids", "queries", "ids", "vectors").mapInArrow(_scored(k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _queries(queries: DataFrame) -> DataFrame:
    return queries.where("vector is not null").select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))


def _asked(rows: DataFrame) -> DataFrame:
    """Packed query blocks; stored, so that their size is known when the join is planned."""
    return kept(rows.mapInArrow(_packed, _BLOCK), "query-blocks").select("list", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """For each query (query_id, vector), the k nearest of all vectors by cosine, ties by id: query_id, rank, id, score.

    A zero vector has cosine 0; null vectors are left out. Blocks of queries meet blocks of vectors: their
    number is the square of the rows over that of a block, and the planner broadcasts query blocks only while they are small.
    """
    none = F.lit(0).alias("list")
    rows = vectors.where(F.col(vector_col).isNotNull()).select(none, F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = _asked(_queries(queries).select(none, "id", "vector"))
    return _ranked(rows.mapInArrow(_packed, _BLOCK).drop("list").join(asked.drop("list"), F.lit(True)), k)


def fitted_centroids(sample: np.ndarray, lists: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids of length 1 by spherical k-means from a spread start; an empty list takes the worst placed row."""
    draw = np.random.default_rng(0)
    centres = sample[draw.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        scores = sample @ centres.T
        own, close = scores.argmax(1), scores.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        for empty in np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0):
            worst = int(close.argmin())
            sums[empty], close[worst] = sample[worst], 1.0
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-10)
    return centres


@dataclass(frozen=True)
class InvertedLists:
    """Blocks of vectors by list, and the lists' centroids."""

    blocks: DataFrame
    centroids: np.ndarray

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """As ``nearest``, among the rows of the ``probes`` lists whose centroids are nearest to a query."""
        rows = _queries(queries).mapInArrow(_probed(self.centroids, probes), "list int, id long, vector array<double>")
        # list blocks and query blocks of one list meet; a large list has many blocks
        return _ranked(self.blocks.join(_asked(rows), "list"), k)


def _probed(centroids: np.ndarray, probes: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, QUERY_ROWS):
                rows = batch.slice(first, QUERY_ROWS)
                scores = _matrix(rows.column(1)) @ centroids.T if len(centroids) else np.zeros((rows.num_rows, 1))
                lists = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(rows.num_rows), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), rows.column(0).take(at), rows.column(1).take(at)], ["list", "id", "vector"])

    return probe


def inverted_lists(vectors: DataFrame, id_col: str, vector_col: str, lists: int, sample: int = SAMPLE) -> InvertedLists:
    """Every non-null vector in the list of its nearest centroid; centroids are fitted on at most about ``sample`` rows, or all if there are fewer."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    share = min(1.0, sample / max(rows.count(), 1))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("vector").limit(2 * sample).toArrow()
    x = _matrix(chosen.column(0).combine_chunks()) if chosen.num_rows else np.zeros((0, 0))
    centroids = fitted_centroids(x, lists) if len(x) else x
    packed = rows.mapInArrow(_probed(centroids, 1), "list int, id long, vector array<double>").mapInArrow(_packed, _BLOCK)
    return InvertedLists(kept(packed, "list-blocks"), centroids)


def save(index: InvertedLists, path: str) -> None:
    """Blocks and centroids as two Parquet tables."""
    index.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(index.centroids)]
    index.blocks.sparkSession.createDataFrame(rows, "list int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> InvertedLists:
    """What ``save`` wrote; the centroids, as many as lists, come to the driver."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return InvertedLists(spark.read.parquet(f"{path}/blocks"), np.array([r.centroid for r in rows], np.float64))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact neighbours (query_id, id) that were found."""
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
