"""Token ids in Parquet list columns.

A file holds documents in ascending id order: doc_id, part, n_tokens, start_in_part and the list
column ids. Ids are dictionary-encoded where the page's distinct ids fit, else delta-packed (format
v2); row groups and pages are small enough that the page index, which the writer always adds, lets a
reader fetch single documents, and metadata reads never touch the list column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.llm.common import bounded_batches, stored
from catalith.llm.vocabulary import JSON_VOCABULARY, tokenizer_coder

END_ID = 2
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "compression": "zstd",
}


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, json_path: str = JSON_VOCABULARY) -> None:
    """Encode every text, append ``end_id``, and write the files; part p holds smaller ids than part p + 1.

    A null or empty text is the end id alone. Null document ids come first; rows with equal ids stay in
    one part, next to each other. An empty table writes files without rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = tokenizer_coder(json_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, ids, ends in coder.encode(batch.column(1)):
                full = np.insert(ids, ends, end_id)
                at = np.concatenate([[0], ends + np.arange(1, hi - lo + 1)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(full.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(np.diff(at)), pa.array(start + at[:-1]), lists], ["doc_id", "part", "n_tokens", "start_in_part", "ids"])
                start += int(at[-1])

    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encoded = ordered.mapInArrow(run, "doc_id long, part int, n_tokens long, start_in_part long, ids array<int>")
    encoded.write.options(**LAYOUT).parquet(path)


def _bases(rows: DataFrame) -> DataFrame:
    """Ids before each part, a row for each file; stored, so that the planner knows its size and broadcasts it only if small."""
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(parts.select("part", before.alias("base")), "token-bases")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, n_tokens and start (ids of all documents before it), without reading any ids.

    Null ids are the first documents, rows with equal ids stand next to each other, and a table without rows
    gives none. The running sum is over parts, of which there are as many as files.
    """
    rows = spark.read.parquet(path).select("doc_id", "part", "n_tokens", "start_in_part")
    return rows.join(_bases(rows), "part").select("doc_id", "part", "n_tokens", (F.col("base") + F.col("start_in_part")).alias("start"))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id and ids; given ids of documents, only pages that may hold them are read."""
    rows = spark.read.parquet(path)
    return (rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))).select("doc_id", "ids")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            data = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path).select("doc_id", "part", "start_in_part", "ids")
    read = rows.mapInArrow(crc, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    bases = _bases(spark.read.parquet(path).select("part", "n_tokens"))
    return read.join(bases, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
