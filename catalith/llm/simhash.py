"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles. Distinct
fingerprints meet in buckets: of four 16-bit blocks, two must be equal if at most two bits differ, so
each fingerprint enters the six buckets of its block pairs. In a bucket, bit planes are stored
vertically, 64 fingerprints a word; distances to many fingerprints are counted at once by carry-save
counters, and words are left as soon as all their fingerprints are too far. A bucket above
BUCKET_ROWS is split by the same argument over its other 32 bits, after which at most 2**16 different
fingerprints can share a bucket: no bucket is capped. Buckets emit a spanning forest, not all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import attach, bounded_batches, row_keyed, stored
from catalith.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
BUCKET_ROWS = 4096
_PAIRS = list(itertools.combinations(range(4), 2))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    k = min(shingle, len(words))
    count, votes = len(words) - k + 1, np.zeros(64, np.int64)
    spans = list(zip(begin[:count].tolist(), end[k - 1 :].tolist(), strict=True))
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[at : at + (1 << 15)]], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carried: Column | None = None) -> DataFrame:
    """A row per document: its id and its fingerprint as a long, and ``carried`` as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])

    bounded_batches(docs.sparkSession)
    more = [] if carried is None else [carried.alias("carried")]
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), *more)
    kind = f", carried {narrow.schema['carried'].dataType.simpleString()}" if more else ""
    return narrow.mapInArrow(run, "id long, fp long" + kind)


def near_forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that join distinct 64-bit values into the classes that links within the radius give."""
    m = len(values)
    width = -(-m // 64)
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    differ = [p for p in range(64) if 0 < bits[:, p].sum() < m]
    planes = np.zeros((len(differ), width * 8), np.uint8)
    for k, p in enumerate(differ):
        packed = np.packbits(bits[:, p], bitorder="little")
        planes[k, : len(packed)] = packed
    planes = planes.view("<u8")
    seen = np.zeros(width * 64, np.uint8)
    seen[m:] = 1
    links: list[tuple[int, int]] = []
    for seed in range(m):
        if seen[seed]:
            continue
        seen[seed] = 1
        queue = [seed]
        while queue:
            now, queue = queue[:64], queue[64:]
            visited = np.packbits(seen, bitorder="little").view("<u8")
            words = np.flatnonzero(visited != _ALL)
            if not words.size:
                return links
            far = np.repeat(visited[None, words], len(now), 0)
            ones, twos = np.zeros_like(far), np.zeros_like(far)
            for k, p in enumerate(differ):
                d = planes[k, words][None, :] ^ np.where(bits[now, p], _ALL, np.uint64(0))[:, None]
                carry = ones & d
                ones ^= d
                far |= twos & carry
                twos ^= carry
                far |= (ones & twos) if radius == 2 else twos if radius == 1 else ones
                if k % 8 == 7 and not (live := (far != _ALL).any(0)).all():
                    words, far, ones, twos = words[live], far[:, live], ones[:, live], twos[:, live]
                    if not words.size:
                        break
            rows, at = np.nonzero(np.unpackbits(np.ascontiguousarray(~far).view(np.uint8), axis=1, bitorder="little"))
            for r, j in zip(rows.tolist(), (words[at // 64] * 64 + at % 64).tolist() if words.size else [], strict=True):
                if not seen[j]:
                    seen[j] = 1
                    links.append((now[r], j))
                    queue.append(j)
    return links


def _blocks(fp: Column, width: int, which: list[int]) -> list[Column]:
    return [F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1)) for k in which]


def _bucket_keys(fp: Column) -> Column:
    """Six keys: pair of blocks, then the bits of both."""
    b = _blocks(fp, 16, [0, 1, 2, 3])
    return F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(b[i], 16)).bitwiseOR(b[j]) for k, (i, j) in enumerate(_PAIRS)])


def _finer_keys(fp: Column, key: Column) -> Column:
    """Six keys under a bucket: its key, then a pair of the 8-bit blocks of the bits that it leaves open."""
    pair, out = F.shiftrightunsigned(key, 32), F.lit(None).cast("array<bigint>")
    for k, (i, j) in enumerate(_PAIRS):
        rest = [n for n in range(4) if n not in (i, j)]
        b = _blocks(fp, 8, [2 * n + h for n in rest for h in (0, 1)])
        keys = F.array(*[F.shiftleft(key, 19).bitwiseOR(F.lit(q << 16)).bitwiseOR(F.shiftleft(b[x], 8)).bitwiseOR(b[y]).bitwiseOR(F.lit(1 << 60)) for q, (x, y) in enumerate(_PAIRS)])
        out = F.when(pair == k, keys).otherwise(out)
    return out


def fingerprint_links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp, each once, stored) that span the classes of links at RADIUS."""
    keyed = distinct.select("fp", F.explode(_bucket_keys(F.col("fp"))).alias("key"))
    counts = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sized = attach(keyed, counts, ["key"], "n", total).where("n is not null")
    small = sized.where(F.col("n") <= bucket_rows).select("key", "fp")
    large = sized.where(F.col("n") > bucket_rows).select(F.explode(_finer_keys(F.col("fp"), F.col("key"))).alias("key"), "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def edges() -> pa.RecordBatch:
            values = np.concatenate(held).view(np.uint64)
            pairs = np.array(near_forest(values), np.int64).reshape(-1, 2)
            ends = values.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[pairs[:, 0]]), pa.array(ends[pairs[:, 1]])], ["a", "b"])

        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for part, at in zip(np.split(values, cuts), [0, *cuts.tolist()], strict=True):
                if not len(part):
                    continue
                if keys[at] != key and held:
                    yield edges()
                    held = []
                key = keys[at]
                held.append(part)
        if held:
            yield edges()

    buckets = small.unionByName(large).repartition("key").sortWithinPartitions("key")
    return buckets.mapInArrow(link, "a long, b long")


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, carried: Column | None = None) -> DataFrame:
    """A row per document: id, fp, root (the fingerprint that names its class), component_id, and ``carried``."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle, carried), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct), "a", "b")
    classes = stored(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root")), "classes")
    least = stored(classes.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members")), "class-ids")
    n_distinct = distinct.count()
    named = stored(attach(classes.select("fp", "n", "root"), least, ["root"], "members", n_distinct).select("fp", "n", "root", "component_id"), "named-fingerprints")
    return attach(rows, named, ["fp"], "n", rows.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hex digits), component_id, the least id in reach.

    Null, empty and wordless texts have fingerprint zero and link like others. Repeated rows share a
    class; null ids are in classes but never name one; an empty table gives an empty result; other
    columns are not read.
    """
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return _classed(docs, id_col, text_col, shingle).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: the smallest id, a null one last, then the first in the files.

    Ids may be null or repeat, and columns may have any names.
    """
    keyed, row = row_keyed(docs)
    classes = _classed(keyed, id_col, text_col, SHINGLE, keyed[row])
    first = classes.groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "carried")).alias("first"))
    return keyed.join(first.select(F.col("first.carried").alias(row)), row, "left_semi").drop(row)
