"""Removal of byte strings of 100 bytes or more that occur earlier in the corpus.

Every 100-byte string has one anchor: the least hash among its 40-byte substrings. Equal strings have
equal anchors, so only strings under one anchor hash need comparing, and neighbouring strings share
an anchor: the strings that one anchor owns are one short span of bytes.

1. Each task finds its spans and sends the first of equal ones (hash of anchor, hash of span, place);
   others are known to be repeats at once. Spans are equal if both 64-bit hashes are.
2. Spans are sorted by anchor hash, streaming: a later span equal to an earlier one is all repeats; spans
   whose anchor has one span only are first; the rest, a few percent, goes to step 3.
3. The bytes of those spans are fetched and grouped by anchor. Shards of whole groups are put into run-length
   Burrows-Wheeler indexes (run_length_index.py); later spans stream through the index of earlier ones, and
   matching statistics of 100 bytes or more mark the repeats. A crowded anchor is split by string:
   each task keeps the first place of a string, and only these meet.
4. Documents meet their repeats and lose the bytes these cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from catalith.llm.common import BATCH_ROWS, attach, bounded_batches, free_name, quoted, stored
from catalith.llm.run_length_index import seen_earlier

LENGTH = 100
ANCHOR = 40
#: Spans of one anchor that an index holds together; anchors with more are split by string, exactly.
GROUP_SPANS = 1024
#: Bytes of spans in one index, whole groups; a group has at most GROUP_SPANS spans of under 2 * LENGTH bytes.
SHARD_BYTES = 1 << 19
#: Strings of crowded anchors of which a task keeps the first places at once.
STRINGS_HELD = 50_000
_NO_ID = (1 << 63) - 1
_POSITION = np.uint64((1 << 24) - 1)
_PIECE = 1 << 20
_CHUNK = 16 << 20
_SPAN = "anchor long, span long, id long, twin long, start int, n int"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _hashes(padded: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 40 and of the 100 bytes that start at each of n places; 128 bytes follow these."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))
    sixteen = _mix(eight[:-8], eight[8:])
    half = _mix(sixteen[:-16], sixteen[16:])
    most = _mix(half[:-32], half[32:])
    return _mix(half[:n], eight[32 : 32 + n]), _mix(_mix(most[:n], half[64 : 64 + n]), eight[92 : 92 + n])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def spans_of(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, span hash, text, place of the first string and number of strings, for each span of the texts.

    ``data`` holds texts end to end, under 2**24 bytes.
    """
    n = len(data)
    padded = np.frombuffer(data + bytes(128), np.uint8)
    anchor, string = _hashes(padded, n)
    ranked = anchor & ~_POSITION | np.arange(n, dtype=np.uint64)
    owner = (_sliding_least(ranked, LENGTH - ANCHOR + 1) & _POSITION).astype(np.int64) if n >= LENGTH else np.zeros(0, np.int64)
    size = np.diff(ends, prepend=0)
    count = np.maximum(size - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(ends)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = (ends - size)[text] + place
    own = owner[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])) if len(at) else np.zeros(0, np.int64)
    much = np.diff(np.append(new, len(at)))
    first, last = at[new], at[new] + much - 1
    span = _mix(_mix(string[first], string[last]), much.astype(np.uint64))
    return anchor[own[new]].view(np.int64), span.view(np.int64), text[new], place[new], much


def _text_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(id, twin, offset, bytes) in lists of about _PIECE bytes; a longer text comes in parts that share LENGTH - 1 bytes."""
    held, size = [], 0
    for batch in batches:
        ids, twins = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k, value in enumerate(batch.column(2).cast(pa.large_binary())):
            data = value.as_py() or b""
            if len(data) < LENGTH:
                continue
            step = 2 * _PIECE
            for at in range(0, max(len(data) - LENGTH + 1, 1), step):
                part = data if len(data) <= step else data[at : at + step + LENGTH - 1]
                held.append((ids[k], twins[k], at, part))
                size += len(part)
                if size >= _PIECE:
                    yield held
                    held, size = [], 0
                if part is data:
                    break
    if held:
        yield held


def _send_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First spans to be compared, and with a negative n the strings that are known to be repeats."""
    held: list[list[np.ndarray]] = []
    size = 0

    def reduced() -> Iterator[pa.RecordBatch]:
        anchor, span, ids, twin, start, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((start, twin, ids, span, anchor))
        anchor, span, ids, twin, start, n = (c[order] for c in (anchor, span, ids, twin, start, n))
        again = np.zeros(len(n), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (span[1:] == span[:-1])
        same = np.zeros(len(n), bool)
        same[1:] = again[1:] & (ids[1:] == ids[:-1]) & (twin[1:] == twin[:-1]) & (start[1:] == start[:-1])
        yield _rows(*(c[~again] for c in (anchor, span, ids, twin, start, n)))
        # known repeats: runs of strings of one document are joined
        ids, twin, start, n = (c[again & ~same] for c in (ids, twin, start, n))
        order = np.lexsort((start, twin, ids))
        ids, twin, start, n = (c[order] for c in (ids, twin, start, n))
        new = np.ones(len(n), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (twin[1:] != twin[:-1]) | (start[1:] > start[:-1] + n[:-1])
        at = np.flatnonzero(new)
        if len(at):
            run = np.append(at[1:], len(n)) - 1
            yield _rows(_mix(ids[at].view(np.uint64), start[at].astype(np.uint64)).view(np.int64), np.zeros(len(at), np.int64), ids[at], twin[at], start[at], -(start[run] + n[run] - start[at]))

    for texts in _text_pieces(batches):
        ends = np.cumsum([len(t[3]) for t in texts])
        anchor, span, text, place, n = spans_of(b"".join(t[3] for t in texts), ends)
        columns = [np.array([t[k] for t in texts], np.int64) for k in range(3)]
        held.append([anchor, span, columns[0][text], columns[1][text], columns[2][text] + place, n])
        size += int(ends[-1])
        if size >= _CHUNK:
            yield from reduced()
            held, size = [], 0
    if held:
        yield from reduced()


def _rows(anchor: np.ndarray, span: np.ndarray, ids: np.ndarray, twin: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(anchor), pa.array(span), pa.array(ids), pa.array(twin), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["anchor", "span", "id", "twin", "start", "n"])


def _judge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, span and place: repeats with a negative n, spans to compare with a positive one.

    Of an anchor, only its last row and, while it may still be the anchor's one span, its first are held.
    """
    last = wait = None  # the row before, and a first span whose anchor had no other so far
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        known = columns[5] < 0
        if known.any():
            yield _rows(*(c[known] for c in columns))
            columns = [c[~known] for c in columns]
        if not len(columns[0]):
            continue
        if last is not None:
            columns = [np.concatenate([[v], c]) for v, c in zip(last, columns, strict=True)]
        anchor, span, ids, twin, start, n = columns
        one_anchor = np.concatenate([[False], anchor[1:] == anchor[:-1]])
        one_span = np.concatenate([[False], one_anchor[1:] & (span[1:] == span[:-1])])
        one_place = np.concatenate([[False], one_span[1:] & (ids[1:] == ids[:-1]) & (twin[1:] == twin[:-1]) & (start[1:] == start[:-1])])
        skip = 0 if last is None else 1
        repeat = one_span & ~one_place
        other = one_anchor & ~one_span  # opens a second or later span of its anchor
        group = np.cumsum(~one_anchor)
        many = np.bincount(group, other, group[-1] + 1)[group] > 0
        opens = ~one_anchor
        compare = other | opens & many
        compare[:skip] = False
        if wait is not None and many[0]:
            yield _rows(*(np.array([v]) for v in wait))
            wait = None
        elif group[-1] != group[0] or skip == 0:
            wait = None
        repeat[:skip] = False
        if repeat.any():
            yield _rows(anchor[repeat], span[repeat], ids[repeat], twin[repeat], start[repeat], -n[repeat])
        if compare.any():
            yield _rows(*(c[compare] for c in columns))
        tail = int(np.flatnonzero(opens)[-1])
        if tail >= skip and not many[tail]:
            wait = tuple(c[tail] for c in columns)
        last = tuple(c[-1] for c in columns)


_BYTES = "anchor long, part long, id long, twin long, start int, n int, bytes binary"


def _fetch_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, twin, text, wanted spans) the bytes of each span, keyed by anchor.

    Strings of crowded anchors are keyed by their own hash too. Of equal ones, the first that the task has
    seen goes on; the others are known to be repeats (n strings, without bytes).
    """
    rows: list[tuple] = []
    first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    again: set[tuple[int, int, int]] = set()

    def settled() -> pa.RecordBatch:
        rows.extend((anchor, int.from_bytes(hashlib.blake2b(string, digest_size=7).digest(), "big"), *place, 0, string) for (anchor, string), place in first.items())
        runs: list[list[int]] = []
        for ids, twin, start in sorted(again):
            if runs and runs[-1][:2] == [ids, twin] and runs[-1][2] + runs[-1][3] == start:
                runs[-1][3] += 1
            else:
                runs.append([ids, twin, start, 1])
        rows.extend((hash((ids, twin, start)), -2, ids, twin, start, n, None) for ids, twin, start, n in runs)
        out = _span_bytes(rows)
        rows.clear(), first.clear(), again.clear()
        return out

    for batch in batches:
        for ids, twin, text, wanted in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2).cast(pa.large_binary()), batch.column(3), strict=True):
            data = text.as_py()
            # one document's spans stay in Arrow; a slice of them at a time becomes Python numbers
            spans = wanted.values
            for at in range(0, len(spans), BATCH_ROWS):
                part = spans.slice(at, BATCH_ROWS)
                for anchor, start, n, crowded in zip(*(part.field(c).to_pylist() for c in ("anchor", "start", "n", "crowded")), strict=True):
                    if not crowded:
                        rows.append((anchor, -1, ids, twin, start, 0, data[start : start + n + LENGTH - 1]))
                        continue
                    for k in range(start, start + n):
                        string, place = data[k : k + LENGTH], (ids, twin, k)
                        known = first.setdefault((anchor, string), place)
                        if place < known:
                            first[anchor, string] = place
                        if place != known:
                            again.add(max(place, known))
                        if len(first) + len(again) > STRINGS_HELD:
                            yield settled()
                    if len(rows) + len(first) + len(again) > STRINGS_HELD:
                        yield settled()
    if rows or first:
        yield settled()


def _span_bytes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _BYTES.split(", ")])


_RUNS = "id long, twin long, start int, n int"


def _runs(ids: np.ndarray, twin: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(twin, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["id", "twin", "start", "n"])


def _shard_repeats(spans: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    """Runs of strings of (anchor, id, twin, start, bytes), sorted, that an earlier span of the anchor has."""
    anchor, ids, twin, start = (np.array(c, np.int64) for c in list(zip(*spans, strict=True))[:4])
    size = np.array([len(x[4]) for x in spans], np.int64)
    ends = np.cumsum(size)
    at = np.flatnonzero(seen_earlier(np.frombuffer(b"".join(x[4] for x in spans), np.uint8), ends, anchor, LENGTH))
    span = np.searchsorted(ends, at, "right")
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (span[1:] != span[:-1])])) if len(at) else at
    n = np.diff(np.append(new, len(at)))
    span, at = span[new], at[new]
    return _runs(ids[span], twin[span], start[span] + at - (ends - size)[span], n)


def _compare_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, part and place: runs of strings that an earlier row of the group has."""
    key, seen = None, set()
    shard: list[tuple[int, int, int, int, bytes]] = []
    held = 0
    for batch in batches:
        known: list[tuple[int, int, int, int]] = []
        for anchor, part, ids, twin, start, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if n:
                known.append((ids, twin, start, n))
            elif part >= 0:  # one string of a crowded anchor; the first row with it has its first place
                if (anchor, part) != key:
                    key, seen = (anchor, part), set()
                if data in seen:
                    known.append((ids, twin, start, 1))
                seen.add(data)
            else:
                if held >= SHARD_BYTES and anchor != shard[-1][0]:
                    yield _shard_repeats(shard)
                    shard, held = [], 0
                if not shard or shard[-1][:4] != (anchor, ids, twin, start):
                    shard.append((anchor, ids, twin, start, data))
                    held += len(data)
        if known:
            yield _runs(*(np.array(c, np.int64) for c in zip(*known, strict=True)))
    if shard:
        yield _shard_repeats(shard)


def removed_runs(n_bytes: int, runs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal byte ranges that strings starting in the runs cover."""
    out: list[list[int]] = []
    for start, n in sorted((r["start"], r["n"]) for r in runs or []):
        end = start + n + LENGTH - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    assert not out or out[-1][1] <= n_bytes
    return [tuple(x) for x in out]


def _left(data: bytes, runs: list[dict] | None) -> tuple[int, int, bytes]:
    """Removed bytes and runs of a text, and what is left of it."""
    ranges = removed_runs(len(data), runs)
    kept, at = [], 0
    for a, b in ranges:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return sum(b - a for a, b in ranges), len(ranges), b"".join(kept)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            rows = []
            for data, runs in zip(part.column(1).cast(pa.large_binary()), part.column(2).to_pylist(), strict=True):
                data = data.as_py() or b""
                rows.append((len(data), *_left(data, runs)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def _with_twin(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """id (never null), and twin, which tells rows with one id and different texts apart, 0 where ids don't repeat."""
    known = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(_NO_ID))
    repeats = docs.groupBy(known.alias("id")).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] > 1
    mark = F.xxhash64(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))
    # the largest id has a negative twin, and a null one, which comes after it, has none
    largest = (known == _NO_ID) & F.col(quoted(id_col)).isNotNull()
    if not repeats:
        return known, F.when(largest, F.lit(-1)).otherwise(F.lit(0)).cast("long")
    return known, F.when(largest, mark.bitwiseOR(F.lit(~_NO_ID))).when(known == _NO_ID, mark.bitwiseAND(F.lit(_NO_ID))).otherwise(mark)


def _own_id(id_: Column, twin: Column) -> Column:
    """The id as it was, null again where it was."""
    return F.when((id_ != _NO_ID) | (twin < 0), id_)


def repeat_runs(texts: DataFrame, group_spans: int = GROUP_SPANS) -> DataFrame:
    """From id, twin and text (UTF-8 bytes): runs (array of start, n) of strings of each text that occur earlier; texts without any are left out."""
    sent = texts.mapInArrow(_send_spans, _SPAN)
    ordered = sent.repartition("anchor").sortWithinPartitions("anchor", "span", "id", "twin", "start")
    judged = stored(ordered.mapInArrow(_judge_spans, _SPAN), "spans")
    to_compare = judged.where("n > 0")
    crowds = stored(to_compare.groupBy("anchor").agg(F.count("*").alias("spans")).where(F.col("spans") > group_spans), "crowded-anchors")
    marked = attach(to_compare, crowds, ["anchor"], "spans", to_compare.count()).withColumn("crowded", F.col("spans").isNotNull())
    wanted = marked.groupBy("id", "twin").agg(F.collect_list(F.struct("anchor", "start", "n", "crowded")).alias("wanted"))
    with_spans = texts.join(wanted, ["id", "twin"]).select("id", "twin", "text", "wanted")
    span_bytes = with_spans.mapInArrow(_fetch_spans, _BYTES)
    by_anchor = span_bytes.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "id", "twin", "start")
    compared = by_anchor.mapInArrow(_compare_strings, _RUNS)
    repeats = judged.where("n < 0").select("id", "twin", "start", (-F.col("n")).alias("n")).unionByName(compared)
    return repeats.groupBy("id", "twin").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_spans: int = GROUP_SPANS) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_removed, n_spans, kept (binary, what is left of the UTF-8 bytes).

    Null and empty texts and those under 100 bytes lose nothing. A null id counts as the largest and comes
    back as null. Rows with one id and different texts are ordered by a hash of the text; rows that
    repeat id and text are one document and lose the same. An empty table gives an empty result; other
    columns are not read. Texts of any length are read in parts.
    """
    bounded_batches(docs.sparkSession)
    known, twin = _with_twin(docs, id_col, text_col)
    texts = docs.select(known.alias("id"), twin.alias("twin"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary").alias("text"))
    # texts are shuffled as in repeat_runs, so that Spark shuffles them once
    joined = texts.join(repeat_runs(texts, group_spans), ["id", "twin"], "left").select(_own_id(F.col("id"), F.col("twin")).alias("id"), "text", "runs")
    out = joined.mapInArrow(_cut_texts, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def repeats_digest(docs: DataFrame) -> DataFrame:
    found = without_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, the text without repeats and its size in characters.

    Ids may be null or repeat, as in ``without_repeats``; columns may have any names. A character of which a
    part was removed goes as a whole. Rows meet the runs that they lose in one join, and carry their
    columns through it. A null text stays null where nothing is removed.
    """
    bounded_batches(docs.sparkSession)
    known, twin = _with_twin(docs, id_col, text_col)
    ids, twins, runs_name = (free_name(docs, c) for c in ("known_id", "twin", "runs"))
    texts = docs.select(known.alias("id"), twin.alias("twin"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary").alias("text"))
    runs = repeat_runs(texts).toDF(ids, twins, runs_name)
    own = [F.col(quoted(c)) for c in docs.columns]
    joined = docs.select("*", known.alias(ids), twin.alias(twins)).join(runs, [ids, twins], "left").select(*own, F.col(runs_name))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                text = [None if x is None else _left(x.encode(), r)[2].decode("utf-8", "ignore") if r else x for x, r in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)]
                columns = [*part.columns[:at], pa.array(text, pa.string()), *part.columns[at + 1 : -1]]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([f if i != at else pa.field(f.name, pa.string()) for i, f in enumerate(part.schema) if i < part.num_columns - 1]))

    # by place: a name may hold a dot
    places = [f"c{i}" for i in range(len(docs.columns))]
    schema = StructType([StructField(places[i], StringType() if i == at else f.dataType, True) for i, f in enumerate(docs.schema)])
    out = joined.toDF(*places, "runs").mapInArrow(run, schema).toDF(*docs.columns)
    size = F.char_length(F.coalesce(F.col(quoted(text_col)), F.lit(""))).cast("long")
    return out.select(*[size.alias(c) if c == size_col else F.col(quoted(c)) for c in docs.columns])
