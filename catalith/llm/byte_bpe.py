"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one token that can end a valid encoding of it. Storing that
token for each prefix gives the encoding by walking back from the end, makes an append exact (earlier
entries never change), and lets an edit stop as soon as the stored tokens after it agree again.
A token may follow another if merging the two tokens' bytes by rank gives just these two.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import bounded_batches
from catalith.llm.pretokens import PieceCoder
from catalith.llm.vocabulary import PATTERN, RANKS, ranks


class PrefixCoder:
    """Encoder over merge ranks; a token's id is its rank."""

    PAIRS_KEPT = 1 << 20

    def __init__(self, merge_ranks: dict[bytes, int]):
        self.ranks = merge_ranks
        self.longest = max(map(len, merge_ranks))
        self.bytes_of: list[bytes] = [b""] * (max(merge_ranks.values()) + 1)
        for token, i in merge_ranks.items():
            self.bytes_of[i] = token
        self._follows: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._found = ahocorasick.Automaton()
        for token, i in merge_ranks.items():
            self._found.add_word(token.decode("latin-1"), (i, len(token)))
        self._found.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """Ids by merging the adjacent pair of lowest rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def can_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self._follows.get(key)) is None:
            if len(self._follows) >= self.PAIRS_KEPT:
                self._follows.clear()
            known = self._follows[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def can_open(self, token: int) -> bool:
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The one token that ends a valid encoding of data[:end]; last[i] has it for each shorter prefix."""
        for begin in range(max(0, end - self.longest), end):
            token = self.ranks.get(data[begin:end])
            if token is not None and (self.can_follow(last[begin], token) if begin else self.can_open(token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def last_tokens(self, data: bytes, last: list[int]) -> None:
        """Add to ``last`` what it lacks, over the tokens that end at each place, found in one pass."""
        done = len(last) - 1
        base = max(0, done - self.longest + 1)
        last += [-1] * (len(data) - done)
        for at, (token, size) in self._found.iter(data[base:].decode("latin-1")):
            end = base + at + 1
            if end > done and last[end] < 0:
                begin = end - size
                if self.can_follow(last[begin], token) if begin else self.can_open(token):
                    last[end] = token
        if -1 in last[done + 1 :]:
            raise ValueError("the vocabulary lacks a byte")

    def encode_piece(self, data: bytes) -> list[int]:
        if (token := self.ranks.get(data)) is not None and self.can_open(token):
            return [token]
        return PrefixTable(self, data).ids()


class PrefixTable:
    """One piece with the last token of each of its prefixes."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.coder.last_tokens(self.data, self.last)

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace data[at:at + removed]; returns how many prefixes had to be worked out again."""
        old, tail_from = self.last, at + removed
        self.data = self.data[:at] + inserted + self.data[tail_from:]
        self.last, done, same = old[: at + 1], 0, 0
        shift = len(inserted) - removed
        for end in range(at + 1, len(self.data) + 1):
            self.last.append(self.coder.last_token(self.data, end, self.last))
            done += 1
            before = end - shift
            same = same + 1 if before > tail_from and old[before] == self.last[end] else 0
            if same >= self.coder.longest:  # what follows looks back no farther than this
                self.last += old[before + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.coder.bytes_of[out[-1]])
        return out[::-1]


class EncodedText:
    """A text's pieces, each with its prefix table, under appends and edits."""

    #: A match depends on no more than so many characters after it.
    LOOKS_AHEAD = 3

    def __init__(self, coder: PrefixCoder, text: str = "", pattern: str = PATTERN):
        self.coder, self.split = coder, regex.compile(pattern)
        self.text, self.pieces = "", []
        self.append(text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), 0, more)

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace text[at:at + removed]; only pieces near the edit are split and encoded again."""
        pos, keep = 0, 0
        while keep < len(self.pieces) and pos + len(self.pieces[keep][0]) + self.LOOKS_AHEAD <= at:
            pos += len(self.pieces[keep][0])
            keep += 1
        rest, old_starts, where = self.pieces[keep:], {}, pos
        for k, (piece, _) in enumerate(rest):
            old_starts[where] = k
            where += len(piece)
        self.text = self.text[:at] + inserted + self.text[at + removed :]
        shift, fresh, tail = len(inserted) - removed, [], []
        while pos < len(self.text):
            if pos >= at + len(inserted) and (k := old_starts.get(pos - shift)) is not None and pos - shift >= at + removed:
                tail = rest[k:]
                break
            piece = self.split.match(self.text, pos).group()
            fresh.append((piece, self._table(rest, len(fresh), piece)))
            pos += len(piece)
        self.pieces[keep:] = fresh + tail

    def _table(self, old: list, k: int, piece: str) -> PrefixTable:
        if k < len(old):
            before, table = old[k]
            if piece == before:
                return table
            if piece.startswith(before):
                longer = PrefixTable(self.coder)
                longer.data, longer.last = table.data, list(table.last)
                longer.append(piece[len(before) :].encode())
                return longer
        return PrefixTable(self.coder, piece.encode())

    def ids(self) -> list[int]:
        return [i for _, table in self.pieces for i in table.ids()]


@functools.cache
def prefix_coder(path: str = RANKS) -> PrefixCoder:
    return PrefixCoder(ranks(path))


@functools.cache
def _column_coder(path: str) -> PieceCoder:
    coder, split = prefix_coder(path), regex.compile(PATTERN)
    return PieceCoder(lambda pieces: [coder.encode_piece(p) for p in pieces], lambda text: [i for p in split.findall(text) for i in coder.encode_piece(p.encode())])


@functools.cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = prefix_coder(path).bytes_of
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """One row per row of ``docs``: its id and ``ids`` array<int>, special strings being ordinary text.

    A null or empty text has an empty array; repeated rows, null ids and empty tables pass through,
    and other columns are not read. Very long texts are encoded in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _column_coder(ranks_path)
        for batch in batches:
            for lo, hi, ids, ends in coder.encode(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["id", "ids"])

    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str = RANKS) -> DataFrame:
    """One row per row: its id, its ids, and ``decoded`` binary, the tokens' bytes joined; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, first, size = _token_bytes(ranks_path)
        step = 256
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                n = size[ids]
                at = np.concatenate([[0], np.cumsum(n)])
                data = flat[np.repeat(first[ids] - at[:-1], n) + np.arange(at[-1])]
                out = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, out], ["id", "ids", "decoded"])

    narrow = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return narrow.mapInArrow(run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col).withColumnRenamed("ids", ids_col)


def round_trip_digest(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """Encode, decode, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, ranks_path=ranks_path), ranks_path=ranks_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
