"""Vectorised byte-level pre-tokenisation and exact piece lookup, used inside tasks.

Texts arrive as one UTF-8 buffer per Arrow batch.  Pre-token boundaries are found with
array operations on bytes; a piece of up to 24 bytes is its own exact key (three 64-bit
words and a length), so a lookup never confuses two pieces.  Longer pieces and texts with
characters outside the tables below go through slower, equally exact paths.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 4
#: Bytes handled at once; a longer text is cut where a piece surely ends.
BLOCK_BYTES = 2 << 20
KEY_BYTES = 24
#: Pieces looked up at once.
PART = 1 << 16


#: Code points above have the class UNKNOWN.
_TOP = 0x30000
#: Unicode's White_Space property above ASCII.
_WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point that array splitting handles.

    Tokenizer libraries carry different Unicode versions. A code point counts as known if it's assigned
    today and its class was the same in Unicode 3.2, in 2002, where unassigned ones count as others.
    """

    def classes(database) -> np.ndarray:
        kind = {"L": LETTER, "N": NUMBER}
        return np.fromiter((kind.get(database.category(chr(cp))[0], OTHER) for cp in range(_TOP)), np.uint8, _TOP)

    now, then = classes(unicodedata), classes(unicodedata.ucd_3_2_0)
    assigned = np.fromiter((unicodedata.category(chr(cp)) not in ("Cn", "Cs") for cp in range(_TOP)), bool, _TOP)
    out = np.where((now == then) & assigned, now, UNKNOWN).astype(np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[_WIDE_SPACES] = SPACE
    out[[0x85, 0x180E, 0x200B]] = UNKNOWN  # white space in some versions only
    return out


def _byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = _classes()
    first = np.full(256, UNKNOWN, np.uint8)
    first[:128] = table[:128]
    cls = first[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if lead.size:
        padded = np.concatenate([buf, np.zeros(4, np.uint8)])
        b0 = padded[lead].astype(np.int32)
        cp = (b0 & 31) << 6 | padded[lead + 1] & 63
        for size, more in ((3, lead[b0 >= 0xE0]), (4, lead[b0 >= 0xF0])):
            if more.size:
                tail = [(padded[more + k] & 63).astype(np.int32) for k in range(1, size)]
                value = padded[more].astype(np.int32) & (15 if size == 3 else 7)
                for t in tail:
                    value = value << 6 | t
                cp[b0 >= (0xE0 if size == 3 else 0xF0)] = value
        got = np.where(cp < _TOP, table[np.minimum(cp, _TOP - 1)], UNKNOWN)
        cls[lead] = got
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            inside = (b0 >= least) & (lead + k < len(buf))
            cls[lead[inside] + k] = got[inside]
    return cls


def piece_starts(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which pieces start, and for each text whether it can't be split here.

    ``bounds`` holds the start of each text and the end of the last one.
    """
    n = len(buf)
    texts = len(bounds) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(texts, bool)
    cls = _byte_classes(buf)
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start |= fresh[:n]
    # white space before a word: its last character joins the word if it is a blank, else stands alone
    at = np.flatnonzero(start[1:] & (cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~fresh[1:n]) + 1
    before = buf[at - 1]
    blank = before == 32
    start[at[blank] - 1] = True
    start[at[blank]] = False
    narrow = at[~blank & (before < 0x80)]
    start[narrow - 1] = True
    wide = at[before >= 0x80]
    start[wide - np.where(buf[wide - 2] >= 0xC0, 2, 3)] = True
    # an apostrophe that opens a piece takes its short ending with it
    at = np.flatnonzero((buf[:-1] == 39) & start[:-1] & (cls[1:] == LETTER) & ~fresh[1:n])
    if at.size:
        padded = np.concatenate([buf, np.zeros(4, np.uint8)])
        open_ = np.concatenate([fresh, np.ones(4, bool)])
        klass = np.concatenate([cls, np.full(4, SPACE, np.uint8)])
        x, y = padded[at + 1], padded[at + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ~open_[at + 2] & ((np.isin(x, np.frombuffer(b"rv", np.uint8)) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
        for which, k in ((one, 1), (two, 2)):
            p = at[which]
            start[p + 1] = False
            q = p + 1 + k
            q = q[(klass[q] == LETTER) & ~open_[q]]
            start[q] = True
    odd = np.flatnonzero(cls == UNKNOWN)
    bad = np.zeros(texts, bool)
    if odd.size:
        bad[np.unique(np.searchsorted(bounds, odd, "right") - 1)] = True
    return np.flatnonzero(start), bad


class PieceTable:
    """Open-addressed hash table from pieces of up to 24 bytes to int32 values."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.room = (1 << bits) * 6 // 10
        self.words = np.zeros((3, 1 << bits), np.uint64)
        self.size = np.zeros(1 << bits, np.uint8)
        self.value = np.zeros(1 << bits, np.int32)
        self.used = 0

    def _slots(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = words[0] * np.uint64(0x9E3779B97F4A7C15) + size
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + words[1]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) + words[2]
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(32) & self.mask).astype(np.int64)

    def find(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Value of each piece, -1 where the table has none."""
        slot = self._slots(words, size)
        out = np.full(len(size), -1, np.int32)
        live = np.arange(len(size))
        while live.size:
            s = slot[live]
            have = self.size[s]
            hit = (have == size[live]) & (self.words[0, s] == words[0, live]) & (self.words[1, s] == words[1, live]) & (self.words[2, s] == words[2, live])
            out[live[hit]] = self.value[s[hit]]
            live = live[~hit & (have != 0)]
            slot[live] = slot[live] + 1 & int(self.mask)
        return out

    def add(self, words: np.ndarray, size: np.ndarray, value: np.ndarray) -> None:
        """Put in pieces that are distinct and not yet there."""
        slot = self._slots(words, size)
        live = np.arange(len(size))
        while live.size:
            free = self.size[slot[live]] == 0
            _, first = np.unique(slot[live[free]], return_index=True)
            put = live[free][first]
            s = slot[put]
            self.words[:, s], self.size[s], self.value[s] = words[:, put], size[put], value[put]
            done = np.zeros(len(live), bool)
            done[np.flatnonzero(free)[first]] = True
            live = live[~done]
            slot[live] = slot[live] + 1 & int(self.mask)
        self.used += len(size)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def piece_words(padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 24 bytes of each piece as three words, zero after its end. padded: 24 bytes follow the texts."""
    view = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))
    return np.stack([view[np.minimum(start + 8 * k, len(view) - 1)] & _MASKS[np.clip(size - 8 * k, 0, 8)] for k in range(3)])


def pieces_as_words(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words and sizes of pieces of at most 24 bytes."""
    flat = np.frombuffer(b"".join(p.ljust(KEY_BYTES, b"\0") for p in pieces), "<u8").reshape(-1, 3)
    return np.ascontiguousarray(flat.T), np.array([len(p) for p in pieces], np.uint8)


class PieceCoder:
    """Encodes texts piece by piece through a bounded cache that one worker process keeps.

    encode_pieces: list of pieces -> list of id lists, for pieces not seen before.
    encode_text: whole text -> ids, for texts the byte tables don't cover.
    special: a string that makes a text go through encode_text.
    """

    #: What ids and longer pieces may take before the cache starts anew; a block of texts adds a few MB to it.
    CACHE_BYTES = 48 << 20
    #: A longer piece's dictionary entry, besides its bytes.
    LONG_EXTRA = 150

    def __init__(self, encode_pieces: Callable, encode_text: Callable, special: bytes | None = None, bits: int = 20):
        self.encode_pieces, self.encode_text, self.special, self.bits = encode_pieces, encode_text, special, bits
        self._clear()

    def _clear(self) -> None:
        self.table = PieceTable(self.bits)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self.first = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.uint32)
        self.entries = self.ids = 0

    def _enter(self, pieces: list[bytes]) -> np.ndarray:
        found = self.encode_pieces(pieces)
        n = np.fromiter(map(len, found), np.int32, len(found))
        more = np.fromiter((i for x in found for i in x), np.uint32, int(n.sum()))
        for name, need in (("first", self.entries + len(n)), ("count", self.entries + len(n)), ("flat", self.ids + len(more))):
            if len(old := getattr(self, name)) < need:
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old)), old.dtype)]))
        at = np.arange(self.entries, self.entries + len(n), dtype=np.int32)
        self.count[at] = n
        self.first[at] = self.ids + np.cumsum(n) - n
        self.flat[self.ids : self.ids + len(more)] = more
        self.entries += len(n)
        self.ids += len(more)
        return at

    def entries_of(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Cache entry of each piece; unseen ones are encoded."""
        if self.table.used + len(self.long) > self.table.room - len(start) or self.long_bytes + self.ids * 4 > self.CACHE_BYTES:
            self._clear()
        out = np.full(len(start), -1, np.int32)
        short = np.flatnonzero(size <= KEY_BYTES)
        words, n = piece_words(padded, start[short], size[short]), size[short].astype(np.uint8)
        got = self.table.find(words, n)
        if (lack := np.flatnonzero(got < 0)).size:
            keys = np.empty(len(lack), np.dtype([("a", "u8"), ("b", "u8"), ("c", "u8"), ("n", "u1")]))
            keys["a"], keys["b"], keys["c"], keys["n"] = *words[:, lack], n[lack]
            _, first, back = np.unique(keys, return_index=True, return_inverse=True)
            which = short[lack[first]]
            new = self._enter([padded[i : i + k].tobytes() for i, k in zip(start[which].tolist(), size[which].tolist(), strict=True)])
            self.table.add(words[:, lack[first]], n[lack[first]], new)
            got[lack] = new[back]
        out[short] = got
        for i in np.flatnonzero(size > KEY_BYTES).tolist():
            piece = padded[start[i] : start[i] + size[i]].tobytes()
            if (e := self.long.get(piece)) is None:
                e = self.long[piece] = int(self._enter([piece])[0])
                self.long_bytes += len(piece) + self.LONG_EXTRA
            out[i] = e
        return out

    def _ids(self, entry: np.ndarray) -> np.ndarray:
        n = self.count[entry]
        shift = self.first[entry] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids one after another, end of each row's ids) by blocks; null counts as empty."""
        for lo, hi, padded, bounds, owner in blocks(column):
            start, slow = self._split(padded, bounds)
            at = np.searchsorted(start, bounds)
            size = np.diff(np.append(start, bounds[-1]))
            if not slow.any():
                parts, ends = self._coded(padded, start, size)
                per = ends[at[1:]] - ends[at[:-1]]
            else:
                parts, per = [], []
                for k in range(len(slow)):
                    if slow[k]:
                        ids = np.asarray(self.encode_text(padded[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "replace")), np.uint32)
                    else:
                        ids = self._coded(padded, start[at[k] : at[k + 1]], size[at[k] : at[k + 1]])[0]
                    parts.append(ids)
                    per.append(len(ids))
                parts, per = np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(per, np.int64)
            rows = np.zeros(hi - lo, np.int64)
            np.add.at(rows, owner - lo, per)
            yield lo, hi, parts, np.cumsum(rows)

    def _split(self, padded: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, slow = piece_starts(padded[: bounds[-1]], bounds)
        return start, slow | self._special(padded, bounds)

    def _special(self, padded: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bounds) - 1, bool)
        if self.special:
            data, at = padded[: bounds[-1]].tobytes(), -1
            while (at := data.find(self.special, at + 1)) >= 0:
                out[np.searchsorted(bounds, at, "right") - 1] = True
        return out

    def _coded(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many there are before each piece and in all."""
        ids, ends = [], [np.zeros(1, np.int64)]
        for k in range(0, len(start), PART):  # the cache may be cleared between parts, never inside one
            entry = self.entries_of(padded, start[k : k + PART], size[k : k + PART])
            ids.append(self._ids(entry))
            ends.append(ends[-1][-1] + np.cumsum(self.count[entry]))
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(ends)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes and 24 zeros, bounds of the texts, row of each text).

    Blocks hold whole rows of about BLOCK_BYTES; a longer row is a block of its own, of several
    texts, cut before a blank between two ASCII letters, where a piece always starts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1)
        hi = min(hi, n)
        padded = np.concatenate([raw[offsets[lo] : offsets[hi]], np.zeros(KEY_BYTES, np.uint8)])
        bounds, owner = offsets[lo : hi + 1] - offsets[lo], np.arange(lo, hi)
        if hi == lo + 1 and bounds[-1] > 2 * BLOCK_BYTES:
            cuts = _cuts(padded, int(bounds[-1]))
            bounds, owner = np.array([0, *cuts, int(bounds[-1])]), np.full(len(cuts) + 1, lo)
        yield lo, hi, padded, bounds, owner
        lo = hi


def _cuts(buf: np.ndarray, n: int) -> list[int]:
    out, at = [], BLOCK_BYTES
    while at < n - 2:
        part = buf[at : min(at + BLOCK_BYTES, n)]
        low = part | 32
        word = (low >= 97) & (low <= 122)
        found = np.flatnonzero(word[:-2] & (part[1:-1] == 32) & word[2:])
        if found.size:
            out.append(at + int(found[0]) + 1)
            at = out[-1]
        at += BLOCK_BYTES
    return out
