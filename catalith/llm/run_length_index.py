"""Run-length Burrows-Wheeler index over a shard of short texts, and matching statistics streamed through it.

The suffixes of the texts are sorted, the transform is kept as runs of equal bytes, and suffix positions are kept
at the two ends of each run only. A text that is streamed backwards through the index holds, for each of its
places, one row of the transform, the match length and the text position of that row. Where the next byte
extends the match, the row moves on inside its run; elsewhere it jumps to the nearer end of a run of that byte
and the match shrinks to what both suffixes share. Many texts are streamed at once, one array operation a step.

Texts belong to cells, and a text matches texts of its own cell only: a byte counts as a letter of its cell's
alphabet, so one index serves many small groups.
"""

from __future__ import annotations

import numpy as np

#: Letters of a cell: the end of a text, then 256 bytes.
LETTERS = 257
_FEW = 7
_LOW_BYTES = np.array([(1 << 8 * (_FEW - k)) - 1 for k in range(_FEW + 1)], np.uint64)


def _laid_out(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one place after each for its end, the text of each place, and the bytes from it to the end."""
    size = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), size + 1)
    stop = np.cumsum(size + 1) - 1
    room = stop[text] - np.arange(len(text))
    laid = np.zeros(len(text) + 8, np.uint8)
    laid[np.flatnonzero(room)] = data[: ends[-1]] if len(ends) else 0
    return laid, text, room


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 0, equal for equal keys."""
    order = np.argsort(key)
    ranked = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    return rank


def suffix_order(laid: np.ndarray, cell: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Places by cell, then by the bytes from the place to its text's end, then by place: prefix doubling from seven bytes."""
    n = len(room)
    word = np.ndarray((n,), ">u8", laid.data, 0, (1,)).astype(np.uint64) >> np.uint64(8)
    few = np.minimum(room, _FEW)
    rank = _dense((word & ~_LOW_BYTES[few]) << np.uint64(3) | few.astype(np.uint64))
    span, longest, at = _FEW, int(room.max(initial=0)), np.arange(n)
    while span < longest and rank.max(initial=0) < n - 1:
        after = np.where(room >= span, rank[np.minimum(at + span, n - 1)] + 1, 0)
        rank = _dense(rank * (n + 1) + after)
        span *= 2
    return np.argsort(cell * n + rank, kind="stable")


class RunLengthIndex:
    """Runs of the transform of texts that lie end to end in ``data``; ``cell`` holds a number for each text."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, cell: np.ndarray):
        self.laid, text, self.room = _laid_out(data, ends)
        cell = np.asarray(cell, np.int64)[text]
        order = suffix_order(self.laid, cell, self.room)
        before = order - 1
        opens = np.concatenate([[True], self.room[:-1] == 0])[order] if len(order) else np.zeros(0, bool)
        letter = cell[order] * LETTERS + np.where(opens, 0, self.laid[before].astype(np.int64) + 1)
        new = np.concatenate([[True], letter[1:] != letter[:-1]]) if len(letter) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(letter)))
        self.letter = letter[self.start]
        self.first, self.last = order[self.start], order[self.start + self.size - 1]
        runs = len(self.start)
        by_letter = np.argsort(self.letter, kind="stable")
        self.target = np.empty(runs, np.int64)
        self.target[by_letter] = np.cumsum(self.size[by_letter]) - self.size[by_letter]
        self.key = self.letter[by_letter] * (runs + 1) + by_letter
        self.words = np.ndarray((len(self.laid) - 7,), "<u8", self.laid.data, 0, (1,))

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, up to ``most``."""
        most = np.minimum(most, np.minimum(self.room[a], self.room[b]))
        out, live, k = most.copy(), np.flatnonzero(most > 0), 0
        while live.size:
            differ = self.words[a[live] + k] ^ self.words[b[live] + k]
            hit = np.flatnonzero(differ)
            low = differ[hit] & (~differ[hit] + np.uint64(1))
            out[live[hit]] = np.minimum(most[live[hit]], k + (np.log2(low.astype(np.float64)) / 8).astype(np.int64))
            k += 8
            live = live[(differ == 0) & (most[live] > k)]
        return out

    def matching_statistics(self, data: np.ndarray, ends: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """For each byte of the streamed texts, how long a string that starts there occurs in the index, in the text's cell."""
        size = np.diff(ends, prepend=0)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        runs = len(self.start)
        if not runs:
            return out
        by_size = np.argsort(-size, kind="stable")
        stop, left, base = ends[by_size], size[by_size], np.asarray(cell, np.int64)[by_size] * LETTERS + 1
        row, length, place = (np.zeros(len(ends), np.int64) for _ in range(3))
        for step in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -step, "left"))  # texts of more than ``step`` bytes
            at = stop[:n] - 1 - step
            letter = base[:n] + data[at]
            run = np.searchsorted(self.start, row[:n], "right") - 1
            go = np.flatnonzero((self.letter[run] == letter) & (length[:n] > 0))
            row[go] += self.target[run[go]] - self.start[run[go]]
            place[go] -= 1
            length[go] += 1
            away = np.ones(n, bool)
            away[go] = False
            if (miss := np.flatnonzero(away)).size:
                self._jump(miss, letter[miss], run[miss], row, length, place)
            out[at] = length[:n]
        return out

    def _jump(self, miss: np.ndarray, letter: np.ndarray, run: np.ndarray, row: np.ndarray, length: np.ndarray, place: np.ndarray) -> None:
        """Move to the run of the letter above or below whose near end shares more with the present suffix."""
        runs = len(self.start)
        below = np.searchsorted(self.key, letter * (runs + 1) + run)
        above = below - 1
        down = self.key[np.minimum(below, runs - 1)]
        up = self.key[np.maximum(above, 0)]
        has_down, has_up = (below < runs) & (down // (runs + 1) == letter), (above >= 0) & (up // (runs + 1) == letter)
        down, up = down % (runs + 1), up % (runs + 1)
        held = length[miss]
        by_down, by_up = np.where(has_down, 0, -1), np.where(has_up, 0, -1)
        for have, ends, best in ((has_down, self.first[down], by_down), (has_up, self.last[up], by_up)):
            if (k := np.flatnonzero(have & (held > 0))).size:
                best[k] = self.shared(place[miss[k]], ends[k], held[k])
        low = by_down >= by_up
        found = low & has_down | ~low
        to = np.where(low, down, up)
        row[miss] = np.where(found, self.target[to] + np.where(low, 0, self.size[to] - 1), 0)
        place[miss] = np.where(found, np.where(low, self.first[to], self.last[to]) - 1, 0)
        length[miss] = np.where(found, np.maximum(by_down, by_up) + 1, 0)


def _chosen(data: np.ndarray, ends: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and ends of some of the texts, and where their bytes are in ``data``."""
    take = size[which]
    cut = np.cumsum(take)
    at = np.arange(int(take.sum())) + np.repeat(ends[which] - cut, take)
    return data[at], cut, at


def seen_earlier(data: np.ndarray, ends: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each byte, whether the ``length`` bytes from there, inside its text, occur in an earlier text of the text's group.

    Two texts of a group are compared where their ranks first differ in a bit: at each bit, the texts
    without it are indexed and those with it are streamed, all groups at once, in cells of equal higher bits.
    Texts all of whose strings are known to be repeats take no further part: their strings occur in an
    earlier text that does.
    """
    size = np.diff(ends, prepend=0)
    out = np.zeros(len(data), bool)
    if not len(ends):
        return out
    new = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    rank = np.arange(len(ends)) - first[number]
    begin = ends - size
    strings = np.maximum(size - length + 1, 0)
    open_ = strings > 0
    for bit in range(int(rank.max()).bit_length()):
        higher = number * (int(rank.max()) + 1) + (rank >> bit + 1)
        late = (rank >> bit & 1).astype(bool) & open_
        early = ~(rank >> bit & 1).astype(bool) & open_
        both = np.intersect1d(higher[late], higher[early])
        if not both.size:
            continue
        late, early = (np.flatnonzero(side & np.isin(higher, both)) for side in (late, early))
        cell = np.searchsorted(both, higher)
        index = RunLengthIndex(*_chosen(data, ends, size, early)[:2], cell[early])
        streamed, cut, at = _chosen(data, ends, size, late)
        out[at[index.matching_statistics(streamed, cut, cell[late]) >= length]] = True
        known = np.concatenate([[0], np.cumsum(out)])
        open_ = known[begin + strings] - known[begin] < strings
    return out
