"""Document quality by Bradley-Terry ranking.

Preference pairs, a document labelled good before one labelled bad, teach a linear score of text features by
logistic loss on feature differences. All labelled rows outside the held-out ones are learnt: they are dealt to
blocks, and in a block each good row is preferred to each bad one. The threshold is the exact quantile of all learnt rows'
scores at their share of bad ones, and the score returned puts it at 0.7.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import bounded_batches, stored
from catalith.llm.langid import held_out

#: Rows of each class that meet in a block, about so many to twice as many.
BLOCK_SIDE = 64
#: Bins that scores are counted in at once.
BINS = 4096
PENALTY = 1e-3
STEPS = 60
THRESHOLD = 0.7
_BLOCK = 1 << 18
_WINDOW = 64
_KINDS = ("lower", "upper", "digit", "other_number", "stop", "pause", "shout", "mark", "symbol", "control", "blank", "line_end")
FEATURES = (*(f"share_{k}" for k in _KINDS[:-2]), "upper_of_letters", "log_words", "word_length", "long_words", "repeated_next", "distinct_near", "repeated_lines", "words_in_line", "shouted_words", "marked_words", "kinds_mixed")


@functools.cache
def _kind() -> np.ndarray:
    """Index into _KINDS of each code point below U+30000; what lies above counts as lower-case letter."""
    by_category = {"Lu": 1, "Lt": 1, "Nd": 2, "Nl": 3, "No": 3, "Zs": 10, "Zl": 11, "Zp": 11}
    out = np.zeros(0x30001, np.uint8)
    for cp in range(0x30000):
        c = unicodedata.category(chr(cp))
        out[cp] = by_category.get(c, {"L": 0, "M": 0, "P": 7, "S": 8}.get(c[0], 9))
    for kind, characters in ((4, ".?…。"), (5, ",;:،、"), (6, "!¡"), (8, "#*%&@/\\_"), (10, "\t\x0b\x0c"), (11, "\n\r")):
        out[[ord(x) for x in characters]] = kind
    return out


def text_features(text: str | None) -> np.ndarray:
    """FEATURES of the whole text; all 0 for a null or blank one."""
    out = np.zeros(len(FEATURES), np.float32)
    words = (text or "").split()
    if not words:
        return out
    table, tally = _kind(), np.zeros(len(_KINDS), np.int64)
    for at in range(0, len(text), _BLOCK):
        points = np.frombuffer(text[at : at + _BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        tally += np.bincount(table[np.minimum(points, 0x30000)], minlength=len(_KINDS))
    n, solid = len(words), max(int(tally[:-2].sum()), 1)
    windows = range(0, n, _WINDOW)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(int(tally[0] + tally[1]), 1)
    shares = tally[:-2] / solid
    out[: len(shares)] = np.sqrt(shares)
    out[len(shares) :] = (
        tally[1] / letters,
        np.log1p(n),
        min(solid / n, 30) / 10,
        sum(len(w) > 24 for w in words) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(len(set(words[a : a + _WINDOW])) for a in windows) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(map(str.isupper, words)) / n,
        sum(not w.isalnum() for w in words) / n,
        float(-(shares[shares > 0] * np.log(shares[shares > 0])).sum()),
    )
    return out


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id and features, in the order of FEATURES."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([text_features(x.as_py()) for x in batch.column(1)]) if batch.num_rows else np.zeros(0, np.float32)
            at = np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(found))], ["id", "features"])

    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, features array<float>")


@dataclass
class Ranking:
    """score(x) is the sigmoid of weights * (x - centre) / spread - cut + logit(0.7); without weights the constant."""

    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    cut: float = 0.0
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x.astype(np.float64) - self.centre) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)), -700, 700)))


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of all pairs of a good and a bad row: their number, sum(log sigmoid(w * (good - bad))), its gradient and the negative of its second derivatives, as one flat array."""
    ahead = np.clip((good @ w)[:, None] - (bad @ w)[None, :], -700, 700)
    lost = 1 / (1 + np.exp(ahead))
    bend = lost * (1 - lost)
    slope = good.T @ lost.sum(1) - bad.T @ lost.sum(0)
    cross = good.T @ bend @ bad
    curve = (good.T * bend.sum(1)) @ good + (bad.T * bend.sum(0)) @ bad - cross - cross.T
    return np.concatenate([[lost.size, -np.logaddexp(0, -ahead).sum()], slope, curve.ravel()])


def climbed(sums: Callable[[np.ndarray], np.ndarray], width: int, steps: int = STEPS) -> np.ndarray:
    """Weights that make the mean over the pairs of ``sums`` (as of ``pair_sums``) largest, less a penalty, by Newton's steps, halved where they lose."""
    w, step, reached = np.zeros(width), np.zeros(width), -np.inf
    for _ in range(steps):
        found = sums(w + step)
        value = found[1] / found[0] - PENALTY / 2 * np.sum((w + step) ** 2)
        if value < reached - 1e-12:
            step = step / 2
            continue
        w, reached = w + step, value
        slope = found[2 : 2 + width] / found[0] - PENALTY * w
        step = np.linalg.solve(found[2 + width :].reshape(width, width) / found[0] + PENALTY * np.eye(width), slope)
        if np.abs(step).max() < 1e-9:
            break
    # sums differ in their last digits with the order of tasks
    return np.round(w, 8)


def pair_weights(good: np.ndarray, bad: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights learnt from all pairs of rows in memory."""
    return climbed(lambda w: pair_sums(good, bad, w), good.shape[1], steps)


def weighted_cut(scores: np.ndarray, weights: np.ndarray, share: float) -> float:
    """Midway between the scores on both sides of the quantile ``share``."""
    order = np.argsort(scores, kind="stable")
    below = np.cumsum(weights[order]) / weights.sum()
    k = int(np.searchsorted(below, share * (1 - 1e-9)))
    low, high = scores[order[min(k, len(order) - 1)]], scores[order[min(k + 1, len(order) - 1)]]
    return float((low + high) / 2)


def _summed(rows: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of what ``add`` makes of the batches: one array a task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [add(batch) for batch in batches if batch.num_rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, axis=0).tolist()], pa.list_(pa.float64()))], ["sums"])

    return np.sum([r.sums for r in rows.mapInArrow(run, "sums array<double>").collect()], axis=0)


def _blocks(learnt: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """All learnt rows, dealt by a hash of the id to blocks of some BLOCK_SIDE to 2 * BLOCK_SIDE rows of each class: good and bad, lists of features.

    A block of the smaller class meets as many blocks of the larger one as the classes' sizes differ by.
    """
    small = int(sizes[1] < sizes[0])
    blocks = max(sizes[small] // BLOCK_SIDE, 1)
    hashed = learnt.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)), "part": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(-(-sizes[1 - small] // sizes[small])))})
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("id", "features"))), lambda r: r["features"])
    few = hashed.where(F.col("label") == small).groupBy("block").agg(gathered.alias("few"))
    many = hashed.where(F.col("label") != small).groupBy("block", "part").agg(gathered.alias("many"))
    names = ("few", "many") if small else ("many", "few")
    # with more than one block, each expects 64 rows of either class or more: the chance that one has none is below 1e-27
    return many.join(few, "block").select(F.col(names[0]).alias("good"), F.col(names[1]).alias("bad"))


def _cut(raw: DataFrame, rank: int, total: int) -> float:
    """Midway between the ``rank``-th smallest of all scores (column raw) and the next value above, by ever finer bins around it."""
    low, high, below = *raw.agg(F.min("raw"), F.max("raw")).first(), 0
    while True:
        width = (high - low) / BINS or 1.0
        at = F.least(F.floor((F.col("raw") - low) / width), F.lit(BINS - 1))
        within = raw.where(F.col("raw").between(low, high)).groupBy(at.alias("at"))
        bins = within.agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).orderBy("at").collect()
        last = below + np.cumsum([b.n for b in bins])
        own = int(np.searchsorted(last, rank))
        if bins[own].low == bins[own].high or len(bins) == 1:
            break
        low, high, below = bins[own].low, bins[own].high, int(last[own]) - bins[own].n
    value = bins[own].low
    above = raw.where(F.col("raw") > value).agg(F.min("raw")).first()[0]
    to = int(last[own])
    return weighted_cut(np.array([value, value if above is None else above]), np.array([to, total - to], float), rank / total)


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows_per_class: int | None = None) -> Ranking:
    """Learn from all labelled ids; an id with several labels has that of most, 1 at a tie. ``rows_per_class``: from about so many of each class.

    ``features`` has id and features. Only counts by class and by bin of scores and a task's sums reach the driver. Labels
    other than 0 and 1, null ones and null ids aren't learnt; neither are held-out ids.
    """
    width = len(FEATURES)
    flat = Ranking(np.zeros(width), np.zeros(width), np.ones(width))
    voted = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label in (0, 1)")
    voted = stored(voted.where(~held_out(F.col("id"))).groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label")), "labels")
    marked = {r.label: r.n for r in voted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(marked) < 2:
        flat.constant = float(next(iter(marked), 0.5))
        return flat
    if rows_per_class is not None:
        part = F.when(F.col("label") == 1, min(1.0, rows_per_class / marked[1])).otherwise(min(1.0, rows_per_class / marked[0]))
        voted = voted.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part * (1 << 30))
    learnt = stored(features.where("id is not null").join(voted, "id").groupBy("id", "label").agg(F.min("features").alias("features")), "learnt")
    sizes = {r.label: r.n for r in learnt.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        flat.constant = marked[1] / (marked[0] + marked[1])
        return flat
    total = sizes[0] + sizes[1]
    matrix = functools.partial(_rows, width=width)
    flat.centre = np.round(_summed(learnt, lambda b: matrix(b.column(2)).sum(0)) / total, 9)
    centre = flat.centre
    flat.spread = np.maximum(np.round(np.sqrt(_summed(learnt, lambda b: ((matrix(b.column(2)) - centre) ** 2).sum(0)) / total), 9), 1e-3)
    spread = flat.spread
    blocks = stored(_blocks(learnt, sizes), "blocks")

    def sums(w: np.ndarray) -> np.ndarray:
        def add(batch: pa.RecordBatch) -> np.ndarray:
            pairs = zip(*(batch.column(c) for c in ("good", "bad")), strict=True)
            return np.sum([pair_sums(*((matrix(x.values) - centre) / spread for x in pair), w) for pair in pairs], axis=0)

        return _summed(blocks, add)

    flat.weights = climbed(sums, width)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(flat.raw(matrix(batch.column(2))))], ["raw"])

    flat.cut = _cut(stored(learnt.mapInArrow(scores, "raw double"), "learnt-scores"), sizes[0], total)
    return flat


def _rows(lists: pa.Array, width: int) -> np.ndarray:
    """A matrix of an array of lists of features."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width).astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, held_out, score (0 to 1), predicted (1 from score 0.7).

    Null, empty and blank texts have features of 0 and get the score of those. Repeated rows are scored
    each; a null id counts as held out and stays null; an empty table gives an empty result; without labels of
    both classes every score is the one label (0.5 without any). Other columns are not read.
    """
    rows = stored(document_features(docs, id_col, text_col), "features")
    ranking = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, id_col, label_col, rows_per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            score = ranking.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    scored = rows.mapInArrow(run, "id long, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", "predicted")
