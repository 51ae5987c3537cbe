"""Language identification by multilingual mixture inference.

Character n-gram frequencies of each language are learnt from labelled rows. A document is taken as a
mixture: expectation-maximisation finds the share of each language that makes its n-grams likeliest,
and languages enter the document's set one at a time while they raise the log-likelihood by more
than a penalty that grows with the document. The prediction is the language with the largest share.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from catalith.llm.common import bounded_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Rows of each language that the model is fitted on, chosen by a hash of text; all where there are fewer.
ROWS_PER_LANGUAGE = 2000
#: Different labels that can be learnt; more are an error, as that is no column of languages. A model takes BUCKETS * 4 bytes a label.
LANGUAGES = 2048
SMOOTHING = 0.5
EM_STEPS = 12
#: A language must raise the log-likelihood by PENALTY * log(1 + n-grams).
PENALTY = 3.0
NO_LANGUAGE = "und"
_LETTER = regex.compile(r"\p{L}")
_BLOCK = 1 << 18
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point below U+30000 is a letter, or a mark that belongs to one."""
    return np.fromiter((unicodedata.category(chr(cp))[0] in "LM" for cp in range(0x30000)), bool, 0x30000)


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of the lower-cased text, in blocks; everything but letters and their marks counts as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[np.minimum(points, 0x2FFFF)]
    if (high := points > 0x2FFFF).any():
        kinds, at = np.unique(points[high], return_inverse=True)
        letter[high] = np.array([cp < 0x110000 and unicodedata.category(chr(cp))[0] in "LM" for cp in kinds.tolist()], bool)[at]
    points = np.where(letter, points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    for at in range(0, len(points), _BLOCK):
        part = points[at : at + _BLOCK + len(ORDERS) - 1]
        h = np.zeros(len(part), np.uint32)
        for order in ORDERS:
            n = min(_BLOCK, len(part) - order + 1)
            if n <= 0:
                break
            h = (h[: len(part) - order + 1] ^ part[order - 1 :]) * _MULTIPLIERS[order - 1]
            h ^= h >> np.uint32(15)
            yield (h[:n] >> np.uint32(2)) % np.uint32(BUCKETS)


@dataclass
class Model:
    """languages, and the probability of each bucket in each, as (BUCKETS, languages)."""

    languages: list[str]
    chance: np.ndarray

    def mixture(self, counts: np.ndarray, chance: np.ndarray, members: list[int], steps: int = EM_STEPS) -> tuple[np.ndarray, float]:
        """Shares of the members and the log-likelihood."""
        p = chance[:, members]
        share = np.full(len(members), 1 / len(members))
        total = counts.sum()
        for _ in range(steps if len(members) > 1 else 0):
            weight = counts / (p @ share)
            new = share * (weight @ p) / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share, float(counts @ np.log(p @ share))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its score; NO_LANGUAGE and 0 without letters.

        The score is the language's share of the document times the posterior of that language against the
        next likely one alone. Neighbouring n-grams depend on each other, so n of them count as
        the square root of n in the posterior.
        """
        if not text or not self.languages or not _LETTER.search(text):
            return NO_LANGUAGE, 0.0
        tally = np.zeros(BUCKETS, np.int64) if len(text) > 4096 else None
        parts = []
        for grams in gram_buckets(text):
            if tally is None:
                parts.append(grams)
            else:
                tally += np.bincount(grams, minlength=BUCKETS)
        if tally is None:
            tally = np.bincount(np.concatenate(parts), minlength=BUCKETS)
        seen = np.flatnonzero(tally)
        counts, chance = tally[seen].astype(np.float32), self.chance[seen]
        alone = counts @ np.log(chance)
        chosen = [int(alone.argmax())]
        sure = 1.0
        if len(alone) > 1:
            first, second = np.sort(alone)[:-3:-1]
            sure = float(1 / (1 + np.exp(-min((first - second) / np.sqrt(counts.sum()), 700.0))))
        share, best = np.ones(1), float(alone[chosen[0]])
        penalty = PENALTY * np.log1p(counts.sum())
        others = [k for k in range(len(self.languages)) if k != chosen[0]]
        while others:
            # how much more likely an n-gram would be under each other language, given the present mixture
            gain = (counts / (chance[:, chosen] @ share)) @ chance[:, others]
            if gain.max() <= counts.sum():
                break  # no first-order gain in likelihood for any other language
            add = others[int(gain.argmax())]
            new_share, new_best = self.mixture(counts, chance, [*chosen, add])
            if new_best - best <= penalty:
                break
            chosen, share, best = [*chosen, add], new_share, new_best
            others.remove(add)
        k = int(share.argmax())
        return self.languages[chosen[k]], float(min(max(share[k], 0.0), 1.0)) * sure


def fit(labelled: DataFrame, text_col: str, lang_col: str, rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Fit on at most about ``rows_per_language`` rows of each label, taken by hash of the text; more than ``languages`` labels are a ValueError.

    Only counts by those labels and by (label, bucket) reach the driver.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.where(labelled[lang_col].isNotNull()).select(labelled[lang_col].cast("string").alias("lang"), F.coalesce(labelled[text_col].cast("string"), F.lit("")).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect()}
    if len(sizes) > languages:
        raise ValueError(f"column {lang_col} has more than {languages} labels")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    parts = spark.createDataFrame([(lang, min(1.0, rows_per_language / n)) for lang, n in sizes.items()], "lang string, part double")
    within = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("part") * (1 << 20)
    sample = rows.join(F.broadcast(parts), "lang").where(within).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tally = tallies.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for grams in gram_buckets(text.as_py()):
                    tally += np.bincount(grams, minlength=BUCKETS)
        for lang, tally in tallies.items():
            seen = np.flatnonzero(tally)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(tally[seen])], ["lang", "bucket", "n"])

    found = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    # sums are rounded to float32 above 2**24 only
    chance = np.full((BUCKETS, len(languages)), SMOOTHING, np.float32 if len(languages) > 256 else np.float64)
    column = found["lang"].map({lang: k for k, lang in enumerate(languages)}).to_numpy(np.int64)
    chance[found["bucket"].to_numpy(np.int64), column] += found["n"].to_numpy(np.float64)
    chance /= chance.sum(0, dtype=np.float64)
    return Model(languages, chance.astype(np.float32, copy=False))


def held_out(doc_id: Column) -> Column:
    """Rows that the model never learns from: crc32 of the id as text, modulo 4, is 2; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, lang_pred and score, as ``Model.predict`` gives them."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"])

    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Fit on the labelled rows that aren't held out, predict all: its id, held_out, lang_pred, score.

    A null text, an empty one or one without a letter gets ``und`` and score 0, as does everything where
    no row has a label. Ties go to the first language by name. Repeated rows are predicted each; an
    empty table gives an empty result; columns other than id, text and label are not read.
    """
    learnt = docs.where(~held_out(docs[id_col]))
    model = fit(learnt, text_col, lang_col, rows_per_language)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(F.col(id_col))).select(id_col, "held_out", "lang_pred", "score")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in one learned language or a mixture of several, with all columns; only those that ``predict`` calls ``und`` go."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out(docs[id_col])), text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.value.predict(x.as_py())[0] != NO_LANGUAGE for x in batch.column(at)], pa.bool_()))

    # by place: a name may hold a dot
    places = [f"c{i}" for i in range(len(docs.columns))]
    schema = StructType([StructField(c, f.dataType, True) for c, f in zip(places, docs.schema, strict=True)])
    return docs.toDF(*places).mapInArrow(run, schema).toDF(*docs.columns)
