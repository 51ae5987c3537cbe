"""Quality rules with host verdicts.

Each document is judged by rules on its words and lines. Failures are counted by host; a host's rate is
shrunk towards the rate of all hosts with a beta prior whose strength the data give (method of
moments), so a few bad pages don't condemn a small host. Documents of condemned hosts go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import attach, bounded_batches, stored

WHITE_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A host of which more than this share fails, after shrinking, is condemned.
HOST_LIMIT = 0.5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of five that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    span = len(known)
    key, width = ids[:n].copy(), span
    for k in range(1, WINDOW):
        if width > (1 << 62) // span:  # the numbers would grow too large: number what there is anew
            values, key = np.unique(key, return_inverse=True)
            width = len(values)
        key = key * span + ids[k : k + n]
        width *= span
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not twice.size:
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(key, twice))
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def text_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text has none."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, WHITE_SPACE))
    lines = [x for x in text.split("\n") if x.strip(WHITE_SPACE)] if "\n" in text else []
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row per document: its id, host, the features and base_failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(x.as_py()) for x in batch.column(2)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "host", *FEATURES])

    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[host_col].cast("string").alias("host"), docs[text_col].cast("string").alias("text"))
    out = narrow.mapInArrow(run, "id long, host string, " + ", ".join(f"{f} long" for f in FEATURES))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(hosts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """From host, n, failed: the shrunk rate and host_rejected.

    The prior's mean m is the rate over all documents. Its strength s makes the variance of the hosts'
    rates, weighted by documents, what a beta distribution with binomial draws would have; without
    excess variance, all hosts get the common rate.
    """
    sums = hosts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("docs"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("bad"),
        F.count("*").alias("hosts"),
        F.coalesce(F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")), F.lit(0.0)).alias("square"),
        F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)).alias("n_square"),
    ).first()
    docs, mean = max(sums.docs, 1), sums.bad / max(sums.docs, 1)
    between = sums.square - docs * mean * mean
    noise = mean * (1 - mean)
    scale = docs - sums.n_square / docs
    variance = (between - (sums.hosts - 1) * noise) / scale if scale > 0 else 0.0
    if noise <= 0 or variance <= 0:
        rate = F.lit(mean)
    else:
        strength = max(noise / variance - 1, 0.0)
        rate = (F.col("failed") + strength * mean) / (F.col("n") + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > limit)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: its id, the features, base_failed, host_rate, kept.

    A null or empty text has no words and fails; a null host is a host of its own; repeated rows count
    each; null ids stay null; an empty table gives an empty result; other columns are not read.
    """
    rows = document_features(docs, id_col, text_col, host_col).withColumn("host", F.coalesce(F.concat(F.lit("="), "host"), F.lit("")))
    rows = stored(rows, "quality")
    hosts = stored(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    verdicts = host_verdicts(hosts)
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = attach(rows, verdicts, ["host"], "n", total)
    return joined.select(F.col("id").alias(id_col), *FEATURES, "base_failed", "host_rate", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM words),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, i, i + 4), ' ')) AS n FROM starts),
hit AS (SELECT DISTINCT doc_id, i + k AS i FROM grams, unnest(range(0, 5)) AS x(k) WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM hit GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, host, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN words USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
hosts AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS bad FROM j GROUP BY host),
sums AS (SELECT sum(n) AS docs, sum(bad) / sum(n) AS mean, count(*) AS hosts, sum(bad * bad / n) AS square, sum(n * n) AS n_square FROM hosts),
spread AS (SELECT *, mean * (1 - mean) AS noise, CASE WHEN docs - n_square / docs > 0 THEN (square - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / (docs - n_square / docs) ELSE 0 END AS variance FROM sums),
verdict AS (SELECT host, CASE WHEN noise <= 0 OR variance <= 0 THEN mean ELSE (bad + greatest(noise / variance - 1, 0) * mean) / (n + greatest(noise / variance - 1, 0)) END > 0.5 AS rejected FROM hosts, spread)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM j JOIN verdict USING (host)
"""
