"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table with the id counts of frequent pre-tokens: every vocabulary
entry that is a whole pre-token, with and without its leading blank, since a vocabulary learnt by
merging holds just the frequent ones. Its size depends on the vocabulary alone. Pre-tokens that it
lacks are encoded once in each worker's bounded cache. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from catalith.llm import pretokens
from catalith.llm.common import bounded_batches
from catalith.llm.vocabulary import JSON_VOCABULARY, PATTERN, RANKS, ranks, tokenizer_coder


def frequent_table(ranks_path: str = RANKS, json_path: str = JSON_VOCABULARY, bits: int = 18) -> pretokens.PieceTable:
    """Id counts of frequent pre-tokens, at most twice as many as the vocabulary has entries."""
    whole = regex.compile(PATTERN)
    forms = set()
    for token in ranks(ranks_path):
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        for form in (text, text[1:] if text[:1] == " " else " " + text):
            if form and len(form.encode()) <= pretokens.KEY_BYTES and whole.fullmatch(form) and whole.findall(form) == [form]:
                forms.add(form.encode())
    pieces = sorted(forms)
    counts = np.array([len(x) for x in tokenizer_coder(json_path, ranks_path).encode_pieces(pieces)], np.int32)
    table = pretokens.PieceTable(bits)
    table.add(*pretokens.pieces_as_words(pieces), counts)
    return table


def count_column(column: pa.Array, frequent: pretokens.PieceTable, coder: pretokens.PieceCoder) -> np.ndarray:
    """Number of ids of each text of an Arrow column; a null text has none."""
    out = np.zeros(len(column), np.int64)
    for _, _, padded, bounds, owner in pretokens.blocks(column):
        start, slow = coder._split(padded, bounds)
        size = np.diff(np.append(start, bounds[-1]))
        ends = np.zeros(len(start) + 1, np.int64)
        for k in range(0, len(start), pretokens.PART):
            s, n = start[k : k + pretokens.PART], size[k : k + pretokens.PART]
            got = np.full(len(s), -1, np.int32)
            short = np.flatnonzero(n <= pretokens.KEY_BYTES)
            got[short] = frequent.find(pretokens.piece_words(padded, s[short], n[short]), n[short].astype(np.uint8))
            if (lack := np.flatnonzero(got < 0)).size:
                entry = coder.entries_of(padded, s[lack], n[lack])
                got[lack] = coder.count[entry]
            ends[k + 1 : k + len(s) + 1] = ends[k] + np.cumsum(got)
        at = np.searchsorted(start, bounds)
        per = ends[at[1:]] - ends[at[:-1]]
        for k in np.flatnonzero(slow).tolist():
            per[k] = len(coder.encode_text(padded[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "replace")))
        np.add.at(out, owner, per)
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, json_path: str = JSON_VOCABULARY, ranks_path: str = RANKS) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each, a null id stays
    null, an empty table gives an empty result; other columns of ``docs`` are neither read nor
    returned. A very long text is counted in blocks of bounded size.
    """
    bounded_batches(docs.sparkSession)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_table(ranks_path, json_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_coder(json_path, ranks_path)
        for batch in batches:
            n = count_column(batch.column(1), frequent.value, coder)
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    out = narrow.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
