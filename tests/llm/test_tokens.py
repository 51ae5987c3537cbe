import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from catalith.llm import byte_bpe, pretokens, token_counts, token_files, vocabulary
from catalith.llm.common import fresh_path

LIBRARY = Tokenizer.from_file(vocabulary.JSON_VOCABULARY)
TIKTOKEN = tiktoken.Encoding("t", pat_str=vocabulary.PATTERN, mergeable_ranks=vocabulary.ranks(), special_tokens={})
ODD = [None, "", " ", "  a", "a  ", "it's we'll 'S '' 's", "x<|endoftext|>y <|endoftext|>", "日本語 text", "naïve café ½ a b   c", "a\x85b\x1cc", "\n\n x\t\ty", "😀😀 ok", "%" * 100, "a" * 5000, " word" * 30000]
SCHEMA = "doc_id long, text string, ids int, id int, part int, n_tokens string, start int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4) for i, t in enumerate(texts)], SCHEMA)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def flat(coder, texts):
    out = []
    for _, _, ids, ends in coder.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in vocabulary.split_ids(ids, ends)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abst'mdlrve  \n\t.,!12é—ßÀ½ 中")), max_size=30), max_size=20))
def test_array_splitting_gives_the_library_ids(texts):
    assert flat(vocabulary.tokenizer_coder(), texts) == [library_ids(t) for t in texts]


SCRIPTS = {
    "cyrillic": [*range(0x410, 0x450), 32, 32, 46],
    "greek": [*range(0x391, 0x3A2), *range(0x3A3, 0x3CA), 32, 10],
    "hebrew and arabic": [*range(0x5D0, 0x5EB), *range(0x621, 0x63B), *range(0x640, 0x66A), 32],
    "devanagari": [*range(0x905, 0x970), 32],
    "east asian": [*range(0x4E00, 0x4F00), *range(0x3041, 0x3097), 0x3000, 0x3002, 32, 97],
    "emoji": [0x1F600, 0x1F60D, 0x2764, 0xFE0F, 0x200D, 32, 97],
    "wide white space": [32, 0xA0, 0x2003, 0x2028, 0x3000, 10, 97, 0x5D0, 39, 115],
    "letters of later versions": [0x378, 0x8A0, 0x1C80, 0x31350, 32, 97],
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_other_scripts_give_the_library_ids(script):
    r = random.Random(script)
    texts = ["".join(chr(r.choice(SCRIPTS[script])) for _ in range(r.randint(0, 60))) for _ in range(300)]
    assert flat(vocabulary.tokenizer_coder(), texts) == [library_ids(t) for t in texts]
    assert flat(byte_bpe._column_coder(vocabulary.RANKS), texts) == [TIKTOKEN.encode_ordinary(t) for t in texts]
    frequent = token_counts.frequent_table()
    assert token_counts.count_column(pa.array(texts), frequent, vocabulary.tokenizer_coder()).tolist() == [len(library_ids(t)) for t in texts]


def test_other_scripts_are_split_by_arrays():
    for script, points in SCRIPTS.items():
        data = "".join(map(chr, points)).encode()
        _, slow = pretokens.piece_starts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert slow.any() == (script == "letters of later versions")


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(pretokens.PieceCoder, "CACHE_BYTES", 2000)
    monkeypatch.setattr(pretokens, "PART", 16)
    coder = pretokens.PieceCoder(lambda ps: [TIKTOKEN._core_bpe.encode_single_piece(p) for p in ps], TIKTOKEN.encode_ordinary)
    texts = [" ".join("long" * 10 + chr(97 + i % 26) * (i % 7) for i in range(k, k + 40)) for k in range(40)]
    assert flat(coder, texts) == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert coder.long_bytes < 8000


def test_long_piece():
    piece = "".join(random.Random(8).choice("abcdefghij") for _ in range(40_000))
    assert byte_bpe.prefix_coder().encode_piece(piece.encode()) == TIKTOKEN.encode_ordinary(piece)


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(pretokens, "BLOCK_BYTES", 100)
    monkeypatch.setattr(pretokens, "PART", 64)
    texts = ["some words 12, and the \n\n rest of it's " * 100, "ü" * 999, None]
    assert flat(vocabulary.tokenizer_coder(), texts) == [library_ids(t) for t in texts]


def test_full_cache_starts_again():
    coder = pretokens.PieceCoder(lambda ps: [TIKTOKEN._core_bpe.encode_single_piece(p) for p in ps], TIKTOKEN.encode_ordinary, bits=8)
    old, pretokens.PART = pretokens.PART, 50
    try:
        texts = [" ".join(f"w{random.Random(i).random()}" for i in range(k, k + 200)) for k in range(5)]
        assert flat(coder, texts) == [TIKTOKEN.encode_ordinary(t) for t in texts]
    finally:
        pretokens.PART = old


def test_counts_and_edge_cases(spark):
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        n = len(library_ids(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_round_trip(spark):
    got = {r.doc_id: r for r in byte_bpe.round_trip_digest(frame(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        ids = TIKTOKEN.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip_digest(frame(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=25))
def test_prefix_tables_agree_with_merging(data):
    coder = byte_bpe.prefix_coder()
    assert byte_bpe.PrefixTable(coder, data).ids() == coder.merged(data)


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from(list("the an's 12'l\n.")), max_size=60), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 9), st.text(st.sampled_from(list("ol's \n9")), max_size=6)), max_size=6))
def test_edits_match_encoding_anew(text, edits):
    coder = byte_bpe.prefix_coder()
    encoded, table = byte_bpe.EncodedText(coder, text), byte_bpe.PrefixTable(coder, text.encode())
    for at, removed, inserted in edits:
        at = min(at, len(text))
        removed = min(removed, len(text) - at)
        text = text[:at] + inserted + text[at + removed :]
        encoded.edit(at, removed, inserted)
        table.edit(at, removed, inserted.encode())
        assert encoded.text == text
        assert encoded.ids() == TIKTOKEN.encode_ordinary(text)
        assert table.ids() == coder.merged(text.encode())


def test_edit_stops_early():
    coder = byte_bpe.PrefixCoder({bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257})
    table = byte_bpe.PrefixTable(coder, b"ab" * 500)
    assert table.edit(4, 4, b"wxyz") < 20
    assert table.ids() == coder.merged(b"abab" + b"wxyz" + b"ab" * 496)


def test_token_files(spark):
    path = fresh_path(spark, "test")
    texts = ODD * 3
    token_files.write_token_files(frame(spark, texts).repartition(7), path)
    rows = sorted(token_files.file_digest(spark, path).collect())
    start = 0
    for i, t in enumerate(texts):
        ids = [*library_ids(t), 2]
        assert tuple(rows[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    meta = {r.doc_id: (r.start, r.n_tokens) for r in token_files.read_metadata(spark, path).collect()}
    assert meta == {r.doc_id: (r.start, r.n_tokens) for r in rows}
    assert [r.ids for r in token_files.read_tokens(spark, path, [5]).collect()] == [[*library_ids(texts[5]), 2]]
    plan = spark.read.parquet(path).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def test_token_files_of_empty_table(spark):
    path = fresh_path(spark, "test")
    token_files.write_token_files(frame(spark, []), path)
    assert token_files.file_digest(spark, path).count() == 0
