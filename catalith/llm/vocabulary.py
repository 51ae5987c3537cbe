"""Coders over public vocabulary files, one of each kind in a worker process."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from catalith.llm.pretokens import PieceCoder

JSON_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@functools.cache
def ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def _library(path: str) -> Tokenizer:
    """Loaded when the first text needs it."""
    return Tokenizer.from_file(path)


@functools.cache
def tokenizer_coder(path: str = JSON_VOCABULARY, ranks_path: str = RANKS) -> PieceCoder:
    """Ids as tokenizers gives them with default handling of special strings.

    Unseen pieces go to tiktoken over the same vocabulary, which is several times faster; whole
    texts with a special string or characters outside the byte tables go to the library itself.
    """
    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    if len(special) != 1:
        raise ValueError("one added token is expected in the vocabulary")
    encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks(ranks_path), special_tokens={})
    one = encoding._core_bpe.encode_single_piece
    return PieceCoder(lambda pieces: [one(p) for p in pieces], lambda text: _library(path).encode(text, add_special_tokens=False).ids, special[0].encode())


def split_ids(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return np.split(ids, ends[:-1]) if len(ends) else []
