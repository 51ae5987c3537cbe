import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.llm.run_length_index import RunLengthIndex, seen_earlier

LETTERS = st.sampled_from([b"ab", b"a\0", b"\xff\xfe\0"])
TEXTS = LETTERS.flatmap(lambda letters: st.lists(st.lists(st.sampled_from(list(letters)), max_size=30).map(bytes), max_size=9))


def laid(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def longest(text, i, others):
    k = 0
    while i + k < len(text) and any(text[i : i + k + 1] in t for t in others):
        k += 1
    return k


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS, st.integers(1, 3))
def test_matching_statistics(indexed, streamed, cells):
    a, b = np.arange(len(indexed)) % cells, np.arange(len(streamed)) % cells
    got = RunLengthIndex(*laid(indexed), a).matching_statistics(*laid(streamed), b)
    assert got.tolist() == [longest(t, i, [x for x, c in zip(indexed, a, strict=True) if c == k]) for t, k in zip(streamed, b, strict=True) for i in range(len(t))]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 6), st.integers(1, 9))
def test_strings_of_earlier_texts(texts, length, group_size):
    group = np.arange(len(texts)) // group_size
    want = [i + length <= len(t) and any(t[i : i + length] in texts[j] for j in range(k) if group[j] == group[k]) for k, t in enumerate(texts) for i in range(len(t))]
    assert seen_earlier(*laid(texts), group, length).tolist() == want


def test_runs_of_a_repetitive_text_are_few():
    index = RunLengthIndex(*laid([b"abcdefgh" * 500]), np.zeros(1))
    assert len(index.start) < 20 and index.size.sum() == 4001
