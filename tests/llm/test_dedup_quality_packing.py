import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalith.llm import common, exact_dedup, packing, quality, simhash, vocabulary
from catalith.llm.components import components

SCHEMA = "doc_id long, text string, source string, n int, content string, host string, fp int, rank int"
WORDS = ["the", "of", "and", "Zebra", "É", "quick", "#x"]


def frame(spark, texts, ids=None, hosts=None):
    rows = [(ids[i] if ids else i, t, hosts[i] if hosts else "h", 1, "c", "h", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def some_texts(seed, n):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 40))) for _ in range(n // 2)]
    return base + [r.choice(base).replace(" ", r.choice([" ", "  ", "\n", " "])) for _ in range(n // 4)] + [None, "", " \n", "same"] * (n // 16)


@pytest.mark.parametrize("share", [1, 256])
def test_exact_duplicates(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    texts = some_texts(3, 200)
    want = collections.defaultdict(list)
    for i, t in enumerate(texts):
        want[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for content, members in want.items():
        keep = min(members, key=lambda i: (-len(texts[i] or ""), i))
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(members), i == keep)
            assert got[i].text_sha256 == hashlib.sha256(content.encode()).hexdigest()
    assert exact_dedup.deduplicated(frame(spark, texts)).count() == len(want)


def test_exact_duplicates_odd_ids(spark):
    got = exact_dedup.exact_duplicates(frame(spark, ["a", "a ", "b", "c", "c"], [None, -5, None, 7, 7])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 99, r.keep_id, r.kept) for r in got if r.keep_id is not None) == [(-5, -5, True), (7, 7, True), (7, 7, True), (99, -5, False)]
    assert [r.kept for r in got if r.keep_id is None] == [True]
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_exact_dedup_plan_is_native(spark):
    plan = exact_dedup.duplicate_groups(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Python" not in plan


def brute_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    earlier, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab #\n\t é")), max_size=120))
def test_text_features(text):
    assert quality.text_features(text) == brute_features(text)


def test_features_of_many_words():
    r = random.Random(1)
    words = [f"w{r.randint(0, 9000)}" for _ in range(20000)]
    text = " ".join(words + words[50:90])
    assert quality.text_features(text) == brute_features(text)


def test_host_verdicts(spark):
    texts, hosts = [], []
    for h in range(6):
        for k in range(40):
            bad = h == 0 or k % 10 == 0
            texts.append("x" if bad else " ".join(f"w{h}{k}{j}" for j in range(20)))
            hosts.append(f"host{h}")
    texts += ["x", None]
    hosts += ["tiny", None]
    rows = quality.quality_verdicts(frame(spark, texts, hosts=hosts)).collect()
    rates = {hosts[r.doc_id]: r.host_rate for r in rows}
    assert rates["host0"] > 0.9 and abs(rates["host1"] - 0.1) < 0.05 and 0.1 < rates["tiny"] < 1
    assert len(rows) == len(texts)
    for r in rows:
        assert r.kept == (not brute_fails(texts[r.doc_id]) and hosts[r.doc_id] != "host0")
    assert quality.quality_verdicts(frame(spark, [])).count() == 0


def brute_fails(text):
    n, *_, repeated = brute_features(text)
    return n < 10 or 100 * repeated > 20 * n


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, radius=2):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_near_forest():
    r = random.Random(5)
    values = list({c ^ sum(1 << r.randrange(64) for _ in range(k)) & (1 << 64) - 1 for c in [r.getrandbits(64) for _ in range(20)] for k in (0, 1, 1, 2, 2, 3, 4, 5) for _ in range(4)})
    got = simhash.near_forest(np.array(values, np.uint64))
    root = list(range(len(values)))
    for a, b in got:
        assert (values[a] ^ values[b]).bit_count() <= 2
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if x == old else x for x in root]
    assert root == classes(values)
    assert len(got) == len(values) - len(set(root))


@pytest.mark.parametrize("bucket_rows", [4096, 5])
def test_links_with_small_and_split_buckets(spark, bucket_rows):
    r = random.Random(6)
    centre = r.getrandbits(64)
    values = sorted({centre ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 4))}) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)} | {0})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = common.stored(spark.createDataFrame([(v,) for v in signed], "fp long"), "t")
    got = components(simhash.fingerprint_links(distinct, bucket_rows), "a", "b").collect()
    want = collections.defaultdict(set)
    for v, c in zip(signed, classes(values), strict=True):
        want[c].add(v)
    have = collections.defaultdict(set)
    for x in got:
        have[x.root].add(x.node)
    assert sorted(map(sorted, have.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)
    assert all(k == min(s) for k, s in have.items())


def test_near_duplicates(spark):
    texts = some_texts(9, 120) + ["", "word", "WORD", "two words"]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    values = [brute_fingerprint(t) for t in texts]
    for i, (v, c) in enumerate(zip(values, classes(values), strict=True)):
        assert (got[i].fingerprint, got[i].component_id) == (f"{v:016x}", c)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long").select(F.col("a"), F.col("b")), "a", "b").collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 300)}


def test_packing(spark):
    library = Tokenizer.from_file(vocabulary.JSON_VOCABULARY)
    texts = [None, "", "one two", " word" * 5000, "<|endoftext|>", *(f"text {i} " * (i * 7 % 400) for i in range(150))]
    rows = packing.pack(frame(spark, texts).repartition(5)).collect()
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, tokens in enumerate(ids):
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(tokens)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.08 * sum(map(len, ids)) / 1024 + 1
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_keeps_padding_small(seed):
    r = np.random.default_rng(seed)
    histogram = np.bincount(r.integers(1, 1025, 20000), minlength=1025)
    p = packing.plan(histogram)
    assert p.sequences * 1024 <= 1.02 * (histogram * np.arange(1025)).sum()
