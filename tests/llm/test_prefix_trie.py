import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from catalith.llm import common, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, conv int, digest string, pos int, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, x = (role or "").encode(), (text or "").encode()
            conv[c].append(((turn is not None, turn or 0), hashlib.sha256(b"%d:" % len(r) + r + x).digest(), (r, x)))
    original = {c: [y for _, _, y in sorted(v)] for c, v in conv.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = original.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
        ends = ",".join(str(c) for c in sorted(members[k]) if len(rebuilt[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    got = prefix_trie.trie(spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA), **options)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("block", [2, 64])
def test_brute_force(spark, block):
    r = random.Random(block)
    texts = ["", "a", "b", "ä€", None]
    rows = []
    for c in [*range(-7, 30), 1000003, 1 << 60]:
        for turn in range(r.choice([1, 2, 5, 9, 14])):
            rows.append((c, r.choice([turn, turn, None, 3]), r.choice(["user", None, ""]), r.choice(texts)))
    rows += [(None, 1, "user", "a"), (None, None, None, None), rows[0], rows[0], rows[5]]
    r.shuffle(rows)
    check(spark, rows, block=block)


def test_long_conversations_of_equal_texts(spark):
    """Two long copies, one with another end, and short ones that leave them at every depth."""
    rows = [(c, t, "u", f"w{t % 7}") for c in (1000, 2000) for t in range(150)] + [(3000, t, "u", f"w{t % 7}" if t < 149 else "z") for t in range(150)]
    rows += [(10 * c, t, "u", f"w{t % 7}") for c in range(1, 30) for t in range(c)]
    check(spark, rows, block=4)


def test_many_equal_conversations(spark, monkeypatch):
    """Ends of one node go through more than one text and task."""
    monkeypatch.setattr(prefix_trie, "_CHUNK", 7)
    check(spark, [(c, t, "u", "same") for c in range(0, 2000, 5) for t in range(2)] + [(1, 0, "u", "other")])


def test_turnless_and_empty(spark):
    """Conversation 7 borrows from one that is absent and has fewer turns than it skips."""
    assert zlib.crc32(b"7") % 9 > 1
    check(spark, [(7, 0, "u", "a")])
    check(spark, [])
    check(spark, [(None, 0, "u", "a")])


def test_looked_up_is_a_left_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(900)] + [(2, 1), (3, 1), (None, 5)], "k int, v int")
    table = spark.createDataFrame([(1, "hot", 900), (2, "cold", 1)], "k int, name string, n long")
    got = {(r.k, r.name): r.n for r in common.looked_up(rows, table, ["k"], "n", 903).groupBy("k", "name").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "hot"): 900, (2, "cold"): 1, (3, None): 1, (None, None): 1}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_prefix_trie"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
