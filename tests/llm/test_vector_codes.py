import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n int, error string, code int"


def brute(rows, rounds=2):
    """rows: (vec_id, vector, label); the codes by comparing every part with every entry."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) and abs(math.floor(np.float32(x) * 256.0)) < vector_codes.LIMIT for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [np.float32(x) for x in r[1]]))
    if not kept:
        return [], None
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    full = -(-width // 16) * 16
    whole = [[math.floor(float(np.float32(x)) * 256) for x in v] + [0] * (full - width) for _, v, _ in kept]
    size = full // 16
    parts = [[tuple(v[p * size : (p + 1) * size]) for p in range(16)] for v in whole]
    books = [[x[p] for x in parts[:64]] for p in range(16)]

    def assigned(p, part):
        away = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p in range(16):
            held = [assigned(p, x[p])[0] for x in parts]
            for k in range(len(books[p])):
                own = [x[p] for x, h in zip(parts, held, strict=True) if h == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    out = []
    for (i, _, g), x in zip(kept, parts, strict=True):
        found = [assigned(p, x[p]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), g))
    by_label = {g: sum(r[2] for r in out if r[3] == g) for g in {r[3] for r in out}}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[g]) for i, c, e, g in out), key=str), digest


def check(spark, rows):
    got = vector_codes.vector_codes(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)).collect()
    want, digest = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} <= {digest}


def test_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(draw.normal(0, 0.05, 32))], int(draw.integers(0, 4)) or None) for i in range(300)]
    rows += [rows[0], rows[0], (5, rows[9][1], 1), (None, rows[1][1], None), (1000, None, 1), (1001, [None] + [0.0] * 31, 1), (1002, [float("nan")] + [0.0] * 31, 1), (1003, [float("inf")] + [0.0] * 31, None)]
    rows += [(1004, [0.0] * 16, 1), (1005, [], 1), (1006, [1e30] + [0.0] * 31, 1), (1007, [-65000.0] * 32, 1)]
    check(spark, rows)


@pytest.mark.parametrize("width,n", [(0, 3), (5, 4), (16, 1), (40, 70)])
def test_widths_and_few_rows(spark, width, n):
    draw = np.random.default_rng(width)
    check(spark, [(i, [float(x) for x in draw.integers(-2, 3, width) / 256], i % 2) for i in range(n)])


def test_empty(spark):
    for rows in ([], [(1, None, 2)]):
        got = vector_codes.vector_codes(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.integers(0, 120), st.sampled_from([1, 3, 40, 1 << 12, (1 << 24) - 1]), st.integers(0, 1 << 30))
def test_tree_finds_the_lowest_of_the_nearest(entries, length, n, size, seed):
    draw = np.random.default_rng(seed)
    book, rows = draw.integers(-size, size + 1, (entries, length)), draw.integers(-size, size + 1, (n, length))
    index, best = vector_codes.nearest_entries(book, vector_codes.ball_tree(book, leaf=3), rows)
    away = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (index == away.argmin(1)).all() and (best == away.min(1)).all()


def test_balls_hold_their_entries():
    book = np.random.default_rng(0).integers(-300, 300, (64, 4))

    def walk(ball):
        assert (np.sqrt(((book[ball.entries] - ball.centre) ** 2).sum(1)) <= ball.radius).all()
        assert not ball.parts or sorted(np.concatenate([x.entries for x in ball.parts])) == ball.entries.tolist()
        for x in ball.parts:
            walk(x)

    walk(vector_codes.ball_tree(book))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_vector_codes"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want and got[0].codebooks_sha256 == digest
