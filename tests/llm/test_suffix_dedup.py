import hashlib
import random

import pytest

from catalith.llm import suffix_dedup

SCHEMA = "doc_id long, text string, id int, n string, start int, anchor int, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in rows], SCHEMA)


def brute(texts):
    """By id order: (n_bytes, n_removed, n_spans, sha256 of what is left)."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                covered[i : i + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        out.append((len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return out


def corpus(seed, n=160):
    r = random.Random(seed)
    words = ["the", "of", "über", "naïve", "x", "station", "and"]

    def prose(k):
        return " ".join(r.choice(words) + str(r.randint(0, 99) if r.random() < 0.6 else "") for _ in range(k))

    passages = [prose(r.randint(12, 80)) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.3 and out:
            t = list(r.choice(out) or "ab")
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = r.choice(["Q", "é", ""])
            out.append("".join(t))
        elif kind < 0.7:
            out.append(prose(r.randint(0, 30)) + r.choice(passages)[r.randint(0, 5) :] + prose(r.randint(0, 30)) + r.choice(passages))
        else:
            out.append(prose(r.randint(0, 60)))
    return [*out, None, "", "a" * 99, "a" * 100, "a" * 350, "ab" * 200, "a" * 150 + "b" + "a" * 150]


@pytest.mark.parametrize(("seed", "group_spans"), [(1, 1024), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, group_spans):
    texts = corpus(seed)
    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    got = sorted(tuple(r) for r in with_digest(suffix_dedup.without_repeats(frame(spark, rows).repartition(5), group_spans=group_spans)))
    assert got == [(i, *x) for i, x in enumerate(brute(texts))]
    assert sum(x[2] for x in got) > 1000


def with_digest(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()]


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 500)
    texts = corpus(3, 30)
    joined = ["".join(t or "" for t in texts[:20]), *texts[20:], "".join(t or "" for t in texts[:20])]
    pieces = list(suffix_dedup._text_pieces(iter([suffix_dedup.pa.RecordBatch.from_arrays([suffix_dedup.pa.array(range(len(joined))), suffix_dedup.pa.array([0] * len(joined)), suffix_dedup.pa.array([t and t.encode() for t in joined], suffix_dedup.pa.binary())], ["id", "twin", "text"])])))
    starts = {}
    for part in pieces:
        for i, _, at, data in part:
            for k in range(len(data) - 99):
                assert at + k not in starts.setdefault(i, set())
                starts[i].add(at + k)
                assert joined[i].encode()[at + k : at + k + 100] == data[k : k + 100]
    assert all(len(starts.get(i, ())) == max(len((t or "").encode()) - 99, 0) for i, t in enumerate(joined))


def test_span_streams_in_small_batches():
    r = random.Random(4)
    rows = sorted((r.randint(0, 12), r.randint(0, 2), r.randint(0, 3), 0, r.randint(0, 5), 7) for _ in range(150))
    first, spans, want = set(), {}, []
    for a, s, *_ in rows:
        spans.setdefault(a, set()).add(s)
    done = set()
    for row in rows:
        if (row[0], row[1]) in first:
            if row[:5] not in done:
                want.append((*row[:5], -7))
        else:
            first.add((row[0], row[1]))
            if len(spans[row[0]]) > 1:
                want.append(row)
        done.add(row[:5])
    for size in (1, 2, 7, 150):
        import numpy as np

        parts = [suffix_dedup._rows(*(np.array(c, np.int64) for c in zip(*rows[k : k + size], strict=True))) for k in range(0, 150, size)]
        got = [tuple(x.values()) for b in suffix_dedup._judge_spans(iter(parts)) for x in b.to_pylist()]
        assert sorted(set(got)) == sorted(set(want)), size


def test_odd_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long), (7, long), (7, long), (3, long[:150]), (7, "other " + long), (None, None)]
    got = with_digest(suffix_dedup.without_repeats(frame(spark, rows)))
    assert len(got) == 6
    by = {}
    for i, n, removed, *_ in got:
        by.setdefault((i, n), set()).add(removed)
    assert by[3, 150] == {0} and by[None, len(long)] == {len(long)} and by[None, 0] == {0}
    assert len(by[7, len(long)]) == 1  # repeated rows lose the same
    assert suffix_dedup.without_repeats(frame(spark, [])).count() == 0
