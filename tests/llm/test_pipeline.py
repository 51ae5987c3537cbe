"""The whole pipeline against plain loops over a small fixture."""

import collections
import random
import zlib

import numpy as np
from test_dedup_quality_packing import brute_fingerprint, classes
from tokenizers import Tokenizer

import corpus_pipeline
from catalith.llm import exact_dedup, langid, simhash, suffix_dedup, vocabulary


def fixture(seed=8):
    r = random.Random(seed)
    sounds = {"aa": "abcdef", "bb": "mnopqé"}

    def prose(lang, n):
        return " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(2, 7))) for _ in range(n))

    passage = prose("bb", 40)
    rows = []
    for i in range(90):
        lang = r.choice(list(sounds))
        kind = r.random()
        if kind < 0.2 and rows:
            text = r.choice(rows)[1] or ""
            text = text.replace(" ", "  ", 3) if r.random() < 0.5 else text + " abc"
        elif kind < 0.3:
            text = r.choice([None, "", "12 34 %%", "\n"])
        else:
            text = prose(lang, r.randint(3, 400)) + (" " + passage if kind > 0.7 else "")
        rows.append((i * 3, text, lang if r.random() < 0.9 else None, "src", len(text or "")))
    return rows


def cut(texts):
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        covered = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                covered[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        out.append(bytes(x for x, c in zip(b, covered, strict=True) if not c).decode("utf-8", "ignore"))
    return out


def test_against_brute_force(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [(i, t) for i, t, *_ in rows if t and langid._LETTER.search(t)]  # the languages are far apart, so none has a low score
    best = {}
    for i, t in left:
        key = "".join(t.split())
        if key not in best or len(t) > len(best[key][1]):
            best[key] = (i, t)
    left = sorted(best.values())
    root = classes([brute_fingerprint(t) for _, t in left])
    left = [x for k, x in enumerate(left) if root[k] == k]
    texts = dict(zip([i for i, _ in left], cut([t for _, t in left]), strict=True))
    assert 30 < len(texts) < 75
    library = Tokenizer.from_file(vocabulary.JSON_VOCABULARY)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(ids)
    for i, parts in pieces.items():
        at = 0
        for start, length, crc in sorted(parts):
            assert start == at and crc == zlib.crc32(np.array(ids[i][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[i])


def test_stages_return_documents(spark):
    docs = spark.createDataFrame(fixture(9), "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_null_and_repeated_ids(spark):
    r = random.Random(11)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[2]), (5, texts[3]), (None, texts[3]), (7, texts[4]), (7, texts[4] + "  "), (None, None), (1, texts[5])]
    want = sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4] + "  "), (None, None), (1, texts[5])], key=str)
    docs = spark.createDataFrame([(i, t, "aa", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = exact_dedup.deduplicated(docs)
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == want
    near = simhash.deduplicated(docs)
    assert sorted(((x.doc_id, (x.text or "").strip()) for x in near.collect()), key=str) == sorted([(i, (t or "").strip()) for i, t in want], key=str)
    cut_rows = sorted(((x.doc_id, x.text) for x in suffix_dedup.cut(docs).collect()), key=str)
    assert len(cut_rows) == len(rows)
    assert collections.Counter(i for i, _ in cut_rows) == collections.Counter(i for i, _ in rows)
    assert sorted((x.doc_id, x.text) for x in suffix_dedup.cut(docs.where("doc_id = 5")).collect()) == sorted(x for x in rows if x[0] == 5)
