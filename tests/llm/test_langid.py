import random
import zlib

import numpy as np

from catalith.llm import langid

SCHEMA = "doc_id long, text string, lang string, id int, score string, bucket int, n int"
SOUNDS = {"aa": "abcdef", "bb": "mnopqé", "cc": "uvwxyz"}


def sentence(r, lang, words):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(2, 6))) for _ in range(words))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", 2, 3) for i, t, g in rows], SCHEMA)


def test_identify(spark):
    r = random.Random(2)
    rows = [(i, sentence(r, g, r.randint(5, 60)), g) for i in range(300) for g in [r.choice(list(SOUNDS))]]
    truth = {i: g for i, _, g in rows}
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 %% ½", "bb"), (1003, sentence(r, "cc", 20000), None), (None, "uvw xyz uvz", None), (5, rows[5][1], truth[5])]
    got = langid.identify(frame(spark, rows + extra)).collect()
    assert len(got) == len(rows) + len(extra)
    for x in got:
        assert 0 <= x.score <= 1
        if x.doc_id is None:
            assert x.held_out and x.lang_pred == "cc"
            continue
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
        if 1000 <= x.doc_id <= 1002:
            assert (x.lang_pred, x.score) == ("und", 0.0)
        else:
            assert x.lang_pred == truth.get(x.doc_id, "cc")


def test_labels_of_held_out_rows_are_not_learnt(spark):
    r = random.Random(3)
    rows = [(i, sentence(r, "aa" if i % 2 else "bb", 30), ("aa" if i % 2 else "bb")) for i in range(200)]
    spoiled = [(i, t, "cc" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows]
    assert langid.identify(frame(spark, rows)).collect() == langid.identify(frame(spark, spoiled)).collect()


def test_mixed_document_gives_both_shares(spark):
    r = random.Random(4)
    model = langid.fit(frame(spark, [(i, sentence(r, g, 60), g) for i, g in enumerate(list(SOUNDS) * 30)]), "text", "lang")
    lang, score = model.predict(sentence(r, "aa", 70) + " " + sentence(r, "cc", 30))
    assert lang == "aa" and 0.55 < score < 0.85
    assert model.predict(sentence(r, "bb", 40))[1] > 0.95


def test_em_never_lowers_the_likelihood(spark):
    r = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], r.dirichlet(np.ones(langid.BUCKETS), 3).T.astype(np.float32) + 1e-9)
    counts, chance = r.integers(1, 5, 300).astype(np.float32), model.chance[:300]
    found = [model.mixture(counts, chance, [0, 1, 2], n)[1] for n in range(1, 12)]
    assert all(b >= a - 1e-2 for a, b in zip(found, found[1:], strict=False))


def test_nothing_to_learn_or_to_predict(spark):
    assert {x.lang_pred for x in langid.identify(frame(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert langid.identify(frame(spark, [])).count() == 0


def test_evenly_mixed_documents_stay(spark):
    r = random.Random(5)
    learnt = [(i, sentence(r, g, 60), g) for i, g in enumerate(list(SOUNDS) * 30)]
    mixed = [(1000 + i, " ".join(sentence(r, g, 60) for g in SOUNDS), None) for i in range(5)]
    docs = frame(spark, [*learnt, *mixed, (2000, "12 %%", None)])
    shares = [x.score for x in langid.identify(docs).where("doc_id between 1000 and 1999").collect()]
    assert len(shares) == 5 and min(shares) < 0.4
    assert {x.doc_id for x in langid.identified(docs).collect()} == {i for i, *_ in learnt + mixed}


def test_mixture_against_brute_force(spark):
    """Every set of languages, with every mixture on a grid, by penalised likelihood."""
    r = random.Random(6)
    model = langid.fit(frame(spark, [(i, sentence(r, g, 60), g) for i, g in enumerate(list(SOUNDS) * 30)]), "text", "lang")
    grid = [k / 20 for k in range(21)]
    for _ in range(40):
        parts = {g: r.choice([0, 0, 20, 50]) for g in SOUNDS}
        text = " ".join(sentence(r, g, n) for g, n in parts.items()) + " " + sentence(r, "aa", 3)
        grams = np.concatenate(list(langid.gram_buckets(text)))
        best = {}
        for mix in [(a, b, round(1 - a - b, 9)) for a in grid for b in grid if a + b <= 1 + 1e-9]:
            members = sum(x > 0 for x in mix)
            value = float(np.log(model.chance[grams] @ np.array(mix)).sum()) - langid.PENALTY * np.log1p(len(grams)) * (members - 1)
            best[mix] = value
        mix = max(best, key=best.get)
        lang, score = model.predict(text)
        if sorted(mix)[-1] - sorted(mix)[-2] > 0.1:  # else the two may differ by the grid
            assert lang == model.languages[int(np.argmax(mix))]
            assert score <= max(mix) + 0.06


def test_score_grows_with_the_evidence(spark):
    r = random.Random(7)
    model = langid.fit(frame(spark, [(i, sentence(r, g, 60), g) for i, g in enumerate(list(SOUNDS) * 30)]), "text", "lang")
    text = sentence(r, "bb", 200)
    scores = [model.predict(text[:n])[1] for n in (2, 8, 40, 200)]
    assert scores == sorted(scores) and 0.5 <= scores[0] < scores[-1] <= 1


def test_every_label_is_learnt(spark):
    rows = [(i, sentence(random.Random(i), "aa", 20), g) for i, g in enumerate(["aa"] * 30 + ["bb"] * 20 + ["typo"] + [f"l{k}" for k in range(300)])]
    assert len(langid.fit(frame(spark, rows), "text", "lang").languages) == 303


def test_ties_go_to_the_first_name():
    model = langid.Model(["a", "b"], np.full((langid.BUCKETS, 2), 1 / langid.BUCKETS, np.float32))
    assert model.predict("some text") == ("a", 0.5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 100 and sum(x.lang == x.lang_pred for x in got) >= 0.98 * len(got)
