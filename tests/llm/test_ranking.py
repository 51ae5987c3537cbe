import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from catalith.llm import queries, ranking

DOCS = "doc_id long, text string, id int, features string, label int, score string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "sun") for b in ("da", "ri", "vo", "nel", "sh")]


def good(r):
    return ". ".join(" ".join(r.choice(WORDS) for _ in range(r.randint(5, 12))).capitalize() for _ in range(r.randint(1, 6))) + "."


def bad(r):
    kind = r.randrange(3)
    if kind == 0:
        return " ".join(w + r.choice(["###", "%%%", "$$$"]) for w in good(r).split())
    if kind == 1:
        return good(r).upper().replace(" ", "!! ")
    return " ".join(w for x in good(r).split() for w in [x] * 6)


def frames(spark, n=400):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        q = int(r.random() < 0.7)
        rows.append((i, good(r) if q else bad(r), 1, "x", 2, "y"))
        labels.append((i, q, "z"))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = frames(spark)
    odd = [(900, None, 1, "x", 2, "y"), (901, "", 1, "x", 2, "y"), (902, " \n\t ", 1, "x", 2, "y"), (None, rows[0][1], 1, "x", 2, "y"), (3, rows[3][1], 1, "x", 2, "y"), (903, "word " * 60000, 1, "x", 2, "y")]
    extra = [(None, 1, "z"), (1, None, "z"), (2, 7, "z"), (99999, 1, "z"), labels[4], labels[4]]
    docs, marks = spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels + extra, "doc_id long, quality int, text string")
    got = ranking.quality_scores(docs, marks).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: q for i, q, _ in labels}
    right = []
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
        assert x.held_out == (x.doc_id is None or zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
        if x.held_out and x.doc_id in truth:
            right.append(x.predicted == truth[x.doc_id])
    assert np.mean(right) > 0.95
    assert len({x.score for x in got if x.doc_id in (900, 901, 902)}) == 1
    assert [x.score for x in got if x.doc_id is None] == [x.score for x in got if x.doc_id == 0]
    assert next(x for x in got if x.doc_id == 903).predicted == 0


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = frames(spark, 200)
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    flipped = [(i, 1 - q if i in held else q, z) for i, q, z in labels]
    docs = spark.createDataFrame(rows, DOCS)
    a, b = (sorted(ranking.quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int, text string")).collect()) for x in (labels, flipped))
    assert a == b


def test_one_class_none_and_empty(spark):
    rows, _ = frames(spark, 8)
    docs = spark.createDataFrame(rows, DOCS)
    schema = "doc_id long, quality int, text string"
    learnt = [i for i in range(8) if zlib.crc32(str(i).encode()) % 4 != 2]
    for labels, score, predicted in (([(i, 1, "") for i in learnt], 1.0, 1), ([(i, 0, "") for i in learnt], 0.0, 0), ([], 0.5, 0)):
        got = ranking.quality_scores(docs, spark.createDataFrame(labels, schema)).collect()
        assert {(x.score, x.predicted) for x in got} == {(score, predicted)}
    assert ranking.quality_scores(docs.limit(0), spark.createDataFrame([], schema)).collect() == []


def test_sample_is_bounded(spark):
    rows, labels = frames(spark)
    features = ranking.document_features(spark.createDataFrame(rows, DOCS))
    found = ranking.fit(features, spark.createDataFrame(labels, "doc_id long, quality int, text string"), rows_per_class=30)
    assert found.constant is None and np.isfinite(found.weights).all()


def test_pair_weights_order_and_cut():
    draw = np.random.default_rng(1)
    a, b = draw.normal([1, 0], 1, (500, 2)), draw.normal([-1, 0], 1, (500, 2))
    w = ranking.pair_weights(a, b)
    assert w[0] > 1 and abs(w[1]) < 0.2
    # gradient of the penalised likelihood over all drawn pairs vanishes
    again = ranking.pair_weights(a, b, steps=2000)
    assert np.allclose(w, again, atol=1e-3)
    assert ranking.weighted_cut(np.array([3.0, 1.0, 2.0, 4.0]), np.ones(4), 0.5) == 2.5
    assert ranking.weighted_cut(np.array([3.0, 1.0]), np.array([3.0, 1.0]), 0.25) == 2.0


def test_all_learnt_rows_set_the_cut(spark):
    # more rows of each class than any sample; the first feature is a noisy label
    noise = (F.pmod(F.xxhash64("id"), F.lit(1000003)) / 1000003).cast("float")
    marked = spark.range(30000).withColumn("quality", (F.col("id") % 3 > 0).cast("int"))
    rest = [F.lit(0.0).cast("float")] * (len(ranking.FEATURES) - 1)
    features = marked.select("id", F.array(F.col("quality") * F.lit(0.5).cast("float") + noise, *rest).alias("features"))
    found = ranking.fit(features, marked.withColumnRenamed("id", "doc_id"))
    learnt = [r for r in features.join(marked, "id").collect() if zlib.crc32(str(r.id).encode()) % 4 != 2]
    x = np.array([r.features for r in learnt], np.float64)
    # as many learnt rows lie above the cut as are good
    assert int((found.score(x) >= ranking.THRESHOLD).sum()) == sum(r.quality for r in learnt)
    y = (x - found.centre) / found.spread
    good = np.array([r.quality == 1 for r in learnt])
    assert abs(found.weights[0] - ranking.pair_weights(y[good][:3000], y[~good][:3000])[0]) < 0.2 and np.allclose(found.centre, x.mean(0), atol=1e-6)


def test_features_of_parts():
    whole = dict(zip(ranking.FEATURES, ranking.text_features("AB cd!! cd!! x9\nAB cd!! cd!! x9"), strict=True))
    assert whole["repeated_lines"] == 0.5 and np.isclose(whole["upper_of_letters"], 4 / 14) and np.isclose(whole["repeated_next"], 2 / 8)
    long = "Some plain words here. " * 30000
    assert np.allclose(ranking.text_features(long)[:10], ranking.text_features(long[: 23 * 1000])[:10], atol=1e-3)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_quality_ranking"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    share = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert share > 0.97
