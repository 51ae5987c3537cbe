import random

from pyspark.sql import functions as F

from catalith.operators import profile


def test_batches_combined_are_close_to_the_whole(spark):
    r = random.Random(2)
    rows = [(r.gauss(0, 1) if i % 5 else None, r.randint(0, 300), r.choice("abc"), i % 2 == 0, float("nan") if i == 7 else 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "x double, k int, s string, b boolean, y double")
    parts = profile.sketched(df.where("k < 100")).unionByName(profile.sketched(df.where("k >= 100"))).unionByName(profile.sketched(df.where("false")))
    got = {p.column_name: p for p in profile.summarized(profile.combined(parts)).collect()}
    x = sorted(v[0] for v in rows if v[0] is not None)
    assert (got["x"].n, got["x"].null_share, got["x"].low, got["x"].high) == (4000, 0.2, x[0], x[-1])
    for name, q in profile.QUARTILES.items():
        assert x[int((q - 0.03) * len(x))] <= got["x"][name] <= x[int((q + 0.03) * len(x))]
    assert abs(got["k"].distinct_about - 301) <= 9 and (got["s"].first, got["s"].last, got["s"].distinct_about, got["s"].low) == ("a", "c", 3, None)
    assert got["b"].distinct_about == 2 and (got["y"].low, got["y"].high, got["y"].null_share) == (1.0, 1.0, 0.0)
    assert profile.sketched(df.where("false")).agg(F.sum("n")).first()[0] == 0
    # one scan for all columns
    assert profile.sketched(df)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
