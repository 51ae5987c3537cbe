"""Builds that are published at once, their audit, and scores with outliers and rules."""

import pytest
from pyspark.sql import functions as F

from catalith import engine
from catalith.__main__ import main
from catalith.operators import quality
from catalith.sinks import versions

REQUIRED = "category_id string, channel string, code string, variant_defining boolean"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("builds")
    (base / "feeds").mkdir()
    widths = [10, 11, 12, 10.5, 11.5, 900]
    rows = [f"Acme,P-{k}0,pumps,{w},{20 if k else 5}" for k, w in enumerate(widths)] + [",lost,pumps,1,1"]
    (base / "feeds" / "one_datasheet.csv").write_text("manufacturer,mpn,category,width,height\n" + "\n".join(rows) + "\n")
    place = f"{base}/tables"
    assert engine.ingest(spark, f"{base}/feeds", place) == 1
    return place


def required(spark):
    return spark.createDataFrame([("pumps", "core", "width", False)], REQUIRED)


def test_nothing_to_read_before_a_build(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        engine.views(spark, f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, f"{tmp_path}/none", "golden")


def test_scores_know_outliers_and_rules(spark, root):
    counts = engine.build(spark, root, required(spark), {"fits": "width <= height"})
    assert counts == {"golden": 12, "conflicts": 0, "issues": 3, "scores": 6, "scorecard": 1}
    got = {r.mpn: (r.consistency, r.distinctiveness) for r in engine.ask(spark, root, "SELECT mpn, consistency, distinctiveness FROM scores JOIN products USING (product_id)").collect()}
    # the odd width breaks its rule and is far from its peers; the odd height breaks a rule too and is far from equal peers by a factor below ten
    assert got["P-10"] == (1.0, 1.0) and got["P-50"] == (0.0, 0.5) and got["P-00"][0] == 0.0
    issues = engine.ask(spark, root, "SELECT mpn, kind, code, level, message FROM issues JOIN products USING (product_id)").collect()
    assert {(r.mpn, r.kind) for r in issues} >= {("P-50", "outlier"), ("P-50", "rule"), ("P-00", "rule")}
    assert all("rule fits: width <= height" in r.message for r in issues if r.kind == "rule")


def test_lift_and_audit(spark, root):
    first = {r.metric: r.before for r in engine.lift(spark, root).collect()}
    assert set(first.values()) == {None}
    engine.build(spark, root, required(spark))
    lift = {r.metric: (r.before, r.after, r.change) for r in engine.lift(spark, root).collect()}
    assert lift["mean_consistency"][1] == 1.0 and lift["mean_consistency"][2] > 0 and lift["products"] == (6.0, 6.0, 0.0)
    steps = engine.audit(spark, root).collect()
    assert {(r.step, r.name): (r.rows, r.refused) for r in steps if r.step == "ingest"} == {("ingest", "sources"): (1, 0), ("ingest", "rows"): (7, 1), ("ingest", "observations"): (12, 0), ("ingest", "products"): (6, 0)}
    assert {r.name: r.rows for r in steps if r.step == "build"}["golden"] == 12 and len({r.run for r in steps}) == 3


def test_commands(spark, root, tmp_path, capsys):
    (tmp_path / "required.csv").write_text("category_id,channel,code,variant_defining\npumps,core,width,false\n")
    main(["--root", root, "build", f"{tmp_path}/required.csv", "--rule", "fits=width <= height"])
    main(["--root", root, "audit"])
    main(["--root", root, "lift"])
    said = capsys.readouterr().out
    assert "12 golden" in said and "refused" in said and "mean_consistency" in said


def test_a_build_that_is_lost_changes_nothing(spark, root, monkeypatch):
    before = sorted(map(str, engine.views(spark, root)["scores"].collect()))
    monkeypatch.setattr(quality, "scorecard", lambda scores: scores.select(F.raise_error(F.lit("lost")).alias("x")))
    with pytest.raises(Exception, match="lost"):
        engine.build(spark, root, spark.createDataFrame([("pumps", "core", "nothing", False)], REQUIRED))
    assert sorted(map(str, engine.views(spark, root)["scores"].collect())) == before and len(versions.published(spark, root)) == 3


def test_two_builds_at_once(spark, tmp_path):
    a, b = (versions.Version(spark, str(tmp_path)) for _ in range(2))
    for v, n in ((a, 3), (b, 0)):
        v.write("t", spark.range(n))
    assert a.publish() == {"t": 3} and b.publish() == {"t": 0}
    assert versions.read(spark, str(tmp_path), "t").count() == 0 and versions.read(spark, str(tmp_path), "t", 1).count() == 3
