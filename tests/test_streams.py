"""Streams against their batch forms: out of order, in several batches, late and restarted."""

import random

import pytest
from pyspark.sql import functions as F

from catalith.operators import golden
from catalith.streaming import arbitration, events

SCHEMA = "product_id long, code string, obs_seq long, value_number double, value_text string, value_list array<string>, source_id long, source_kind string, method string, quote_verified boolean, grave boolean"


@pytest.fixture()
def rocks(spark):
    for k, v in arbitration.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in arbitration.STORE:
        spark.conf.unset(k)


def drawn(n=160, seed=4):
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        p = r.randrange(6)
        kind = p % 3
        number = r.choice([10.0, 10.1, 10.3, 12.0, float("nan"), None]) if kind == 0 else None
        text = r.choice(["Red", " red", "blue", " ", None]) if kind else None
        members = r.choice([["a", "b"], ["b", "a", "a"], None]) if kind == 2 else None
        rows.append((p, r.choice(["x", "y"]), seq, number, text, members, r.choice([1, 2, 3, None]), r.choice(["datasheet", "catalog", "user", None]), r.choice(["ocr", "structured_feed", None, "native_table"] + ["human"] * (p == 4)), r.choice([True, False, None]), p == 3))
    return rows


def comparable(df):
    return sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))


def test_summaries_give_the_same_records(spark):
    rows = spark.createDataFrame(drawn(), SCHEMA)
    direct = golden.confidence(golden.decided(golden.group_stats(golden.summaries(rows))))
    assert comparable(direct) == comparable(golden.golden_records(rows)) and direct.count() == 12


def test_state_in_any_order_and_after_a_restart(rocks, tmp_path):
    rows = drawn()
    random.Random(9).shuffle(rows)
    whole = rocks.createDataFrame(rows, SCHEMA)
    source = f"{tmp_path}/in"

    def run():
        stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        events.run_available(arbitration.arbitrated(stream), f"{tmp_path}/cp", arbitration.written_batches(f"{tmp_path}/out", whole))

    for part in (rows[:50], rows[50:90]):
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    assert comparable(arbitration.current(rocks, f"{tmp_path}/out").select(*golden.golden_records(whole).columns)) == comparable(golden.golden_records(rocks.createDataFrame(rows[:90], SCHEMA)))
    rocks.createDataFrame(rows[90:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    want = golden.golden_records(whole)
    assert comparable(arbitration.current(rocks, f"{tmp_path}/out").select(*want.columns)) == comparable(want)
    # a batch that runs again replaces its own folder
    again = rocks.read.parquet(f"{tmp_path}/out/batch=0")
    before = comparable(again)
    again.cache().count()
    assert comparable(again) == before


def test_merging_is_the_same_in_any_order():
    base = {"number": 1.0, "text": None, "members": None, "source_id": "1", "n": 1, "grave": False, "human": None, "human_seq": None}
    a, b, c = (base | {"first_seq": s, "precedence": p, "method_rank": m, "best": f"o{s}", "best_precedence": p, "best_rank": m, "best_seq": s} | h for s, p, m, h in [(5, 90.0, 0.5, {}), (2, 90.0, 0.5, {"human": "h2", "human_seq": 2}), (9, 70.0, 0.9, {"human": "h9", "human_seq": 9})])
    m = arbitration.merged
    assert m(m(a, b), c) == m(c, m(b, a)) == m(m(c, a), b)
    assert m(m(a, b), c)["best"] == "o2" and m(m(a, b), c)["human"] == "h9" and m(a, b)["first_seq"] == 2


def test_late_rows_and_windows(spark, tmp_path):
    """A row behind the watermark is dropped, one within it counts."""
    schema = "ts timestamp, event_type string, value double"
    batches = [["2024-01-01 00:05:00", "2024-01-01 00:20:00"], ["2024-01-01 03:00:00"], ["2024-01-01 00:10:00", "2024-01-01 02:30:00"], ["2024-01-01 09:00:00"]]
    for i, stamps in enumerate(batches):
        spark.createDataFrame([(t, "view", 1.0) for t in stamps], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    for i in range(4):  # one folder a batch, so that they arrive in this order
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/b[0-{i}]")
        out = events.windowed(events.timed(stream), "1 hour")
        out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(str(r.start)[11:13], r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("00", 2), ("02", 1), ("03", 1)}


def test_corrections_in_batches_that_run_again(spark, tmp_path):
    from catalith.operators import quality, review
    from catalith.sinks import versions
    from catalith.streaming import corrections

    root = f"{tmp_path}/corrections"
    seen = spark.createDataFrame([(f"p{k}", code, 10 * k + j, v, t, f"s{j}", "catalog", "native_table", True) for k in range(4) for j, (code, v, t) in enumerate([("width", float(k), None), ("finish", None, "matt")])], "product_id string, code string, obs_seq long, value_number double, value_text string, source_id string, source_kind string, method string, quote_verified boolean")
    products = spark.createDataFrame([(f"p{k}", "pumps", False) for k in range(4)], "product_id string, category_id string, is_family boolean")
    required = spark.createDataFrame([("pumps", "core", "width", False), ("pumps", "core", "height", False)], "category_id string, channel string, code string, variant_defining boolean")
    checks = spark.createDataFrame([], "product_id string, passed long, applicable long, errors long, outliers long, numeric long")
    records = golden.golden_records(seen)
    records.write.parquet(f"{tmp_path}/golden")
    records = spark.read.parquet(f"{tmp_path}/golden")
    facts = records.withColumns({"generated": F.lit(False), "inferred": F.lit(False), "verified": F.lit(True)})
    flags = review.flags(review.producer(records, "low_confidence: x", "warning", F.col("confidence"))).withColumn("resolved", F.lit(False))
    base = {"products": products, "observations": seen, "golden": records, "scores": quality.quality(products, facts, required, checks), "flags": flags}
    definitions = spark.createDataFrame([("pumps", "width", "number", None), ("pumps", "height", "number", None), ("pumps", "finish", "enum", ["matt", "gloss"])], "category_id string, code string, datatype string, allowed array<string>")
    apply = corrections.correction_batches(base, definitions, required, checks, root)
    source = f"{tmp_path}/asked"

    def ask(rows):
        spark.createDataFrame(rows, corrections.CORRECTION).coalesce(1).write.mode("append").parquet(source)
        events.run_available(spark.readStream.schema(corrections.CORRECTION).parquet(source), f"{tmp_path}/cp", apply)

    ask([(1, "p1", "width", "7.5", "ann"), (2, "p2", "finish", "velvet", "ann"), (3, "p1", "height", "4", "ann")])
    ask([(1, "p3", "finish", "Gloss", "bob")])
    now = corrections.current(spark, base, root)
    value = {(r.product_id, r.code): (r.value_number, r.value_text, r.method) for r in now["golden"].collect()}
    assert value["p1", "width"] == (7.5, None, "human") and value["p1", "height"][0] == 4.0 and value["p3", "finish"] == (None, "gloss", "human")
    assert value["p2", "finish"] == (None, "matt", "native_table") and len(value) == 9
    assert [(r.product_id, r.correction_seq) for r in now["refused"].collect()] == [("p2", 2)]
    assert {r.product_id: r.completeness_core for r in now["scores"].collect()} == {"p0": 0.5, "p1": 1.0, "p2": 0.5, "p3": 0.5}
    assert {(r.product_id, r.code) for r in now["flags"].where("resolved").collect()} == {("p1", "width"), ("p3", "finish")}
    assert [tuple(r) for r in now["synonyms"].where("code = 'finish'").collect()] == [("finish", "matt", "gloss", 1)]
    before = {name: sorted(map(str, t.collect())) for name, t in now.items()}
    apply(spark.createDataFrame([(9, "p0", "width", "99", "eve")], corrections.CORRECTION), 1)
    assert len(versions.published(spark, root)) == 2 and {name: sorted(map(str, t.collect())) for name, t in corrections.current(spark, base, root).items()} == before
    assert now["observations"].count() == 11
