"""Small cases of value normalisation, intake, validation, listings, corrections, search and exports."""

import glob

import pytest
from pyspark.sql import functions as F

from catalith.functions import values
from catalith.operators import graph, intake, linking, listing, nearest, quality, review, search, validate
from catalith.sinks import exports

DEFINED = "code string, raw string, datatype string, cardinality string, unit_family string, canonical_unit string, low double, high double, allowed array<string>, max_length int, pattern string"


def normal(spark, rows, **more):
    full = [(c, raw, *(d.get(k) for k in values.DEFINITION)) for c, raw, d in rows]
    return [r.asDict() for r in values.normalized(spark.createDataFrame(full, DEFINED), **more).collect()]


def test_numbers_by_definition(spark):
    amps = {"datatype": "number", "unit_family": "current", "canonical_unit": "kA", "low": 1.0, "high": 100.0}
    got = normal(spark, [("a", "65,000 A", amps), ("a", "0.5 kA", amps), ("a", "10", amps), ("a", "none", amps), ("a", " ", amps), ("a", None, amps), ("t", "212 °F", {"datatype": "number", "unit_family": "temperature", "canonical_unit": "degC"}), ("p", "2 in. w.g.", {"datatype": "number", "unit_family": "pressure", "canonical_unit": "inH2O"}), ("n", "7 m", {"datatype": "number"})])
    assert [(r["value_number"], r["unit"], r["errors"], r["notes"], r["unit_assumed"]) for r in got] == [
        (65.0, "kA", [], ["65000 A -> 65 kA"], False),
        (0.5, "kA", ["0.5 is below the plausible minimum 1"], [], False),
        (10.0, "kA", [], ["no unit found; assumed kA"], True),
        (None, None, ["could not parse a number from 'none'"], [], False),
        (None, None, ["empty value"], [], False),
        (None, None, ["empty value"], [], False),
        (100.0, "degC", [], ["212 degF -> 100 degC"], False),
        (2.0, "inH2O", [], [], False),
        (7.0, None, [], [], False),
    ]


def test_choices_by_definition(spark):
    material = {"datatype": "enum", "allowed": ["Brass", "Stainless Steel 316", "PTFE"]}
    synonyms = {"ss316": "Stainless Steel 316", "teflon": "PTFE", "tef": "Brass", "gold": "Gold"}
    rows = [("m", x, material) for x in ("BRASS.", "ss316", "forged brass", "ptf", "made of teflon", "mystery", "gold")]
    got = normal(spark, rows, synonyms=synonyms, learned=F.create_map(F.lit("mystery"), F.lit("PTFE")))
    assert [r["value_text"] for r in got] == ["Brass", "Stainless Steel 316", "Brass", "PTFE", "PTFE", "PTFE", None]
    assert [r["notes"] for r in got][1:3] == [["mapped 'ss316' -> 'Stainless Steel 316'"], ["matched 'forged brass' -> 'Brass'"]]
    assert got[5]["notes"] == ["applied a learned mapping: 'mystery' -> 'PTFE'"] and got[0]["notes"] == []
    assert got[6]["errors"] == ["'gold' is not a legal value (allowed: Brass, Stainless Steel 316, PTFE...)"]


def test_other_values_by_definition(spark):
    got = normal(spark, [("tags", "a; b ,c;", {"cardinality": "multi"}), ("tags", ";", {"cardinality": "multi"}), ("certifications", "UL489; ce", {"cardinality": "multi"}), ("s", "  a   b—c ", {}), ("s", "abcdefgh", {"max_length": 4, "pattern": "b"}), ("b", "Standard", {"datatype": "boolean"}), ("b", "perhaps", {"datatype": "boolean"})], canonical={"ul489": "UL 489", "ce": "CE"})
    assert [r["value_list"] for r in got[:3]] == [["a", "b", "c"], None, ["UL 489", "CE"]] and got[1]["errors"] == ["no values parsed"]
    assert (got[3]["value_text"], got[4]["value_text"], got[4]["errors"], got[4]["notes"]) == ("a b-c", "abcd...", ["'abcd...' does not match the required pattern b"], ["truncated to 4 characters"])
    assert (got[5]["value_boolean"], got[6]["value_boolean"], got[6]["errors"]) == (True, None, ["'perhaps' is not a boolean"])


def test_medians_of_large_groups_are_exact(spark):
    import random
    import statistics

    r = random.Random(4)
    groups = {"even": [r.random() for _ in range(4000)], "odd": [r.gauss(0, 9) for _ in range(3001)], "ties": [float(r.randint(0, 3)) for _ in range(2500)], "small": [5.0, 1.0, 9.0, 2.0], "half": [0.0] * 600 + [1.0] * 600}
    rows = spark.createDataFrame([(g, v) for g, values_ in groups.items() for v in values_], "g string, v double").repartition(5)
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    for bound in (0, 1000, 10_000):
        got = {x.g: x.median for x in quality.medians(rows, ["g"], "v", sizes, bound).collect()}
        assert got == pytest.approx({g: statistics.median(v) for g, v in groups.items()})
    stats = {x.g: x.mad for x in quality.peer_stats(rows, ["g"], "v", 100).collect()}
    assert stats["odd"] == pytest.approx(statistics.median(abs(v - statistics.median(groups["odd"])) for v in groups["odd"]))


def test_rules_compare_mixed_types_as_texts_and_say_why(spark):
    wide = spark.createDataFrame([("a", 20.0, "20", None), ("b", 3.0, "x", 5.0)], "product_id string, size double, label string, width double")
    kinds = dict(wide.dtypes)
    got = wide.select(quality.rule_condition("size == label", wide.columns, kinds).alias("x"), quality.rule_condition("label == '20'", wide.columns, kinds).alias("y"), quality.implication_message("size > 1", ["width"], then_max={"width": 4}).alias("m")).collect()
    assert [tuple(r) for r in got] == [(True, True, "width is required when size > 1"), (False, False, "width must not exceed 4")]
    assert spark.range(1).select(quality.outlier_message(F.lit(40.0), F.lit(2.0), F.lit(0.0), F.lit(5), F.lit(2.0), F.lit(40.0))).first()[0] == "40 is far from the peer value 2 (n=5)"


def test_quotes_and_records(spark):
    mirrors = spark.createDataFrame([("s1", "Rated current: 63 A at 40 degrees")], "source_id string, text string")
    records = spark.createDataFrame([("p", "amps", "s1", "rated CURRENT 63A", "t1", True), ("p", "volts", "s1", "rated voltage 400 V", "t2", True), ("p", "mm", "s2", "17 mm", "t3", True), ("p", "x", None, "y", None, True)], "product_id string, code string, source_id string, quote string, locator string, quote_verified boolean")
    found = validate.quote_issues(records, mirrors)
    assert {(r.code, r.kind, r.message) for r in found.collect()} == {("volts", "quote", "volts: cited quote could not be located in s1 (t2)"), ("mm", "mirror", "mm: source mirror s2 is unavailable")}
    assert {r.code: r.quote_verified for r in validate.rechecked(records, found).collect()} == {"amps": True, "volts": False, "mm": True, "x": True}


FRAGMENT = "source_id string, pos int, kind string, row_scoped boolean, cells array<array<string>>, text string"


def test_intake(spark):
    rows = [
        ("feed", 0, "keyvalue", True, [["Part Number", "A-1"], ["Manufacturer name", "Acme"], ["Series", " "]], None),
        ("feed", 1, "keyvalue", True, [["SKU", "B-2"], ["color", "red"]], None),
        ("feed", 2, "keyvalue", True, [["color", "red"]], None),
        ("sheet", 0, "heading", False, None, "Volt-Ampere Works VX100-2P Datasheet | page"),
        ("sheet", 1, "table", False, [["Catalog No", "Poles"], ["VX100-2P", "2"], ["Nominal Size", "3"], ["VX100-3P", "3"], ["VX100-2P", "x"]], None),
        ("plain", 0, "heading", False, None, "X"),
    ]
    mirrors = spark.createDataFrame([("feed", ""), ("sheet", "Series: VX100\n"), ("plain", "Brand: Ferrum Works Ltd.\nmodel Q7-1, 240/415 V"), ("none", "nothing here")], "source_id string, text string")
    hints = spark.createDataFrame([("feed", "Hinted")], "source_id string, manufacturer string")
    found = intake.described(spark.createDataFrame(rows, FRAGMENT), mirrors, hints)
    assert {tuple(r) for r in found.collect()} == {
        ("feed", 0, "Acme", "A-1", None), ("feed", 1, "Hinted", "B-2", None),
        ("sheet", None, "Volt-Ampere Works", "VX100", "VX100"), ("sheet", None, "Volt-Ampere Works", "VX100-2P", "VX100"), ("sheet", None, "Volt-Ampere Works", "VX100-3P", "VX100"),
        ("plain", None, "Ferrum Works", "Q7-1", None),
    }
    assert intake.assigned(spark.createDataFrame(rows, FRAGMENT), found).count() == 2 + 3 * 2 + 1


def test_corrections_that_the_definition_refuses(spark):
    seen = spark.createDataFrame([("p", "amps", 1, 5.0, None, "s", "catalog", "ocr", False)], "product_id string, code string, obs_seq long, value_number double, value_text string, source_id string, source_kind string, method string, quote_verified boolean")
    products = spark.createDataFrame([("p", "c")], "product_id string, category_id string")
    definitions = spark.createDataFrame([("c", "amps", "number"), ("c", "new", "boolean")], "category_id string, code string, datatype string")
    asked = spark.createDataFrame([(1, "p", "amps", "7", "ann"), (2, "p", "amps", "much", "ann"), (3, "p", "volts", "7", "ann"), (4, "q", "amps", "7", "ann"), (5, "p", "new", "yes", "bob")], "correction_seq int, product_id string, code string, raw string, reviewer string")
    from catalith.operators import golden

    grown, records, refused = review.correct(seen, products, definitions, asked, golden.golden_records)
    assert grown.count() == 3
    assert {(r.code, r.value_number, r.value_text, r.source_id) for r in records.collect()} == {("amps", 7.0, None, "human:ann"), ("new", None, "true", "human:bob")}
    assert {r.correction_seq: r.errors for r in refused.collect()} == {2: ["could not parse a number from 'much'"], 3: ["not an attribute of c"], 4: ["not an attribute of an unknown product"]}


def test_search_falls_back_and_index(spark, tmp_path):
    none = spark.createDataFrame([], "product_id string")
    near = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "product_id string, score double")
    assert [tuple(r) for r in search.structured_or_nearest(none, near, 1).collect()] == [("b", 0.9, "semantic")]
    assert search.structured_or_nearest(near.select("product_id"), near, 1).count() == 2
    texts = spark.createDataFrame([("a", "red"), ("b", "blue"), ("c", "red"), ("d", None)], "product_id string, text string")
    cache = texts.where("text = 'blue'").select(search.embedding_key("m", F.col("text")).alias("key"), F.array(F.lit(3.0), F.lit(4.0)).alias("vector"))
    assert [r.text for r in search.to_embed(texts, cache, "m").collect()] == ["red"]
    assert search.to_embed(texts, cache, "other").count() == 2
    search.store_index(texts, cache, "m", f"file://{tmp_path}/index")
    assert [tuple(r) for r in search.load_index(spark, f"file://{tmp_path}/index", "m").collect()] == [("b", [0.6, 0.8])]


def test_many_blocks_of_queries(spark):
    import numpy as np

    r = np.random.default_rng(3)
    data = r.normal(size=(60, 5))
    data[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>").repartition(3)
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = {}
    for x in nearest.nearest(rows, asked, 4, "id", "v").orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.id)
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-10)
    for q in range(0, 60, 3):
        scores = unit @ unit[q]
        assert got[q] == sorted(range(60), key=lambda i: (-scores[i], i))[:4]
    assert nearest.nearest(rows, asked.where("false"), 4, "id", "v").count() == 0


def test_labels_by_words(spark):
    aliases = spark.createDataFrame([("rated current", "amps", False), ("current", "x", False), ("name", "y", True)], "alias string, code string, identity boolean")
    labels = spark.createDataFrame([(1, "max rated current"), (2, "current"), (3, "concurrent"), (4, "name"), (5, "")], "label_id int, label string")
    assert {(r.label_id, r.code, r.score) for r in linking.label_codes(labels, aliases).collect()} == {(1, "amps", 13), (2, "x", 107)}


def test_lists(spark):
    rows = spark.createDataFrame([(i, f"M{i % 2}", f"m{9 - i}", "n", "s", "c", "v", "draft", i % 2 == 0, float(i), 0.5, True, 0, i % 3) for i in range(6)], "product_id int, manufacturer string, mpn string, name string, series string, category_id string, vertical string, status string, is_family boolean, quality_overall double, completeness double, channel_ready boolean, conflict_count int, open_flags int")
    page, total = listing.page(listing.filtered(rows, listing.Filters(flagged=True)), "flags", 1, 2)
    assert total == 4 and [r.product_id for r in page.collect()] == [5, 1]
    assert [r.product_id for r in listing.page(rows, "no such order", 0, 3)[0].collect()] == [4, 2, 0]
    assert listing.filtered(rows, listing.Filters(q=" M1 ", families=False, ready=True, vertical="v")).count() == 3
    assert listing.filtered(rows, listing.Filters(maker_part="m0", status="published")).count() == 0


def test_stored_graph(spark, tmp_path):
    products = spark.createDataFrame([("a", "c", "B"), ("b", "c", "B"), ("x", None, None)], "product_id string, category_id string, base_id string")
    certs = spark.createDataFrame([("a", "CE", 0.7)], "product_id string, label string, confidence double")
    edges = graph.build(products, spark.createDataFrame([("a", "s")], "product_id string, source_id string"), certs)
    assert ("a", "certified_by", "cert:CE", 0.7) in {tuple(r) for r in edges.collect()}
    assert {r.dst for r in edges.where("src = 'family:B' and predicate = 'compatible_with'").collect()} == {"a", "b"}
    graph.save(edges, f"file://{tmp_path}/g")
    (tmp_path / "g" / "more.json").write_text('{"src": "a"}\nbroken\n{"src": "x", "predicate": "replaces", "dst": "y", "confidence": 1.0}\n')
    assert graph.load(spark, f"file://{tmp_path}/g").count() == edges.count() + 1


def test_articles_and_header(spark, tmp_path):
    products = spark.createDataFrame([("p1", "Acme", "VX1", "EC1", "12.5"), ("p2", "Acme", "VX2", None, None)], "product_id string, manufacturer string, mpn string, etim_class string, list_price_usd string")
    attributes = spark.createDataFrame([("p1", "width", 17.5, None, "mm", 0.9, False), ("p1", "copy", None, "text", None, 0.5, True), ("p1", "blank", None, "", None, 0.5, False)], "product_id string, code string, value_number double, value_text string, unit string, confidence double, generated boolean")
    exports.write_articles(products, attributes, f"file://{tmp_path}/xml")
    text = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/xml/part*"))
    assert "<FVALUE>17.5</FVALUE>" in text and "confidence=0.90" in text and "<PRICE_AMOUNT>12.50</PRICE_AMOUNT>" in text and 'price_type="net_list"' in text and "copy" not in text and text.count("<ARTICLE>") == 2
    assert "<CATALOG_NAME>" in "".join(open(f).read() for f in glob.glob(f"{tmp_path}/xml-header/part*"))


def test_from_files_to_values(spark, tmp_path):
    from catalith.functions import identity
    from catalith.operators import extract
    from catalith.sources import files

    (tmp_path / "datasheets").mkdir()
    (tmp_path / "price").mkdir()
    page = "<html><h1>Acme VX100 Datasheet</h1><table><tr><td>Series</td><td>VX100</td></tr><tr><td>Rated Voltage (AC)</td><td></td><td>230 V</td></tr></table><p>x</p><table><tr><td>Catalog No</td><td>Poles</td><td>Width</td></tr><tr><td>VX100-1P</td><td>1</td><td>17 mm</td></tr><tr><td>vx100 2p</td><td>2</td><td>35 mm</td></tr></table><p>Finish: matt grey; rated voltage: 999 V and more to read about it.</p></html>"
    (tmp_path / "datasheets" / "a.html").write_text(page)
    (tmp_path / "price" / "list.csv").write_text("Brand|Part Number|Price USD\nAcme|VX100-1P|12.5\n")
    (tmp_path / "notes.pdf").write_bytes(b"x")
    found = files.discover(spark, f"file://{tmp_path}")
    pieces = files.fragments(spark, found).cache()
    assert {r.kind for r in pieces.collect()} == {"heading", "table", "keyvalue", "text"}
    text = F.coalesce("text", F.array_join(F.flatten("cells"), " "))
    mirrors = pieces.groupBy("source_id").agg(F.array_join(F.collect_list(text), "\n").alias("text"))
    products = intake.described(pieces, mirrors, found.select("source_id", F.lit(None).cast("string").alias("manufacturer")))
    rows = intake.assigned(pieces, products).withColumn("product_id", identity.product_id(F.col("manufacturer"), F.col("mpn")))
    aliases = spark.createDataFrame([("poles", "poles"), ("width", "width_mm"), ("rated voltage", "volts"), ("price usd", "price"), ("finish", "finish")], "alias string, code string")
    got = extract.observations(rows, aliases, mirrors).join(rows.select("product_id", "mpn").distinct(), "product_id").collect()
    values_ = {(r.mpn, r.code): (r.raw, r.method) for r in got}
    assert values_ == {
        ("VX100-1P", "poles"): ("1", "native_table"), ("VX100-1P", "width_mm"): ("17 mm", "native_table"), ("VX100-1P", "volts"): ("230 V", "native_table"), ("VX100-1P", "finish"): ("matt grey", "native_text"), ("VX100-1P", "price"): ("12.5", "structured_feed"),
        ("VX100", "volts"): ("230 V", "native_table"), ("VX100", "finish"): ("matt grey", "native_text"),
    }
    assert all(r.quote_verified for r in got)
    order = [r.code for r in sorted(got, key=lambda r: r.obs_seq) if r.mpn == "VX100-1P" and r.code != "price"]
    assert order[-1] == "finish"
    pieces.unpersist()


def test_blocks_hold_one_list_each(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(nearest, "BLOCK_ROWS", 4)
    monkeypatch.setattr(nearest, "HELD_ROWS", 10)
    r = np.random.default_rng(1)
    keys, ids, x = r.integers(0, 3, 50).astype(np.int32), r.permutation(50), r.normal(size=(50, 3))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 7]), pa.array(ids[a : a + 7]), pa.array(x[a : a + 7].tolist())], ["list", "id", "vector"]) for a in range(0, 50, 7)]
    seen = {}
    for b in nearest._packed(iter(batches)):
        names = np.frombuffer(b.column(1)[0].as_py(), np.int64)
        rows = np.frombuffer(b.column(3)[0].as_py()).reshape(len(names), 3)
        assert len(names) <= 8 and (np.diff(names) > 0).all()
        seen |= {int(i): (b.column(0)[0].as_py(), v) for i, v in zip(names, rows, strict=True)}
    for k, i, v in zip(keys, ids, x, strict=True):
        assert seen[int(i)][0] == k and np.allclose(seen[int(i)][1], v / np.linalg.norm(v))


def test_lists_probed_all_are_exact_and_few_are_near(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8))
    data = [(i, (centres[i % 12] + 0.2 * r.normal(size=8)).tolist()) for i in range(600)] + [(600, None), (601, [0.0] * 8)]
    rows = spark.createDataFrame(data, "id long, v array<double>").repartition(3)
    asked = rows.where("id % 50 = 0 and v is not null").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    exact = nearest.nearest(rows, asked, 5, "id", "v")
    index = nearest.inverted_lists(rows, "id", "v", lists=12)
    assert index.blocks.agg(F.sum("rows")).first()[0] == 601
    order = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id").collect()))
    assert order(index.search(asked, 5, probes=12)) == order(exact)
    nearest.save(index, f"{tmp_path}/index")
    again = nearest.load(spark, f"{tmp_path}/index")
    found = nearest.recall(again.search(asked, 5, probes=2), exact).first()
    assert found.queries == 12 and found.recall >= 0.9
    assert nearest.inverted_lists(rows.where("false"), "id", "v", lists=4).search(asked, 3, probes=2).count() == 0


def test_shipped_spellings(spark):
    allowed = {"datatype": "enum", "allowed": ["Stainless Steel 316", "NPT Threaded", "DIN Rail", "3"]}
    got = normal(spark, [("m", "SS316", allowed), ("c", "female npt", allowed), ("r", "35mm DIN rail", allowed), ("p", "three phase", allowed), ("x", "velvet", allowed), ("certifications", "ul489; CE marked, Energy Star; other", {"cardinality": "multi"})])
    assert [r["value_text"] for r in got[:5]] == ["Stainless Steel 316", "NPT Threaded", "DIN Rail", "3", None]
    assert got[5]["value_list"] == ["UL 489", "CE", "ENERGY STAR", "other"]
