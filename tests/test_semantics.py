"""Values worked out by hand from the contracts of the operators."""

import pytest
from pyspark.sql import functions as F

from catalith.functions import extraction, identity
from catalith.operators import golden, quality, search

OBS = "product_id string, code string, obs_seq long, value_number double, value_text string, source_id string, source_kind string, method string, quote_verified boolean, value_list array<string>, grave boolean"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def records(spark, rows):
    full = [(*r, *([None, None][len(r) - 9 :])) for r in rows]
    return {r.code: r for r in golden.golden_records(spark.createDataFrame(full, OBS)).collect()}


def test_severity_compares_the_winner_with_all_losers(spark):
    got = records(spark, [
        # same precedence, .95 against .65
        ("p", "a", 1, 1.0, None, "x", "catalog", "structured_feed", True), ("p", "a", 2, 2.0, None, "y", "catalog", "llm", True),
        # the best loser by method has a lower precedence, but counts
        ("p", "b", 1, 1.0, None, "x", "catalog", "structured_feed", True), ("p", "b", 2, 2.0, None, "y", "catalog", "ocr", True), ("p", "b", 3, 3.0, None, "z", "price_file", "native_table", True),
        # another precedence is a warning, unless the attribute tells variants apart
        ("p", "c", 1, 1.0, None, "x", "datasheet", "native_table", True), ("p", "c", 2, 2.0, None, "y", "catalog", "native_table", True),
        ("p", "d", 1, 1.0, None, "x", "datasheet", "native_table", True, None, True), ("p", "d", 2, 2.0, None, "y", "catalog", "native_table", True, None, True),
    ])
    assert {c: (r.rule, r.severity) for c, r in got.items()} == {"a": ("method reliability", "warning"), "b": ("method reliability", "critical"), "c": ("source precedence", "warning"), "d": ("source precedence", "critical")}


def test_lists_agree_as_sets_and_sources_without_names_count_each(spark):
    got = records(spark, [
        ("p", "certs", 1, None, None, "x", "catalog", "native_table", True, ["UL", "CE"], None), ("p", "certs", 2, None, None, "y", "catalog", "native_table", True, ["CE", "UL", "CE"], None), ("p", "certs", 3, None, "UL", "z", "catalog", "native_table", True, None, None),
        ("p", "none", 1, 5.0, None, None, None, None, None), ("p", "none", 2, 5.0, None, None, None, None, None),
    ])
    assert (got["certs"].agreeing, got["certs"].disagreeing, got["certs"].value_list) == (2, 1, ["UL", "CE"])
    assert (got["none"].agreeing, got["none"].groups) == (2, 1)


CONFIDENCE = "source_kind string, method string, quote_verified boolean, agreeing int, disagreeing int, errors int, defined boolean, inferred boolean, unit_assumed boolean, note string"


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("datasheet", "native_table", True, 2, 0, 0, True, False, False, None), 0.86),  # .9 * (1 - .6 * .035) * (1 - .8 * .03)
        (("datasheet", "native_table", True, 1, 0, 0, True, False, False, None), 0.8106),
        ((None, None, None, 1, 0, 0, True, True, False, None), 0.2622),  # .5 * .75 * (1 - .6 * .4) * .92
        ((None, None, None, 1, 0, 0, True, False, False, None), 0.0734),  # .3 * .35 * .76 * .92
        (("user", "human", True, 3, 0, 0, False, False, False, None), 0.9),  # an attribute that the dictionary lacks
        (("user", "human", True, 3, 0, 1, True, False, False, None), 0.3),
        (("user", "human", None, 3, 0, 0, True, False, True, None), 0.517),  # .55 * (1 - .5 * .12)
        (("user", "human", True, 3, 0, 0, True, False, False, "unit 'V' belongs to 'voltage', expected 'length'"), 0.9),
    ],
)
def test_confidence(spark, row, want):
    assert golden.confidence(spark.createDataFrame([row], CONFIDENCE)).first().confidence == pytest.approx(want, abs=1e-9)


def test_defaults_fill_what_nothing_states(spark):
    have = spark.createDataFrame([("p", "size", 1.0, None, 0.9)], "product_id string, code string, value_number double, value_text string, confidence double")
    products = spark.createDataFrame([("p", "c"), ("q", "c"), ("r", "d")], "product_id string, category_id string")
    defaults = spark.createDataFrame([("c", "size", 2.0, None), ("c", "uom", None, "EA"), ("c", "blank", None, None)], "category_id string, code string, value_number double, value_text string")
    got = {(r.product_id, r.code): (r.value_number, r.value_text, r.confidence, r.strategy) for r in golden.with_defaults(have, products, defaults).collect()}
    assert got == {("p", "size"): (1.0, None, 0.9, None), ("p", "uom"): (None, "EA", 0.4, "schema_default"), ("q", "size"): (2.0, None, 0.4, "schema_default"), ("q", "uom"): (None, "EA", 0.4, "schema_default")}


def test_classifier(spark):
    keywords = {"fans": ["fan", "exhaust fan"], "valves": ["valve"], "none": []}
    texts = [(1, "A fan, a fantastic exhaust fan"), (2, "valve_x fan"), (3, "fantastic"), (4, None), (5, "valve fan")]
    got = {r.id: r for r in quality.keyword_category(spark.createDataFrame(texts, "id int, text string"), "id", "text", keywords).collect()}
    assert (got[1].category, got[1].score, got[1].keyword) == ("fans", 6.0, "exhaust fan")  # 2 * 1.5 + 3
    assert got[1].confidence == 0.925  # .35 + .4 + .35 * .5
    assert (got[2].category, got[2].score) == ("fans", 1.5)
    assert (got[3].category, got[3].confidence, got[4].category) == ("industrial.generic", 0.0, "industrial.generic")
    assert (got[5].category, got[5].runner_up, got[5].confidence) == ("fans", 1.5, 0.394)  # a tie goes to the first; .35 + .35 / 8


def test_hybrid_scores(spark):
    products = spark.createDataFrame([("p", "Acme VX1"), ("q", "Other"), ("r", "Third")], "product_id string, identity string")
    facts = [("p", "Poles", "3", 3.0, True), ("p", "Rated current", "63 A", 63.0, False), ("q", "Colour", "vx1 red", None, False)]
    attributes = spark.createDataFrame(facts, "product_id string, label string, shown string, value_number double, variant_defining boolean")
    raw = search.token_scores(products, attributes, "vx1 63 current")
    # p: '63' and 'current' in a value and a label (.3 each), the number 63 (1.2); q: 'vx1'
    assert {r.product_id: round(r.raw, 6) for r in raw.collect()} == {"p": 1.8, "q": 0.3}
    assert {r.product_id: round(r.raw, 6) for r in search.token_scores(products, attributes, " VX1").collect()} == {"p": 3.0, "q": 0.3}
    near = spark.createDataFrame([("p", 0.5), ("r", 0.9)], "product_id string, semantic_score double")
    got = [(r.product_id, round(r.score, 6)) for r in search.hybrid(raw, near, 10).collect()]
    assert got == [("r", 0.9), ("p", 0.725), ("q", 0.075)]  # .5 + 1.8 / 8; .3 / 4


@pytest.mark.parametrize(("text", "want"), [("PN MPN100", "100"), ("P/N: cb 100", "CB100"), ("Part Number . AB-1", "AB1"), ("model: sku #X-9", "X9"), ("", ""), (None, None)])
def test_part_number_key(spark, text, want):
    assert one(spark, identity.normalize_mpn(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("text", "want"), [("12.5", True), ("100_2P", True), ("100_2", True), ("VX 100", False), ("ab", False), ("abc", False), ("123", False), ("NSX100F", True), ("-A1", False), ("A1" * 21, False)])
def test_shape_of_part_numbers(spark, text, want):
    assert one(spark, identity.looks_like_mpn(F.lit(text))) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("use vx100-2p-c20 now", ["VX100-2P-C20"]),
        ("Model: AB1.", ["AB1"]),
        ("Part no. X-1; part number: Y/22, 240/415 V and 5-1-1", ["X-1", "Y/22"]),
        ("order code zz", []),
        ("catalogue number=12", []),
        ("SKU:ab-12, model (NSX 100) mpn: Q70", ["ab-12", "Q70", "AB-12"]),
        ("Order Code: NSX100F-C20 on DIN rail", ["NSX100F-C20"]),
        (None, None),
    ],
)
def test_part_numbers_in_text(spark, text, want):
    assert one(spark, identity.mpn_candidates(F.lit(text).cast("string"))) == want


def test_family_of_a_part_number(spark):
    base = lambda mpn, series=None: one(spark, identity.variant_base(F.lit(mpn), F.lit(series).cast("string")))
    assert (base("CB-100-2P-C20"), base("VX1-2P-C20"), base("A-B"), base("X", "S9"), base("--")) == ("CB-100", "VX1", None, "S9", None)
    assert one(spark, identity.variant_base_id(F.lit("Acme Inc."), F.lit("CB-100-2P-C20"), F.lit(None).cast("string"))) == one(spark, identity.product_id(F.lit("ACME"), F.lit("cb100")))


@pytest.mark.parametrize(
    ("text", "want"),
    [("Size: 3 in", ("Size", "3 in")), ("Temp - 5", None), ("Temp – -5 C", ("Temp", "-5 C")), ("Flow  9: x", ("Flow", "9: x")), ("Made by - Acme", ("Made by", "Acme")), (": x", None), ("plain words", None), (None, None)],
)
def test_label_and_value(spark, text, want):
    found = one(spark, extraction.label_and_value(F.lit(text).cast("string")))
    assert (found and (found.label, found.value)) == want


def test_value_of_a_labelled_line(spark):
    text = "About\nManufacturer: acme\nThe brand - Acme Works; Series: X9"
    upper = lambda v: v.rlike("^[A-Z]")
    assert one(spark, extraction.labelled_value(F.lit(text), ["manufacturer", "brand"], upper)) == "Acme Works"
    assert one(spark, extraction.labelled_value(F.lit(text), ["series"], upper)) == "X9"
    assert one(spark, extraction.labelled_value(F.lit(text), ["line"], upper)) is None
