import decimal
import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from catalith import registry, session
from catalith.functions import extraction, identity, normalize
from catalith.operators import detail, enrich, golden, graph, linking, nearest, quality, review, search
from catalith.plans import catalog_queries, detail_queries, product_queries, stream_queries, view_queries  # noqa: F401
from catalith.sinks import exports
from catalith.sources import files
from catalith.streaming import events

DATA = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(value):
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if value is None or not isinstance(value, (int, float, decimal.Decimal)) or isinstance(value, bool):
        return repr(value)
    return f"{float(value):.9g}"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    rows = registry.QUERIES[name](spark, DATA)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(rows.columns) == sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert ours == theirs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "family", "want"),
    [('1/2"', "length", 12.7), ("1 1/2 in", "length", 38.1), ("2.4 lbs", "mass", 1.088622), ("600 PSI WOG", "pressure", 41.368544), ("1200 CFM", "flow", 2038.812984), ("-20 F", "temperature", -28.888889), ("450 F", "temperature", 232.222222), ("63A", "current", 63.0), ("10 kA", "current", 10000.0), ("20", "length", 20.0), ("none", "length", None)],
)
def test_quantities(spark, text, family, want):
    got = one(spark, normalize.quantity(F.lit(text), family))
    assert got == want or math.isclose(got, want, abs_tol=1e-6)


@pytest.mark.parametrize(("text", "want"), [("240/415 V AC", 240.0), ("3/4 HP", 0.75), ("65,000 A", 65000.0), ("½ in", 0.5), ("−5", -5.0), ("", None), (None, None)])
def test_numbers(spark, text, want):
    assert one(spark, normalize.parse_number(F.lit(text).cast("string"))) == want


def test_scalars(spark):
    assert one(spark, identity.normalize_mpn(F.lit("P/N: CB-100/2P-C20"))) == one(spark, identity.normalize_mpn(F.lit("cb 100 2p c20"))) == "CB1002PC20"
    assert one(spark, identity.normalize_manufacturer(F.lit("Ferrum Valve Works Ltd."))) == "Ferrum Valve Works"
    assert one(spark, identity.product_id(F.lit("Acme Inc."), F.lit("CB-100"))) == one(spark, identity.product_id(F.lit("ACME"), F.lit("cb100")))
    assert [one(spark, identity.looks_like_mpn(F.lit(t))) for t in ("VX100-2P-C20", "Nominal Size", "ab")] == [True, False, False]
    assert "240/415" not in one(spark, identity.mpn_candidates(F.lit("runs at 240/415 V, VX100-2P-C20")))
    assert tuple(one(spark, normalize.split_range(F.lit("-20 to +70 C")))) == (-20.0, 70.0)
    assert tuple(one(spark, normalize.split_range(F.lit("-4...158 F")))) == (-4.0, 158.0)
    assert one(spark, normalize.heal_split_numbers(F.lit("2 15,719 8 ,927 1, 200 12 34"))) == "215,719 8,927 1,200 12 34"
    assert [one(spark, normalize.render_number(F.lit(x))) for x in (12.7, 20.0, 1e6, 0.0)] == ["12.7", "20", "1e+06", "0"]
    assert one(spark, identity.source_kind(F.lit("/x/Datasheets/a.pdf"))) == "datasheet"
    assert one(spark, normalize.quote_found(normalize.squeezed(F.lit("Rated\n current: 63 A")), normalize.squeezed(F.lit("x rated current 63a y"))))
    assert not one(spark, normalize.quote_found(normalize.squeezed(F.lit("invented text of some length")), normalize.squeezed(F.lit("x rated current 63a y"))))


OBS = "product_id string, code string, obs_seq long, value_number double, value_text string, source_id string, source_kind string, method string, quote_verified boolean"


def test_arbitration(spark):
    rows = [
        ("p", "ka", 1, 6.0, None, "w", "manufacturer_web", "native_table", True), ("p", "ka", 2, 10.0, None, "d", "datasheet", "native_table", True),
        ("p", "poles", 1, 3.0, None, "d", "datasheet", "native_table", True), ("p", "poles", 2, 4.0, None, "h", "user", "human", True), ("p", "poles", 3, 5.0, None, "h", "user", "human", True),
        ("p", "mm", 1, 12.7, None, "a", "catalog", "native_table", True), ("p", "mm", 2, 12.70, None, "b", "catalog", "native_table", True), ("p", "mm", 3, 12.8, None, "c", "catalog", "ocr", False),
        ("p", "color", 1, None, "Red", "a", "catalog", "ocr", False), ("p", "color", 2, None, " red ", "b", "catalog", "llm", False), ("p", "none", 1, None, " ", "b", "catalog", "llm", False), ("p", "odd", 1, float("nan"), None, "b", None, None, None),
    ]
    got = {r.code: r for r in golden.golden_records(spark.createDataFrame(rows, OBS)).collect()}
    assert set(got) == {"ka", "poles", "mm", "color"}
    assert (got["ka"].value_number, got["ka"].rule, got["ka"].disagreeing) == (10.0, "source precedence", 1)
    assert (got["poles"].value_number, got["poles"].rule) == (5.0, None)
    assert (got["mm"].agreeing, got["mm"].groups) == (3, 1)
    assert (got["color"].value_text, got["color"].agreeing) == (" red ", 2)
    single = [("q", "mm", 1, 1.0, None, "a", "datasheet", "native_table", True)]
    alone = golden.golden_records(spark.createDataFrame(single, OBS)).first()
    assert abs(alone.confidence - 0.811) < 0.001
    assert golden.golden_records(spark.createDataFrame([], OBS)).count() == 0


def test_outliers(spark):
    rows = spark.createDataFrame([("c", x) for x in (17.5, 17.6, 17.4, 17.5, 35.0, 4000.0)], "g string, v double")
    flagged = {r.v for r in quality.outliers(rows, ["g"], "v").where("outlier").collect()}
    assert 4000.0 in flagged and 17.5 not in flagged


def test_rules(spark):
    wide = spark.createDataFrame([("a", 70.0, -20.0, "PTFE"), ("b", -30.0, -20.0, "PTFE"), ("c", None, -20.0, None)], "product_id string, hi double, lo double, seat string")
    rules = {"order": quality.rule_condition("hi > lo", wide.columns), "seat": quality.implication("seat == 'PTFE'", wide.columns, then_max={"hi": 60}), "odd": quality.rule_condition("import os", wide.columns)}
    got = {(r.product_id, r.rule_id): r.passed for r in quality.evaluate_rules(wide, rules).collect()}
    assert got == {("a", "order"): True, ("b", "order"): False, ("a", "seat"): False, ("b", "seat"): True}


def test_graph(spark):
    edges = graph.closed(spark.createDataFrame([("a", "replaces", "b", 1.0), ("a", "compatible_with", "c", 0.6), ("a", "compatible_with", "c", 0.5), ("x", "variant_of", "x", 1.0)], "src string, predicate string, dst string, confidence double"))
    assert {tuple(r) for r in edges.collect()} == {("a", "replaces", "b", 1.0), ("b", "replaced_by", "a", 1.0), ("a", "compatible_with", "c", 0.6), ("c", "compatible_with", "a", 0.6)}
    assert graph.node_count(edges).first().nodes == 3
    assert {(r.node, r.depth) for r in graph.reachable(edges, spark.createDataFrame([("b",)], "start string"), 2).collect()} == {("b", 0), ("a", 1), ("c", 2)}


def test_feed_pages_and_discovery(spark, tmp_path):
    (tmp_path / "price").mkdir()
    (tmp_path / "price" / "list.csv").write_text("Item,Brand , Price\nA-1,Acme,  1,0\nB-2,,3\n", "utf-8")
    (tmp_path / "notes.txt").write_text("x")
    found = files.discover(spark, f"file://{tmp_path}").collect()
    assert [(r.content_type, r.source_kind) for r in found] == [("tabular", "price_file")]
    cells = {(r.row, r.key.strip(), r.value) for r in files.read_feed(spark, f"file://{tmp_path}/price").collect()}
    assert {(2, "Item", "A-1"), (2, "Brand", "Acme"), (3, "Item", "B-2"), (3, "Price", "3")} <= cells and not any(k == "Brand" and r == 3 for r, k, _ in cells)
    page = "<html><nav>x</nav><h1>Big &amp; head</h1><table><tr><th>Poles</th><td>2</td></tr></table><dl><dt>Width<dd>17 mm</dl><ul><li>Curve: C</li></ul><p>" + "long text " * 6 + "</p></html>"
    got = [(r.kind, r.text) for r in files.read_pages(spark.createDataFrame([(1, page), (2, None)], "i int, h string"), "i", "h").collect()]
    assert ("heading", "Big & head") in got and ("table", "Poles\t2") in got and ("keyvalue", "Curve\tC") in got and ("keyvalue", "Width\t17 mm") in got and any(k == "text" for k, _ in got)


def test_records_and_exports(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": 1}\n{broken\n{"id": 2}\n')
    assert sorted(r.id for r in files.read_records(spark, f"file://{tmp_path}/p.json", "id int").collect()) == [1, 2]
    products = spark.createDataFrame([("p1", "Acme", "VX1")], "product_id string, manufacturer string, mpn string")
    attributes = spark.createDataFrame([("p1", "width_mm", 17.5, None, 0.9), ("p1", "curve", None, "C", 0.8)], "product_id string, code string, value_number double, value_text string, confidence double")
    exports.write_articles(products, attributes, f"file://{tmp_path}/xml")
    text = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/xml/part*"))
    assert "<BMECAT>" in text and "<FVALUE>17.5</FVALUE>" in text
    item = exports.trade_items(products, attributes).first().item
    assert '"measurements":{"width_mm":17.5}' in item and item.index('"curve"') < item.index('"shown":"17.5"')
    assert exports.wide_feed(products, attributes, ["curve", "width_mm"]).first().asDict() == {"product_id": "p1", "manufacturer": "Acme", "mpn": "VX1", "curve": "C", "width_mm": "17.5"}
    exports.rebuild({"products": products}, f"file://{tmp_path}/t")
    exports.store_changes(f"file://{tmp_path}/t/products", products.withColumn("mpn", F.lit("VX2")), "product_id", f"file://{tmp_path}/t2")
    assert [r.mpn for r in spark.read.parquet(f"file://{tmp_path}/t2").collect()] == ["VX2"]


def test_review_and_enrichment(spark):
    flag = spark.createDataFrame([("p", "c", "outlier", "warning", 0.5), ("p", "c", "outlier", "warning", 0.5), ("q", None, "conflict_critical:x", "critical", 0.2)], "product_id string, code string, reason string, severity string, confidence double")
    made = review.flags(flag)
    assert made.count() == 2 and review.prioritised(made, 1).first().product_id == "q"
    queue = made.withColumn("resolved", F.col("product_id") == "p")
    assert {(r.product_id, r.resolved) for r in review.merged(queue, made).collect()} == {("p", True), ("q", False)}
    assert one(spark, enrich.unverified_numbers(F.lit("25 A and 10"), F.lit("10 kA"))) == ["25"]
    obs = spark.createDataFrame([("p", "c", 4, 1.0, None, "s", "catalog", "ocr", False)], OBS)
    fix = spark.createDataFrame([("p", "c", 1, 9.0, None, "ann")], "product_id string, code string, correction_seq long, value_number double, value_text string, reviewer string")
    assert golden.golden_records(review.corrected(obs, fix)).first().value_number == 9.0


def test_near_part_numbers_find_all(spark):
    import random

    r = random.Random(3)
    names = {"".join(r.choice("AB1") for _ in range(r.randint(4, 11))) for _ in range(150)}
    rows = spark.createDataFrame([(k, "m", n) for k, n in enumerate(sorted(names))], "k int, maker string, mpn string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    want = {}
    for a in names:
        near = [(edits(a, b), b) for b in names if b != a]
        near = [(d, b) for d, b in near if d <= 2 and d <= 0.2 * max(len(a), len(b))]
        if near:
            want[a] = min(near)
    got = {x.mpn: (x.edits, x.near_mpn) for x in linking.near_part_numbers(rows, "maker", "mpn", "k").collect()}
    assert got == want and want


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7]), (4, [0.0, 0.0]), (5, None)], "id long, v array<double>")
    got = [(r.rank, r.id) for r in nearest.nearest(rows, spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, vector array<double>"), 2, "id", "v").orderBy("rank").collect()]
    assert got == [(1, 1), (2, 3)]
    assert one(spark, search.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_stream(spark, tmp_path):
    source = spark.createDataFrame([(k, f"2024-01-01 00:{k % 60:02d}:00", k % 3, "view", 1.0) for k in range(90)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    source.write.parquet(f"{tmp_path}/in")
    stream = events.timed(events.read_stream(spark, f"{tmp_path}/in", source.schema.simpleString()[7:-1].replace(":", " ")))
    seen = []
    events.run_available(events.deduplicated(stream, ["event_id"]), f"{tmp_path}/cp", lambda df, n: seen.extend(r.event_id for r in df.collect()))
    assert sorted(seen) == list(range(90))
    events.run_available(events.deduplicated(stream, ["event_id"]), f"{tmp_path}/cp", lambda df, n: seen.extend(r.event_id for r in df.collect()))
    assert len(seen) == 90
    assert events.windowed(source, "10 minutes").agg(F.sum("n")).first()[0] == 90


@pytest.mark.parametrize("bad", ["", "DELETE FROM t", "DROP TABLE t", "SELECT 1; DROP TABLE t", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT * FROM a ASOF JOIN b", "SELECT * FROM parquet.`/x`", "SELECT reflect('java.lang.System', 'exit', 0)", "-- nothing", "SELECT '--', java_method('java.lang.System','getProperty','user.home')", "SELECT '--' AS a, value FROM text.`/etc/hostname`", "SELECT r'\\', java_method('java.lang.System', 'exit', r'')", "SELECT '/*', java_method('a', 'b') /* '*/", "SELECT `java_method`('a', 'b')"])
def test_gate_refuses(bad):
    with pytest.raises(ValueError):
        session.check_read_only(bad)


LEAKS = [
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')", "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'user.home')",
    "WITH x AS (SELECT * FROM identifier('text.`/etc/hostname`')) SELECT 1", "SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "EXPLAIN SELECT * FROM text.`/etc/hostname`", "DESCRIBE QUERY SELECT IDENTIFIER('reflect')('a', 'b')",
    "SELECT input_file_name() FROM gate", "SELECT current_user()", "SELECT TRANSFORM(a) USING 'cat' AS (x) FROM gate", "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')", "SHOW CREATE TABLE gate",
    "DELETE FROM gate", "DROP TABLE gate", "UPDATE gate SET a = 'x'", "INSERT INTO gate VALUES (1)", "COPY gate TO '/tmp/leak.csv'", "ATTACH '/etc/passwd' AS pw", "INSTALL httpfs", "SELECT 1; DROP TABLE gate", "SUMMARIZE elsewhere",
]


@pytest.mark.parametrize("bad", LEAKS)
def test_gate_refuses_what_the_plan_shows(spark, bad):
    session.register({"gate": spark.createDataFrame([(1,)], "a int")})
    with pytest.raises(ValueError):
        session.read_sql(spark, bad)


def test_gate_knows_registered_views_only(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("gate_stored")
    session.register({"gate": spark.createDataFrame([(1, [1, 2])], "a int, c array<int>")})
    with pytest.raises(ValueError, match="registered"):
        session.read_sql(spark, "SELECT * FROM gate, gate_stored")
    for good, n in (("SELECT * FROM gate, LATERAL explode(c) u", 2), ("SELECT (SELECT max(a) FROM gate) AS m FROM VALUES (1), (2) v(x)", 2), ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT * FROM r", 4), ("EXPLAIN SELECT a FROM gate", 1), ("DESCRIBE gate", 2)):
        assert session.read_sql(spark, good).count() == n
    spark.sql("DROP TABLE gate_stored")


def test_gate_allows(spark):
    assert session.read_sql(spark, "SELECT 'drop; load' AS x -- delete").first().x == "drop; load"
    assert session.read_sql(spark, "WITH a AS (SELECT ? AS y) SELECT y FROM a;", [3]).first().y == 3
    session.register({"t": spark.createDataFrame([(1, "x y")], "a int, b string")})
    session.register_functions(spark)
    assert session.read_sql(spark, "SELECT squeezed(b) AS s FROM `t` /* a -- b */ WHERE b <> '/*'").first().s == "xy"
    assert {r.summary: r.a for r in session.read_sql(spark, "SUMMARIZE t").collect()}["count"] == "1"
    assert [tuple(r) for r in session.read_sql(spark, "PRAGMA table_info('t')").collect()] == [("a", "int"), ("b", "string")]
    with pytest.raises(ValueError):
        session.read_sql(spark, "SELECT * FROM (SELECT (SELECT max(value) FROM `text`.`/etc/hostname`) AS x)")


def test_library_stands_without_corpus_operators(tmp_path):
    for name in ("catalith", "__spark_entry__.py"):
        source = f"{REPO}/{name}"
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op1') for q in e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert out.split()[1:] == ["False", "False"] and int(out.split()[0]) > 50


def test_prose_values_need_a_delimiter_and_a_long_alias(spark):
    rows = spark.createDataFrame([("Rated voltage: 24 V; Finish - matt.",), ("Rated voltage -25 V",), ("rated voltage and more",), ("overrated voltage: 3",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(extraction.prose_value(F.col("t"), "rated voltage")).collect()] == ["24 V", "-25 V", None, None, None, None]
    assert rows.select(extraction.prose_value(F.col("t"), "finish")).first()[0] == "matt"
    assert rows.select(extraction.prose_value(F.col("t"), "v")).first()[0] is None


def test_lenient_json(spark):
    texts = ['{"a": 1}', '```json\n{"a": [1, 2,]}\n```', 'so: {"a": {"b": "c', '{"a":', "none", "", None, '[1, {"x": "}"']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(extraction.repaired_json("t")).collect()]
    assert got == ['{"a":1}', '{"a":[1,2]}', '{"a":{"b":"c"}}', '{"a":null}', None, None, None, '[1,{"x":"}"}]']


def test_a_sticky_category_and_null_proposals(spark):
    now = spark.createDataFrame([(1, "pumps", 0.9), (2, "industrial.generic", 0.9), (3, "pumps", 0.5), (4, "pumps", 0.5)], "product_id int, category_id string, confidence double")
    new = spark.createDataFrame([(1, "fans", 1.0), (2, "fans", 0.95), (3, "fans", 0.5)], "product_id int, category_id string, confidence double")
    assert {r.product_id: r.category_id for r in detail.classified(now, new).collect()} == {1: "pumps", 2: "fans", 3: "pumps", 4: "pumps"}


def test_range_partners_keep_their_tail(spark):
    codes = spark.createDataFrame([("c", x) for x in ("t_min_c", "t_max_c", "t_max", "w_min", "w_max", "min", "admin")], "category_id string, code string")
    assert {(r.low_code, r.high_code) for r in detail.range_partners(codes).collect()} == {("t_min_c", "t_max_c"), ("w_min", "w_max")}
