"""Queries on tables whose keys, order or partitions aren't those of the small test tables."""

import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from catalith import registry
from catalith.operators import golden, graph, nearest, quality
from catalith.plans import catalog, catalog_queries, product_queries, stream_queries, view_queries  # noqa: F401  they register their queries
from catalith.streaming import arbitration


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of_sql(name, folder, *tables):
    """The query's SQL over the tables of the folder, on one thread, which reads rows in their order."""
    db = duckdb.connect()
    db.execute("SET threads=1")
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(db.execute(registry.ORACLE_SQL[name]).fetchall(), key=repr)


def test_upsert_with_keys_above_a_million(spark, tmp_path):
    rows = [(k, f"n{k}", float(k)) for k in (0, 1, 2, 11, 1000000, 1000001, 1000002, 1000011)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = rows_of(registry.QUERIES["jn_upsert"](spark, str(tmp_path)))
    assert found == rows_of_sql("jn_upsert", tmp_path, "part") and len(found) == 12


def test_means_at_the_bound_in_several_tasks(spark, tmp_path):
    taxes = [0.01, 0.08, 0.03, 0.07, 0.02, 0.05, 0.01, 0.06, 0.04, 0.03, 0.04]
    # each part has all of them in an order of its own, one after another in 4 files
    draw = random.Random(5)
    orders = [draw.sample(taxes, len(taxes)) for _ in range(300)]
    rows = [(part, own[turn]) for turn in range(len(taxes)) for part, own in enumerate(orders)]
    spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "l_partkey long, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() > 2
        found = rows_of(registry.QUERIES["agg_publish"](spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == rows_of_sql("agg_publish", tmp_path, "lineitem") and len({s for _, s in found}) == 2


def test_state_of_a_stream_needs_no_python(spark, tmp_path):
    schema = "product_id long, code string, obs_seq long, value_number double, value_text string, source_id long, source_kind string, method string, quote_verified boolean"
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}")
    plan = arbitration.arbitrated(stream)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Python" not in plan and "Pandas" not in plan


def test_pages_of_a_small_file_are_read_by_many_tasks(spark):
    for name in ("src_html_tables", "src_html_lists", "src_json_ld", "sql_page_fragments"):
        found = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert found.rdd.getNumPartitions() >= 4, name
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("ArrowEvalPythonUDTF") + plan.count("BatchEvalPythonUDTF") == 1, name


def test_pairs_of_one_family_are_made_by_several_tasks(spark):
    products = spark.range(60).select(F.lit("b").alias("base_id"), F.col("id").alias("product_id")).coalesce(1)
    pairs = graph.family_pairs(products).withColumn("task", F.spark_partition_id()).collect()
    assert len({(r.a, r.b) for r in pairs}) == len(pairs) == 60 * 59 // 2 and len({r.task for r in pairs}) > 1


def test_edges_are_dealt_by_edge_before_any_task_gathers_them(spark):
    plan = registry.QUERIES["gr_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "Aggregate" not in plan.optimizedPlan().toString() and plan.executedPlan().toString().count("Exchange") == 1
    assert "hashpartitioning(src" in plan.executedPlan().toString() and "REPARTITION_BY_NUM" in plan.executedPlan().toString()
    rows = [("a", "is", "b", None), ("a", "is", "b", 0.2), ("a", "is", "b", 0.7), ("a", "is", "c", None), (None, "is", "b", 1.0), ("a", "compatible_with", "b", 0.1), ("b", "compatible_with", "a", 0.3)]
    found = graph.closed(spark.createDataFrame(rows, "src string, predicate string, dst string, confidence double"))
    assert rows_of(found) == sorted([("a", "is", "b", 0.7), ("a", "is", "c", None), ("a", "compatible_with", "b", 0.3), ("b", "compatible_with", "a", 0.3)], key=repr)


def test_stats_count_edges_that_no_task_gathered_before(spark, tmp_path):
    spark.range(15).selectExpr("id AS p_partkey", "concat('T', id % 3) AS p_type", "concat('B', id % 2) AS p_brand", "id AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3000).selectExpr("id % 15 AS l_partkey", "id % 7 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES["gr_stats"](spark, str(tmp_path))
    below = found._jdf.queryExecution().optimizedPlan().toString().partition("RepartitionByExpression")[2]
    assert "Union" in below and "Aggregate" not in below
    assert rows_of(found) == rows_of_sql("gr_stats", tmp_path, "part", "lineitem")


def test_more_edges_are_dealt_to_more_tasks(spark, tmp_path):
    spark.range(900).selectExpr("id AS p_partkey", "concat('T', id % 3) AS p_type", "concat('B', id % 2) AS p_brand", "id AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3_200_000).selectExpr("id % 900 AS l_partkey", "id % 7 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    for name in ("gr_stats", "gr_edges"):
        found = registry.QUERIES[name](spark, str(tmp_path))
        # 3,200,000 rows and five edges of each part at most, half a million for a task
        assert re.findall(r"hashpartitioning\(src.*?, (\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString()) == ["7"]
        assert rows_of(found) == rows_of_sql(name, tmp_path, "part", "lineitem")
    edges = spark.createDataFrame([("a", "is", "b", 1.0)], "src string, predicate string, dst string, confidence double")
    assert [graph.closed(edges, rows).rdd.getNumPartitions() for rows in (0, 2_000_000, 2_000_001, 10**10)] == [4, 4, 5, 200]


def test_repeated_sources_and_certificates_give_one_edge(spark):
    products = spark.createDataFrame([("a", "x", "B"), ("a", "x", "B")], "product_id string, category_id string, base_id string")
    sources = spark.createDataFrame([("a", "s"), ("a", "s"), ("a", None)], "product_id string, source_id string")
    certs = spark.createDataFrame([("a", "CE", 0.2), ("a", "CE", 0.9), ("a", None, 1.0)], "product_id string, label string, confidence double")
    found = rows_of(graph.build(products, sources, certs))
    assert found == sorted([("a", "belongs_to", "x", 1.0), ("a", "variant_of", "B", 0.9), ("a", "documented_in", "s", 1.0), ("a", "certified_by", "cert:CE", 0.9), ("a", "compatible_with", "family:B", 0.6), ("family:B", "compatible_with", "a", 0.6)], key=repr)


def test_values_of_a_small_file_are_dealt_to_tasks(spark):
    found = registry.QUERIES["fn_normalize_values"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() >= 4 and "SortMergeJoin" not in plan


def test_keywords_that_a_text_does_not_hold_need_no_expression(spark):
    texts = spark.createDataFrame([(1, "A pump, pumps and pump"), (2, "none")], "id int, text string")
    found = quality.keyword_category(texts, "id", "text", {"pumps": ["pump"], "valves": ["valve"]})
    assert [(r.category, r.score) for r in found.orderBy("id").collect()] == [("pumps", 3.0), ("industrial.generic", 0.0)]
    assert "contains(" in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_probed_queries_leave_python_in_small_batches():
    vectors = np.random.default_rng(1).normal(size=(2000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(vectors.tolist())], ["id", "vector"])
    found = list(nearest._probed(vectors[:20], 10)([batch]))
    assert max(b.num_rows for b in found) <= 256 * 10 and sum(b.num_rows for b in found) == 2000 * 10
    # each in the list of its nearest centroid
    first = np.concatenate([b.column(0).to_numpy()[::10] for b in found])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert (first == (unit @ vectors[:20].T).argmax(1)).all()


def test_profile_is_checked_by_many_tasks(spark):
    found = registry.QUERIES["agg_profile"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # neither all values of a column nor rows repeated for each column meet in one task
    assert "percentile(" not in plan and "Expand" not in plan
    assert all(r.distinct_close and r.middle_close for r in found.collect()) and found.count() == 6


def test_profile_check_sees_a_wrong_middle(spark):
    rows = spark.createDataFrame([(float(i), 1.0, 0.5, i, "a", "b") for i in range(100)], view_queries._PROFILED)
    for middle, below, up_to in ((30.0, 30, 31), (49.5, 50, 50)):
        at = spark.createDataFrame([(middle, 1.0, 0.5, 0)], [f"m_{c}" for c in view_queries._PROFILED[:4]])
        got = {r.column_name: r for r in view_queries._checked(rows, at).collect()}
        assert (got["l_quantity"].exact, got["l_quantity"].filled, got["l_quantity"].below, got["l_quantity"].up_to) == (100, 100, below, up_to)
        assert (got["l_linestatus"].exact, got["l_linestatus"].filled) == (1, None) and len(got) == 6


def test_arbitration_deals_rows_by_their_key_once(spark):
    # after the shuffle for their order of arrival, texts go through one for groups, winners and rules
    texts = golden.text_groups(catalog.text_observations(spark, "/root/testdata/sf0.001"))
    assert golden.winners(texts)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    for name in ("agg_arbitrate_text", "golden_records", "agg_conflicts"):
        assert rows_of(registry.QUERIES[name](spark, "/root/testdata/sf0.001")) == sorted(duckdb_rows(name), key=repr)


def test_arbitration_stream_keeps_little_on_disk(spark, monkeypatch):
    exchange = catalog.observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().partition("Exchange ")[2]
    assert exchange and "datasheet" not in exchange and "discount AS code" not in exchange
    folder, parts, remove = f"{spark.conf.get('spark.checkpoint.dir')}/catalog/{spark.sparkContext.applicationId}", [], stream_queries.removed
    files: list[int] = []

    def removed(session, *paths):
        files.extend(len([f for f in os.listdir(f"{p}/landed/{k}") if f.endswith(".parquet")]) for p in paths for k in range(2) if os.path.isdir(f"{p}/landed") and not os.path.isdir(f"{p}/whole"))
        parts.extend(len(os.listdir(f"{p}/state/0")) - 1 for p in paths if os.path.isdir(f"{p}/state/0"))
        remove(session, *paths)

    monkeypatch.setattr(stream_queries, "removed", removed)
    monkeypatch.setattr(stream_queries, "TASK_ROWS", 1000)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = registry.QUERIES["st_arbitration"](spark, "/root/testdata/sf0.001")
    # of 6000 rows, a task for each thousand; neither the state nor the stream's files stay
    assert parts == [6] and files == [6, 6] and {n.rpartition("-")[0] for n in set(os.listdir(folder)) - before} == {"records"}
    # both batches have changed most keys
    records = spark.read.parquet(next(f"{folder}/{n}" for n in set(os.listdir(folder)) - before))
    assert records.select("product_id", "batch").distinct().groupBy("product_id").count().where("count = 2").count() > 150
    # what tells an entry apart isn't kept again with its best observation
    assert "precedence" not in records.columns and not {"source_id", "obs_seq"} & set(records.schema["best"].dataType.names)
    assert rows_of(found) == sorted(duckdb_rows("st_arbitration"), key=repr)


def test_summaries_restore_what_they_leave_out(spark):
    schema = "product_id long, code string, obs_seq long, value_number double, value_text string, value_list array<string>, source_id long, source_kind string, method string, quote_verified boolean"
    rows = [
        (1, "x", 2, -0.0, "none", None, 7, "catalog", "structured_feed", True), (1, "x", 1, 0.0, None, None, 7, "catalog", "ocr", True),
        (2, "x", 1, 5.0, "five", None, None, "catalog", "ocr", None), (2, "x", 2, 5.0, " 5", None, None, "datasheet", "ocr", None), (2, "x", 3, 5.0, None, None, 8, None, "human", False), (2, "x", 4, 5.0, "V", None, 8, None, "human", None),
        (3, "x", 1, None, " ", ["b", "a"], 9, None, None, None), (3, "x", 2, None, "a", None, 9, None, None, None),
    ]
    for some in (rows, rows[:4], rows[1:2] + rows[6:]):
        seen = spark.createDataFrame(some, schema)
        summed, want = golden.summaries(seen), golden.golden_records(seen)
        found = golden.confidence(golden.decided(golden.group_stats(summed))).select(*want.columns)
        assert [tuple(map(str, r)) for r in found.orderBy("product_id").collect()] == [tuple(map(str, r)) for r in want.orderBy("product_id").collect()]
        assert "-0.0" in str(found.collect()) or len(some) == 3


def duckdb_rows(name):
    db = duckdb.connect()
    for t in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return db.execute(registry.ORACLE_SQL[name]).fetchall()
