"""Queries of extraction, product views and rankings over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import extraction
from catalith.operators import detail, golden, quality, review
from catalith.plans import catalog
from catalith.plans.catalog import ATTRIBUTES_SQL, METHOD_SQL, OBSERVATIONS_SQL, PRECEDENCE_SQL, PRODUCTS_SQL, table
from catalith.registry import query
from catalith.session import read_sql


def _key() -> Column:
    return F.col("p_partkey")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# extraction

_FILES = "CASE p_partkey % 5 WHEN 0 THEN 'Hero-' WHEN 1 THEN 'wiring_' WHEN 2 THEN 'dim-alt-' ELSE 'IMG_' END || p_partkey || '.png'"


@query("src_shot_type", f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'hero' WHEN p_partkey % 5 = 1 THEN 'line_drawing' WHEN p_partkey % 5 = 2 THEN 'dimension' WHEN p_size / 50.0 > 0.82 AND p_size % 20 < 12 THEN 'line_drawing' WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 20 >= 12 THEN 'hero' ELSE 'unknown' END ELSE 'lifestyle' END AS shot, {_FILES} AS file_name FROM part")
def src_shot_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(_key() % 5 == 0, "Hero-").when(_key() % 5 == 1, "wiring_").when(_key() % 5 == 2, "dim-alt-").otherwise("IMG_")
    rows = table(spark, sf_dir, "part").withColumn("file_name", _text(prefix, _key(), ".png"))
    shot = extraction.shot_type(F.col("file_name"), F.col("p_size") / 50.0, F.col("p_size") % 20, F.when(F.col("p_size") % 3 == 0, "white").otherwise("non-white"))
    return rows.select("p_partkey", shot.alias("shot"), "file_name")


@query("ext_orientation", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN 'variant_matrix' ELSE 'label_value' END AS orientation FROM part")
def ext_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(_key() % 4 == 0, " Part Number").otherwise("Voltage")
    header = F.when(F.col("p_size") % 2 == 0, F.array(first, F.lit("Width"), F.lit("Height"))).otherwise(F.array(first, F.lit("Width")))
    return table(spark, sf_dir, "part").select("p_partkey", extraction.table_orientation(F.array(header, F.array(F.lit("a"), F.lit("1"), F.lit("2")))).alias("orientation"))


@query("ext_prose_values", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_size || ' mm' END AS width, p_name AS finish, NULL::VARCHAR AS od FROM part")
def ext_prose_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = _text(F.col("p_size"), " mm")
    width = F.when(_key() % 4 == 0, _text("Overall width: ", size)).when(_key() % 4 == 1, _text("OVERALL WIDTH ", size)).when(_key() % 4 == 2, _text("overall width - ", _text("", size))).otherwise(_text("bandwidth: 3; overall width of ", size))
    text = F.when(_key() % 4 == 2, _text("overall width  ", size)).otherwise(width)
    text = _text(text, "; od: 4 | Finish: ", F.col("p_name"), ".\nmade here")
    return table(spark, sf_dir, "part").select("p_partkey", extraction.prose_value(text, "overall width").alias("width"), extraction.prose_value(text, "finish").alias("finish"), extraction.prose_value(text, "od").alias("od"))


@query("ext_range_emit", "SELECT p_partkey, 'temp_min_c' AS code, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'temp_max_c', p_size + 5.0::DOUBLE FROM part")
def ext_range_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text(F.col("p_size") + 5, " to ", F.col("p_size"), " C")
    ends = extraction.range_observations(F.lit("temp_min_c"), F.lit("temp_max_c"), text)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(ends).alias("e")).select("p_partkey", "e.*")


@query("ext_range_partner", "WITH d AS (SELECT DISTINCT p_type AS category_id, 'size' || (p_size % 3) AS stem FROM part) SELECT category_id, stem || '_min' AS low_code, stem || '_max' AS high_code FROM d WHERE stem <> 'size1' UNION ALL SELECT DISTINCT category_id, 'temp_min_c', 'temp_max_c' FROM d")
def ext_range_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = table(spark, sf_dir, "part").select(F.col("p_type").alias("category_id"), (F.col("p_size") % 3).alias("k"))
    stem = F.concat(F.lit("size"), F.col("k").cast("string"))
    high = F.when(F.col("k") != 1, F.concat(stem, F.lit("_max")))
    codes = F.array_compact(F.array(F.concat(stem, F.lit("_min")), high, F.lit("temp_min_c"), F.lit("temp_max_c"), F.lit("temp_max"), F.lit("admin")))
    return detail.range_partners(kind.select("category_id", F.explode(codes).alias("code")).distinct())


@query("ext_identity_observations", "WITH p AS (SELECT p_partkey AS product_id, 'src_' || p_size AS source_id, p_brand AS manufacturer, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS mpn, ' ' AS series FROM part) SELECT product_id, source_id, 'mpn' AS code, mpn AS value_text FROM p WHERE mpn IS NOT NULL UNION ALL SELECT product_id, source_id, 'manufacturer', manufacturer FROM p WHERE product_id % 2 = 1")
def ext_identity_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(_key().alias("product_id"), _text("src_", F.col("p_size")).alias("source_id"), F.col("p_brand").alias("manufacturer"), F.when(_key() % 3 != 0, F.col("p_name")).alias("mpn"), F.lit(" ").alias("series"))
    return detail.identity_observations(p, p.where("product_id % 2 = 0").select("product_id", "source_id", F.lit("manufacturer").alias("code"))).select("product_id", "source_id", "code", "value_text")


_RANKED = "SELECT source, doc_id, (contains(b, 'der')::INT + contains(b, 'the')::INT + contains(b, 'que')::INT) * CASE WHEN doc_id % 3 = 0 THEN 1.4::DOUBLE ELSE 1 END AS raw FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS b FROM documents)"


@query("win_fragment_rank", f"WITH s AS (SELECT source AS product_id, doc_id AS fragment_id, floor(raw * 10000 + 0.5) / 10000 AS score FROM ({_RANKED})) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, fragment_id) AS place FROM s WHERE score > 0) WHERE place <= 12")
def win_fragment_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = table(spark, sf_dir, "documents").select(F.col("source").alias("product_id"), F.col("doc_id").alias("fragment_id"), F.when(F.col("doc_id") % 3 == 0, "table").otherwise("text").alias("kind"), "text")
    return detail.ranked_fragments(fragments, ["der", "the", "que", "el"])


@query("cls_sticky", "SELECT p_partkey AS product_id, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 AND p_size > 25 THEN 'new' WHEN p_partkey % 3 = 2 AND p_size > 45 THEN 'new' WHEN p_partkey % 3 = 2 THEN 'industrial.generic' ELSE p_type END AS category_id FROM part")
def cls_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(_key() % 3 == 2, "industrial.generic").otherwise(F.col("p_type"))
    now = p.select(_key().alias("product_id"), kind.alias("category_id"), F.when(_key() % 3 == 1, 0.5).otherwise(0.9).alias("confidence"))
    return detail.classified(now, p.select(_key().alias("product_id"), F.lit("new").alias("category_id"), (F.col("p_size") / 50).alias("confidence"))).select("product_id", "category_id")


# functions


@query("fn_boolean", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS value FROM part")
def fn_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(_key() % 4 == 0, " Included").when(_key() % 4 == 1, "NOT INCLUDED").when(_key() % 4 == 2, "maybe")
    return table(spark, sf_dir, "part").select("p_partkey", extraction.truth(word).alias("value"))


@query("fn_bounded_text", "SELECT p_partkey, CASE WHEN length(t) > 18 THEN rtrim(left(t, 18)) || '...' ELSE t END AS shown, CASE WHEN p_size < 5 THEN 'below minimum' WHEN p_size > 40 THEN 'above maximum' END AS error FROM (SELECT *, p_brand || ' ' || p_name AS t FROM part)")
def fn_bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), "p_brand", F.lit(" \n "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", extraction.bounded_text(text, 18).alias("shown"), extraction.bound_error(F.col("p_size"), F.lit(5), F.lit(40)).alias("error"))


@query("fn_json_repair", "SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE '{\"name\":\"' || p_name || '\",\"sizes\":[1,' || p_size || ']' || CASE WHEN p_partkey % 5 = 3 THEN ',\"more\":null' ELSE '' END || '}' END AS value FROM part")
def fn_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _text('{"name": "', F.col("p_name"), '", "sizes": [1, ', F.col("p_size"))
    text = F.when(_key() % 5 == 0, _text("```json\n", body, "]}\n```")).when(_key() % 5 == 1, _text("Here it is: ", body, ",],} done")).when(_key() % 5 == 2, body).when(_key() % 5 == 3, _text(body, '], "more":')).otherwise("nothing")
    return table(spark, sf_dir, "part").select("p_partkey", extraction.repaired_json(text).alias("value"))


@query("fn_highlight_offset", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 1 THEN CASE WHEN n > 20 AND floor(n * 0.6::DOUBLE) <= n - 10 THEN 3 END ELSE 3 + length(p_brand) + 3 END::INT AS place FROM (SELECT *, length(regexp_replace(p_brand || p_name, '[^A-Za-z0-9]', '', 'g')) + 10 AS n FROM part)")
def fn_highlight_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("-- "), "p_brand", F.lit(" : "), "p_name", F.lit("!"))
    quote = F.when(_key() % 3 == 0, F.upper("p_name")).when(_key() % 3 == 1, F.concat("p_brand", F.lit("  "), "p_name", F.lit(" and 12 words"))).otherwise("zzqq")
    return table(spark, sf_dir, "part").select("p_partkey", extraction.highlight_offset(quote, text).cast("int").alias("place"))


_SOURCE = f"0.65::DOUBLE + 0.35::DOUBLE * ({PRECEDENCE_SQL}) / 100"
_CONFIDENCE = f"(1 - 1.0::DOUBLE * (1 - {METHOD_SQL})) * (1 - 1.0::DOUBLE * (1 - CASE WHEN quote_verified THEN 1 ELSE 0.65::DOUBLE END)) * (1 - 0.6::DOUBLE * (1 - ({_SOURCE}))) * (1 - 0.8::DOUBLE * (1 - 0.9::DOUBLE))"


@query("agg_confidence", f"SELECT product_id, obs_seq, floor({_CONFIDENCE} * 10000 + 0.5) / 10000 AS confidence FROM ({OBSERVATIONS_SQL})")
def agg_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = catalog.observations(spark, sf_dir).withColumns({"agreeing": F.lit(1), "disagreeing": F.lit(0)})
    return golden.confidence(alone).select("product_id", "obs_seq", "confidence")


@query("flt_rule_expr", f"SELECT product_id, size * 20.0 <= price AS fits, category_id = 'PROMO' AS promo, size <> 7 AS other, NULL::BOOLEAN AS unparsed FROM ({PRODUCTS_SQL})")
def flt_rule_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.products(spark, sf_dir)
    rule = {"fits": "size * 20 <= price", "promo": "category_id == 'PROMO'", "other": "size != 7", "unparsed": "size between 1"}
    return p.select("product_id", *[quality.rule_condition(e, p.columns).alias(n) for n, e in rule.items()])


@query("flt_filled", "SELECT p_partkey FROM part WHERE p_partkey % 4 IN (0, 3)")
def flt_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, text = F.when(_key() % 4 == 0, 0.0), F.when(_key() % 4 == 1, "").when(_key() % 4 == 3, F.col("p_name"))
    return table(spark, sf_dir, "part").where(quality.is_filled(number, text)).select("p_partkey")


# views

_NAMES = "SELECT 'src_' || s_suppkey AS source_id, s_name AS name FROM supplier"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(_text("src_", F.col("s_suppkey")).alias("source_id"), F.col("s_name").alias("name"))


@query("prj_evidence_view", f"SELECT product_id, code, coalesce(name, a.source_id) AS source_name FROM ({ATTRIBUTES_SQL}) a LEFT JOIN ({_NAMES}) n ON n.source_id = a.source_id")
def prj_evidence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.evidence_view(catalog.attributes(spark, sf_dir), _sources(spark, sf_dir)).select("product_id", "code", "source_name")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(F.struct(F.lit("documented_in").alias("predicate"), _text("src_", _key() % 10).alias("dst")), F.struct(F.lit("certified_by").alias("predicate"), _text("cert:", F.col("p_type")).alias("dst")), F.struct(F.lit("variant_of").alias("predicate"), F.floor(_key() / 2).cast("string").alias("dst")))
    return table(spark, sf_dir, "part").select(_key().cast("string").alias("src"), F.explode(ends).alias("e")).select("src", "e.*")


@query("prj_relations", f"SELECT p_partkey::VARCHAR AS src, 'documented_in' AS predicate, coalesce(name, 'src_' || (p_partkey % 10)) AS label FROM part LEFT JOIN ({_NAMES}) ON source_id = 'src_' || (p_partkey % 10) UNION ALL SELECT p_partkey::VARCHAR, 'certified_by', p_type FROM part UNION ALL SELECT p.p_partkey::VARCHAR, 'variant_of', coalesce(q.p_name, (p.p_partkey // 2)::VARCHAR) FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey // 2 AND q.p_partkey % 2 = 0")
def prj_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(_key().cast("string").alias("product_id"), F.col("p_name").alias("mpn"))
    return detail.relations(_edges(spark, sf_dir), known, _sources(spark, sf_dir)).select("src", "predicate", "label")


@query("prj_product_detail", f"WITH a AS (SELECT product_id, string_agg(code, ',' ORDER BY CASE WHEN generated THEN 4 WHEN variant_defining THEN 1 WHEN code = 'name' THEN 2 ELSE 3 END, code) AS codes FROM ({ATTRIBUTES_SQL}) GROUP BY ALL) SELECT p_partkey AS product_id, codes, 3 AS relations, CASE WHEN p_partkey % 2 = 0 THEN 1 END AS assets FROM part LEFT JOIN a ON product_id = p_partkey")
def prj_product_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = detail.display_rank(F.col("code"), F.col("generated"), F.col("variant_defining"), F.col("code") == "name")
    attributes = catalog.attributes(spark, sf_dir).withColumn("rank", rank)
    products = catalog.products(spark, sf_dir).select("product_id", "manufacturer")
    none = attributes.where("false").select("product_id", "code", F.lit("").alias("rule"), F.lit("").alias("severity"))
    edges = _edges(spark, sf_dir).withColumn("src", F.col("src").cast("long"))
    assets = products.where("product_id % 2 = 0").select("product_id", _text("a", F.col("product_id")).alias("asset_id"))
    found = detail.product_detail(products, attributes, none, edges, assets)
    return found.select("product_id", F.array_join("attributes.code", ",").alias("codes"), F.array_size("relations").alias("relations"), F.array_size("assets").alias("assets"))


_WINNER = f"SELECT source_id FROM (SELECT * FROM ({OBSERVATIONS_SQL}) WHERE product_id = 7 AND source_kind IS NOT NULL) ORDER BY {PRECEDENCE_SQL} DESC, {METHOD_SQL} DESC, obs_seq LIMIT 1"


@query("prj_observations", f"SELECT obs_seq, source_id, discount AS value_number, source_id = ({_WINNER}) AS won FROM ({OBSERVATIONS_SQL}) WHERE product_id = 7")
def prj_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one observation in a group of its own each: the best source and method decide
    seen = catalog.observations(spark, sf_dir)
    records = golden.winners(seen.where("product_id = 7").withColumn("grp", F.col("obs_seq")))
    return detail.drill_down(seen, records, 7, "discount").select("obs_seq", "source_id", "value_number", "won")


@query("prj_show", f"SELECT product_id, code, CASE WHEN generated THEN 'GEN' ELSE 'SRC' END AS tag, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM ({ATTRIBUTES_SQL})")
def prj_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.shown(catalog.attributes(spark, sf_dir)).select("product_id", "code", "tag", "band")


@query("prj_schema_detail", "WITH a AS (SELECT DISTINCT p_type AS code, p_name AS alias FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY alias) AS r FROM a) SELECT code, string_agg(alias, ',' ORDER BY alias) AS aliases FROM r WHERE r <= 8 GROUP BY code")
def prj_schema_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("code"), F.col("p_name").alias("alias"))
    return detail.schema_detail(p.select("code").distinct(), p).select("code", F.array_join("aliases", ",").alias("aliases"))


@query("dct_required", "WITH d AS (SELECT DISTINCT p_type AS category_id, 'size_' || (p_size % 4) AS code, p_size % 4 AS k FROM part WHERE p_size % 4 < 3) SELECT category_id, code, channel FROM d, (VALUES (0, 'core'), (1, 'ecommerce'), (2, 'enhanced')) c(n, channel) WHERE n >= k")
def dct_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    own = F.when(k == 0, "core").when(k == 1, "ecommerce").when(k == 2, "enhanced").otherwise("none")
    return detail.required_codes(table(spark, sf_dir, "part").select(F.col("p_type").alias("category_id"), _text("size_", k).alias("code"), own.alias("channel")).distinct())


@query("win_bare_quantity", "SELECT p_brand AS unit_family, p_partkey AS code FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 45) DESC, (p_size > 30) DESC, (p_size % 2 = 0) DESC, p_partkey) AS r FROM part WHERE p_partkey % 5 <> 0) WHERE r = 1")
def win_bare_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("unit_family"), _key().alias("code"), _key().alias("pos"), (size > 45).alias("variant_defining"), (size > 30).alias("required_core"), (size % 2 == 0).alias("required_ecommerce"), (_key() % 5 == 0).alias("generated"))
    return detail.bare_quantity_codes(d).select("unit_family", "code")


@query("sem_lookup", "SELECT CASE p_partkey % 3 WHEN 0 THEN 'prod_' || p_partkey WHEN 1 THEN 'MPN: X-' || p_partkey ELSE 'none ' || p_partkey END AS asked, CASE WHEN p_partkey % 3 < 2 THEN 'prod_' || p_partkey END AS product_id FROM part")
def sem_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    asked = F.when(_key() % 3 == 0, _text("prod_", _key())).when(_key() % 3 == 1, _text("MPN: X-", _key())).otherwise(_text("none ", _key()))
    return detail.looked_up(p.select(asked.alias("asked")), p.select(_text("prod_", _key()).alias("product_id"), _text("x", _key()).alias("mpn")))


@query("enr_content_confidence", "SELECT l_partkey AS product_id, CASE WHEN l_partkey % 3 = 0 THEN floor(s * 0.5 * 10000 + 0.5) / 10000 ELSE s END AS confidence FROM (SELECT l_partkey, floor(coalesce(avg(CASE WHEN l_linenumber > 2 THEN l_linenumber / 8.0::DOUBLE END), 0.5::DOUBLE) * 0.85::DOUBLE * 10000 + 0.5) / 10000 AS s FROM lineitem GROUP BY ALL)")
def enr_content_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber") / 8).otherwise(0.0).alias("confidence"))
    return detail.content_confidence(facts, facts.where("product_id % 3 = 0"))


@query("rev_apply_correction", "SELECT p_partkey AS product_id, 'discount' AS code, 0.5::DOUBLE AS value_number, 'human:ann' AS source_id FROM part WHERE p_partkey % 9 = 0")
def rev_apply_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = catalog.observations(spark, sf_dir).withColumn("source_id", F.col("source_id").cast("string"))
    p = table(spark, sf_dir, "part").where("p_partkey % 9 = 0").select(_key().alias("product_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("correction_seq"))
    corrections = p.select("product_id", F.lit("discount").alias("code"), "correction_seq", (F.col("correction_seq") / 4).alias("value_number"), F.lit(None).cast("string").alias("value_text"), F.lit("ann").alias("reviewer"))
    return golden.last_human(review.corrected(seen, corrections)).select("product_id", "code", "value_number", "source_id")


@query("rev_learned_synonyms", "WITH s AS (SELECT 'kind' AS code, lower(p_name) AS synonym, p_type AS value, count(*) AS times FROM part GROUP BY ALL) SELECT code, synonym, value, times FROM (SELECT *, row_number() OVER (PARTITION BY code, synonym ORDER BY times DESC, value) AS r FROM s) WHERE r = 1 AND times >= 2")
def rev_learned_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    corrections = table(spark, sf_dir, "part").select(F.lit("kind").alias("code"), F.concat(F.lit(" "), F.upper("p_name")).alias("old_value"), F.col("p_type").alias("new_value"))
    return detail.learned_synonyms(corrections, 2)


@query("agg_status_counts", "SELECT 'status' AS kind, o_orderstatus AS value, count(*) AS n, count(DISTINCT o_custkey) AS products FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*), count(DISTINCT o_custkey) FROM orders GROUP BY ALL")
def agg_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.struct(F.lit("status").alias("kind"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("value")))
    return table(spark, sf_dir, "orders").select("o_custkey", F.inline(kinds)).groupBy("kind", "value").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("products"))


# SQL


def _sql(name: str, statement: str, duck: str | None = None, args: list | None = None) -> None:
    @query(name, duck or statement)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in ("part", "orders", "customer", "supplier", "nation", "lineitem"):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return read_sql(spark, statement, args)


_sql("sql_frames", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS quarter, percent_rank() OVER (PARTITION BY p_type ORDER BY p_size) AS share, cume_dist() OVER (PARTITION BY p_type ORDER BY p_size) AS below, lead(p_partkey, 2) OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS second FROM part")
_sql("sql_lateral", "SELECT n_nationkey, s_suppkey, s_acctbal FROM nation, LATERAL (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) t")
_sql("sql_correlated", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_type = p.p_type) AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
_sql("sql_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 1000) AS large, count(DISTINCT o_custkey) FILTER (WHERE o_orderkey % 2 = 0) AS even_customers FROM orders GROUP BY ALL")
_sql("sql_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 4 GROUP BY c_nationkey) b ON a.k = b.k")
_sql("sql_ranked_subquery", "SELECT * FROM (SELECT p_type, p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) AS r FROM part) WHERE r <= 3", "SELECT p_type, p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) AS r FROM part QUALIFY r <= 3")
_sql("sql_bound_parameters", "SELECT p_partkey FROM part WHERE p_size >= ? AND lower(p_brand) = lower(?)", "SELECT p_partkey FROM part WHERE p_size >= 20 AND lower(p_brand) = 'brand#5'", [20, "BRAND#5"])
_sql("sql_except_columns", "SELECT * EXCEPT (p_retailprice, p_size) FROM part", "SELECT * EXCLUDE (p_retailprice, p_size) FROM part")
