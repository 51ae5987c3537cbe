"""Queries of validation, flags, listings, exports, families and intake over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith import session
from catalith.functions import identity, values
from catalith.operators import extract, golden, graph, intake, listing, quality, review, search, validate
from catalith.plans import catalog
from catalith.plans.catalog import ATTRIBUTES_SQL, OBSERVATIONS_SQL, PRODUCTS_SQL, table
from catalith.registry import query
from catalith.sinks import exports
from catalith.sources import pages
from catalith.sources.kept import spread


def _key() -> Column:
    return F.col("p_partkey")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# values by their definition

_RAW = """raw AS (SELECT p_partkey, 'width' AS code, p_size || CASE p_partkey % 3 WHEN 0 THEN ' mm' WHEN 1 THEN ' in' ELSE '' END AS raw FROM part UNION ALL SELECT p_partkey, 'color', p_name FROM part UNION ALL SELECT p_partkey, 'kinds', p_type || '; ' || p_brand || ';' FROM part
UNION ALL SELECT p_partkey, 'title', '  ' || p_brand || '  ' || p_name FROM part UNION ALL SELECT p_partkey, 'stock', CASE p_size % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no ' ELSE p_name END FROM part)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    unit = F.when(_key() % 3 == 0, " mm").when(_key() % 3 == 1, " in").otherwise("")
    stock = F.when(size % 3 == 0, "Yes").when(size % 3 == 1, "no ").otherwise(F.col("p_name"))
    cells = {"width": _text(size, unit), "color": F.col("p_name"), "kinds": _text(F.col("p_type"), "; ", F.col("p_brand"), ";"), "title": _text("  ", F.col("p_brand"), "  ", F.col("p_name")), "stock": stock}
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select("p_partkey", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), v.alias("raw")) for c, v in cells.items()])).alias("c")).select("p_partkey", "c.*")
    definitions = [
        ("width", "number", "single", "length", "mm", 5.0, 600.0, None, None, None),
        ("color", "enum", "single", None, None, None, None, ["Red", "Blue", "Steel"], None, None),
        ("kinds", "string", "multi", None, None, None, None, None, None, None),
        ("title", "string", "single", None, None, None, None, None, 16, "Brand#1"),
        ("stock", "boolean", "single", None, None, None, None, None, None, None),
    ]
    schema = "code string, " + ", ".join(f"{n} {k}" for n, k in values.DEFINITION.items())
    # five definitions: a join by shuffle would give each code's rows to one task
    return rows.join(F.broadcast(spark.createDataFrame(definitions, schema)), "code")


@query("fn_normalize_values", f"""WITH {_RAW}, n AS (SELECT p_partkey, code, raw, p_size, CASE WHEN code = 'width' THEN p_size * CASE WHEN p_partkey % 3 = 1 THEN 25.4::DOUBLE ELSE 1 END END AS v FROM raw JOIN part USING (p_partkey))
SELECT p_partkey, code, floor(v * 1000000 + 0.5) / 1000000 AS value_number,
 CASE code WHEN 'color' THEN CASE WHEN contains(raw, 'red') THEN 'Red' WHEN contains(raw, 'blue') THEN 'Blue' WHEN contains(raw, 'steel') THEN 'Steel' WHEN contains(raw, 'green') THEN 'Blue' END
   WHEN 'title' THEN CASE WHEN length(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) > 16 THEN rtrim(left(trim(regexp_replace(raw, '\\s+', ' ', 'g')), 16)) || '...' ELSE trim(regexp_replace(raw, '\\s+', ' ', 'g')) END END AS value_text,
 CASE WHEN code = 'stock' THEN CASE WHEN lower(trim(raw)) = 'yes' THEN true WHEN lower(trim(raw)) = 'no' THEN false END END AS value_boolean,
 CASE WHEN code = 'kinds' THEN (SELECT p_type || '|' || p_brand FROM part q WHERE q.p_partkey = n.p_partkey) END AS value_list,
 CASE WHEN code = 'width' THEN 'mm' END AS unit,
 CASE WHEN code = 'width' AND v < 5 THEN 1 WHEN code = 'width' AND v > 600 THEN 1 WHEN code = 'color' AND NOT regexp_matches(raw, 'red|blue|steel|green') THEN 1 WHEN code = 'title' AND NOT regexp_matches(trim(raw), '^Brand#1') THEN 1 WHEN code = 'stock' AND lower(trim(raw)) NOT IN ('yes', 'no') THEN 1 ELSE 0 END AS errors,
 code = 'width' AND p_partkey % 3 = 2 AS unit_assumed FROM n""")
def fn_normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values.normalized(_raw(spark, sf_dir), synonyms={"green": "Blue"})
    return found.select("p_partkey", "code", "value_number", "value_text", "value_boolean", F.array_join("value_list", "|").alias("value_list"), "unit", F.size("errors").alias("errors"), "unit_assumed")


# validation and flags

_DEFINITIONS = [("size", "number", None), ("name", "enum", ["red widget", "blue bolt", "small ring"])]
_EVIDENCE_SQL = f"""products AS ({PRODUCTS_SQL}), records AS (SELECT a.*, CASE WHEN a.product_id % 6 = 0 THEN 'not plausible' END AS error, CASE WHEN a.product_id % 9 = 0 THEN NULL ELSE 'src_' || (a.product_id % 10) END AS source FROM ({ATTRIBUTES_SQL}) a)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.attributes(spark, sf_dir)
    k = F.col("product_id")
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "errors": F.when(k % 6 == 0, F.array(F.lit("not plausible"))).otherwise(none), "notes": F.when(F.col("generated") & (k % 2 == 0), F.array(F.lit("Unverified figure 7"))).otherwise(none), "strategy": F.lit(None).cast("string"),
        "source_id": F.when(k % 9 != 0, F.col("source_id")), "reasons": F.array(F.lit("a"), F.lit("b"), F.lit("c")),
    })


@query("val_product_issues", f"""WITH {_EVIDENCE_SQL}
SELECT product_id, NULL::VARCHAR AS code, 'error' AS level, 'identity' AS kind, 'product has no manufacturer part number' AS message FROM products WHERE product_id % 11 = 0 UNION ALL
SELECT product_id, code, 'warning', 'undefined', code || ': not defined in the ''' || category_id || ' parts'' attribute set' FROM records JOIN products USING (product_id) WHERE code = 'price' UNION ALL
SELECT product_id, code, 'error', 'value', code || ': ' || error FROM records WHERE code <> 'price' AND error IS NOT NULL UNION ALL
SELECT product_id, code, 'error', 'not_allowed', code || ': ''' || value_text || ''' is not an allowed value' FROM records WHERE code = 'name' AND value_text NOT IN ('red widget', 'blue bolt', 'small ring') UNION ALL
SELECT product_id, code, 'warning', 'ungrounded', code || ': value has no evidence and no declared inference' FROM records WHERE code <> 'price' AND source IS NULL AND NOT (generated AND product_id % 2 = 0) UNION ALL
SELECT product_id, NULL, 'error', 'rule', 'rule fits: size is larger than the price allows' FROM products WHERE size * 30 >= price UNION ALL
SELECT product_id, 'size', 'warning', 'conflict', 'size: sources disagree (corroboration)' FROM products WHERE product_id % 14 = 0""")
def val_product_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.products(spark, sf_dir)
    kinds = p.select("category_id").distinct()
    definitions = kinds.crossJoin(F.broadcast(spark.createDataFrame(_DEFINITIONS, "code string, datatype string, allowed array<string>")))
    named = p.withColumn("mpn", F.when(F.col("product_id") % 11 != 0, F.col("product_name")))
    rules = quality.evaluate_rules(p, {"fits": quality.rule_condition("size * 30 < price", p.columns)}).withColumn("message", F.lit("size is larger than the price allows"))
    conflicts = p.where("product_id % 7 = 0").select("product_id", F.lit("size").alias("code"), F.when(F.col("product_id") % 2 == 0, "critical").otherwise("warning").alias("severity"), F.lit("corroboration").alias("rule"))
    return validate.product_issues(named, _records(spark, sf_dir), definitions, kinds.select("category_id", _text(F.col("category_id"), " parts").alias("category_name")), rules=rules, conflicts=conflicts)


@query("val_quotes", "WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 50) WHEN 1 THEN 'qq' || doc_id || 'xx not there' ELSE substr(text, 1, 3) END AS quote, CASE WHEN doc_id % 5 = 0 THEN 'gone' ELSE doc_id::VARCHAR END AS source_id FROM documents), q AS (SELECT * FROM d WHERE quote <> '') SELECT doc_id AS product_id, CASE WHEN source_id = 'gone' THEN 'mirror' ELSE 'quote' END AS kind FROM q WHERE source_id = 'gone' OR doc_id % 4 = 1 OR regexp_replace(lower(quote), '[^a-z0-9]', '', 'g') = ''")
def val_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    quote = F.when(k % 4 == 0, F.substring("text", 1, 50)).when(k % 4 == 1, _text("qq", k, "xx not there")).otherwise(F.substring("text", 1, 3))
    records = d.select(k.alias("product_id"), F.lit("text").alias("code"), F.when(k % 5 == 0, "gone").otherwise(k.cast("string")).alias("source_id"), quote.alias("quote"), F.lit("p. 1").alias("locator"))
    return validate.quote_issues(records, d.select(k.cast("string").alias("source_id"), "text")).select("product_id", "kind")


def _sha(reason: str) -> str:
    return f"'flag_' || left(sha256(product_id || '|' || coalesce(code, '') || '|' || {reason}), 12)"


@query("rev_product_flags", f"""WITH a AS ({ATTRIBUTES_SQL}), products AS ({PRODUCTS_SQL}), f AS (
SELECT product_id, 'size' AS code, 'conflict_critical: sources disagree (9 vs 1, 2, 3)' AS reason, 'critical' AS severity, coalesce((SELECT confidence FROM a WHERE a.product_id = p.product_id AND code = 'size'), 0.5::DOUBLE) AS confidence, 'conflict_critical' AS key FROM products p WHERE product_id % 14 = 0 UNION ALL
SELECT product_id, NULL, 'possible_duplicate: 1 edit. Confirm whether this is a distinct product or an OCR misread of 5.', 'critical', 0.3, 'possible_duplicate' FROM products WHERE product_id % 10 = 3 UNION ALL
SELECT product_id, 'size', 'missing_required_core: Size is required for the ecommerce channel', 'critical', 0.0, 'missing_required' FROM products WHERE size IS NULL UNION ALL
SELECT product_id, code, 'generated_unverified: Unverified figure 7', 'critical', confidence, 'generated_unverified' FROM a WHERE generated AND product_id % 2 = 0 UNION ALL
SELECT product_id, code, 'low_confidence: ' || printf('%.2f', confidence) || ' -- a; b', 'warning', confidence, 'low_confidence' FROM a WHERE NOT generated AND confidence < 0.8 UNION ALL
SELECT product_id, code, 'validation_error: not plausible', 'critical', confidence, 'validation_error' FROM a WHERE product_id % 6 = 0 UNION ALL
SELECT product_id, 'price', 'outlier: far off', 'warning', coalesce((SELECT confidence FROM a WHERE a.product_id = p.product_id AND code = 'price'), 0.5::DOUBLE), 'outlier' FROM products p WHERE product_id % 20 = 1 UNION ALL
SELECT product_id, NULL, 'validation_error: rule fits: too large', 'critical', 0.4, 'validation_error:rule fits: too large' FROM products WHERE product_id % 30 = 2)
SELECT product_id::VARCHAR AS product_id, code, reason, severity, confidence::DOUBLE AS confidence, {_sha('key')} AS flag_id FROM f""")
def rev_product_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.products(spark, sf_dir)
    k = F.col("product_id")
    twins = p.select("product_id", F.when(k % 10 == 3, "5").alias("suspected_duplicate_of"), F.lit("1 edit").alias("duplicate_evidence"))
    conflicts = p.where("product_id % 7 = 0").select("product_id", F.lit("size").alias("code"), F.when(k % 2 == 0, "critical").otherwise("warning").alias("severity"), F.lit("9").alias("winning_value"), F.array(*[F.lit(x) for x in "1234"]).alias("losing_values"))
    missing = p.where("size is null").select("product_id", F.lit("size").alias("code"), F.lit("Size").alias("name"), F.lit(True).alias("is_core"))
    far = p.where("product_id % 20 = 1").select("product_id", F.lit("price").alias("code"), F.lit("far off").alias("message"))
    broken = p.where("product_id % 30 = 2").select("product_id", F.lit("rule fits: too large").alias("message"))
    return review.product_flags(twins, _records(spark, sf_dir), conflicts, missing, far, broken, threshold=0.8)


@query("rev_correct", f"""WITH o AS (SELECT product_id, obs_seq, discount FROM ({OBSERVATIONS_SQL})), c AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 18 = 0 THEN NULL ELSE p_size / 100.0::DOUBLE END AS v FROM part WHERE p_partkey % 9 = 0)
SELECT product_id, 'discount' AS code, v AS value_number, 'human:ann' AS source_id FROM c WHERE v IS NOT NULL""")
def rev_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = catalog.observations(spark, sf_dir).withColumn("source_id", F.col("source_id").cast("string"))
    p = table(spark, sf_dir, "part").select(_key().alias("product_id"), F.lit("c").alias("category_id"), "p_size")
    asked = p.where("product_id % 9 = 0").select(F.lit(1).alias("correction_seq"), "product_id", F.lit("discount").alias("code"), F.when(F.col("product_id") % 18 == 0, "none").otherwise((F.col("p_size") / 100).cast("string")).alias("raw"), F.lit("ann").alias("reviewer"))
    definitions = spark.createDataFrame([("c", "discount", "number")], "category_id string, code string, datatype string")
    _, records, _ = review.correct(seen, p.select("product_id", "category_id"), definitions, asked, golden.golden_records)
    return records.select("product_id", "code", "value_number", "source_id")


@query("agg_defaults", f"WITH a AS ({ATTRIBUTES_SQL}), p AS ({PRODUCTS_SQL}) SELECT product_id, code, value_number, confidence, NULL::VARCHAR AS strategy FROM a WHERE code = 'size' UNION ALL SELECT product_id, 'size', 10.0::DOUBLE, 0.4::DOUBLE, 'schema_default' FROM p WHERE size IS NULL AND category_id <> 'PROMO'")
def agg_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.products(spark, sf_dir)
    records = catalog.attributes(spark, sf_dir).where("code = 'size'").select("product_id", "code", "value_number", "value_text", "confidence")
    defaults = p.where("category_id <> 'PROMO'").select("category_id").distinct().withColumns({"code": F.lit("size"), "value_number": F.lit(10.0), "value_text": F.lit(None).cast("string")})
    return golden.with_defaults(records, p, defaults).select("product_id", "code", "value_number", "confidence", "strategy")


@query("agg_attribute_scorecard", f"WITH a AS ({ATTRIBUTES_SQL}) SELECT count(*) AS attributes_total, count(*) FILTER (WHERE NOT generated) AS attributes_sourced, count(*) FILTER (WHERE generated) AS attributes_generated, count(*) FILTER (WHERE inferred) AS inferred_attributes, floor(avg(confidence) FILTER (WHERE NOT generated) * 10000 + 0.5) / 10000 AS confidence_sourced, floor(avg(confidence) FILTER (WHERE generated) * 10000 + 0.5) / 10000 AS confidence_generated, (SELECT count(*) FROM part WHERE p_size = 7) AS conflicts FROM a")
def agg_attribute_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.attribute_scorecard(catalog.attributes(spark, sf_dir), table(spark, sf_dir, "part").where("p_size = 7"))


@query("agg_large_medians", "SELECT event_type, median(value) AS median, count(*) AS n FROM events GROUP BY ALL")
def agg_large_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a group above the bound has it: all groups are bracketed and ranked."""
    e = table(spark, sf_dir, "events")
    sizes = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return quality.medians(e, ["event_type"], "value", sizes, buffered=0).join(sizes, "event_type")


# lists

_LIST = f"""a AS ({ATTRIBUTES_SQL}), p AS ({PRODUCTS_SQL}), list AS (SELECT p.product_id, manufacturer, 'M' || p.product_id AS mpn, NULL::VARCHAR AS gtin, NULL::VARCHAR AS series, CASE WHEN p.product_id % 3 = 0 THEN manufacturer || ' M' || p.product_id ELSE product_name END AS name, category_id, category_id || ' parts' AS category_name, 'industrial' AS vertical, CASE WHEN p.product_id % 2 = 0 THEN 'published' ELSE 'draft' END AS status,
 p.product_id % 4 = 0 AS is_family, p.product_id % 10 / 10.0::DOUBLE AS quality_overall, p.product_id % 5 / 5.0::DOUBLE AS completeness, p.product_id % 3 = 0 AS channel_ready, CASE WHEN p.product_id % 7 = 0 THEN 1 ELSE 0 END AS conflict_count, (SELECT count(*) FROM a WHERE a.product_id = p.product_id) AS attribute_count,
 (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p.product_id) AS source_count, CASE WHEN p.product_id % 4 = 1 THEN 1 ELSE 0 END AS open_flags, NULL::VARCHAR AS suspected_duplicate_of FROM p)"""


def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.products(spark, sf_dir)
    k = F.col("product_id")
    none = F.lit(None).cast("string")
    rows = p.select("product_id", "manufacturer", _text("M", k).alias("mpn"), none.alias("gtin"), none.alias("series"), F.when(k % 3 == 0, " ").otherwise(F.col("product_name")).alias("name"), "category_id", F.when(k % 2 == 0, "published").otherwise("draft").alias("status"), F.when(k % 4 != 0, k).alias("base_id"), none.alias("suspected_duplicate_of"))
    kinds = p.select("category_id").distinct().select("category_id", _text(F.col("category_id"), " parts").alias("category_name"), F.lit("industrial").alias("vertical"))
    scores = p.select("product_id", (k % 10 / 10).alias("overall"), (k % 5 / 5).alias("completeness_ecommerce"), (k % 3 == 0).alias("channel_ready"))
    flags = p.where("product_id % 2 = 1").select("product_id", (k % 4 == 3).alias("resolved"))
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("source_id"))
    return listing.summaries(rows, kinds, scores, catalog.attributes(spark, sf_dir), p.where("product_id % 7 = 0"), flags, sources)


@query("lst_summaries", f"WITH {_LIST} SELECT * FROM list")
def lst_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir)


@query("lst_page", f"WITH {_LIST} SELECT product_id, quality_overall, count(*) OVER () AS total FROM list WHERE contains(lower(name), 're') AND status = 'published' AND NOT is_family ORDER BY quality_overall DESC, product_id LIMIT 20 OFFSET 5")
def lst_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total = listing.page(listing.filtered(_list(spark, sf_dir), listing.Filters(q=" RE", status="published", families=False)), "quality", 5, 20)
    return rows.select("product_id", "quality_overall", F.lit(total).cast("long").alias("total"))


@query("lst_flagged", f"WITH {_LIST} SELECT product_id, manufacturer FROM list WHERE open_flags > 0 AND channel_ready AND contains(lower(manufacturer), '#1') ORDER BY lower(manufacturer), lower(mpn), product_id LIMIT 200")
def lst_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(listing.filtered(_list(spark, sf_dir), listing.Filters(flagged=True, ready=True, maker_part="#1")))[0].select("product_id", "manufacturer")


@query("lst_review", """WITH f AS (SELECT 'f' || p_partkey AS flag_id, p_partkey, CASE WHEN p_size % 2 = 0 THEN 'outlier: x' ELSE 'low_confidence: y' END AS reason, CASE WHEN p_size % 3 = 0 THEN 'critical' ELSE 'warning' END AS severity, p_size / 100.0::DOUBLE AS confidence FROM part),
r AS (SELECT *, CASE WHEN reason = 'outlier: x' THEN 0.65::DOUBLE ELSE 0.7::DOUBLE END * CASE WHEN severity = 'critical' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END * (1 - least(confidence, 0.99::DOUBLE)) AS priority FROM f), top AS (SELECT * FROM r ORDER BY priority DESC, flag_id LIMIT 2000)
SELECT flag_id, p_brand AS manufacturer, 'Width' AS attribute_name, floor(priority * 1000000 + 0.5) / 1000000 AS priority FROM top JOIN part USING (p_partkey) WHERE severity = 'critical' AND reason = 'outlier: x' ORDER BY top.priority DESC, flag_id LIMIT 50""")
def lst_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    flags = p.select(_text("f", _key()).alias("flag_id"), _key().cast("string").alias("product_id"), F.lit("width").alias("code"), F.when(size % 2 == 0, "outlier: x").otherwise("low_confidence: y").alias("reason"), F.when(size % 3 == 0, "critical").otherwise("warning").alias("severity"), (size / 100).alias("confidence"))
    named = p.select(_key().alias("product_id"), F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("mpn"), F.lit("c").alias("category_id"))
    definitions = spark.createDataFrame([("c", "width", "Width")], "category_id string, code string, name string")
    found = listing.review_list(flags, named, definitions, severity="critical", reason="outlier", limit=50)
    return found.select("flag_id", "manufacturer", "attribute_name", golden.round_half_up(F.col("priority"), 6).alias("priority"))


@query("win_spec_phrases", f"WITH a AS ({ATTRIBUTES_SQL}) SELECT product_id, code, CASE WHEN code = 'size' THEN 1 ELSE row_number() OVER (PARTITION BY product_id ORDER BY CASE code WHEN 'size' THEN 5 WHEN 'price' THEN 1 ELSE 0 END DESC, code) END AS place FROM a WHERE code <> 'name'")
def win_spec_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = spark.createDataFrame([("size", True, True, True, False, False), ("price", False, False, True, False, False), ("name", False, True, True, False, True)], "code string, variant_defining boolean, required_core boolean, required_ecommerce boolean, generated boolean, identity boolean")
    rows = catalog.attributes(spark, sf_dir).drop("variant_defining", "generated")
    return listing.spec_phrases(rows, definitions).select("product_id", "code", F.col("place").cast("long").alias("place"))


# exports

_SHOWN = "CASE WHEN value_number = floor(value_number) THEN value_number::BIGINT::VARCHAR WHEN value_number IS NOT NULL THEN rtrim(rtrim(printf('%.' || (5 - floor(log10(value_number)))::INT || 'f', value_number), '0'), '.') ELSE value_text END"


def _feed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("product_id")
    none = F.lit(None).cast("string")
    return catalog.products(spark, sf_dir).select("product_id", "manufacturer", _text("M", k).alias("mpn"), none.alias("gtin"), none.alias("series"), "category_id", F.lower("category_id").alias("category_name"), F.lit("EC01").alias("etim_class"), none.alias("unspsc"), (k % 10 / 10).alias("quality_overall"), F.lit(0.5).alias("completeness_ecommerce"), F.lit(1.0).alias("accuracy"), (k % 3 == 0).alias("channel_ready"))


@query("exp_channel_feed", f"""WITH a AS (SELECT *, {_SHOWN} AS shown FROM ({ATTRIBUTES_SQL})) SELECT p_partkey::VARCHAR AS product_id, p_brand AS manufacturer, 'M' || p_partkey AS mpn, '' AS gtin, '' AS series, p_type AS category_id, lower(p_type) AS category_name, 'EC01' AS etim_class, '' AS unspsc,
coalesce(max(shown) FILTER (WHERE code = 'name'), '') AS name, coalesce(max(shown) FILTER (WHERE code = 'price'), '') AS price, coalesce(max(shown) FILTER (WHERE code = 'size'), '') AS size, printf('%.4f', p_partkey % 10 / 10.0::DOUBLE) AS quality_overall, '0.5000' AS completeness_ecommerce, '1.0000' AS accuracy, CASE WHEN p_partkey % 3 = 0 THEN 'Y' ELSE 'N' END AS channel_ready,
CASE WHEN p_partkey % 7 = 0 THEN '1' ELSE '0' END AS conflict_count, coalesce(printf('%.4f', avg(confidence)), '0') AS mean_confidence FROM part LEFT JOIN a ON product_id = p_partkey GROUP BY p_partkey, p_brand, p_type""")
def exp_channel_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _feed_products(spark, sf_dir)
    return exports.channel_feed(p, catalog.attributes(spark, sf_dir), p.where("product_id % 7 = 0"), ["size", "price", "name"])


@query("exp_record_items", f"""WITH a AS (SELECT *, {_SHOWN} AS shown FROM ({ATTRIBUTES_SQL})), n AS (SELECT product_id, string_agg('"' || code || '":{{"value":"' || shown || '","generated":' || generated || ',"evidence":{{"source_id":"' || source_id || '"}}}}', ',' ORDER BY code) AS list FROM a GROUP BY ALL)
SELECT p_partkey AS product_id, '{{"product_id":' || p_partkey || ',"manufacturer":"' || p_brand || '","mpn":"M' || p_partkey || '","category":{{"id":"' || p_type || '","name":"' || lower(p_type) || '","etim":"EC01"}}' || coalesce(',"attributes":{{' || list || '}}', '') || CASE WHEN p_partkey % 7 = 0 THEN ',"conflicts":[{{"code":"size","rule":"r","severity":"warning"}}]' ELSE '' END || ',"source_ids":["s1","s2"]}}' AS item FROM part LEFT JOIN n ON product_id = p_partkey""")
def exp_record_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _feed_products(spark, sf_dir)
    conflicts = p.where("product_id % 7 = 0").select("product_id", F.lit("size").alias("code"), F.lit("r").alias("rule"), F.lit("warning").alias("severity"))
    sources = p.select("product_id", F.explode(F.array(F.lit("s2"), F.lit("s1"))).alias("source_id"))
    return exports.record_items(p, catalog.attributes(spark, sf_dir).drop("confidence"), conflicts, sources)


@query("exp_articles", f"""WITH a AS (SELECT *, {_SHOWN} AS shown FROM ({ATTRIBUTES_SQL})), n AS (SELECT product_id, string_agg(code || '=' || shown || ' ' || 'confidence=' || printf('%.2f', confidence), ',' ORDER BY code) AS features FROM a WHERE NOT generated GROUP BY ALL)
SELECT 'M' || p_partkey AS article, p_brand || ' M' || p_partkey AS title, features FROM part LEFT JOIN n ON product_id = p_partkey""")
def exp_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exports.articles(_feed_products(spark, sf_dir), catalog.attributes(spark, sf_dir))
    shown = F.array_join(F.transform("ARTICLE_FEATURES.FEATURE", lambda f: F.concat(f["FNAME"], F.lit("="), f["FVALUE"], F.lit(" "), f["FDESCR"])), ",")
    return rows.select(F.col("SUPPLIER_AID").alias("article"), F.col("ARTICLE_DETAILS.DESCRIPTION_SHORT").alias("title"), shown.alias("features"))


# families


def _family_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    variant = n.select(_text("n", F.col("n_nationkey")).alias("src"), F.lit("variant_of").alias("predicate"), _text("r", F.col("n_regionkey")).alias("dst"))
    made = table(spark, sf_dir, "supplier").select(_text("s", F.col("s_suppkey")).alias("src"), F.lit("belongs_to").alias("predicate"), _text("n", F.col("s_nationkey")).alias("dst"))
    return variant.unionByName(made).withColumn("confidence", F.lit(1.0))


@query("gr_family", "SELECT 'n' || n_nationkey AS product, 'r' || n_regionkey AS member FROM nation UNION ALL SELECT 'n' || a.n_nationkey, 'n' || b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation")
def gr_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _family_edges(spark, sf_dir)
    asked = edges.where("predicate = 'variant_of'").select(F.explode(F.array("src", "dst")).alias("product")).distinct()
    return graph.family(edges, asked)


@query("gr_paths", "SELECT 's' || s_suppkey AS start, 'n' || s_nationkey AS node, 1 AS depth, 'belongs_to' AS path FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2, 'belongs_to>variant_of' FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def gr_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _family_edges(spark, sf_dir)
    found = graph.paths(edges, edges.where("predicate = 'belongs_to'").select(F.col("src").alias("start")), ["belongs_to", "variant_of"])
    return found.select("start", "node", "depth", F.array_join("path", ">").alias("path"))


@query("gr_totals", "SELECT (SELECT count(*) FROM (SELECT 'n' || n_nationkey FROM nation UNION SELECT 'r' || n_regionkey FROM nation UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'n' || s_nationkey FROM supplier)) AS nodes, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS edges, 'belongs_to=' || (SELECT count(*) FROM supplier) || ',variant_of=' || (SELECT count(*) FROM nation) AS by_type")
def gr_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return graph.totals(_family_edges(spark, sf_dir)).select("nodes", "edges", shown.alias("by_type"))


# intake and search


def _fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A feed's row (k % 4 = 0), a family's table (1), a document with labels (2) or prose only (3) for each part."""
    p = table(spark, sf_dir, "part")
    k, source = _key() % 4, _text("s", _key())
    pair = lambda a, b: F.array(F.lit(a), b)
    feed = F.array(pair("Brand", F.col("p_brand")), pair("Catalog Number", _text("VX-", _key())), pair("Price", F.lit("1")))
    family = F.array(pair("Part Number", F.lit("Size")), F.array(_text("FX-", _key(), "-A"), F.lit("1")), F.array(F.lit("n/a"), F.lit("1")), F.array(_text("FX-", _key(), "-B"), F.lit("2")))
    labels = F.array(pair("Made by", _text(F.col("p_brand"), " Inc.")), pair("Order code", _text("OC", _key())))
    cells = F.when(k == 0, feed).when(k == 1, family).when(k == 2, labels)
    table_rows = p.where(k < 3).select(source.alias("source_id"), F.lit(1).alias("pos"), F.when(k == 1, "table").otherwise("keyvalue").alias("kind"), (k == 0).alias("row_scoped"), cells.alias("cells"), F.lit(None).cast("string").alias("text"))
    heads = p.where(k > 0).select(source.alias("source_id"), F.lit(0).alias("pos"), F.lit("heading").alias("kind"), F.lit(False).alias("row_scoped"), F.lit(None).cast("array<array<string>>").alias("cells"), _text(F.col("p_brand"), " Works HX-", _key(), " datasheet | x").alias("text"))
    mirror = F.when(k == 1, _text("Product line: F", _key(), "\nno more")).when(k == 3, _text("see HX-", _key(), " at 240/415 V")).otherwise("")
    hints = p.select(source.alias("source_id"), F.lit(None).cast("string").alias("manufacturer"))
    return table_rows.unionByName(heads), p.select(source.alias("source_id"), mirror.alias("text")), hints


@query("jn_described_products", """SELECT 's' || p_partkey AS source_id, 1 AS pos, p_brand AS manufacturer, 'VX-' || p_partkey AS mpn, NULL::VARCHAR AS series FROM part WHERE p_partkey % 4 = 0 UNION ALL
SELECT 's' || p_partkey, NULL, p_brand || ' Works', unnest(['F' || p_partkey, 'FX-' || p_partkey || '-A', 'FX-' || p_partkey || '-B']), 'F' || p_partkey FROM part WHERE p_partkey % 4 = 1 UNION ALL
SELECT 's' || p_partkey, NULL, p_brand, 'OC' || p_partkey, NULL FROM part WHERE p_partkey % 4 = 2 UNION ALL SELECT 's' || p_partkey, NULL, p_brand || ' Works', 'HX-' || p_partkey, NULL FROM part WHERE p_partkey % 4 = 3""")
def jn_described_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.described(*_fragments(spark, sf_dir))


@query("jn_assigned_fragments", "SELECT 's' || p_partkey AS source_id, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 2 ELSE 1 END AS n FROM part")
def jn_assigned_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments, mirrors, hints = _fragments(spark, sf_dir)
    return intake.assigned(fragments, intake.described(fragments, mirrors, hints)).groupBy("source_id").agg(F.count("*").alias("n"))


@query("ext_observations", "SELECT 's' || p_partkey AS source_id, CASE WHEN p_partkey % 4 = 0 THEN 'price' ELSE 'ordering' END AS code, CASE WHEN p_partkey % 4 = 0 THEN '1' ELSE 'OC' || p_partkey END AS raw, CASE WHEN p_partkey % 4 = 0 THEN 'Price: 1' ELSE 'Order code: OC' || p_partkey END AS quote, CASE WHEN p_partkey % 4 = 0 THEN 'structured_feed' ELSE 'native_table' END AS method FROM part WHERE p_partkey % 2 = 0")
def ext_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments, mirrors, hints = _fragments(spark, sf_dir)
    rows = intake.assigned(fragments, intake.described(fragments, mirrors, hints)).withColumn("product_id", identity.product_id(F.col("manufacturer"), F.col("mpn"))).persist()
    aliases = spark.createDataFrame([("price", "price"), ("order code", "ordering"), ("size", "size")], "alias string, code string")
    return extract.observations(rows, aliases).select("source_id", "code", "raw", "quote", "method")


@query("sem_embedding_cache", "WITH t AS (SELECT DISTINCT left(sha256('m1|' || text), 24) AS key FROM documents WHERE text IS NOT NULL), c AS (SELECT left(sha256('m1|' || text), 24) AS key FROM documents WHERE doc_id % 2 = 0) SELECT key FROM t WHERE key NOT IN (SELECT key FROM c WHERE key IS NOT NULL)")
def sem_embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cache = d.where("doc_id % 2 = 0").select(search.embedding_key("m1", F.col("text")).alias("key"), F.array(F.lit(1.0)).alias("vector"))
    return search.to_embed(d, cache, "m1").select("key")


@query("sem_answers", f"""WITH a AS (SELECT *, {_SHOWN} AS shown FROM ({ATTRIBUTES_SQL})) SELECT product_id, code, shown AS value, source_id, confidence, code = 'name' OR (code = 'size') AS listed FROM a JOIN part ON p_partkey = product_id WHERE (p_type <> 'PROMO' AND code IN ('price', 'size')) OR (p_type = 'PROMO' AND code = 'price')""")
def sem_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.products(spark, sf_dir)
    kinds = p.select("category_id").distinct()
    codes = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(i).alias("pos"), F.lit(core).alias("required_core")) for i, (c, core) in enumerate([("name", True), ("size", False), ("price", False)])])
    definitions = kinds.select("category_id", F.explode(codes).alias("d")).select("category_id", "d.*").withColumn("variant_defining", (F.col("code") == "size") & (F.col("category_id") != "PROMO"))
    found = search.answers(p, catalog.attributes(spark, sf_dir), definitions, ["price"])
    return found.select("product_id", "code", "value", "source_id", "confidence", F.col("code").isin("name", "size").alias("listed"))


def _product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each product: page_id, html, with a table, bullets, terms and a JSON-LD record, most elements left open."""
    text = lambda c: F.col(c).cast("string")
    record = F.to_json(F.struct(F.lit("Product").alias("@type"), text("p_partkey").alias("sku"), F.struct(text("p_retailprice").alias("price"), F.array(text("p_size"), F.lit("x")).alias("codes")).alias("offers"), F.array(F.struct(F.lit("Size").alias("name"), text("p_size").alias("value"))).alias("additionalProperty")))
    parts = ["<title>no</title><nav><ul><li>Home: x<li>Shop: y</ul></nav><h1>", text("p_name"), "</h1><table><caption>Data of ", text("p_brand"), "</caption><tr><th>Size<td>", text("p_size"), "<tr><th>Brand</th><td>", text("p_brand"), "</td></table><table><tr><td>one row</table><ul><li>Type: ", text("p_type"), "<li>Sold as - ", text("p_name"), "<li>no label</ul><dl><dt>Key<dd>", text("p_partkey"), "</dl><script type='application/ld+json'>", record, "</script><!-- <p>hidden</p>"]
    page = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    # dealt while rows are narrow; a page is made and read in one task
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")).select(F.col("p_partkey").cast("string").alias("page_id"), page.alias("html"))


def _cells(spark: SparkSession, sf_dir: str, *locators: str) -> DataFrame:
    """Cells of the fragments whose locator begins with one of these; pages are read once."""
    found = pages.page_fragments(_product_pages(spark, sf_dir), "page_id", "html").where(F.col("locator").rlike(f"^({'|'.join(locators)})"))
    return found.select("source_id", "locator", "caption", F.posexplode("cells").alias("row", "cell")).select("source_id", "locator", "caption", F.col("row").cast("long").alias("row"), F.col("cell")[0].alias("label"), F.col("cell")[1].alias("value"))


@query("src_html_tables", """SELECT p_partkey::VARCHAR AS source_id, 'table:nth(1)' AS locator, 'Data of ' || p_brand AS caption, 0::BIGINT AS row, 'Size' AS label, p_size::VARCHAR AS value FROM part UNION ALL
SELECT p_partkey::VARCHAR, 'table:nth(1)', 'Data of ' || p_brand, 1, 'Brand', p_brand FROM part""")
def src_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "table")


@query("src_html_lists", """SELECT p_partkey::VARCHAR AS source_id, 'ul:nth(1)' AS locator, 0::BIGINT AS row, 'Type' AS label, p_type AS value FROM part UNION ALL SELECT p_partkey::VARCHAR, 'ul:nth(1)', 1, 'Sold as', p_name FROM part UNION ALL
SELECT p_partkey::VARCHAR, 'dl:nth(1)', 0, 'Key', p_partkey::VARCHAR FROM part""")
def src_html_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "ul", "dl").drop("caption")


@query("src_json_ld", """SELECT p_partkey::VARCHAR AS source_id, 0::BIGINT AS row, 'sku' AS label, p_partkey::VARCHAR AS value FROM part UNION ALL SELECT p_partkey::VARCHAR, 2, 'offers.codes', p_size::VARCHAR FROM part UNION ALL
SELECT p_partkey::VARCHAR, 3, 'offers.codes', 'x' FROM part UNION ALL SELECT p_partkey::VARCHAR, 4, 'Size', p_size::VARCHAR FROM part""")
def src_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    # prices are written in another way by each engine
    return _cells(spark, sf_dir, "script").where("label <> 'offers.price'").drop("caption", "locator")


@query("sql_page_fragments", "SELECT p_partkey::VARCHAR AS page_id, 'h1' AS locator, p_name AS text FROM part UNION ALL SELECT p_partkey::VARCHAR, 'dl:nth(1)', 'Key: ' || p_partkey FROM part")
def sql_page_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages.register_parsers(spark)
    session.register({"product_pages": _product_pages(spark, sf_dir)})
    return session.read_sql(spark, "SELECT page_id, f.locator, f.text FROM product_pages, LATERAL page_fragments(html) f WHERE f.locator IN ('h1', 'dl:nth(1)')")
