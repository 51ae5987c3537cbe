"""Queries of dictionary tables and read views over the test tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import dictionary, enrich, golden, profile, quality, views
from catalith.plans import catalog
from catalith.plans.catalog import ATTRIBUTES_SQL, PRODUCTS_SQL, table
from catalith.registry import query
from catalith.sources import files
from catalith.sources.kept import kept


def _definitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "part").select(F.col("p_type").alias("category_id"), F.concat(F.lit("size_"), (F.col("p_size") % 4).cast("string")).alias("code"), F.lit("core").alias("channel")).distinct()
    common = spark.createDataFrame([("name", "core"), ("size_0", "enhanced"), ("price", "ecommerce")], "code string, channel string")
    return common, own


_MERGED = "own AS (SELECT DISTINCT p_type AS category_id, 'size_' || (p_size % 4) AS code, 'core' AS channel FROM part), common(code, channel) AS (VALUES ('name', 'core'), ('size_0', 'enhanced'), ('price', 'ecommerce')), merged AS (SELECT * FROM own UNION ALL SELECT category_id, code, channel FROM common, (SELECT DISTINCT category_id FROM own) WHERE (category_id, code) NOT IN (SELECT (category_id, code) FROM own))"


@query("dct_merge", f"WITH {_MERGED} SELECT * FROM merged")
def dct_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.merged(*_definitions(spark, sf_dir))


@query("dct_listing", f"WITH {_MERGED} SELECT category_id, count(*) AS attributes, count(*) FILTER (WHERE channel = 'core') AS core, count(*) FILTER (WHERE channel IN ('core', 'ecommerce')) AS ecommerce, (SELECT count(*) FROM part WHERE p_type = category_id) AS products FROM merged GROUP BY ALL")
def dct_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.listing(dictionary.merged(*_definitions(spark, sf_dir)), catalog.products(spark, sf_dir))


@query("dct_category_fallback", "SELECT p_partkey, CASE WHEN p_type < 'M' THEN p_type ELSE 'industrial.generic' END AS category_id FROM part")
def dct_category_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category_id"))
    return dictionary.with_category(p, p.where("category_id < 'M'").select("category_id").distinct()).select("p_partkey", "category_id")


@query("dct_aliases", "SELECT DISTINCT p_brand AS code, unnest([lower(p_brand), lower(p_type)]) AS alias FROM part")
def dct_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.col("p_brand").alias("name"), F.array("p_type").alias("aliases"))
    return dictionary.alias_patterns(rows)


@query("prj_product_summary", f"WITH p AS ({PRODUCTS_SQL}), a AS ({ATTRIBUTES_SQL}) SELECT product_id, manufacturer, (SELECT count(*) FROM a WHERE a.product_id = p.product_id) AS attributes, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p.product_id AND l_discount > 0.08) AS conflicts, CASE WHEN product_id % 4 = 1 THEN 1 ELSE 0 END AS open_flags FROM p")
def prj_product_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.products(spark, sf_dir).select("product_id", "manufacturer")
    conflicts = table(spark, sf_dir, "lineitem").where("l_discount > 0.08").select(F.col("l_partkey").alias("product_id"), "l_suppkey").distinct()
    flags = p.where("product_id % 2 = 1").select("product_id", (F.col("product_id") % 4 == 3).alias("resolved"))
    return views.product_summary(p, catalog.attributes(spark, sf_dir), conflicts, flags)


@query("prj_attribute_view", f"WITH a AS ({ATTRIBUTES_SQL}), n AS (SELECT l_partkey AS product_id, count(*) AS n FROM lineitem GROUP BY ALL) SELECT product_id, code, CASE WHEN code = 'size' THEN greatest(coalesce(n, 1), 1) ELSE 1 END AS observations FROM a LEFT JOIN n USING (product_id)")
def prj_attribute_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.lit("size").alias("code"))
    return views.attribute_view(catalog.attributes(spark, sf_dir), seen).select("product_id", "code", F.col("observations").cast("long").alias("observations"))


@query("prj_display_name", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' ' || p_partkey ELSE p_name END AS shown FROM part")
def prj_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", views.display_name(name, F.col("p_brand"), F.col("p_partkey").cast("string")).alias("shown"))


@query("snk_table_summary", "SELECT 'part' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def snk_table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table_summary({t: table(spark, sf_dir, t) for t in ("part", "supplier")})


@query("agg_scorecard_lift", "WITH b AS (SELECT avg((p_size > 10)::INT) AS m FROM part), a AS (SELECT avg((p_size > 5)::INT) AS m FROM part) SELECT 'm' AS metric, b.m AS before, a.m AS after, floor((a.m - b.m) * 10000 + 0.5::DOUBLE) / 10000 AS lift FROM a, b")
def agg_scorecard_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    card = lambda limit: p.agg(F.avg((F.col("p_size") > limit).cast("double")).alias("m"))
    return views.scorecard_lift(card(10), card(5), ["m"])


@query("val_issues", f"WITH p AS ({PRODUCTS_SQL}) SELECT product_id, 'size' AS code, 'error' AS level, 'missing' AS kind, 'size is missing' AS message FROM p WHERE size IS NULL UNION ALL SELECT product_id, 'price', 'warning', 'high', 'price over 1000' FROM p WHERE price > 1000")
def val_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.products(spark, sf_dir)
    issue = lambda rows, *what: rows.select("product_id", *[F.lit(w).alias(n) for n, w in zip(("code", "level", "kind", "message"), what, strict=True)])
    return views.issues(issue(p.where("size is null"), "size", "error", "missing", "size is missing"), issue(p.where("price > 1000"), "price", "warning", "high", "price over 1000"))


@query("jn_identity_resolve", "SELECT p_partkey AS request_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE (SELECT min(q.p_partkey) FROM part q WHERE q.p_name = p.p_name) END AS product_id FROM part p")
def jn_identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    gtin = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string"))
    known = p.select(F.col("p_partkey").alias("product_id"), F.col("p_partkey").cast("string").alias("gtin"), F.col("p_name").alias("mpn"))
    return views.resolved(p.select(F.col("p_partkey").alias("request_id"), gtin.alias("gtin"), F.col("p_name").alias("mpn")), known)


@query("fn_origin", "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'human' WHEN 'N' THEN 'inferred' ELSE 'sourced' END AS origin, count(*) AS n FROM lineitem GROUP BY ALL")
def fn_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    origin = enrich.origin(F.when(flag == "A", "human").otherwise("ocr"), F.lit(False), F.when(flag == "N", "base_product"), F.lit(True))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", origin.alias("origin")).agg(F.count("*").alias("n"))


@query("fn_reasons", """SELECT p_partkey, coalesce(nullif(concat_ws('; ', CASE WHEN p_size % 2 = 0 THEN 'supporting quote could not be verified against the source mirror' END, CASE WHEN p_size < 25 THEN 'recovered by ocr, which is less reliable than a native spec table' END,
CASE WHEN p_size > 45 THEN 'sources disagree or only one source reports this value' END, CASE WHEN p_partkey % 5 = 0 THEN 'came from a lower-precedence source' END), ''), 'verified quote from a high-precedence source, within schema bounds') AS reasons FROM part""")
def fn_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    factors = {"method": size / 50 + 0.2, "quote": F.when(size % 2 == 0, 0.65).otherwise(1.0), "source": F.when(F.col("p_partkey") % 5 == 0, 0.755).otherwise(0.95), "schema": F.lit(1.0), "corroboration": F.when(size > 45, 0.55).otherwise(1.0)}
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(enrich.reasons(factors, F.lit("ocr")), "; ").alias("reasons"))


@query("fn_alt_text", "SELECT p_partkey, left(CASE p_size % 4 WHEN 0 THEN 'Product photograph of ' || p_name WHEN 1 THEN 'Dimensional drawing of ' || p_name || ' showing measurements' WHEN 2 THEN p_name || ' shown in a typical installation' ELSE 'Image of ' || p_name END || ' (' || p_type || ')', 125) AS alt FROM part")
def fn_alt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shot = F.when(F.col("p_size") % 4 == 0, "hero").when(F.col("p_size") % 4 == 1, "dimension").when(F.col("p_size") % 4 == 2, "lifestyle").otherwise("top_down")
    return table(spark, sf_dir, "part").select("p_partkey", views.alt_text(F.col("p_name"), F.col("p_type"), shot).alias("alt"))


@query("src_image_compliance", "SELECT p_partkey, concat_ws('; ', CASE WHEN p_size * 40 < 800 THEN 'below 800 x 800' END, CASE WHEN abs(p_size * 40 / 1000.0 - 1) > 0.35 THEN 'aspect ratio' END, CASE WHEN p_partkey % 2 = 0 THEN 'background not white' END) AS notes FROM part")
def src_image_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = files.image_compliance(F.col("p_size") * 40, F.lit(1000), F.col("p_partkey") % 2 != 0, F.lit(1000))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(notes, "; ").alias("notes"))


@query("ext_label_values", "SELECT p_partkey AS row_id, p_brand AS label, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS value FROM part")
def ext_label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit("  "))
    return views.label_values(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.array(F.col("p_brand"), second, F.col("p_type")).alias("cells")))


@query("ext_variant_row", "SELECT p_type AS table_id, p_name AS mpn, min(p_partkey) AS first_key FROM part WHERE p_name IN (SELECT min(p_name) FROM part GROUP BY p_brand) GROUP BY ALL")
def ext_variant_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    tables = p.select(F.col("p_type").alias("table_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("key"), F.array(F.col("p_partkey").cast("string")).alias("cells"))
    wanted = p.groupBy("p_brand").agg(F.min("p_name").alias("mpn")).select("mpn").distinct()
    return views.variant_row(tables, wanted).select("table_id", "mpn", F.col("cells")[0].cast("long").alias("first_key"))


@query("agg_publish", "SELECT l_partkey, CASE WHEN avg(l_tax) < 0.04 THEN 'enriched' ELSE 'published' END AS status FROM lineitem WHERE l_tax > 0 GROUP BY ALL")
def agg_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = quality.mean_in_order(table(spark, sf_dir, "lineitem").where("l_tax > 0"), ["l_partkey"], "l_tax")
    zero = F.lit(0)
    return mean.select("l_partkey", quality.status(zero, zero, F.when(F.col("mean") < 0.04, 0.5).otherwise(0.9), zero).alias("status"))


@query("agg_mean_confidence", "SELECT source_kind, floor(avg(c) * 10000 + 0.5::DOUBLE) / 10000 AS mean FROM (SELECT (['user','datasheet','erp_export','catalog','manufacturer_web','price_file','distributor_web','image','inferred'])[l_suppkey % 9 + 1] AS source_kind, l_discount AS c FROM lineitem WHERE l_discount > 0) GROUP BY ALL")
def agg_mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.observations(spark, sf_dir).where("value_number > 0")
    return rows.groupBy("source_kind").agg(golden.round_half_up(F.avg("value_number"), 4).alias("mean"))


_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey", "l_returnflag", "l_linestatus"]
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS nulls, " + (f"NULL::DOUBLE AS low, NULL::DOUBLE AS high, min({c}) AS first, max({c}) AS last" if c in ("l_returnflag", "l_linestatus") else f"min({c})::DOUBLE + 0 AS low, max({c})::DOUBLE + 0 AS high, NULL AS first, NULL AS last") + ", true AS distinct_close, true AS middle_close FROM lineitem" for c in _PROFILED
)


def _checked(rows: DataFrame, middles: DataFrame) -> DataFrame:
    """Of each column: exact distinct values, and for numbers how many there are, below the sketch's middle and up to it. Distinct values of one column are counted by many tasks; no task gets all values."""
    at = rows.crossJoin(F.broadcast(middles))
    counts = at.agg(*[x for c in _PROFILED[:4] for x in (F.count(c).alias(f"n_{c}"), F.count_if(F.col(c) < F.col(f"m_{c}")).alias(f"b_{c}"), F.count_if(F.col(c) <= F.col(f"m_{c}")).alias(f"u_{c}"))])
    none = F.lit(None).cast("long")
    placed = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *[(F.col(f"{k}_{c}") if c in _PROFILED[:4] else none).alias(as_) for k, as_ in (("n", "filled"), ("b", "below"), ("u", "up_to"))]) for c in _PROFILED])))
    distinct = [rows.agg(F.count_distinct(c).alias("exact")).select(F.lit(c).alias("column_name"), "exact") for c in _PROFILED]
    return functools.reduce(DataFrame.unionByName, distinct).join(F.broadcast(placed), "column_name")


@query("agg_profile", _PROFILE_SQL)
def agg_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of four parts of the rows, combined; distinct values must be within 3 % of the exact ones, the middle within 2 % of the ranks."""
    rows = table(spark, sf_dir, "lineitem").select(*_PROFILED)
    parts = [profile.sketched(rows.where(F.pmod(F.xxhash64("l_partkey"), F.lit(4)) == k)) for k in range(4)]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    found = kept(profile.summarized(profile.combined(whole)), "profile")
    middles = found.agg(*[F.max(F.when(F.col("column_name") == c, F.col("q50"))).alias(f"m_{c}") for c in _PROFILED[:4]])
    exact = _checked(rows, middles)
    close = F.abs(F.col("distinct_about") - F.col("exact")) <= 0.03 * F.col("exact")
    middle = F.col("filled").isNull() | ((F.col("below") <= 0.52 * F.col("filled")) & (F.col("up_to") >= 0.48 * F.col("filled")))
    nulls = F.round(F.col("null_share") * F.col("n")).cast("long")
    return found.join(exact, "column_name").select("column_name", "n", nulls.alias("nulls"), "low", "high", "first", "last", close.alias("distinct_close"), middle.alias("middle_close"))
