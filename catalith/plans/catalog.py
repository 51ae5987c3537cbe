"""The catalog's concepts over the test tables: part is a product, supplier a source, lineitem an observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ["user", "datasheet", "erp_export", "catalog", "manufacturer_web", "price_file", "distributor_web", "image", "inferred"]
METHODS = {"A": "structured_feed", "N": "native_table", "R": "ocr"}
#: The same as SQL over the test tables.
OBSERVATIONS_SQL = """
  SELECT l_partkey AS product_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS obs_seq,
         l_discount AS discount, l_tax AS tax, l_suppkey AS source_id,
         (['user','datasheet','erp_export','catalog','manufacturer_web','price_file','distributor_web','image','inferred'])[l_suppkey % 9 + 1] AS source_kind,
         CASE l_returnflag WHEN 'A' THEN 'structured_feed' WHEN 'N' THEN 'native_table' ELSE 'ocr' END AS method,
         l_linestatus = 'F' AS quote_verified, l_quantity AS quantity, l_extendedprice AS price
  FROM lineitem"""
PRECEDENCE_SQL = "CASE source_kind WHEN 'user' THEN 100 WHEN 'datasheet' THEN 90 WHEN 'erp_export' THEN 80 WHEN 'catalog' THEN 70 WHEN 'manufacturer_web' THEN 60 WHEN 'price_file' THEN 50 WHEN 'distributor_web' THEN 30 WHEN 'image' THEN 25 WHEN 'inferred' THEN 10 ELSE 40 END"
METHOD_SQL = "CASE method WHEN 'structured_feed' THEN 0.95::DOUBLE WHEN 'native_table' THEN 0.90::DOUBLE ELSE 0.55::DOUBLE END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, value: str = "l_discount", code: str = "discount") -> DataFrame:
    """Observations of one numeric attribute, in order of arrival within each product."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    # numbered before all else is worked out: the columns of the table are what is dealt by product
    rows = table(spark, sf_dir, "lineitem").withColumn("obs_seq", F.row_number().over(Window.partitionBy("l_partkey").orderBy(*order)).cast("long"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_suppkey") % 9 + 1).cast("int"))
    method = F.when(F.col("l_returnflag") == "A", "structured_feed").when(F.col("l_returnflag") == "N", "native_table").otherwise("ocr")
    return rows.select(
        F.col("l_partkey").alias("product_id"), F.lit(code).alias("code"), "obs_seq",
        F.col(value).alias("value_number"), F.lit(None).cast("string").alias("value_text"), F.col("l_suppkey").alias("source_id"), kind.alias("source_kind"), method.alias("method"), (F.col("l_linestatus") == "F").alias("quote_verified"),
    )


def text_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a text attribute: the ship month, spelt in two ways."""
    rows = observations(spark, sf_dir, "l_tax", "tax_label")
    label = F.concat(F.lit("tax "), F.floor(F.col("value_number") * 100 + 0.5).cast("string"))
    return rows.withColumns({"value_text": F.when(F.col("obs_seq") % 2 == 0, F.upper(label)).otherwise(F.concat(F.lit(" "), label)), "value_number": F.lit(None).cast("double")})


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with a brand as base and a share without category; every seventh lacks its size, every fifth its price."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category_id"), F.col("p_brand").alias("base_id"), (F.col("p_partkey") % 50 == 0).alias("is_family"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("size"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """size, price and name of each product as attribute rows."""
    p = products(spark, sf_dir)
    none = F.lit(None)

    def cell(code: str, number, text) -> Column:
        return F.struct(F.lit(code).alias("code"), number.cast("double").alias("value_number"), text.cast("string").alias("value_text"))

    cells = F.array(cell("size", F.col("size"), none), cell("price", F.col("price"), none), cell("name", none, F.when(F.col("product_id") % 11 != 0, F.col("product_name"))))
    rows = p.select("product_id", F.explode(cells).alias("a")).select("product_id", "a.*").where("value_number is not null or value_text is not null")
    return rows.withColumns({"confidence": F.lit(0.7) + F.lit(0.05) * (F.col("product_id") % 7), "generated": (F.col("code") == "name") & (F.col("product_id") % 3 == 0), "inferred": F.lit(False), "verified": F.col("product_id") % 4 != 0, "variant_defining": F.col("code") == "size", "source_id": F.concat(F.lit("src_"), (F.col("product_id") % 10).cast("string"))})


PRODUCTS_SQL = "SELECT p_partkey AS product_id, p_brand AS manufacturer, p_name AS product_name, p_type AS category_id, p_brand AS base_id, p_partkey % 50 = 0 AS is_family, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part"
ATTRIBUTES_SQL = f"""
  SELECT *, 0.7::DOUBLE + 0.05::DOUBLE * (product_id % 7) AS confidence, code = 'name' AND product_id % 3 = 0 AS generated, false AS inferred, product_id % 4 <> 0 AS verified, code = 'size' AS variant_defining, 'src_' || (product_id % 10) AS source_id
  FROM (SELECT product_id, 'size' AS code, size AS value_number, NULL::VARCHAR AS value_text FROM ({PRODUCTS_SQL}) UNION ALL
        SELECT product_id, 'price', price, NULL FROM ({PRODUCTS_SQL}) UNION ALL
        SELECT product_id, 'name', NULL, CASE WHEN product_id % 11 <> 0 THEN product_name END FROM ({PRODUCTS_SQL}))
  WHERE value_number IS NOT NULL OR value_text IS NOT NULL"""


def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category requires name (core), size (core, variant-defining) and price (ecommerce)."""
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("category_id")).distinct()
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(code).alias("code"), F.lit(v).alias("variant_defining")) for c, code, v in (("core", "name", False), ("core", "size", True), ("ecommerce", "price", False))])
    return kinds.select("category_id", F.explode(rows).alias("r")).select("category_id", "r.*")
