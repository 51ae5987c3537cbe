"""Channel exports and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.normalize import render_number
from catalith.operators.linking import upsert

MEASURES = ["width_mm", "height_mm", "depth_mm", "weight_kg", "length_mm"]


def rendered(attributes: DataFrame) -> DataFrame:
    """With ``shown``: a list joined by commas, the number in short form, else the text."""
    values = [F.array_join("value_list", ", ")] if "value_list" in attributes.columns else []
    return attributes.withColumn("shown", F.coalesce(*values, render_number(F.col("value_number")), "value_text"))


def displayed(attributes: DataFrame) -> DataFrame:
    """With ``shown`` and the unit behind a number."""
    unit = F.when(F.col("value_number").isNotNull() & F.col("unit").isNotNull(), F.concat(F.lit(" "), "unit")).otherwise("")
    return rendered(attributes).withColumn("shown", F.concat("shown", unit))


def ready_only(products: DataFrame) -> DataFrame:
    return products.where("channel_ready")


#: Columns of the channel feed before and after those of the attributes.
LEAD = ["product_id", "manufacturer", "mpn", "gtin", "series", "category_id", "category_name", "etim_class", "unspsc"]
TAIL = ["quality_overall", "completeness_ecommerce", "accuracy", "channel_ready", "conflict_count", "mean_confidence"]


def wide_feed(products: DataFrame, attributes: DataFrame, codes: list[str]) -> DataFrame:
    """One row per product and a column per code, in sorted order: the flat channel feed. codes come from the dictionary, not from the data."""
    shown = rendered(attributes).groupBy("product_id").pivot("code", sorted(codes)).agg(F.min("shown"))
    return products.join(shown, "product_id", "left")


def channel_feed(products: DataFrame, attributes: DataFrame, conflicts: DataFrame, codes: list[str]) -> DataFrame:
    """The channel feed as text: LEAD, a column per code, TAIL; what lacks is empty.

    products: LEAD, and quality_overall, completeness_ecommerce, accuracy, channel_ready; numbers of quality have
    four places, readiness is Y or N. The feed's columns are told by name, so a code may not be one of LEAD or TAIL.
    """
    own = sorted(set(codes) - set(LEAD) - set(TAIL))
    facts = attributes.groupBy("product_id").agg(F.avg("confidence").alias("mean"))
    clashes = conflicts.groupBy("product_id").agg(F.count("*").alias("n"))
    four = lambda c: F.format_string("%.4f", F.coalesce(F.col(c), F.lit(0.0)))
    tail = {
        "quality_overall": four("quality_overall"), "completeness_ecommerce": four("completeness_ecommerce"), "accuracy": four("accuracy"),
        "channel_ready": F.when(F.coalesce("channel_ready", F.lit(False)), "Y").otherwise("N"),
        "conflict_count": F.coalesce("n", F.lit(0)).cast("string"),
        "mean_confidence": F.when(F.col("mean").isNull(), "0").otherwise(F.format_string("%.4f", "mean")),
    }
    rows = wide_feed(products, attributes, own).join(facts, "product_id", "left").join(clashes, "product_id", "left")
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in [*LEAD, *own]]
    return rows.select(*text, *[tail[c].alias(c) for c in TAIL])


def record_items(products: DataFrame, attributes: DataFrame, conflicts: DataFrame, sources: DataFrame, evidence: bool = True) -> DataFrame:
    """One JSON text per product with all that is known of it; with evidence it is what an audit reads.

    products: identity, category columns and a struct ``quality``; attributes: code, name, shown values, unit, confidence,
    generated, and with evidence source_id, source_kind, method, quote, quote_verified and strategy.
    """
    value = F.coalesce(F.col("value_text"), render_number(F.col("value_number")))
    entry = [value.alias("value"), *[F.col(c) for c in ("unit", "confidence", "name", "generated") if c in attributes.columns]]
    if evidence:
        entry.append(F.when(F.col("source_id").isNotNull(), F.struct(*[F.col(c) for c in ("source_id", "source_kind", "method", "quote", "quote_verified") if c in attributes.columns])).alias("evidence"))
        entry += [F.struct("strategy").alias("inference")] if "strategy" in attributes.columns else []
    facts = attributes.groupBy("product_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", F.struct(*entry).alias("entry"))))).alias("attributes"))
    clashes = conflicts.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("code", "rule", "severity"))).alias("conflicts"))
    named = sources.groupBy("product_id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    whole = products.join(facts, "product_id", "left").join(clashes, "product_id", "left").join(named, "product_id", "left")
    identity = [c for c in ("product_id", "manufacturer", "mpn", "gtin", "series", "base_product_id") if c in products.columns]
    category = F.struct(*[F.col(c).alias(n) for c, n in (("category_id", "id"), ("category_name", "name"), ("etim_class", "etim"), ("unspsc", "unspsc"), ("vertical", "vertical")) if c in products.columns])
    nested = ["attributes", *(["quality"] if "quality" in products.columns else []), "conflicts", "source_ids"]
    return whole.select("product_id", F.to_json(F.struct(*identity, category.alias("category"), *nested)).alias("item"))


def trade_items(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """One JSON text per product: identity, measurements, attributes sorted by code with confidence to three places."""
    item = F.struct("code", "shown", F.format_string("%.3f", "confidence").alias("confidence"))
    nested = rendered(attributes).groupBy("product_id").agg(
        F.array_sort(F.collect_list(item)).alias("attributes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("code").isin(MEASURES), F.struct("code", "value_number"))))).alias("measurements"),
    )
    whole = products.join(nested, "product_id", "left")
    return whole.select("product_id", F.to_json(F.struct("product_id", "manufacturer", "mpn", "measurements", "attributes")).alias("item"))


def articles(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Articles as nested rows: details, order unit, price where there is one, and features.

    Features are the attributes with a value that aren't generated (column generated), by code, each with its
    unit and confidence; products may have name, long_description, gtin, etim_class, base_product_id, uom and list_price_usd.
    """
    have = set(products.columns)
    given = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    facts = rendered(attributes).where(F.coalesce("shown", F.lit("")) != "")
    facts = facts.where(~F.col("generated")) if "generated" in facts.columns else facts
    sure = F.concat(F.lit("confidence="), F.format_string("%.2f", "confidence")) if "confidence" in facts.columns else F.lit(None).cast("string")
    fname = F.coalesce("name", "code") if "name" in facts.columns else F.col("code")
    funit = F.col("unit") if "unit" in facts.columns else F.lit(None).cast("string")
    feature = F.struct("code", fname.alias("FNAME"), F.col("shown").alias("FVALUE"), funit.alias("FUNIT"), sure.alias("FDESCR"))
    features = facts.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(feature)), lambda f: f.dropFields("code")).alias("FEATURE"))
    title = F.left(F.coalesce(given("name"), F.concat_ws(" ", "manufacturer", "mpn")), F.lit(150))
    unit = F.coalesce(given("uom"), F.lit("EA"))
    price = F.when(given("list_price_usd").isNotNull(), F.struct(F.struct(F.lit("net_list").alias("_price_type"), F.format_string("%.2f", given("list_price_usd").cast("double")).alias("PRICE_AMOUNT"), F.lit("USD").alias("PRICE_CURRENCY")).alias("ARTICLE_PRICE")))
    return products.join(features, "product_id", "left").select(
        F.coalesce("mpn", F.col("product_id").cast("string")).alias("SUPPLIER_AID"),
        F.struct(title.alias("DESCRIPTION_SHORT"), given("long_description").alias("DESCRIPTION_LONG"), given("gtin").alias("EAN"), F.col("manufacturer").alias("MANUFACTURER_NAME"), F.col("mpn").alias("MANUFACTURER_AID")).alias("ARTICLE_DETAILS"),
        F.struct(unit.alias("ORDER_UNIT"), unit.alias("CONTENT_UNIT"), F.lit("1").alias("PRICE_QUANTITY"), F.lit("1").alias("QUANTITY_MIN")).alias("ARTICLE_ORDER_DETAILS"),
        price.alias("ARTICLE_PRICE_DETAILS"),
        F.struct(F.lit("ETIM-8.0").alias("REFERENCE_FEATURE_SYSTEM_NAME"), given("etim_class").alias("REFERENCE_FEATURE_GROUP_ID"), "FEATURE").alias("ARTICLE_FEATURES"),
        F.struct(F.lit("base_product").alias("_type"), F.coalesce(given("base_product_id"), F.lit("")).alias("_VALUE")).alias("ARTICLE_REFERENCE"),
    )


def write_articles(products: DataFrame, attributes: DataFrame, path: str, catalog_id: str = "CATALOG", catalog_name: str = "Catalog export") -> None:
    """Articles as XML files, one root element each, with a header file of the catalog's name beside them."""
    articles(products, attributes).write.format("xml").option("rowTag", "ARTICLE").option("rootTag", "BMECAT").mode("overwrite").save(path)
    spark = products.sparkSession
    header = spark.range(1).select(F.struct(F.lit("eng").alias("LANGUAGE"), F.lit(catalog_id).alias("CATALOG_ID"), F.lit("1.0").alias("CATALOG_VERSION"), F.lit(catalog_name).alias("CATALOG_NAME"), F.date_format(F.current_date(), "yyyy-MM-dd").alias("GENERATION_DATE")).alias("CATALOG"))
    header.coalesce(1).write.format("xml").option("rowTag", "HEADER").option("rootTag", "BMECAT").mode("overwrite").save(path.rstrip("/") + "-header")


def rebuild(tables: dict[str, DataFrame], root: str) -> None:
    """Replace the stored tables."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}")


def store_changes(current: str, delta: DataFrame, key: str, target: str) -> None:
    """Write the stored table with the delta's keys replaced to a new place; readers move there when it is whole."""
    upsert(delta.sparkSession.read.parquet(current), delta, key).write.mode("error").parquet(target)
