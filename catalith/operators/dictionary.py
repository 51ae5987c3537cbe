"""Attribute dictionary as tables: merging common and own definitions, aliases, required codes, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FALLBACK_CATEGORY = "industrial.generic"


def merged(common: DataFrame, own: DataFrame) -> DataFrame:
    """Definitions of each category: its own ones, and the common ones (without category_id) that it doesn't override by code."""
    categories = own.select("category_id").distinct()
    inherited = common.withColumn("all", F.lit(1)).join(categories.withColumn("all", F.lit(1)), "all").drop("all").join(own.select("category_id", "code"), ["category_id", "code"], "left_anti")
    return own.unionByName(inherited.select(own.columns))


def alias_patterns(definitions: DataFrame) -> DataFrame:
    """code and alias for each attribute's name, its code with blanks, and its aliases, longest first."""
    words = F.array_distinct(F.transform(F.concat(F.array("name", F.replace("code", F.lit("_"), F.lit(" "))), "aliases"), lambda a: F.lower(F.trim(a))))
    return definitions.select("code", F.explode(words).alias("alias")).where("alias <> ''").distinct().orderBy(F.desc(F.length("alias")), "alias", "code")


def alias_index(definitions: DataFrame) -> DataFrame:
    """Codes that each alias may mean."""
    return alias_patterns(definitions).groupBy("alias").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def extractable(definitions: DataFrame) -> DataFrame:
    return definitions.where("not generated and not identity")


def variant_defining(definitions: DataFrame) -> DataFrame:
    """Codes that tell variants apart."""
    return definitions.where("variant_defining").select("category_id", "code").distinct()


def with_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows with their category, the generic one where theirs is unknown."""
    known = categories.select("category_id", F.lit(True).alias("__known"))
    joined = rows.join(known, "category_id", "left")
    return joined.withColumn("category_id", F.when(F.col("__known"), F.col("category_id")).otherwise(FALLBACK_CATEGORY)).drop("__known")


def listing(definitions: DataFrame, products: DataFrame) -> DataFrame:
    """Attributes, required ones and products of each category."""
    counted = definitions.groupBy("category_id").agg(F.count("*").alias("attributes"), F.count_if(F.col("channel") == "core").alias("core"), F.count_if(F.col("channel").isin("core", "ecommerce")).alias("ecommerce"))
    return counted.join(products.groupBy("category_id").agg(F.count("*").alias("products")), "category_id", "left").fillna(0, ["products"])
