"""Search: by attribute predicates, by vectors, by both, and cited answers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.functions.normalize import render_number

_OPS = {"=": lambda a, b: a == b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


@dataclass(frozen=True)
class Predicate:
    """A condition on one attribute."""

    code: str
    op: str
    value: float | str


def structured(products: DataFrame, attributes: DataFrame, predicates: list[Predicate], limit: int, category: str | None = None, manufacturer: str | None = None) -> DataFrame:
    """Products that meet every predicate, best quality first; each predicate is a semi join with a pushed filter."""
    out = products
    if category is not None:
        out = out.where(F.col("category_id") == category)
    if manufacturer is not None:
        out = out.where(F.lower("manufacturer") == manufacturer.lower())
    for p in predicates:
        value = F.lower("value_text") if isinstance(p.value, str) else F.col("value_number")
        wanted = p.value.lower() if isinstance(p.value, str) else p.value
        out = out.join(attributes.where((F.col("code") == p.code) & _OPS[p.op](value, F.lit(wanted))).select("product_id"), "product_id", "left_semi")
    return out.orderBy(F.desc("quality_overall"), "mpn", "product_id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    both = norm(a) * norm(b)
    return F.when(both > 1e-10, dot / both).otherwise(0.0)


def token_scores(products: DataFrame, attributes: DataFrame, question: str) -> DataFrame:
    """What products (product_id, identity) and their attributes (product_id, label, shown, value_number, variant_defining) have in common with a question: product_id, raw.

    3 if the identity holds the whole question; for each word of two characters or more that an attribute's
    value or label holds, 0.6 if it tells variants apart, else 0.3; 1.2 for each number of the question that an
    attribute has within 0.01. Products without any are left out.
    """
    whole = question.lower()
    tokens = [t for t in re.split(r"[\s,]+", whole) if len(t) > 1]
    numbers = [float(n) for n in re.findall(r"\d+(?:\.\d+)?", question)]
    shown, label = F.lower(F.coalesce("shown", F.lit(""))), F.lower(F.coalesce("label", F.lit("")))
    weight = F.when(F.coalesce("variant_defining", F.lit(False)), 0.6).otherwise(0.3)
    words = sum((F.when(F.contains(shown, F.lit(t)) | F.contains(label, F.lit(t)), weight).otherwise(0.0) for t in tokens), F.lit(0.0))
    equal = sum((F.when(F.abs(F.col("value_number") - n) < 0.01, 1.2).otherwise(0.0) for n in numbers), F.lit(0.0))
    by_attribute = attributes.where(F.coalesce("shown", F.lit("")) != "").groupBy("product_id").agg(F.sum(words + equal).alias("found"))
    identity = F.when(F.contains(F.lower("identity"), F.lit(whole.strip())), 3.0).otherwise(0.0)
    scored = products.join(by_attribute, "product_id", "left").select("product_id", (F.coalesce("found", F.lit(0.0)) + identity).alias("raw"))
    return scored.where("raw > 0")


def kept(products: DataFrame, category: str | None = None, manufacturer: str | None = None, ready_only: bool = False) -> DataFrame:
    """Products (product_id, category_id, manufacturer, channel_ready) that a search may show; both sides of a hybrid search are joined to them."""
    for name, value in (("category_id", category), ("manufacturer", manufacturer), ("channel_ready", True if ready_only else None)):
        if value is not None:
            products = products.where(F.col(name) == value)
    return products


def hybrid(attribute_scores: DataFrame, semantic_scores: DataFrame, limit: int) -> DataFrame:
    """Best products of both sides: a semantic score plus an eighth of the raw attribute score, or a quarter of that alone, at most 1.

    semantic_scores (product_id, semantic_score) are those of the nearest three times ``limit`` products.
    """
    both = attribute_scores.join(semantic_scores, "product_id", "full_outer")
    alone, added = F.col("raw") / 4, F.col("semantic_score") + F.coalesce("raw", F.lit(0.0)) / 8
    score = F.least(F.lit(1.0), F.when(F.col("semantic_score").isNull(), alone).otherwise(added))
    return both.select("product_id", score.alias("score")).orderBy(F.desc("score"), "product_id").limit(limit)


def cited_answers(hits: DataFrame, attributes: DataFrame, asked: list[str], most: int = 8) -> DataFrame:
    """Cited values of hits: the codes asked for first, then variant-defining ones, at most ``most`` a product."""
    rank = F.when(F.col("code").isin(asked), 0).when(F.col("variant_defining"), 1).otherwise(2)
    own = attributes.join(hits.select("product_id"), "product_id", "left_semi").withColumn("rank", rank).where("rank < 2")
    place = F.row_number().over(Window.partitionBy("product_id").orderBy("rank", "code"))
    value = F.coalesce("value_text", F.col("value_number").cast("string"))
    return own.withColumn("place", place).where(F.col("place") <= most).select("product_id", "code", value.alias("value"), "source_id")


def answer_codes(definitions: DataFrame, asked: list[str], most: int = 8, most_core: int = 6) -> DataFrame:
    """category_id, code and place of what an answer shows: the codes asked for, then those that tell variants apart; without any, the first core ones.

    definitions: category_id, code, pos, variant_defining, required_core.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in asked]), F.col("code")) if asked else F.lit(0)
    by = Window.partitionBy("category_id")
    wanted = definitions.where((order > 0) | F.col("variant_defining")).withColumn("place", F.row_number().over(by.orderBy(F.when(order > 0, order).otherwise(1 << 20), "pos"))).where(F.col("place") <= most)
    rest = definitions.join(wanted.select("category_id").distinct(), "category_id", "left_anti").where("required_core")
    core = rest.withColumn("place", F.row_number().over(by.orderBy("pos"))).where(F.col("place") <= most_core)
    return wanted.select("category_id", "code", "place").unionByName(core.select("category_id", "code", "place"))


def answers(hits: DataFrame, attributes: DataFrame, definitions: DataFrame, asked: list[str]) -> DataFrame:
    """One row per shown value of the hits (product_id, category_id): code, value, and where it comes from; inferred values cite their strategy.

    attributes: product_id, code, value_number, value_text, confidence, and of source_id, locator, quote, quote_verified and strategy those that there are.
    """
    codes = answer_codes(definitions, asked)
    have = set(attributes.columns)
    given = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    rows = hits.select("product_id", "category_id").join(codes, "category_id").join(attributes, ["product_id", "code"])
    value = F.coalesce("value_text", render_number(F.col("value_number")))
    inferred = given("source_id").isNull()
    verified = F.coalesce(F.col("quote_verified"), F.lit(False)) if "quote_verified" in have else F.lit(False)
    return rows.where(F.coalesce(value, F.lit("")) != "").select(
        "product_id", "place", "code", value.alias("value"), F.coalesce(given("source_id"), F.lit("inferred")).alias("source_id"), F.when(inferred, given("strategy")).otherwise(given("locator")).alias("locator"),
        given("quote").alias("quote"), (verified & ~inferred).alias("verified"), "confidence",
    )


def structured_or_nearest(found: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """Products that meet the predicates; where there are none, the nearest by vector (product_id, score)."""
    mode = lambda rows, name: rows.select("product_id", F.col("score").cast("double").alias("score"), F.lit(name).alias("mode"))
    met = found.agg(F.count("*").alias("met"))
    instead = near.orderBy(F.desc("score"), "product_id").limit(limit).crossJoin(F.broadcast(met)).where("met = 0")  # one row
    return mode(found.select("product_id", F.lit(None).alias("score")), "structured").unionByName(mode(instead, "semantic"))


def embedding_key(model: str, text: Column) -> Column:
    """Key of a text's vector: what is embedded anew is told by model and text alone."""
    return F.left(F.sha2(F.concat(F.lit(model + "|"), text), 256), F.lit(24))


def to_embed(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts (column text) whose vector the cache (key, vector) lacks: key, text."""
    keyed = texts.where("text is not null").select(embedding_key(model, F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def unit_vector(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > 1e-10, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def store_index(texts: DataFrame, cache: DataFrame, model: str, path: str) -> None:
    """Write product_id and vector of length 1 of every text (product_id, text) that the cache holds, with the model's name."""
    keyed = texts.select("product_id", embedding_key(model, F.col("text")).alias("key"))
    keyed.join(cache, "key").select("product_id", unit_vector(F.col("vector")).alias("vector"), F.lit(model).alias("model")).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("model") == model).select("product_id", "vector")
