"""Joins between products, observations, assets and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.normalize import quote_found, squeezed


def _shortened(text: Column) -> Column:
    """Array of a text without one of its characters, for each of them."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def near_part_numbers(products: DataFrame, manufacturer: str, mpn: str, key: str) -> DataFrame:
    """For each product, the closest other part number of its maker: at most two edits and a fifth of the length.

    Part numbers within d edits are equal after at most d characters are taken from each. So every one is
    entered under what is left of it, and candidates meet on (maker, hash of what is left): many part numbers
    with one beginning don't meet for that alone. Those too short for a second edit lose one character only.
    """
    rows = products.where(F.length(mpn) >= 4).select(F.col(manufacturer).alias("maker"), F.col(mpn).alias("mpn"), F.col(key).alias("id"))
    mpns = rows.select("maker", "mpn").distinct().withColumn("once", _shortened(F.col("mpn")))
    twice = F.when(F.length("mpn") >= 8, F.flatten(F.transform("once", _shortened))).otherwise(F.array().cast("array<string>"))
    left = F.array_distinct(F.transform(F.concat(F.array("mpn"), "once", twice), lambda t: F.xxhash64(t)))
    entered = mpns.select("maker", "mpn", F.explode(left).alias("left"))
    others = entered.select("maker", F.col("mpn").alias("other"), "left")
    pairs = entered.join(others, ["maker", "left"]).where("mpn <> other").select("maker", "mpn", "other").distinct()
    edits = F.levenshtein("mpn", "other", 2)
    near = pairs.withColumn("edits", edits).where((F.col("edits") >= 0) & (F.col("edits") <= 0.2 * F.greatest(F.length("mpn"), F.length("other"))))
    best = near.groupBy("maker", "mpn").agg(F.min(F.struct("edits", "other")).alias("b")).select("maker", "mpn", F.col("b.other").alias("near_mpn"), F.col("b.edits").alias("edits"))
    return rows.join(best, ["maker", "mpn"]).select("id", "mpn", "near_mpn", "edits")


def verified_quotes(quotes: DataFrame, mirrors: DataFrame) -> DataFrame:
    """Quotes (quote_id, source_id, quote) with ``verified``: whether their source (source_id, text) holds them. Each mirror is squeezed once."""
    texts = mirrors.select("source_id", squeezed(F.col("text")).alias("source_text"))
    joined = quotes.join(texts, "source_id", "left")
    return joined.select("quote_id", "source_id", F.coalesce(quote_found(squeezed(F.col("quote")), F.col("source_text")), F.lit(False)).alias("verified"))


def label_codes(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Code of each label (label_id, label): the longest alias (alias, code) that equals it, or that it holds as words; equality beats length.

    Aliases of attributes that name the product or are generated (columns identity, generated) don't count.
    Labels are cut into their runs of words, as long as aliases are, so the containment is an equality join.
    """
    for flag in ("identity", "generated"):
        if flag in aliases.columns:
            aliases = aliases.where(~F.coalesce(flag, F.lit(False)))
    longest = aliases.agg(F.coalesce(F.max(F.size(F.split("alias", " "))), F.lit(0)).alias("longest"))
    words = F.split("label", " ")
    lengths = F.when((F.col("longest") > 0) & (F.size(words) > 0), F.sequence(F.lit(1), F.greatest(F.least(F.size(words), F.col("longest")), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(lengths, lambda w: F.transform(F.sequence(F.lit(1), F.size(words) - w + 1), lambda i: F.array_join(F.slice(words, i, w), " "))))
    cut = labels.crossJoin(F.broadcast(longest)).select("label_id", "label", F.explode(F.array_distinct(runs)).alias("alias"))
    joined = cut.join(aliases.select("alias", "code").distinct(), "alias")
    score = F.length("alias") + F.when(F.col("label") == F.col("alias"), 100).otherwise(0)
    ranked = joined.groupBy("label_id").agg(F.max(F.struct(score.alias("score"), F.col("code"))).alias("best"))
    return ranked.select("label_id", "best.code", "best.score")


def _filled(attributes: DataFrame) -> DataFrame:
    return attributes.where("value_number is not null or coalesce(value_text, '') <> ''")


def inherited(products: DataFrame, attributes: DataFrame, missing: DataFrame) -> DataFrame:
    """Missing codes that the product's base record fills (product_id, code, base_id, and the donor's other columns)."""
    wanted = missing.select("product_id", "code").join(products.select("product_id", "base_id"), "product_id").where("base_id is not null and base_id <> product_id")
    donors = _filled(attributes).withColumnRenamed("product_id", "base_id")
    return wanted.join(donors, ["base_id", "code"])


def sibling_consensus(products: DataFrame, attributes: DataFrame, missing: DataFrame) -> DataFrame:
    """Missing codes on which two or more siblings have a value and all agree: value, siblings and the donor's columns as a struct."""
    values = _filled(attributes).join(products.select("product_id", "base_id"), "product_id").where("base_id is not null")
    text = F.coalesce("value_text", F.col("value_number").cast("string"))
    donor = F.min_by(F.struct(*[c for c in attributes.columns if c not in ("product_id", "code")]), "product_id")
    agreed = values.groupBy("base_id", "code").agg(F.count("*").alias("siblings"), F.min(text).alias("value"), F.max(text).alias("most"), donor.alias("donor")).where("siblings >= 2 and value = most")
    return missing.select("product_id", "code").join(products.select("product_id", "base_id"), "product_id").join(agreed.drop("most"), ["base_id", "code"]).select("product_id", "code", "value", "siblings", "donor")


def upsert(base: DataFrame, delta: DataFrame, *key: str) -> DataFrame:
    """Base rows of other keys, and all delta rows; a key may have several columns."""
    return base.join(delta.select(*key).distinct(), [*key], "left_anti").unionByName(delta)


def attached_assets(assets: DataFrame, products: DataFrame) -> DataFrame:
    """Assets (asset_id, stem) with the products (product_id, name_key of three characters or more) whose key the stem holds, longest keys only.

    Stems are cut into their substrings of the lengths that keys have, so the containment is an equality join.
    """
    keys = products.where(F.length("name_key") >= 3).select("product_id", "name_key")
    lengths = keys.agg(F.collect_set(F.length("name_key")).alias("lengths"))
    n = F.length("stem")
    parts = F.flatten(F.transform("lengths", lambda w: F.when(n >= w, F.transform(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: F.substring("stem", i, w))).otherwise(F.array().cast("array<string>"))))
    cut = assets.crossJoin(F.broadcast(lengths)).select("asset_id", F.explode(F.array_distinct(parts)).alias("name_key"))
    hits = cut.join(keys, "name_key")
    longest = hits.groupBy("asset_id").agg(F.max(F.length("name_key")).alias("longest"))
    return hits.join(longest, "asset_id").where(F.length("name_key") == F.col("longest")).select("asset_id", "product_id", "name_key")
