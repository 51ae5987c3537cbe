"""Lists of products and review flags: the summary of each product, filters, sort orders and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.normalize import round_half_up
from catalith.operators.review import prioritised

#: Flags that are ranked before a review list is filtered.
RANKED_FLAGS = 2000
SORTS = {
    "mpn": [F.asc, "maker_key", "mpn_key"],
    "quality": [F.desc, "quality_overall"],
    "completeness": [F.desc, "completeness"],
    "flags": [F.desc, "open_flags"],
    "conflicts": [F.desc, "conflict_count"],
}


def summaries(products: DataFrame, categories: DataFrame, scores: DataFrame, attributes: DataFrame, conflicts: DataFrame, flags: DataFrame, sources: DataFrame, channel: str = "ecommerce") -> DataFrame:
    """The nineteen columns that lists show of a product.

    products: product_id, manufacturer, mpn, gtin, series, name, category_id, status, base_id, suspected_duplicate_of; categories:
    category_id, category_name, vertical; scores: product_id, overall, completeness_<channel>, channel_ready; sources: product_id, source_id.
    """
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("product_id").agg(F.count("*").alias(name))

    out = products.join(categories.select("category_id", "category_name", "vertical"), "category_id", "left")
    out = out.join(scores.select("product_id", "overall", F.col(f"completeness_{channel}").alias("share"), "channel_ready"), "product_id", "left")
    counts = {"conflict_count": conflicts, "attribute_count": attributes, "source_count": sources.select("product_id", "source_id").distinct(), "open_flags": flags.where("not resolved")}
    for name, rows in counts.items():
        out = out.join(counted(rows, name), "product_id", "left")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat_ws(" ", "manufacturer", "mpn"))
    return out.select(
        "product_id", "manufacturer", "mpn", "gtin", "series", name.alias("name"), "category_id", "category_name", "vertical", "status",
        F.col("base_id").isNull().alias("is_family"), round_half_up(F.coalesce("overall", F.lit(0.0)), 4).alias("quality_overall"), round_half_up(F.coalesce("share", F.lit(0.0)), 4).alias("completeness"),
        F.coalesce("channel_ready", F.lit(False)).alias("channel_ready"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "suspected_duplicate_of",
    )


@dataclass(frozen=True)
class Filters:
    """What a list shows; None asks for all."""

    q: str | None = None
    category: str | None = None
    vertical: str | None = None
    manufacturer: str | None = None
    maker_part: str | None = None
    status: str | None = None
    ready: bool | None = None
    families: bool | None = None
    flagged: bool | None = None

    def conditions(self) -> list[Column]:
        out = [F.col(name) == value for name, value in (("category_id", self.category), ("vertical", self.vertical), ("manufacturer", self.manufacturer), ("status", self.status), ("channel_ready", self.ready), ("is_family", self.families)) if value is not None]
        if self.q:
            needle = F.lit(self.q.lower().strip())
            found = [F.contains(F.lower(F.coalesce(c, F.lit(""))), needle) for c in ("mpn", "manufacturer", "name", "series")]
            out.append(found[0] | found[1] | found[2] | found[3])
        if self.maker_part:
            out.append(F.contains(F.lower("manufacturer"), F.lit(self.maker_part.lower())))
        if self.flagged:
            out.append(F.col("open_flags") > 0)
        return out


def filtered(rows: DataFrame, filters: Filters) -> DataFrame:
    for condition in filters.conditions():
        rows = rows.where(condition)
    return rows


def page(rows: DataFrame, sort: str = "mpn", offset: int = 0, limit: int = 200) -> tuple[DataFrame, int]:
    """A page of a list, and how many rows the list has; ties are in order of the id, an unknown order is that of part numbers."""
    direction, *keys = SORTS.get(sort, SORTS["mpn"])
    keyed = rows.withColumns({"maker_key": F.lower("manufacturer"), "mpn_key": F.lower("mpn")})
    found = keyed.orderBy(*[direction(k) for k in keys], "product_id").offset(offset).limit(limit)
    return found.drop("maker_key", "mpn_key"), rows.count()


def review_list(open_flags: DataFrame, products: DataFrame, definitions: DataFrame, severity: str | None = None, reason: str | None = None, product_id: str | None = None, limit: int = 100) -> DataFrame:
    """The most urgent flags with part number, maker and the attribute's name; filters apply to the first RANKED_FLAGS of all."""
    top = prioritised(open_flags, RANKED_FLAGS)
    if severity is not None:
        top = top.where(F.col("severity") == severity)
    if reason is not None:
        top = top.where(F.substring_index("reason", ":", 1) == reason)
    if product_id is not None:
        top = top.where(F.col("product_id") == product_id)
    names = definitions.select("category_id", "code", F.col("name").alias("attribute_name"))
    rows = top.join(products.select(F.col("product_id").cast("string").alias("product_id"), "manufacturer", "mpn", "category_id"), "product_id")
    return rows.join(names, ["category_id", "code"], "left").orderBy(F.desc("priority"), "flag_id").limit(limit)


def spec_phrases(attributes: DataFrame, definitions: DataFrame, most: int = 8) -> DataFrame:
    """The attributes that describe a product best: 3 for telling variants apart, and 2 for core or 1 for ecommerce; then by code, at most ``most``.

    definitions: code, variant_defining, required_core, required_ecommerce, generated, identity.
    """
    weight = F.when(F.col("variant_defining"), 3).otherwise(0) + F.when(F.col("required_core"), 2).when(F.col("required_ecommerce"), 1).otherwise(0)
    rows = attributes.join(definitions.where("not generated and not identity").select("code", weight.alias("weight")), "code")
    place = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("weight"), "code"))
    return rows.withColumn("place", place).where(F.col("place") <= most)
