"""Views of one product or attribute, and rankings of fragments and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.identity import normalize_mpn
from catalith.functions.normalize import label, round_half_up

# Codes that identify a product.
IDENTITY = ["manufacturer", "mpn", "gtin", "series"]
CHANNELS = ["core", "ecommerce", "enhanced"]


def display_rank(code: Column, generated: Column, variant_defining: Column, required_core: Column) -> Column:
    """Identity first, then what tells variants apart, then required codes, the rest, and generated copy."""
    return F.when(code.isin(IDENTITY), 0).when(generated, 4).when(variant_defining, 1).when(required_core, 2).otherwise(3)


def evidence_view(attributes: DataFrame, sources: DataFrame) -> DataFrame:
    """Attributes with the name of their source (source_id, name), its id where the name isn't known."""
    named = attributes.join(sources.select("source_id", F.col("name").alias("known")), "source_id", "left")
    return named.withColumn("source_name", F.coalesce("known", "source_id")).drop("known")


def relations(edges: DataFrame, products: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges with a label of their end: a certification's or source's name, else the part number, else the id."""
    mpns = products.select(F.col("product_id").alias("dst"), F.col("mpn"))
    names = sources.select(F.col("source_id").alias("dst"), F.col("name"))
    joined = edges.join(mpns, "dst", "left").join(names, "dst", "left")
    shown = F.when(F.col("dst").startswith("cert:"), F.substring("dst", 6, 1 << 20)).when(F.col("dst").startswith("src_"), F.coalesce("name", "dst")).otherwise(F.coalesce("mpn", "dst"))
    return joined.select("src", "predicate", "dst", shown.alias("label"))


def product_detail(products: DataFrame, attributes: DataFrame, conflicts: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Products with nested attributes in display order (attributes have ``rank``), conflicts, relations and assets; each child is grouped once before it is joined."""
    def children(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    out = products.join(children(attributes, "attributes", "rank", "code", "value_number", "value_text", "confidence"), "product_id", "left")
    out = out.join(children(conflicts, "conflicts", "code", "rule", "severity"), "product_id", "left")
    out = out.join(children(edges.withColumnRenamed("src", "product_id"), "relations", "predicate", "dst"), "product_id", "left")
    return out.join(children(assets, "assets", "asset_id"), "product_id", "left")


def drill_down(observations: DataFrame, records: DataFrame, product_id, code: str) -> DataFrame:
    """All observations of one attribute of one product and whether their source won; the key's filter reaches both scans."""
    one = (F.col("product_id") == product_id) & (F.col("code") == code)
    winner = records.where(one).select("product_id", "code", F.col("source_id").alias("winner"))
    return observations.where(one).join(winner, ["product_id", "code"], "left").withColumn("won", F.coalesce(F.col("source_id") == F.col("winner"), F.lit(False))).drop("winner")


def shown(attributes: DataFrame) -> DataFrame:
    """Attributes with their tag of origin and band of confidence, as a console shows them."""
    tag = F.when(F.col("generated"), "GEN").when(F.col("inferred"), "INF").otherwise("SRC")
    band = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    return attributes.withColumns({"tag": tag, "band": band})


def schema_detail(definitions: DataFrame, aliases: DataFrame, most: int = 8) -> DataFrame:
    """Definitions with their first aliases in order, at most ``most``."""
    row = F.row_number().over(Window.partitionBy("code").orderBy("alias"))
    few = aliases.select("code", "alias").distinct().withColumn("r", row).where(F.col("r") <= most)
    return definitions.join(few.groupBy("code").agg(F.array_sort(F.collect_list("alias")).alias("aliases")), "code", "left")


def required_codes(definitions: DataFrame) -> DataFrame:
    """category_id, channel and code for every channel that requires a code: a channel requires what the ones before it do."""
    at = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel")).cast("int")
    every = F.slice(F.array(*[F.lit(c) for c in CHANNELS]), at, F.lit(len(CHANNELS)))
    return definitions.where(at > 0).select("category_id", F.explode(every).alias("channel"), "code").distinct()


def range_partners(definitions: DataFrame) -> DataFrame:
    """Pairs of codes of a category that hold the ends of one range: stem_min with stem_max, stem_min_c with stem_max_c."""
    part = [F.regexp_extract("code", r"^(.*)_(min|max)(_c)?$", k) for k in (1, 2, 3)]
    ends = definitions.select("category_id", "code", part[0].alias("stem"), part[1].alias("end"), part[2].alias("tail")).where("end <> ''")
    low = ends.where("end = 'min'").select("category_id", "stem", "tail", F.col("code").alias("low_code"))
    high = ends.where("end = 'max'").select("category_id", "stem", "tail", F.col("code").alias("high_code"))
    return low.join(high, ["category_id", "stem", "tail"]).select("category_id", "low_code", "high_code")


def identity_observations(products: DataFrame, known: DataFrame) -> DataFrame:
    """manufacturer, mpn and series of each product and source as observations, but for those known already."""
    codes = ["manufacturer", "mpn", "series"]
    cells = F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("string").alias("value_text")) for c in codes])
    rows = products.select("product_id", "source_id", F.explode(cells).alias("a")).select("product_id", "source_id", "a.*").where("trim(value_text) <> ''")
    return rows.join(known.select("product_id", "source_id", "code"), ["product_id", "source_id", "code"], "left_anti")


def ranked_fragments(fragments: DataFrame, aliases: list[str], most: int = 12) -> DataFrame:
    """The fragments (product_id, fragment_id, kind, text) of each product that name most of the aliases, tables counting 1.4 times."""
    words = sorted({a for a in aliases if len(a) > 2})
    body = label(F.col("text"))
    hits = sum((F.contains(body, F.lit(a)).cast("int") for a in words), F.lit(0))
    scored = fragments.select("product_id", "fragment_id", round_half_up(hits * F.when(F.col("kind").isin("table", "keyvalue"), 1.4).otherwise(1.0), 4).alias("score")).where("score > 0")
    row = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("score"), "fragment_id"))
    return scored.withColumn("place", row).where(F.col("place") <= most)


def bare_quantity_codes(definitions: DataFrame) -> DataFrame:
    """Of each unit family, the code that a quantity without a label means: what tells variants apart, then core, then ecommerce, then first."""
    order = [F.desc("variant_defining"), F.desc("required_core"), F.desc("required_ecommerce"), F.col("pos")]
    row = F.row_number().over(Window.partitionBy("unit_family").orderBy(*order))
    return definitions.where("not generated and unit_family is not null").withColumn("r", row).where("r = 1").drop("r")


def classified(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """Category of each product: a confident one (.8, not generic) stays; another gives way only to a higher confidence."""
    new = proposed.select("product_id", F.col("category_id").alias("new"), F.col("confidence").alias("sure"))
    keep = ((F.col("confidence") >= 0.8) & (F.col("category_id") != "industrial.generic")) | ~F.coalesce(F.col("sure") > F.col("confidence"), F.lit(False))
    joined = current.join(new, "product_id", "left")
    return joined.select("product_id", F.when(keep, F.col("category_id")).otherwise(F.col("new")).alias("category_id"), F.when(keep, F.col("confidence")).otherwise(F.col("sure")).alias("confidence"))


def looked_up(asked: DataFrame, products: DataFrame) -> DataFrame:
    """Product of each identifier (asked): by id, else by normalised part number, the smallest id of equal ones."""
    by_id = products.select(F.col("product_id").alias("asked"), F.col("product_id").alias("by_id"))
    by_mpn = products.groupBy(normalize_mpn(F.col("mpn")).alias("key")).agg(F.min("product_id").alias("by_mpn"))
    return asked.join(by_id, "asked", "left").withColumn("key", normalize_mpn(F.col("asked"))).join(by_mpn, "key", "left").select("asked", F.coalesce("by_id", "by_mpn").alias("product_id"))


def content_confidence(facts: DataFrame, unverified: DataFrame, generation: float = 0.85) -> DataFrame:
    """Confidence of a product's generated copy: mean of its facts' confidences above 0 (.5 if none), times the penalty of generation, halved if the copy states unverified numbers."""
    mean = facts.groupBy("product_id").agg(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.5)).alias("source_facts"))
    doubt = unverified.select("product_id").distinct().withColumn("doubtful", F.lit(True))
    score = round_half_up(F.col("source_facts") * generation, 4)
    halved = F.when(F.coalesce("doubtful", F.lit(False)), round_half_up(score * 0.5, 4)).otherwise(score)
    return mean.join(doubt, "product_id", "left").select("product_id", halved.alias("confidence"))


def learned_synonyms(corrections: DataFrame, at_least: int = 1) -> DataFrame:
    """Spellings that corrections replaced by an allowed value: code, synonym and the value chosen most often, the first of ties."""
    seen = corrections.where("lower(trim(old_value)) <> lower(trim(new_value))").groupBy("code", F.lower(F.trim("old_value")).alias("synonym"), "new_value").agg(F.count("*").alias("times"))
    best = seen.groupBy("code", "synonym").agg(F.min(F.struct((-F.col("times")).alias("t"), F.col("new_value").alias("value"))).alias("b"))
    return best.where(-F.col("b.t") >= at_least).select("code", "synonym", "b.value", (-F.col("b.t")).alias("times"))
