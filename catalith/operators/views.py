"""Read views over the catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import vocabulary
from catalith.functions.normalize import round_half_up


def display_name(name: Column, manufacturer: Column, mpn: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat_ws(" ", manufacturer, mpn))


def product_summary(products: DataFrame, attributes: DataFrame, conflicts: DataFrame, flags: DataFrame) -> DataFrame:
    """Each product with its numbers of attributes, conflicts and open flags."""
    counts = [attributes.groupBy("product_id").agg(F.count("*").alias("attributes")), conflicts.groupBy("product_id").agg(F.count("*").alias("conflicts")), flags.where("not resolved").groupBy("product_id").agg(F.count("*").alias("open_flags"))]
    out = products
    for c in counts:
        out = out.join(c, "product_id", "left")
    return out.fillna(0, ["attributes", "conflicts", "open_flags"])


def attribute_view(records: DataFrame, observations: DataFrame) -> DataFrame:
    """Records with the number of observations behind them, at least one."""
    seen = observations.groupBy("product_id", "code").agg(F.count("*").alias("n"))
    return records.join(seen, ["product_id", "code"], "left").withColumn("observations", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).drop("n")


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, rows in tables.items():
        n = rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def scorecard_lift(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """Change of each metric between two scorecards of one row each."""
    b = before.select(*[F.col(m).alias(f"b_{m}") for m in metrics])
    joined = after.crossJoin(F.broadcast(b))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").cast("double").alias("before"), F.col(m).cast("double").alias("after")) for m in metrics])
    return joined.select(F.explode(rows).alias("r")).select("r.*", round_half_up(F.col("r.after") - F.col("r.before"), 4).alias("lift"))


def issues(*producers: DataFrame) -> DataFrame:
    """Validation issues of all producers: product_id, code, level, kind, message."""
    columns = ["product_id", "code", "level", "kind", "message"]
    out = producers[0].select(columns)
    for more in producers[1:]:
        out = out.unionByName(more.select(columns))
    return out


def resolved(asked: DataFrame, products: DataFrame) -> DataFrame:
    """Product of each request (request_id, gtin, mpn): by GTIN, else by part number."""
    by_gtin = products.where("gtin is not null").groupBy("gtin").agg(F.min("product_id").alias("g"))
    by_mpn = products.groupBy("mpn").agg(F.min("product_id").alias("m"))
    return asked.join(by_gtin, "gtin", "left").join(by_mpn, "mpn", "left").select("request_id", F.coalesce("g", "m").alias("product_id"))


def alt_text(name: Column, category: Column, shot: Column) -> Column:
    """Alternative text of an image, at most 125 characters, by what it shows."""
    def said(phrase: str) -> Column:
        before, _, after = phrase.partition("{}")
        return F.concat(F.lit(before), name, F.lit(after))

    text = said(vocabulary.ALT_PHRASES["unknown"])
    for kind, phrase in vocabulary.ALT_PHRASES.items():
        text = F.when(shot == kind, said(phrase)).otherwise(text)
    return F.left(F.concat(text, F.lit(" ("), category, F.lit(")")), F.lit(125))


def label_values(rows: DataFrame) -> DataFrame:
    """From table rows (row_id, cells): the label and the first filled cell after it."""
    rest = F.filter(F.slice("cells", 2, 1 << 20), lambda c: F.trim(c) != "")
    return rows.where((F.size("cells") >= 2) & (F.size(rest) > 0)).select("row_id", F.trim(F.col("cells")[0]).alias("label"), F.trim(rest[0]).alias("value"))


def variant_row(tables: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first row of a variant table (table_id, pos, key, cells) whose key is the part number asked for."""
    hits = tables.join(wanted, tables.key == wanted.mpn)
    return hits.groupBy("table_id", "mpn").agg(F.min_by("cells", "pos").alias("cells"))
