"""From fragments of sources to observations of products: tables and pairs first, then prose for codes that they lack.

fragments: product_id, mpn, source_id, pos, kind, row_scoped, cells, text, as ``intake.assigned`` gives them with the
products' ids; aliases: code, alias (as labels are written: lower case, single blanks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.extraction import label_and_value, table_orientation
from catalith.functions.identity import normalize_mpn
from catalith.functions.normalize import label, quote_found, squeezed
from catalith.operators.linking import label_codes

#: An alias is looked for in prose from this length on.
PROSE_ALIAS = 4
#: Characters of a value in prose.
PROSE_VALUE = 90
PASSES = ["variant_matrix", "label_value", "prose"]
RAW = ["product_id", "source_id", "pos", "row", "column", "label", "raw", "method", "pass"]


def _table_pairs(fragments: DataFrame) -> DataFrame:
    """label and raw value from tables and pairs.

    A table with a header of three or more cells whose first names a key gives the row of the product's own
    part number, the first one; any other gives each row's label and the first filled cell after it.
    """
    rows = fragments.where(F.col("kind").isin("table", "keyvalue") & (F.size("cells") > 0)).withColumn("shape", F.when(F.col("row_scoped"), "label_value").otherwise(table_orientation(F.col("cells"))))
    method = F.when(F.col("row_scoped"), "structured_feed").otherwise("native_table")
    wide = rows.where("shape = 'variant_matrix'")
    own = F.get(F.filter(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))), lambda r: normalize_mpn(F.get(r, F.lit(0))) == normalize_mpn(F.col("mpn"))), F.lit(0))
    matched = wide.withColumn("own", own).where("own is not null")
    cells = matched.select("product_id", "source_id", "pos", F.lit(0).alias("row"), F.posexplode(F.arrays_zip(F.col("cells")[0].alias("head"), F.col("own").alias("value"))).alias("column", "c"), method.alias("method"), F.lit("variant_matrix").alias("pass"))
    matrix = cells.where("column > 0").select("product_id", "source_id", "pos", "row", "column", F.col("c.head").alias("label"), F.trim("c.value").alias("raw"), "method", "pass")
    narrow = rows.where("shape <> 'variant_matrix'").select("product_id", "source_id", "pos", F.posexplode("cells").alias("row", "cell"), method.alias("method"))
    rest = F.filter(F.slice("cell", F.lit(2), F.greatest(F.size("cell") - 1, F.lit(0))), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    pairs = narrow.where(F.size(rest) > 0).select("product_id", "source_id", "pos", "row", F.lit(1).alias("column"), F.trim(F.col("cell")[0]).alias("label"), F.trim(rest[0]).alias("raw"), "method", F.lit("label_value").alias("pass"))
    return matrix.unionByName(pairs).where("coalesce(raw, '') <> '' and coalesce(label, '') <> ''").select(RAW)


def _coded(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs with the code of their label; labels that mean nothing go."""
    labels = pairs.select(F.struct(*RAW).alias("label_id"), label(F.col("label")).alias("label"))
    return label_codes(labels, aliases).select("label_id.*", "code")


def _prose_pairs(fragments: DataFrame) -> DataFrame:
    """What texts give as 'words: value', 'words - value' or 'words  value': one pair for each line or clause."""
    clauses = fragments.where("kind in ('text', 'heading')").select("product_id", "source_id", "pos", F.posexplode(F.split("text", r"[\n;|]|(?<=[a-z0-9)])\.\s")).alias("row", "clause"))
    pairs = clauses.withColumn("found", label_and_value(F.col("clause"))).where("found is not null")
    pairs = pairs.withColumn("label", F.col("found.label")).withColumn("raw", F.btrim(F.left("found.value", F.lit(PROSE_VALUE)), F.lit(" ")))
    pairs = pairs.withColumn("raw", F.rtrim(F.regexp_replace("raw", r"[.,;]+$", "")))
    return pairs.where("label <> '' and raw <> ''").select("product_id", "source_id", "pos", "row", F.lit(0).alias("column"), "label", "raw", F.lit("native_text").alias("method"), F.lit("prose").alias("pass")).select(RAW)


def observations(fragments: DataFrame, aliases: DataFrame, mirrors: DataFrame | None = None) -> DataFrame:
    """product_id, code, obs_seq, raw, quote, method and source_id of all values that sources state.

    Values arrive in the order of sources, then tables before prose, then place. Prose counts only for
    codes that the same source's tables and pairs don't give for the product, and the first such value alone.
    Fragments are read several times, so give a stored table.
    With mirrors (source_id, text), quote_verified tells whether the source holds label and value.
    """
    stated = _coded(_table_pairs(fragments), aliases)
    told = _coded(_prose_pairs(fragments), aliases.where(F.length("alias") >= PROSE_ALIAS))
    key, prose = ["product_id", "source_id", "code"], F.col("pass") == "prose"
    first = F.row_number().over(Window.partitionBy(*key, prose).orderBy("pos", "row", "column", "label", "raw"))
    tables = F.max(F.when(~prose, F.lit(1)).otherwise(0)).over(Window.partitionBy(*key))
    rows = stated.unionByName(told).withColumn("first", first).withColumn("tables", tables)
    rows = rows.where(~prose | ((F.col("tables") == 0) & (F.col("first") == 1))).drop("first", "tables")
    rows = rows.withColumn("quote", F.concat("label", F.lit(": "), "raw"))
    if mirrors is not None:
        text = mirrors.select("source_id", squeezed(F.col("text")).alias("source_text"))
        found = quote_found(squeezed(F.col("quote")), F.col("source_text")) | F.contains(F.col("source_text"), squeezed(F.col("raw")))
        rows = rows.join(text, "source_id", "left").withColumn("quote_verified", F.coalesce(found, F.lit(False))).drop("source_text")
    return rows.withColumn("obs_seq", arrival()).drop("pos", "row", "column", "label", "pass")


def arrival() -> Column:
    """Order of arrival as one number: a part of the source's hash, the pass, and the place."""
    wide = lambda n: F.lit(str(n)).cast("decimal(30,0)")
    rank = F.array_position(F.array(*[F.lit(p) for p in PASSES]), F.col("pass"))
    parts = [(F.pmod(F.xxhash64("source_id"), F.lit(1 << 30)), 1 << 80), (rank, 1 << 76), (F.col("pos"), 1 << 45), (F.col("row"), 1 << 14), (F.col("column"), 1)]
    total = F.lit("0").cast("decimal(38,0)")
    for value, weight in parts:
        total = total + value.cast("decimal(20,0)") * wide(weight)
    return total.cast("decimal(38,0)")
