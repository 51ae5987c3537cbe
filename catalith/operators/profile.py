"""Profiles of tables in one scan: counts, bounds, and mergeable sketches of distinct values and quantiles for each column.

A profile is a small table that can be stored for each batch and combined later without reading the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def sketched(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: column_name, n, filled, low and high (numbers, null for other types), first and last (texts), distinct and quantiles (sketches).

    All columns are worked out in one aggregation of one scan. NaN counts as filled and has no part in bounds and quantiles.
    """
    names = columns or rows.columns
    cells: list[Column] = []
    parts: list[Column] = []
    for i, name in enumerate(names):
        kind, value = rows.schema[name].dataType, rows[name]
        number = isinstance(kind, NumericType)
        text = value.cast("string")
        x = F.when(~F.isnan(value.cast("double")), value.cast("double")) if number else F.lit(None).cast("double")
        cells += [
            F.count("*").alias(f"n{i}"), F.count(value).alias(f"f{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            (F.lit(None).cast("string") if number else F.min(text)).alias(f"a{i}"), (F.lit(None).cast("string") if number else F.max(text)).alias(f"z{i}"),
            F.hll_sketch_agg(text if not isinstance(kind, BooleanType) else value.cast("int"), F.lit(14)).alias(f"d{i}"), (F.kll_sketch_agg_double(x) if number else F.lit(None).cast("binary")).alias(f"k{i}"),
        ]
        columns_of = [(f"n{i}", "n"), (f"f{i}", "filled"), (f"lo{i}", "low"), (f"hi{i}", "high"), (f"a{i}", "first"), (f"z{i}", "last"), (f"d{i}", "distinct"), (f"k{i}", "quantiles")]
        parts.append(F.struct(F.lit(name).alias("column_name"), *[F.col(c).alias(as_) for c, as_ in columns_of]))
    return rows.agg(*cells).select(F.inline(F.array(*parts)))


def combined(profiles: DataFrame) -> DataFrame:
    """Profiles of several batches as one: sketches are merged."""
    return profiles.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.hll_union_agg("distinct", F.lit(True)).alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def summarized(profiles: DataFrame) -> DataFrame:
    """column_name, n, null_share, low, high, first, last, distinct_about and quartiles of profiles."""
    share = F.when(F.col("n") > 0, (F.col("n") - F.col("filled")) / F.col("n")).otherwise(0.0)
    number = F.col("low").isNotNull()
    quartiles = [F.when(number, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(name) for name, q in QUARTILES.items()]
    return profiles.select("column_name", "n", share.alias("null_share"), "low", "high", "first", "last", F.hll_sketch_estimate("distinct").alias("distinct_about"), *quartiles)
