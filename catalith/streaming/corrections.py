"""Corrections as a stream: each micro-batch changes several tables at once and may be run again.

Base tables stay as they are. A folder holds what corrections add to them: human evidence, records of touched
keys, scores of touched products, resolved flags, learned spellings, refused corrections. A batch writes them as
one version whose name holds the batch's number; a batch whose number is published is left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import quality, review
from catalith.operators.detail import learned_synonyms
from catalith.operators.golden import KEY, golden_records
from catalith.sinks import versions
from catalith.sources.kept import kept

#: A correction: what a reviewer says a product's attribute is.
CORRECTION = "correction_seq long, product_id string, code string, raw string, reviewer string"
HISTORY = "product_id string, code string, old_value string, new_value string, reviewer string"
REFUSED = "correction_seq long, product_id string, code string, errors array<string>"


def _replaced(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    return base.join(delta.select(*key).distinct(), key, "left_anti").unionByName(delta.select(base.columns))


def _added(spark: SparkSession, base: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """The last version's tables, empty before the first."""
    builds = versions.published(spark, root)
    kinds = {"human": base["observations"].schema, "golden": base["golden"].schema, "scores": base["scores"].schema, "resolved": "flag_id string", "history": HISTORY, "refused": REFUSED}
    if not builds:
        return {name: spark.createDataFrame([], kind) for name, kind in kinds.items()}
    return {name: spark.read.schema(kind).parquet(f"{builds[-1]}/{name}") for name, kind in kinds.items()}


def current(spark: SparkSession, base: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """observations, golden, scores and flags (with ``resolved``) as they are with all corrections, synonyms learned from them, and the refused ones."""
    more = _added(spark, base, root)
    done = more["resolved"].withColumn("done", F.lit(True))
    flags = base["flags"].drop("resolved").join(done, "flag_id", "left").withColumn("resolved", F.coalesce("done", F.lit(False))).drop("done")
    return {
        "observations": base["observations"].unionByName(more["human"]),
        "golden": _replaced(base["golden"], more["golden"], KEY),
        "scores": _replaced(base["scores"], more["scores"], ["product_id"]),
        "flags": flags,
        "synonyms": learned_synonyms(more["history"]),
        "refused": more["refused"],
    }


def applied(spark: SparkSession, root: str, batch: int) -> bool:
    return any(f"/corrections-{batch}-" in path for path in versions.published(spark, root))


def correction_batches(base: dict[str, DataFrame], definitions: DataFrame, required: DataFrame, checks: DataFrame, root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over CORRECTION rows: correct, rebuild the touched keys, score their products, resolve their flags, learn.

    base: products, observations, golden, scores, flags; the others as ``review.correct`` and ``quality.quality`` take them.
    What a definition refuses is kept with its errors and changes nothing else.
    """

    def apply(asked: DataFrame, batch: int) -> None:
        spark = asked.sparkSession
        if applied(spark, root, batch):
            return
        asked = kept(asked, f"corrections-{batch}")
        more, now, version = _added(spark, base, root), current(spark, base, root), versions.Version(spark, root, f"corrections-{batch}")
        last = now["observations"].agg(F.coalesce(F.max("obs_seq"), F.lit(0))).first()[0]
        grown, records, refused = review.correct(now["observations"], base["products"], definitions, asked, golden_records)
        version.write("human", more["human"].unionByName(grown.where(F.col("obs_seq") > F.lit(last)).select(more["human"].columns)))
        version.write("refused", more["refused"].unionByName(refused.select(more["refused"].columns)))
        # keys that the batch refused are no touched keys
        records = kept(records.select(base["golden"].columns), f"corrected-{batch}")
        version.write("golden", _replaced(more["golden"], records, KEY))
        products = base["products"].join(records.select("product_id").distinct(), "product_id", "left_semi")
        facts = _replaced(now["golden"].join(products.select("product_id"), "product_id", "left_semi"), records, KEY)
        facts = facts.withColumns({"generated": F.lit(False), "inferred": F.lit(False), "verified": F.coalesce("quote_verified", F.lit(False))})
        scores = quality.quality(products, facts, required, checks.join(products.select("product_id"), "product_id", "left_semi"))
        version.write("scores", _replaced(more["scores"], scores, ["product_id"]))
        touched = records.select(*KEY)
        version.write("resolved", more["resolved"].unionByName(base["flags"].join(touched, KEY, "left_semi").select("flag_id")).distinct())
        shown = F.coalesce("value_text", F.col("value_number").cast("string"))
        old, new = now["golden"].select(*KEY, shown.alias("old_value")), records.select(*KEY, shown.alias("new_value"))
        said = asked.join(new, KEY).join(old, KEY, "left").select("product_id", "code", F.coalesce("old_value", F.lit("")).alias("old_value"), "new_value", "reviewer")
        version.write("history", more["history"].unionByName(said))
        version.publish()

    return apply
