"""Review flags: producers, identity, priority, merging with what was resolved, and learning from corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import identity, vocabulary
from catalith.functions.values import normalized
from catalith.operators.golden import lookup

FLAG = ["product_id", "code", "reason", "severity", "confidence", "key"]
#: Read values below this confidence are flagged.
REVIEW_CONFIDENCE = 0.7
#: Failed rules of one product that are flagged.
RULE_FLAGS = 5


def flags(*sources: DataFrame) -> DataFrame:
    """Union of flag producers with an id made of product, code and key (the reason, where a producer has no key); equal flags count once."""
    named = [rows if "key" in rows.columns else rows.withColumn("key", F.col("reason")) for rows in sources]
    out = named[0].select(*FLAG)
    for more in named[1:]:
        out = out.unionByName(more.select(*FLAG))
    return out.withColumn("flag_id", identity.flag_id(F.col("product_id"), F.col("code"), F.col("key"))).drop("key").dropDuplicates(["flag_id"])


def producer(rows: DataFrame, reason: str | Column, severity: str | Column, confidence: Column, key: str | Column | None = None) -> DataFrame:
    """Flags of the rows; ``key`` names the kind of a flag in its id, its reason where there is none."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    code = F.col("code") if "code" in rows.columns else F.lit(None).cast("string")
    kind = as_column(reason if key is None else key)
    return rows.select(F.col("product_id").cast("string").alias("product_id"), code.alias("code"), as_column(reason).alias("reason"), as_column(severity).alias("severity"), confidence.cast("double").alias("confidence"), kind.alias("key"))


def product_flags(
    products: DataFrame, records: DataFrame, conflicts: DataFrame, missing: DataFrame, outliers: DataFrame, rule_errors: DataFrame, channel: str = "ecommerce", threshold: float = REVIEW_CONFIDENCE,
) -> DataFrame:
    """Flags of all producers.

    products: product_id, suspected_duplicate_of, duplicate_evidence; records: product_id, code, confidence, generated, notes, errors
    and reasons (arrays); conflicts: product_id, code, severity, winning_value, losing_values (array); missing: product_id, code,
    name, is_core; outliers: product_id, code, message; rule_errors: product_id, message (as issues have them), in order.
    """
    sure = records.select("product_id", "code", F.col("confidence").alias("own"))
    half = F.coalesce("own", F.lit(0.5))
    critical = conflicts.where("severity = 'critical'").join(sure, ["product_id", "code"], "left")
    losers = F.array_join(F.slice("losing_values", 1, 3), ", ")
    twins = products.where("suspected_duplicate_of is not null")
    twin = F.format_string("possible_duplicate: %s. Confirm whether this is a distinct product or an OCR misread of %s.", F.col("duplicate_evidence"), F.col("suspected_duplicate_of"))
    lacking = F.format_string(f"missing_required%s: %s is required for the {channel} channel", F.when(F.col("is_core"), "_core").otherwise(""), F.coalesce("name", "code"))
    unverified = F.get(F.filter("notes", lambda n: F.contains(F.lower(n), F.lit("unverified"))), F.lit(0))
    weak = records.where((~F.col("generated")) & (F.col("confidence") < threshold))
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy("message"))
    rules = rule_errors.withColumn("place", rank).where(F.col("place") <= RULE_FLAGS)
    return flags(
        producer(critical, F.format_string("conflict_critical: sources disagree (%s vs %s)", F.col("winning_value"), losers), "critical", half, "conflict_critical"),
        producer(twins.drop("code"), twin, "critical", F.lit(0.3), "possible_duplicate"),
        producer(missing, lacking, F.when(F.col("is_core"), "critical").otherwise("warning"), F.lit(0.0), "missing_required"),
        producer(records.where("generated").where(unverified.isNotNull()), F.concat(F.lit("generated_unverified: "), unverified), "critical", F.col("confidence"), "generated_unverified"),
        producer(weak, F.format_string("low_confidence: %.2f -- %s", F.col("confidence"), F.array_join(F.slice("reasons", 1, 2), "; ")), "warning", F.col("confidence"), "low_confidence"),
        producer(records.where(F.size("errors") > 0), F.concat(F.lit("validation_error: "), F.array_join(F.slice("errors", 1, 2), "; ")), "critical", F.col("confidence"), "validation_error"),
        producer(outliers.join(sure, ["product_id", "code"], "left"), F.concat(F.lit("outlier: "), "message"), "warning", half, "outlier"),
        producer(rules.drop("code"), F.concat(F.lit("validation_error: "), "message"), "critical", F.lit(0.4), F.concat(F.lit("validation_error:"), F.left("message", F.lit(30)))),
    )


def priority(reason: Column, severity: Column, confidence: Column) -> Column:
    """Weight of the reason, times severity, times doubt."""
    weight = lookup(vocabulary.REASON_WEIGHT, F.substring_index(reason, ":", 1), 0.5)
    return weight * lookup(vocabulary.SEVERITY_BOOST, severity, 1.0) * (1 - F.least(confidence, F.lit(0.99)))


def prioritised(open_flags: DataFrame, limit: int) -> DataFrame:
    ranked = open_flags.withColumn("priority", priority(F.col("reason"), F.col("severity"), F.col("confidence")))
    return ranked.orderBy(F.desc("priority"), "flag_id").limit(limit)


def merged(queue: DataFrame, fresh: DataFrame) -> DataFrame:
    """Queue after a build: resolved flags are never raised again, open ones take their new values, the rest stays."""
    resolved = queue.where("resolved")
    kept = queue.where("not resolved").join(fresh.select("flag_id"), "flag_id", "left_anti")
    new = fresh.join(resolved.select("flag_id"), "flag_id", "left_anti").withColumn("resolved", F.lit(False))
    return resolved.unionByName(kept).unionByName(new.select(queue.columns))


def stats(open_flags: DataFrame) -> DataFrame:
    """Flags and products affected by reason and severity."""
    return open_flags.groupBy(F.substring_index("reason", ":", 1).alias("reason"), "severity").agg(F.count("*").alias("flags"), F.count_distinct("product_id").alias("products"))


def learned_defaults(corrections: DataFrame, by: list[str], value: str, at_least: int = 3) -> DataFrame:
    """Corrections made the same way often enough to be a default."""
    return corrections.groupBy(*by, value).agg(F.count("*").alias("times")).where(F.col("times") >= at_least)


def corrected(observations: DataFrame, corrections: DataFrame) -> DataFrame:
    """Observations with corrections (product_id, code, value_number, value_text, reviewer) appended as human evidence, last ones last."""
    last = observations.agg(F.coalesce(F.max("obs_seq"), F.lit(0)).alias("last"))
    seq = F.col("last") + F.col("correction_seq")
    human = corrections.crossJoin(F.broadcast(last)).select("product_id", "code", seq.alias("obs_seq"), "value_number", "value_text", F.concat(F.lit("human:"), "reviewer").alias("source_id"), F.lit("user").alias("source_kind"), F.lit("human").alias("method"), F.lit(True).alias("quote_verified"))
    return observations.unionByName(human.select(observations.columns))


def correct(observations: DataFrame, products: DataFrame, definitions: DataFrame, corrections: DataFrame, rebuild, synonyms: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply corrections (correction_seq, product_id, code, raw, reviewer): the new observations, the records of the touched keys, and the refused ones with their errors.

    Values are normalised by their definition first; of codes that the category lacks, and of values that it
    refuses, nothing is written. ``rebuild`` makes records of observations (as golden_records does); it
    gets the observations of touched keys only, found by a semi join. Store the records with ``upsert``.
    """
    of = products.select("product_id", "category_id")
    asked = corrections.join(of, "product_id", "left").join(definitions.withColumn("known", F.lit(True)), ["category_id", "code"], "left")
    checked = normalized(asked, synonyms)
    empty = F.col("value_number").isNull() & F.col("value_text").isNull() & F.col("value_boolean").isNull() & F.col("value_list").isNull()
    unknown = F.when(F.col("known").isNull(), F.array(F.concat(F.lit("not an attribute of "), F.coalesce("category_id", F.lit("an unknown product")))))
    refused = checked.where(empty | F.col("known").isNull()).select("correction_seq", "product_id", "code", F.coalesce(unknown, F.col("errors")).alias("errors"))
    text = F.coalesce("value_text", F.col("value_boolean").cast("string"), F.array_join("value_list", ", "))
    kept = checked.where(~empty & F.col("known")).select("product_id", "code", "correction_seq", "value_number", text.alias("value_text"), "reviewer")
    grown = corrected(observations, kept)
    touched = grown.join(kept.select("product_id", "code").distinct(), ["product_id", "code"], "left_semi")
    return grown, rebuild(touched), refused
