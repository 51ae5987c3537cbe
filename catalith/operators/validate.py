"""Validation issues of products: identity, definitions, values, evidence, rules, outliers and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.normalize import render_number
from catalith.operators.linking import verified_quotes
from catalith.operators.views import issues
from catalith.sources.kept import kept, once


def _issue(rows: DataFrame, code: Column | None, level: str, kind: str, message: Column) -> DataFrame:
    named = code if code is not None else F.lit(None)
    return rows.select(F.col("product_id"), named.cast("string").alias("code"), F.lit(level).alias("level"), F.lit(kind).alias("kind"), message.alias("message"))


def identity_issues(products: DataFrame) -> DataFrame:
    """Products without a maker or a part number."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    lack = [_issue(products.where(blank(F.col(c))), None, "error", "identity", F.lit(text)) for c, text in (("manufacturer", "product has no manufacturer"), ("mpn", "product has no manufacturer part number"))]
    return lack[0].unionByName(lack[1])


def definition_issues(products: DataFrame, records: DataFrame, definitions: DataFrame, categories: DataFrame) -> DataFrame:
    """Records of codes that the category doesn't define, and of the others their errors, values that aren't allowed, and values without evidence.

    records: product_id, code, value_number, value_text, errors, notes (arrays), source_id, strategy; definitions:
    category_id, code, datatype, allowed; categories: category_id, category_name.
    """
    of = products.select("product_id", "category_id").join(categories.select("category_id", "category_name"), "category_id", "left")
    known = definitions.select("category_id", "code", "datatype", "allowed", F.lit(True).alias("known"))
    # four checks read them
    rows = kept(records.join(of, "product_id").join(known, ["category_id", "code"], "left"), "defined-records")
    code, shown = F.col("code"), F.coalesce("value_text", render_number(F.col("value_number")))
    defined, open_ = rows.where("known"), rows.where("known is null")
    undefined = _issue(open_, code, "warning", "undefined", F.format_string("%s: not defined in the '%s' attribute set", code, F.coalesce("category_name", "category_id")))
    errors = defined.select("product_id", "code", F.explode("errors").alias("error"))
    said = _issue(errors, code, "error", "value", F.concat(code, F.lit(": "), F.col("error")))
    legal = (F.col("datatype") == "enum") & (F.size("allowed") > 0) & shown.isNotNull() & ~F.array_contains("allowed", shown)
    illegal = _issue(defined.where(legal), code, "error", "not_allowed", F.format_string("%s: '%s' is not an allowed value", code, shown))
    bare = F.col("source_id").isNull() & F.col("strategy").isNull() & (F.coalesce(F.size("notes"), F.lit(0)) <= 0)
    ungrounded = _issue(defined.where(bare), code, "warning", "ungrounded", F.concat(code, F.lit(": value has no evidence and no declared inference")))
    return undefined.unionByName(said).unionByName(illegal).unionByName(ungrounded)


def quote_issues(records: DataFrame, mirrors: DataFrame) -> DataFrame:
    """Cited quotes that their source lacks, and sources without a mirror (source_id, text). records: product_id, code, source_id, quote, locator."""
    cited = records.where("coalesce(quote, '') <> '' and source_id is not null")
    have = mirrors.select("source_id").distinct().withColumn("have", F.lit(True))
    placed = cited.join(have, "source_id", "left")
    code = F.col("code")
    gone = _issue(placed.where("have is null"), code, "warning", "mirror", F.format_string("%s: source mirror %s is unavailable", code, F.col("source_id")))
    asked = placed.where("have").withColumn("quote_id", F.struct("product_id", "code", "locator"))
    found = verified_quotes(asked.select("quote_id", "source_id", "quote"), mirrors).where("not verified").select("quote_id.*", "source_id")
    lost = _issue(found, code, "error", "quote", F.format_string("%s: cited quote could not be located in %s (%s)", code, F.col("source_id"), F.col("locator")))
    return gone.unionByName(lost)


def rechecked(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records whose quote was not found (issues of kind 'quote') count as unverified."""
    lost = found.where("kind = 'quote'").select("product_id", "code").distinct().withColumn("lost", F.lit(True))
    return records.join(lost, ["product_id", "code"], "left").withColumn("quote_verified", F.col("quote_verified") & F.col("lost").isNull()).drop("lost")


def rule_issues(results: DataFrame) -> DataFrame:
    """Rules that failed (product_id, rule_id, passed, message)."""
    return _issue(results.where("not passed"), None, "error", "rule", F.format_string("rule %s: %s", F.col("rule_id"), F.coalesce("message", F.lit(""))))


def outlier_issues(found: DataFrame) -> DataFrame:
    """Outliers among peers (product_id, code, message)."""
    return _issue(found, F.col("code"), "warning", "outlier", F.concat("code", F.lit(": "), "message"))


def conflict_issues(conflicts: DataFrame) -> DataFrame:
    """Critical conflicts (product_id, code, severity, rule)."""
    return _issue(conflicts.where("severity = 'critical'"), F.col("code"), "warning", "conflict", F.format_string("%s: sources disagree (%s)", F.col("code"), F.col("rule")))


def product_issues(products: DataFrame, records: DataFrame, definitions: DataFrame, categories: DataFrame, mirrors: DataFrame | None = None, rules: DataFrame | None = None, outliers: DataFrame | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """All issues: product_id, code, level, kind, message. What isn't given isn't checked."""
    products, records = once(products, "products"), once(records, "records")
    parts = [identity_issues(products), definition_issues(products, records, definitions, categories)]
    for given, check in ((mirrors, lambda m: quote_issues(records, m)), (rules, rule_issues), (outliers, outlier_issues), (conflicts, conflict_issues)):
        if given is not None:
            parts.append(check(given))
    return issues(*parts)


def report(found: DataFrame) -> DataFrame:
    """Errors, warnings and failed rules of each product."""
    return found.groupBy("product_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), F.count_if(F.col("kind") == "rule").alias("failed_rules"))
