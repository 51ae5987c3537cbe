"""Enrichment: gap filling from the family, template copy, and checking the numbers that copy states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import vocabulary
from catalith.functions.normalize import render_number, round_half_up
from catalith.operators.golden import confidence
from catalith.operators.linking import inherited, sibling_consensus

#: What a filled gap takes over from its donor.
EVIDENCE = {"source_id": "string", "source_kind": "string", "quote_verified": "boolean"}
#: An inference is never as good as an observation.
INFERENCE_SHARE = 0.85


def fill_gaps(products: DataFrame, attributes: DataFrame, missing: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """Values for missing codes: the base record's, else what two or more siblings all agree on.

    Codes that are a product's own, and with definitions (code, generated, variant_defining) those that are generated or tell
    variants apart, stay open. A value takes over its donor's evidence with the method 'inherited' and is
    scored as such, times 0.85: product_id, code, value, value_number, value_text, source_id, source_kind, quote_verified, method, strategy, confidence.
    """
    open_ = missing.select("product_id", "code").where(~F.col("code").isin(vocabulary.NON_INHERITABLE))
    if definitions is not None:
        open_ = open_.join(definitions.where("generated or variant_defining").select("code").distinct(), "code", "left_anti")
    full = attributes
    for name, kind in EVIDENCE.items():
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast(kind))
    full = full.select("product_id", "code", "value_number", "value_text", *[F.col(name).cast(kind).alias(name) for name, kind in EVIDENCE.items()])
    taken = ["product_id", "code", "value_number", "value_text", *EVIDENCE]
    base = inherited(products, full, open_).select(*taken, F.lit("family_inheritance").alias("strategy"))
    rest = open_.join(base.select("product_id", "code"), ["product_id", "code"], "left_anti")
    agreed = sibling_consensus(products, full, rest).select("product_id", "code", "donor.*", F.lit("variant_sibling_consensus").alias("strategy")).select(*taken, "strategy")
    rows = base.unionByName(agreed)
    scored = confidence(rows.withColumns({"method": F.when(F.col("source_id").isNotNull(), F.lit("inherited")), "inferred": F.lit(True), "agreeing": F.lit(1), "disagreeing": F.lit(0)}))
    value = F.coalesce("value_text", F.col("value_number").cast("string"))
    return scored.select("product_id", "code", value.alias("value"), "value_number", "value_text", *EVIDENCE, "method", "strategy", round_half_up(F.col("confidence") * INFERENCE_SHARE, 4).alias("confidence"))


def template_copy(manufacturer: Column, mpn: Column, category: Column, facts: Column, name: Column | None = None, certifications: Column | None = None, warranty: Column | None = None) -> dict[str, Column]:
    """Copy assembled from facts (array of structs label, value, in order), certifications (array) and months of warranty.

    The sentences are fixed values; lengths are capped at 300, 3000, 70 and 160 characters and twelve keywords.
    """
    certs = F.coalesce(certifications, F.array().cast("array<string>")) if certifications is not None else F.array().cast("array<string>")
    title = F.concat_ws(" ", manufacturer, mpn)
    kind = F.lower(category)
    lead = F.array_join(F.transform(F.slice(facts, 1, 3), lambda f: F.concat(F.lower(f["label"]), F.lit(" "), f["value"])), ", ")
    short = F.concat(title, F.lit(" "), category, F.when(lead != "", F.concat(F.lit(" with "), lead)).otherwise(""))
    short = F.concat(F.rtrim(F.left(short, F.lit(300))), F.lit("."))
    key = F.array_join(F.transform(F.slice(facts, 1, 5), lambda f: F.concat(F.lower(f["label"]), F.lit(" of "), f["value"])), "; ")
    sentences = [
        F.concat(F.lit("The "), title, F.lit(" is a "), kind, F.lit(" engineered for industrial and commercial applications.")),
        F.when(F.size(facts) > 0, F.concat(F.lit("Key specifications include "), key, F.lit("."))),
        F.when(F.size(certs) > 0, F.concat(F.lit("This product carries "), F.array_join(certs, ", "), F.lit(" approval."))),
        F.when(warranty != 0, F.concat(F.lit("Backed by a "), warranty.cast("int").cast("string"), F.lit("-month manufacturer warranty."))) if warranty is not None else F.lit(None).cast("string"),
    ]
    bullets = F.concat(F.transform(F.slice(facts, 1, 6), lambda f: F.concat(f["label"], F.lit(": "), f["value"])), F.when(F.size(certs) > 0, F.array(F.concat(F.lit("Certified to "), F.array_join(F.slice(certs, 1, 3), ", ")))).otherwise(F.array().cast("array<string>")))
    words = F.concat(F.array(kind, F.lower(manufacturer), F.lower(mpn), F.concat_ws(" ", F.lower(manufacturer), kind)), F.transform(F.slice(facts, 1, 3), lambda f: F.lower(f["value"])))
    own = F.nullif(name, F.lit("")) if name is not None else F.lit(None).cast("string")
    return {
        "product_name": F.coalesce(own, F.concat(title, F.lit(" "), category)),
        "short_description": short,
        "long_description": F.left(F.concat_ws(" ", *sentences), F.lit(3000)),
        "feature_bullets": bullets,
        "seo_title": F.left(F.concat(title, F.lit(" | "), category), F.lit(70)),
        "seo_description": F.left(short, F.lit(160)),
        "search_keywords": F.slice(F.array_distinct(words), 1, 12),
    }


def _canonical(number: Column) -> Column:
    """A number's digits without zeros at the end of its fraction."""
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", "")).otherwise(number)


def unverified_numbers(copy: Column, known: Column, numbers: Column | None = None, names: Column | None = None) -> Column:
    """Numbers that a text states, each once, and the known facts don't have.

    known: the facts' values as text; numbers: array of numeric values; names: text of part number and maker,
    whose numbers count as they are written. Digits inside words and part numbers are no statement; 25.0 is 25.
    """
    plain = r"([0-9]+(?:\.[0-9]+)?)"
    stated = F.array_distinct(F.regexp_extract_all(copy, F.lit(r"(?<![\p{L}\p{N}_.])" + plain + r"(?![\p{L}\p{N}_])"), F.lit(1)))
    facts = F.transform(F.regexp_extract_all(known, F.lit(plain), F.lit(1)), _canonical)
    if numbers is not None:
        whole = F.filter(numbers, lambda x: (x == F.floor(x)) & (F.abs(x) < 1e15))
        facts = F.concat(facts, F.transform(numbers, render_number), F.transform(whole, lambda x: x.cast("long").cast("string")))
    if names is not None:
        facts = F.concat(facts, F.regexp_extract_all(names, F.lit(plain), F.lit(1)))
    return F.filter(stated, lambda n: ~F.array_contains(facts, _canonical(n)) & ~F.array_contains(facts, n))


def origin(method: Column, generated: Column, strategy: Column, has_source: Column, note: Column | None = None) -> Column:
    """Where a value comes from, first that holds: human, generated, inferred, sourced, default, sourced."""
    out = F.when(method == "human", "human").when(generated, "generated")
    out = out.when(F.startswith(strategy, F.lit("generated")), "generated").when(strategy.isNotNull(), "inferred")
    out = out.when(has_source & (method == "inherited"), "inferred").when(has_source, "sourced")
    if note is not None:
        out = out.when(F.contains(note, F.lit("default applied")), "default")
    return out.otherwise("sourced")


# What is said of a factor below its threshold, in order.
REASONS = [
    ("quote", 0.7, "supporting quote could not be verified against the source mirror"),
    ("method", 0.7, "recovered by {}, which is less reliable than a native spec table"),
    ("schema", 0.9, "value failed or sits at the edge of its schema plausibility range"),
    ("corroboration", 0.9, "sources disagree or only one source reports this value"),
    ("normalization", 1.0, "a unit or enum assumption was made during normalization"),
    ("source", 0.8, "came from a lower-precedence source"),
]
NO_REASON = "verified quote from a high-precedence source, within schema bounds"


def reasons(factors: dict[str, Column], method: Column) -> Column:
    """What lowers a confidence, as sentences; factors may lack. method: the extraction method, null for an inference."""
    found = []
    for name, least, text in REASONS:
        if name in factors:
            before, _, after = text.partition("{}")
            said = F.concat(F.lit(before), F.coalesce(method, F.lit("inference")), F.lit(after)) if after else F.lit(text)
            found.append(F.when(factors[name] < least, said))
    kept = F.array_compact(F.array(*found))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(NO_REASON)))


def document_text(parts: list[Column], facts: Column) -> Column:
    """Text that stands for a product in search: parts that aren't blank, then facts (array of 'Name: value') in order of their names."""
    own = F.filter(F.concat(F.array(*parts), F.array_sort(facts)), lambda p: F.trim(F.coalesce(p, F.lit(""))) != "")
    return F.array_join(own, " | ")
