"""Peer statistics, outliers, completeness, quality scores, rules and validation issues.

Tables: products (product_id, category_id, manufacturer, is_family), attributes (product_id, code,
value_number, value_text, confidence, generated, inferred, verified), required (category_id, channel,
code, variant_defining).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.normalize import render_number, round_half_up
from catalith.sources.kept import kept

MIN_PEERS, OUTLIER_Z = 4, 3.5
CHANNELS = ["core", "ecommerce", "enhanced"]


#: Groups up to so many rows have their median worked out in one buffer.
BUFFERED_ROWS = 100_000


def medians(values: DataFrame, by: list[str], value: str, sizes: DataFrame, buffered: int = BUFFERED_ROWS) -> DataFrame:
    """Exact median of each group in ``sizes`` (the columns ``by`` and n, the group's rows).

    Of a group above ``buffered`` rows, a sketch brackets the middle to a thousandth of the rows on both sides; rows
    below the bracket are counted, and distinct values inside it are ranked. So no task holds a group.
    """
    rows = values.select(*by, F.col(value).alias("value"))
    large = sizes.where(F.col("n") > buffered)
    if large.isEmpty():
        return rows.join(sizes.select(*by), by, "left_semi").groupBy(*by).agg(F.median("value").alias("median"))
    small = rows.join(sizes.where(F.col("n") <= buffered).select(*by), by, "left_semi").groupBy(*by).agg(F.median("value").alias("median"))
    wide = rows.join(large.select(*by, "n"), by)
    bracket = wide.groupBy(*by).agg(F.percentile_approx("value", [0.499, 0.501], 10_000).alias("b")).select(*by, F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
    placed = wide.join(bracket, by)
    below = placed.groupBy(*by).agg(F.count_if(F.col("value") < F.col("low")).alias("below"))
    counted = placed.where("value between low and high").groupBy(*by, "value").agg(F.count("*").alias("times"), F.max("n").alias("n"))
    upto = F.sum("times").over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).join(below, by).withColumn("upto", F.col("upto") + F.col("below"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))  # noqa: E731  the value at a rank from 0
    found = ranked.groupBy(*by).agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))
    return small.unionByName(found)


def _counted_stats(counted: DataFrame, by: list[str]) -> DataFrame:
    """Median, n, low, high and mad of groups from their distinct values with counts: both medians by running sums in one exchange."""
    group = Window.partitionBy(*by)
    running = lambda order: F.sum("times").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    low_rank, high_rank = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    at = lambda upto, rank, x: F.min(F.when(F.col(upto) > rank, F.col(x).cast("double")))  # noqa: E731  the value at a rank from 0
    rows = counted.withColumn("n", F.sum("times").over(group)).where(F.col("n") >= MIN_PEERS).withColumn("upto", running("value"))
    rows = rows.withColumn("median", (at("upto", low_rank, "value").over(group) + at("upto", high_rank, "value").over(group)) / 2)
    rows = rows.withColumn("away", F.abs(F.col("value") - F.col("median"))).withColumn("upto", running("away"))
    return rows.groupBy(*by, "n", "median").agg(F.min("value").alias("low"), F.max("value").alias("high"), ((at("upto", low_rank, "away") + at("upto", high_rank, "away")) / 2).alias("mad")).select(*by, "median", "n", "low", "high", "mad")


def peer_stats(values: DataFrame, by: list[str], value: str, buffered: int = BUFFERED_ROWS) -> DataFrame:
    """Exact median and median absolute deviation of each peer group of four or more.

    Values are counted first; of a group, its distinct values are ranked. Groups with more than ``buffered``
    of those go through ``medians`` twice, so that no task holds one. Null groups are left out.
    """
    known = values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("value")).dropna(subset=by)
    counted = kept(known.groupBy(*by, "value").agg(F.count("*").alias("times")), "counted-values")
    sizes = counted.groupBy(*by).agg(F.sum("times").alias("n"), F.count("*").alias("distinct"), F.min("value").alias("low"), F.max("value").alias("high"))
    large = sizes.where(F.col("distinct") > buffered).drop("distinct")
    if large.isEmpty():
        return _counted_stats(counted, by)
    first = large.join(medians(known, by, "value", large.select(*by, "n"), 0), by)
    away = known.join(first.select(*by, "median"), by).select(*by, F.abs(F.col("value") - F.col("median")).alias("value"))
    spread = medians(away, by, "value", large.select(*by, "n"), 0)
    wide = first.join(spread.withColumnRenamed("median", "mad"), by).select(*by, "median", "n", "low", "high", "mad")
    return _counted_stats(counted.join(large.select(*by), by, "left_anti"), by).unionByName(wide)


def is_outlier(value: Column, median: Column, mad: Column) -> Column:
    """By robust z-score; where all peers are equal, by a factor of ten."""
    far = (median != 0) & ((value > 10 * median) | (value < median / 10))
    return F.when(mad == 0, far).otherwise(F.abs(0.6745 * (value - median) / F.when(mad != 0, mad)) > OUTLIER_Z)


def outlier_message(value: Column, median: Column, mad: Column, n: Column, low: Column, high: Column) -> Column:
    """Why a value is an outlier."""
    far = F.format_string("%s is far from the peer value %s (n=%d)", render_number(value), render_number(median), n)
    spread = F.format_string("%s is %.1f MAD from the category median %s (peer range %s-%s, n=%d)", render_number(value), F.abs(0.6745 * (value - median) / F.when(mad != 0, mad)), render_number(median), render_number(low), render_number(high), n)
    return F.when(mad == 0, far).otherwise(spread)


def outliers(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows with ``outlier``; null where a group has too few peers."""
    stats = peer_stats(values, by, value)
    return values.join(stats, by, "left").withColumn("outlier", is_outlier(F.col(value), F.col("median"), F.col("mad")))


def channel_requirements(required: DataFrame) -> DataFrame:
    """Channels are cumulative: what core requires, every channel requires."""
    level = F.array_position(F.lit(CHANNELS), F.col("channel"))
    return required.select("category_id", "code", "variant_defining", F.explode(F.slice(F.lit(CHANNELS), F.greatest(level, F.lit(1)).cast("int"), len(CHANNELS))).alias("channel")).distinct()


def is_filled(value_number: Column, value_text: Column) -> Column:
    """Zero and false are values; null and empty text aren't."""
    return value_number.isNotNull() | (F.coalesce(value_text, F.lit("")) != "")


def requirement_status(products: DataFrame, attributes: DataFrame, required: DataFrame) -> DataFrame:
    """A row per product, channel and required code, and whether it is filled; families need no variant-defining codes."""
    wanted = products.join(channel_requirements(required), "category_id").where(~(F.col("is_family") & F.col("variant_defining")))
    present = attributes.where(is_filled(F.col("value_number"), F.col("value_text"))).select("product_id", "code", F.lit(True).alias("filled")).distinct()
    return wanted.join(present, ["product_id", "code"], "left").withColumn("filled", F.coalesce("filled", F.lit(False)))


def missing_required(products: DataFrame, attributes: DataFrame, required: DataFrame, channel: str) -> DataFrame:
    """Required codes that a product lacks, as an anti join."""
    wanted = products.join(channel_requirements(required).where(F.col("channel") == channel), "category_id").where(~(F.col("is_family") & F.col("variant_defining")))
    present = attributes.where(is_filled(F.col("value_number"), F.col("value_text")))
    return wanted.join(present.select("product_id", "code"), ["product_id", "code"], "left_anti").select("product_id", "code")


def completeness(products: DataFrame, attributes: DataFrame, required: DataFrame) -> DataFrame:
    """Share of required codes filled per channel, to four places; 1 where none is required."""
    status = requirement_status(products, attributes, required)
    share = status.groupBy("product_id").agg(*[F.avg(F.when(F.col("channel") == c, F.col("filled").cast("double"))).alias(f"completeness_{c}") for c in CHANNELS])
    return products.select("product_id").join(share, "product_id", "left").select("product_id", *[round_half_up(F.coalesce(F.col(f"completeness_{c}"), F.lit(1.0)), 4).alias(f"completeness_{c}") for c in CHANNELS])


def quality(products: DataFrame, attributes: DataFrame, required: DataFrame, checks: DataFrame, channel: str = "ecommerce") -> DataFrame:
    """Scores of each product; checks: product_id, passed, applicable, errors, outliers, numeric."""
    facts = attributes.groupBy("product_id").agg(
        F.count_if(~F.col("generated") & ~F.col("inferred")).alias("sourced"),
        F.count_if(~F.col("generated") & ~F.col("inferred") & F.col("verified")).alias("verified"),
    )
    rows = completeness(products, attributes, required).join(products.select("product_id", "is_family"), "product_id").join(facts, "product_id", "left").join(checks, "product_id", "left")
    zero = F.lit(0)
    errors = F.coalesce("errors", zero)
    accuracy = F.when(F.coalesce("sourced", zero) > 0, F.col("verified") / F.col("sourced")).otherwise(0.0)
    base = F.when(F.coalesce("applicable", zero) > 0, F.col("passed") / F.col("applicable")).otherwise(F.when(errors > 0, 0.5).otherwise(1.0))
    consistency = F.greatest(base - F.least(F.lit(0.5), 0.1 * errors), F.lit(0.0))
    distinct = F.when(F.coalesce("numeric", zero) > 0, 1 - F.least(F.lit(1.0), F.col("outliers") / F.col("numeric"))).otherwise(1.0)
    rows = rows.select("product_id", "is_family", *[f"completeness_{c}" for c in CHANNELS], round_half_up(accuracy, 4).alias("accuracy"), round_half_up(consistency, 4).alias("consistency"), round_half_up(distinct, 4).alias("distinctiveness"), errors.alias("errors"))
    own = F.col(f"completeness_{channel}")
    overall = 0.40 * own + 0.25 * F.col("accuracy") + 0.25 * F.col("consistency") + 0.10 * F.col("distinctiveness")
    ready = ~F.col("is_family") & (own == 1.0) & (F.col("errors") == 0) & (F.col("accuracy") >= 0.5)
    return rows.withColumn("overall", round_half_up(overall, 4)).withColumn("channel_ready", ready).drop("errors")


def scorecard(scores: DataFrame) -> DataFrame:
    """Catalog-wide means and the share of sellable products that are ready."""
    means = [round_half_up(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(f"mean_{c}") for c in ("completeness_core", "completeness_ecommerce", "accuracy", "consistency", "distinctiveness", "overall")]
    sellable = F.count_if(~F.col("is_family"))
    ready = F.count_if(F.col("channel_ready"))
    return scores.agg(F.count("*").alias("products"), sellable.alias("sellable"), ready.alias("ready"), round_half_up(F.when(sellable > 0, ready / sellable).otherwise(0.0), 4).alias("ready_share"), *means)


def attribute_scorecard(attributes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Numbers of attributes and their mean confidence, read ones and generated ones apart, inferred ones and conflicts: one row."""
    mean = lambda which: round_half_up(F.coalesce(F.avg(F.when(which, F.col("confidence"))), F.lit(0.0)), 4)
    made = F.col("generated")
    row = attributes.agg(
        F.count("*").alias("attributes_total"), F.count_if(~made).alias("attributes_sourced"), F.count_if(made).alias("attributes_generated"), F.count_if("inferred").alias("inferred_attributes"),
        mean(~made).alias("confidence_sourced"), mean(made).alias("confidence_generated"),
    )
    return row.crossJoin(F.broadcast(conflicts.agg(F.count("*").alias("conflicts"))))


def coverage(products: DataFrame, attributes: DataFrame, required: DataFrame, channel: str = "ecommerce") -> DataFrame:
    """Filled share of each required code over the products that need it, least covered first."""
    status = requirement_status(products.where(~F.col("is_family")), attributes, required).where(F.col("channel") == channel)
    return status.groupBy("code").agg(F.count("*").alias("applicable"), F.count_if("filled").alias("filled")).withColumn("coverage", round_half_up(F.col("filled") / F.col("applicable"), 4)).orderBy("coverage", "code")


def rollup(scores: DataFrame, by: str) -> DataFrame:
    """Products, ready ones and mean completeness for each value of a column, largest first."""
    return scores.groupBy(by).agg(F.count("*").alias("products"), F.count_if("channel_ready").alias("ready"), round_half_up(F.avg("completeness_ecommerce"), 4).alias("mean_completeness")).orderBy(F.desc("products"), by)


_RULE = re.compile(r"^\s*([a-z_]\w*)\s*(?:\*\s*([\d.]+)\s*)?(>=|<=|==|!=|>|<)\s*([a-z_]\w*|-?[\d.]+|'[^']*')\s*$", re.I)


def rule_condition(expression: str, columns: Iterable[str], kinds: dict[str, str] | None = None) -> Column:
    """A comparison 'code [* scale] op code|number|'text'' over a row of attribute columns; null if an operand is.

    With the columns' types (``kinds``, as DataFrame.dtypes gives them), a number and a text are compared as texts.
    """
    m = _RULE.match(expression)
    if not m or m[1] not in columns:
        return F.lit(None).cast("boolean")
    left, right = F.col(m[1]), m[4]
    text = (kinds or {}).get(m[1]) == "string"
    if m[2]:
        left, text = left.cast("double") * float(m[2]), False
    if right.startswith("'"):
        side, other = F.lit(right[1:-1]), True
    elif right in columns:
        side, other = F.col(right), (kinds or {}).get(right) == "string"
    elif re.fullmatch(r"-?\d+(\.\d+)?|-?\.\d+", right):
        side, other = F.lit(float(right)), False
    else:
        return F.lit(None).cast("boolean")
    if text != other:
        left, side = (c if is_text else F.coalesce(render_number(c.try_cast("double")), c.cast("string")) for c, is_text in ((left, text), (side, other)))
    return {">=": left >= side, "<=": left <= side, "==": left == side, "!=": left != side, ">": left > side, "<": left < side}[m[3]]


def implication(condition: str, columns: Iterable[str], then_present: Iterable[str] = (), then_min: dict | None = None, then_max: dict | None = None) -> Column:
    """Null unless the condition holds; then whether all of what it demands is there."""
    columns = list(columns)
    demands = [F.col(c).isNotNull() for c in then_present]
    demands += [F.coalesce(F.col(c) >= v, F.lit(True)) for c, v in (then_min or {}).items()]
    demands += [F.coalesce(F.col(c) <= v, F.lit(True)) for c, v in (then_max or {}).items()]
    held = F.lit(True)
    for d in demands:
        held = held & d
    return F.when(rule_condition(condition, columns), held)


def implication_message(condition: str, then_present: Iterable[str] = (), then_min: dict | None = None, then_max: dict | None = None) -> Column:
    """What the first unmet demand of an implication says; null if all are met."""
    parts = [F.when(F.col(c).isNull(), F.lit(f"{c} is required when {condition}")) for c in then_present]
    parts += [F.when(F.col(c) < v, F.lit(f"{c} must be at least {v}")) for c, v in (then_min or {}).items()]
    parts += [F.when(F.col(c) > v, F.lit(f"{c} must not exceed {v}")) for c, v in (then_max or {}).items()]
    return F.coalesce(*parts, F.lit(None).cast("string"))


def evaluate_rules(wide: DataFrame, rules: dict[str, Column], key: str = "product_id") -> DataFrame:
    """A row per product and rule that applies: rule_id, passed."""
    found = F.array(*[F.struct(F.lit(n).alias("rule_id"), c.alias("passed")) for n, c in rules.items()])
    return wide.select(key, F.explode(found).alias("r")).select(key, "r.*").where(F.col("passed").isNotNull())


def status(errors: Column, missing: Column, mean_confidence: Column, critical: Column) -> Column:
    """Publication status, first reason first."""
    return F.when(errors > 0, "needs_review").when(missing > 0, "needs_review").when(mean_confidence < 0.85, "enriched").when(critical > 0, "needs_review").otherwise("published")


GENERIC = "industrial.generic"


def mean_in_order(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The mean of each key that has values, added up in the order of the rows in their Parquet files.

    Partial sums depend on how files are cut into tasks, and their last digits decide where a mean meets a bound.
    The running sum is that of a sorted window, so that no key's rows are held at once.
    """
    place = rows.metadataColumn("_metadata")
    ordered = rows.select(*key, F.col(value).cast("double").alias("value"), place["file_path"].alias("file"), place["row_index"].alias("at")).where("value is not null")
    in_order = Window.partitionBy(*key).orderBy("file", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ordered.withColumns({"n": F.count("value").over(in_order), "total": F.sum("value").over(in_order)})
    return running.groupBy(*key).agg((F.max_by("total", "n") / F.max("n")).alias("mean"))


def keyword_category(texts: DataFrame, id_col: str, text_col: str, keywords: dict[str, list[str]], generic: str = GENERIC) -> DataFrame:
    """Best category by whole keywords in the lower-cased text, each hit worth 1.5 per word of the keyword.

    With it come its score, the runner-up's, the confidence (0.35, with 0.4 of the lead over the runner-up and
    0.35 of the score over 12, at most 0.99) and the longest keyword found. Ties go to the category named
    first; a text without hits is generic, with confidence 0. A null text has no hits.
    """
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    scores = []
    for place, (name, words) in enumerate(keywords.items()):
        # a text that doesn't hold the word at all needs no regular expression
        hits = [(w, F.when(F.contains(lower, F.lit(w)), F.regexp_count(lower, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(w)}(?![\p{{L}}\p{{N}}_])"))).otherwise(F.lit(0))) for w in words if w]
        score = sum((n * (1.5 * len(w.split())) for w, n in hits), F.lit(0.0))
        longest = F.coalesce(*[F.when(n > 0, F.lit(w)) for w, n in sorted(hits, key=lambda h: -len(h[0]))], F.lit(None).cast("string"))
        scores.append(F.struct((-score).alias("below"), F.lit(place).alias("place"), F.lit(name).alias("category"), longest.alias("keyword")))
    ranked = texts.select(id_col, F.array_sort(F.array(*scores)).alias("ranked"))
    top, second = -F.col("ranked")[0]["below"], -F.coalesce(F.get("ranked", F.lit(1))["below"], F.lit(0.0))
    rows = ranked.select(id_col, F.when(top > 0, F.col("ranked")[0]["category"]).otherwise(F.lit(generic)).alias("category"), (top + 0.0).alias("score"), (second + 0.0).alias("runner_up"), F.col("ranked")[0]["keyword"].alias("keyword"))
    sure = 0.35 + 0.4 * (F.col("score") - F.col("runner_up")) / F.col("score") + 0.35 * F.least(F.col("score") / 12, F.lit(1.0))
    return rows.withColumn("confidence", F.when(F.col("score") > 0, round_half_up(F.least(sure, F.lit(0.99)), 3)).otherwise(0.0))
