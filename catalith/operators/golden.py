"""Arbitration of observations into one value for each product and attribute.

Observations are rows: product_id, code, obs_seq (arrival order), value_number, value_text, source_id,
source_kind, method, quote_verified. Numbers agree within two percent of the larger one and are grouped
by first agreeing leader in order of arrival; texts agree if equal but for case and outer blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import vocabulary
from catalith.functions.normalize import round_half_up
from catalith.sources.kept import once

TOLERANCE = 0.02
KEY = ["product_id", "code"]
#: What tells the entries of a key apart in ``summaries``.
ENTRY = ["number", "text", "members", "source_id"]


def lookup(values: dict, key: Column, default) -> Column:
    """Value of a small fixed table, default for unknown keys."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def ranked(observations: DataFrame) -> DataFrame:
    """With precedence of the source and reliability of the method."""
    return observations.withColumns({
        "precedence": F.when(F.col("source_kind").isNull(), vocabulary.NO_EVIDENCE_PRECEDENCE).otherwise(lookup(vocabulary.SOURCE_PRECEDENCE, F.col("source_kind"), vocabulary.UNKNOWN_PRECEDENCE)),
        "method_rank": F.when(F.col("method").isNull(), vocabulary.NO_EVIDENCE_RELIABILITY).otherwise(lookup(vocabulary.METHOD_RELIABILITY, F.col("method"), vocabulary.UNKNOWN_RELIABILITY)),
    })


def numbers_agree(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b))


def number_groups(observations: DataFrame) -> DataFrame:
    """Adds ``grp``, the number of the first leader that a number agrees with.

    Leaders come from the distinct numbers in order of first arrival: a repeated number always joins the
    group of its first occurrence, so repeats never enter the list that is gathered for each key.
    """
    observations = once(observations, "numbers")
    firsts = observations.groupBy(*KEY, "value_number").agg(F.min("obs_seq").alias("first_seq"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "value_number"))), lambda s: s["value_number"])
    lists = firsts.groupBy(*KEY).agg(ordered.alias("numbers"))
    leaders = F.aggregate("numbers", F.array().cast("array<double>"), lambda acc, x: F.when(F.exists(acc, lambda y: numbers_agree(y, x)), acc).otherwise(F.concat(acc, F.array(x))))
    led = lists.select(*KEY, leaders.alias("leaders"))
    # rows are dealt by their key alone, so that groups and winners need no further shuffle
    grp = F.array_position(F.transform("leaders", lambda y: numbers_agree(y, F.col("value_number"))), True).cast("long")
    return observations.where("value_number is not null").join(led, KEY).withColumn("grp", grp).drop("leaders")


def text_groups(observations: DataFrame) -> DataFrame:
    """Adds ``grp``, which orders equal texts by first arrival.

    With a column value_list (array of strings), lists agree if they hold the same strings; where a key has a
    list, a text counts as a list of one.
    """
    # rows are dealt by their key alone, so that groups and winners need no further shuffle; stored, as the planner doesn't see that of a code that is a constant
    observations = once(observations, "texts").repartition(*KEY)
    key = F.lower(F.trim("value_text"))
    if "value_list" in observations.columns:
        observations = observations.withColumn("has_list", F.bool_or(F.col("value_list").isNotNull()).over(Window.partitionBy(*KEY)))
        members = F.coalesce("value_list", F.array("value_text"))
        key = F.when(F.col("has_list"), F.to_json(F.array_sort(F.array_distinct(members)))).otherwise(key)
    keyed = observations.withColumn("text_key", key).drop("has_list").where("text_key is not null")
    return keyed.withColumn("grp", F.min("obs_seq").over(Window.partitionBy(*KEY, "text_key"))).drop("text_key")


#: Columns of an observation that a winner keeps, where they are there.
CARRIED = ["obs_seq", "value_number", "value_text", "value_list", "source_id", "source_kind", "method", "quote_verified", "inferred", "defined", "errors", "unit_assumed", "note"]


def _kept(columns: list[str]) -> Column:
    return F.struct(*[c for c in CARRIED if c in columns], "method_rank")


def summaries(observations: DataFrame) -> DataFrame:
    """Observations of one value from one source as one row for each key: first_seq, n, method_rank, best, human, grave.

    best and human begin with what ranks them and have only what the row doesn't tell of an observation, as a stream stores
    one for each row; ``restored`` gives the observations. Null values, blank texts and NaN are no observations.
    """
    rows = ranked(observations)
    number = F.when(~F.isnan("value_number"), F.col("value_number"))
    members = F.to_json(F.array_sort(F.array_distinct("value_list"))) if "value_list" in rows.columns else F.lit(None).cast("string")
    text = F.when(F.col("value_number").isNull() & (F.trim("value_text") != ""), F.col("value_text"))
    rows = rows.withColumns({"number": number, "text": text, "members": F.when(F.col("value_number").isNull(), members), "is_grave": F.coalesce(F.col("grave"), F.lit(False)) if "grave" in rows.columns else F.lit(False)})
    # -0 and 0 are one number, and a text is kept beside a number or a list
    odd = [F.when(F.col("value_number") == 0, F.col("value_number")).alias("value_number"), F.when(F.col("text").isNull(), F.col("value_text")).alias("value_text")]
    kept = [*odd, *[c for c in CARRIED if c in rows.columns and c not in ("obs_seq", "value_number", "value_text", "source_id")]]
    human = F.when((F.col("method") == "human") & F.col("obs_seq").isNotNull(), F.struct("obs_seq", *kept, "method_rank"))
    return rows.where("number is not null or text is not null or members is not null").groupBy(*KEY, *ENTRY).agg(
        F.min("obs_seq").alias("first_seq"), F.count("*").alias("n"), F.max("method_rank").alias("method_rank"),
        F.max(F.struct("precedence", "method_rank", (-F.col("obs_seq")).alias("back"), *kept)).alias("best"), F.max(human).alias("human"), F.bool_or("is_grave").alias("grave"),
    )


def restored(summed: DataFrame) -> DataFrame:
    """Rows of ``summaries`` with best and human as observations, what ranks them as best_order and human_seq, and precedence."""
    best, human = F.col("best"), F.col("human")

    def observation(kept: Column, seq: Column) -> Column:
        known = {"obs_seq": seq, "value_number": F.coalesce(kept["value_number"], "number"), "value_text": F.coalesce(kept["value_text"], "text"), "source_id": F.col("source_id")}
        names = [c for c in CARRIED if c in known or c in summed.schema["best"].dataType.names]
        return F.struct(*[known.get(c, kept[c]).alias(c) for c in names], kept["method_rank"].alias("method_rank"))

    return summed.withColumns({
        "best": observation(best, -best["back"]), "best_order": F.struct(best["precedence"], best["method_rank"], best["back"]), "precedence": best["precedence"],
        "human": F.when(human.isNotNull(), observation(human, human["obs_seq"])), "human_seq": human["obs_seq"],
    })


def group_stats(summed: DataFrame) -> DataFrame:
    """Groups of agreeing values for each key, from ``summaries``, restored or not: grp (first arrival), grp_precedence, grp_sources, grp_method, best, human, human_seq, grave.

    The distinct numbers, texts and sources of a key meet in one row, as leaders depend on order; repeats don't
    count. A number belongs to the first leader it agrees with; texts agree by case and outer blanks; where a key
    has a list, a text counts as a list of one.
    """
    rest = [c for c in summed.columns if c not in KEY]
    rows = summed.groupBy(*KEY).agg(F.collect_list(F.struct(*rest)).alias("rows"))
    numbers = F.array_sort(F.transform(F.filter("rows", lambda r: r["number"].isNotNull()), lambda r: F.struct(r["first_seq"], r["number"])))
    none = F.array().cast("array<struct<first_seq:bigint,number:double>>")
    leaders = F.aggregate(numbers, none, lambda acc, v: F.when(F.exists(acc, lambda y: numbers_agree(y["number"], v["number"])), acc).otherwise(F.concat(acc, F.array(v))))
    # leaders come before the rows are taken apart, else they are worked out for each row
    rows = rows.select(*KEY, leaders.alias("leaders"), F.exists("rows", lambda r: r["members"].isNotNull()).alias("has_list"), "rows")
    rows = rows.select(*KEY, "leaders", "has_list", F.explode("rows").alias("r")).select(*KEY, "leaders", "has_list", "r.*")
    if "best_order" not in rows.columns:
        rows = restored(rows)
    leader = F.get(F.filter("leaders", lambda y: numbers_agree(y["number"], F.col("number"))), F.lit(0))["first_seq"]
    text = F.when(F.col("has_list"), F.coalesce("members", F.to_json(F.array("text")))).otherwise(F.lower(F.trim("text")))
    rows = rows.withColumns({"leader": leader, "text_key": F.when(F.col("number").isNull(), text)})
    sources = F.size(F.collect_set("source_id")).cast("long")
    return rows.groupBy(*KEY, "leader", "text_key").agg(
        F.min("first_seq").alias("grp"), F.max("precedence").alias("grp_precedence"), F.when(sources > 0, sources).otherwise(F.sum("n")).alias("grp_sources"), F.max("method_rank").alias("grp_method"),
        F.max_by("best", "best_order").alias("best"), F.max_by("human", "human_seq").alias("human"), F.max("human_seq").alias("human_seq"), F.bool_or("grave").alias("grave"),
    ).drop("leader", "text_key")


def winners(grouped: DataFrame) -> DataFrame:
    """One row per key, from observations with ``grp``; see ``decided``."""
    rows = ranked(grouped)
    grave = F.col("grave") if "grave" in rows.columns else F.lit(False)
    sources = F.count_distinct("source_id")
    kept = _kept(rows.columns)
    return decided(rows.groupBy(*KEY, "grp").agg(
        F.max("precedence").alias("grp_precedence"), F.when(sources > 0, sources).otherwise(F.count("*")).alias("grp_sources"), F.max("method_rank").alias("grp_method"),
        F.max_by(kept, F.struct("precedence", "method_rank", -F.col("obs_seq"))).alias("best"),
        F.max_by(kept, F.when(F.col("method") == "human", F.col("obs_seq"))).alias("human"),
        F.max(F.when(F.col("method") == "human", F.col("obs_seq"))).alias("human_seq"),
        F.bool_or(F.coalesce(grave, F.lit(False))).alias("grave"),
    ))


def decided(stats: DataFrame) -> DataFrame:
    """One row per key: the winning observation, agreeing and disagreeing sources, groups, and the rule that decided.

    The last human observation wins outright. Else groups are ordered by best precedence, number of
    sources (of observations, where none names a source) and best method, the rest by arrival; in the winning
    group the best observation wins. A conflict is critical if a loser has the winner's precedence and the best
    method of all losers is within 0.15 of the winner's, or if the column ``grave`` (the attribute tells
    variants apart or names the product) is true.
    """
    order = F.struct("grp_precedence", "grp_sources", "grp_method", -F.col("grp"))
    other = F.struct("grp_precedence", "grp_sources", "grp_method", "grp")
    per_key = stats.groupBy(*KEY).agg(
        F.max_by(F.struct(F.col("best").alias("obs"), "grp_precedence", "grp_sources", "grp_method", "grp"), order).alias("top"),
        F.collect_list(other).alias("all"), F.sum("grp_sources").alias("sources"), F.count("*").alias("groups"),
        F.max_by("human", "human_seq").alias("human"), F.max("human_seq").alias("human_seq"), F.bool_or("grave").alias("grave"),
    )
    rest = F.filter("all", lambda g: g["grp"] != F.col("top.grp"))
    next_precedence = F.array_max(F.transform(rest, lambda g: g["grp_precedence"]))
    next_method = F.array_max(F.transform(rest, lambda g: g["grp_method"]))
    human = F.col("human_seq").isNotNull()
    winner = F.when(human, F.col("human")).otherwise(F.col("top.obs"))
    agreeing = F.when(human, F.lit(1)).otherwise(F.col("top.grp_sources")).cast("long")
    disagreeing = F.when(human, F.lit(0)).otherwise(F.col("sources") - F.col("top.grp_sources")).cast("long")
    rule = (
        F.when(human | (F.col("groups") == 1), F.lit(None).cast("string"))
        .when(F.col("top.grp_precedence") > next_precedence, F.lit("source precedence"))
        .when(F.col("top.grp_sources") > 1, F.lit("corroboration"))
        .otherwise(F.lit("method reliability"))
    )
    tie = (F.col("top.grp_precedence") == next_precedence) & (F.abs(F.col("top.obs.method_rank") - next_method) < 0.15)
    severity = F.when(rule.isNotNull(), F.when(tie | F.col("grave"), F.lit("critical")).otherwise(F.lit("warning")))
    return per_key.select(*KEY, winner.alias("w"), agreeing.alias("agreeing"), disagreeing.alias("disagreeing"), F.col("groups").cast("long").alias("groups"), rule.alias("rule"), severity.alias("severity")).select(
        *KEY, "w.*", "agreeing", "disagreeing", "groups", "rule", "severity"
    ).drop("method_rank")


def confidence(rows: DataFrame) -> DataFrame:
    """Adds ``confidence``: the product of weighted factors, from method, source_kind, quote_verified, agreeing, disagreeing.

    Further columns count where they are there: errors (violations of the schema), defined (whether the
    dictionary has the attribute), inferred (a value without evidence that was worked out), unit_assumed,
    note (of the normalisation).
    """
    w = vocabulary.CONFIDENCE_WEIGHTS

    def given(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)

    inferred, bare = given("inferred", False), F.col("method").isNull()
    factors = {
        "method": F.when(bare, F.when(inferred, vocabulary.METHOD_RELIABILITY["inherited"]).otherwise(0.3)).otherwise(lookup(vocabulary.METHOD_RELIABILITY, F.col("method"), vocabulary.UNKNOWN_RELIABILITY)),
        "quote": F.when(bare, F.when(inferred, 0.75).otherwise(0.35)).when(F.col("quote_verified").isNull(), 0.55).when(F.col("quote_verified"), 1.0).otherwise(0.65),
        "schema": F.when(given("errors", 0) > 0, 0.3).when(~given("defined", True), 0.9).otherwise(1.0),
        "source": F.when(F.col("source_kind").isNull(), 0.6).otherwise(0.65 + 0.35 * lookup(vocabulary.SOURCE_PRECEDENCE, F.col("source_kind"), vocabulary.UNKNOWN_PRECEDENCE) / 100),
        "corroboration": F.when((F.col("disagreeing") > 0) & (F.col("agreeing") <= 1), 0.55).when(F.col("disagreeing") > 0, 0.75).when(F.col("agreeing") >= 3, 1.0).when(F.col("agreeing") == 2, 0.97).otherwise(0.9),
        "normalization": F.when(given("unit_assumed", False), 0.88).when(given("note", "").rlike("not in allowed|expected"), 0.8).otherwise(1.0),
    }
    score = F.lit(1.0)
    for name, factor in factors.items():
        score = score * (1 - w[name] * (1 - factor))
    return rows.withColumn("confidence", round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def with_defaults(records: DataFrame, products: DataFrame, defaults: DataFrame) -> DataFrame:
    """Records, and the dictionary's defaults (category_id, code, value_number, value_text) where a product has none: confidence 0.4, strategy 'schema_default'."""
    have = records.withColumn("strategy", F.lit(None).cast("string"))
    rows = products.select("product_id", "category_id").join(defaults, "category_id").where("value_number is not null or value_text is not null")
    lacking = rows.join(records.select(*KEY), KEY, "left_anti").select(*KEY, "value_number", "value_text", F.lit(0.4).alias("confidence"), F.lit("schema_default").alias("strategy"))
    return have.unionByName(lacking, allowMissingColumns=True)


def golden_records(observations: DataFrame) -> DataFrame:
    """Winners with confidence, from observations with either a number or a text as value; null values are ignored."""
    observations = once(observations, "observations")
    numbers = observations.where(F.col("value_number").isNotNull() & ~F.isnan("value_number"))
    filled = F.trim(F.coalesce("value_text", F.lit(""))) != ""
    if "value_list" in observations.columns:
        filled = filled | F.col("value_list").isNotNull()
    texts = observations.where(F.col("value_number").isNull() & filled)
    columns = observations.columns
    grouped = number_groups(numbers).select(*columns, "grp").unionByName(text_groups(texts).select(*columns, "grp"))
    return confidence(winners(grouped))


def conflicts(records: DataFrame) -> DataFrame:
    """Keys on which sources disagreed."""
    return records.where(F.col("rule").isNotNull()).select(*KEY, "source_id", (F.col("groups") - 1).alias("losing_groups"), "rule", "severity")


def last_human(observations: DataFrame) -> DataFrame:
    """The last human observation of each key."""
    human = observations.where(F.col("method") == "human")
    last = human.groupBy(*KEY).agg(F.max_by(F.struct("value_number", "value_text", "source_id"), "obs_seq").alias("last"), F.max("obs_seq").alias("obs_seq"))
    return last.select(*KEY, "last.*", "obs_seq")


def first_by_order(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rank = 1").drop("__rank")
