"""A catalog in a folder of Parquet tables: take in feeds, build golden records and scores, ask in SQL, export."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from catalith import session
from catalith.functions import identity, normalize
from catalith.operators import golden, quality, validate
from catalith.operators.detail import looked_up, shown
from catalith.operators.review import REVIEW_CONFIDENCE, corrected, flags, prioritised, producer
from catalith.operators.search import token_scores
from catalith.operators.views import table_summary
from catalith.sinks import exports, versions
from catalith.sources import files
from catalith.sources.kept import kept

OBSERVATION = "product_id string, code string, obs_seq decimal(38,0), value_number double, value_text string, source_id string, source_kind string, method string, quote_verified boolean"
PRODUCT = "product_id string, manufacturer string, mpn string, category_id string, source_id string"
MANIFEST = "source_id string, path string, status string, batch int"
#: Columns of a feed that tell the product; all others are attributes.
IDENTITY = ["manufacturer", "mpn", "category"]
BUILT = ["golden", "conflicts", "scores", "issues", "scorecard"]


def stored(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A stored table, empty before it is first written."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def feed_rows(cells: DataFrame, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Products and observations from cells (source_id, source_kind, row, key, value, batch); rows without a maker or part number go.

    Cells of one row meet once, in one shuffle on (source_id, row). ``seen`` counts rows and refused ones while observations are written.
    """
    named = cells.withColumn("key", F.lower(F.trim("key")))
    first = [F.min(F.when(F.col("key") == c, F.col("value"))).alias(c) for c in IDENTITY]
    facts = F.collect_list(F.when(~F.col("key").isin(IDENTITY), F.struct("key", "value"))).alias("facts")
    rows = named.groupBy("source_id", "source_kind", "row", "batch").agg(*first, facts)
    lacking = F.col("manufacturer").isNull() | F.col("mpn").isNull()
    named_rows = rows.where(~lacking)
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(lacking).alias("refused"))
    rows = rows.where(~lacking).withColumn("product_id", identity.product_id(F.col("manufacturer"), F.col("mpn")))
    named_rows = named_rows.withColumn("product_id", identity.product_id(F.col("manufacturer"), F.col("mpn")))
    products = named_rows.select("product_id", "manufacturer", "mpn", F.col("category").alias("category_id"), "source_id").distinct()
    # order of arrival: batch, row, and a part of the source's hash for rows of one number; wide enough for any of them
    wide = lambda x: F.lit(str(x)).cast("decimal(30,0)")
    order = (F.col("batch").cast("decimal(10,0)") * wide(1 << 84) + F.col("row").cast("decimal(20,0)") * wide(1 << 20) + F.pmod(F.crc32("source_id"), F.lit(1 << 20))).cast("decimal(38,0)")
    each = rows.select("product_id", "source_id", "source_kind", order.alias("obs_seq"), F.inline("facts"))
    number = F.when(F.col("value").rlike(r"^\s*[-+]?[\d,]*\.?\d+\s*$"), normalize.parse_number(F.col("value")))
    text = F.when(number.isNull(), F.col("value"))
    return products, each.select("product_id", F.col("key").alias("code"), "obs_seq", number.cast("double").alias("value_number"), text.alias("value_text"), "source_id", "source_kind", F.lit("structured_feed").alias("method"), F.lit(True).alias("quote_verified"))


def ingest(spark: SparkSession, feeds: str, root: str, sep: str | None = None) -> int:
    """Take in the feeds of a folder that aren't in the manifest yet; the number of files taken.

    Delimited feeds are read by their separator, found by looking unless it's given; those of one separator share
    a layout by name. Workbooks are read by their first sheet. The manifest is written last: a run
    that was lost before is repeated, and what it left behind is told by its sources, which the manifest
    doesn't name.
    """
    done = stored(spark, root, "manifest", MANIFEST)
    batch = done.agg(F.coalesce(F.max("batch"), F.lit(0)) + 1).first()[0]
    found = files.discover(spark, feeds).where("content_type = 'tabular'")
    fresh = files.pending(found, done).dropDuplicates(["source_id"]).withColumn("batch", F.lit(batch).cast("int"))
    taken = fresh.select("source_id", "path", F.lit("completed").alias("status"), "batch").persist()
    n = taken.count()
    if n:
        path = F.regexp_replace("path", "^file:/+", "/")
        known = fresh.select(path.alias("path"), "source_id", "source_kind", "batch")
        paths = [r.path for r in taken.select("path").toLocalIterator()]  # Spark lists the files of a read on the driver too
        books = [p for p in paths if p.lower().endswith((".xlsx", ".xlsm"))]
        groups: dict[str, list[str]] = {}
        if plain := sorted(set(paths) - set(books)):
            told = {r.path: r.sep for r in files.separators(spark, plain).collect()} if sep is None else {}
            for p in plain:
                groups.setdefault(told.get(p, sep or ","), []).append(p)
        parts = [files.read_feed(spark, group, s) for s, group in groups.items()] + ([files.read_sheets(spark, books)] if books else [])
        cells = parts[0]
        for more in parts[1:]:
            cells = cells.unionByName(more)
        start, seen, taken_in, told_of = time.time(), Observation("rows"), Observation("observations"), Observation("products")
        products, observations = feed_rows(cells.withColumn("path", path).join(known, "path"), seen)
        observations.observe(taken_in, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(f"{root}/observations")
        products.observe(told_of, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(f"{root}/products")
        spent = time.time() - start
        steps = [("sources", n, 0), ("rows", seen.get["rows"], seen.get["refused"]), ("observations", taken_in.get["rows"], 0), ("products", told_of.get["rows"], 0)]
        versions.record(spark, root, [("ingest", name, rows, refused, spent, f"batch-{batch}") for name, rows, refused in steps])
        taken.write.mode("append").parquet(f"{root}/manifest")
    taken.unpersist()
    return n


def tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """products, one row each, and observations, both of sources that were taken in as a whole; a source taken in twice counts once."""
    whole = stored(spark, root, "manifest", MANIFEST).select("source_id").distinct()
    seen = stored(spark, root, "observations", OBSERVATION).join(whole, "source_id", "left_semi").dropDuplicates(["product_id", "code", "source_id", "obs_seq"])
    rows = stored(spark, root, "products", PRODUCT).join(whole, "source_id", "left_semi")
    products = rows.groupBy("product_id").agg(*[F.min(c).alias(c) for c in ("manufacturer", "mpn", "category_id")])
    return {"products": products, "observations": seen.select(*[c.split()[0] for c in OBSERVATION.split(", ")])}


def build(spark: SparkSession, root: str, required: DataFrame, rules: dict[str, str] | None = None) -> dict[str, int]:
    """Golden records, conflicts, issues and scores from all observations, published at once; the number of rows of each table.

    required: category_id, channel, code, variant_defining. Numbers are compared with those of the same code and
    category; ``rules`` are conditions over numeric codes by name, such as ``width <= height``. A lost build leaves
    the last one as it was.
    """
    now, version = tables(spark, root), versions.Version(spark, root)
    records = version.write("golden", golden.golden_records(now["observations"]))
    products = now["products"].withColumn("is_family", F.lit(False))
    clashes = version.write("conflicts", golden.conflicts(records))
    peers = records.where("value_number is not null").join(products.select("product_id", "category_id"), "product_id").select("product_id", "category_id", "code", F.col("value_number").alias("value"))
    judged = quality.outliers(peers, ["category_id", "code"], "value")
    message = quality.outlier_message(F.col("value"), F.col("median"), F.col("mad"), F.col("n"), F.col("low"), F.col("high"))
    judged = kept(judged.select("product_id", "code", F.col("outlier").alias("out"), F.when(F.col("outlier"), message).alias("message")), "outliers")
    results = _rule_results(records, rules or {})
    found = validate.issues(validate.identity_issues(products), validate.outlier_issues(judged.where("out")), validate.conflict_issues(clashes), validate.rule_issues(results))
    found = version.write("issues", found)
    checks = _checks(judged, results, found)
    attributes = records.withColumns({"generated": F.lit(False), "inferred": F.lit(False), "verified": F.coalesce("quote_verified", F.lit(False))})
    scores = version.write("scores", quality.quality(products, attributes, required, checks))
    version.write("scorecard", quality.scorecard(scores))
    return version.publish()


def _rule_results(records: DataFrame, rules: dict[str, str]) -> DataFrame:
    """product_id, rule_id, passed, message of each rule that applies: all codes that it names must be there."""
    if not rules:
        return records.sparkSession.createDataFrame([], "product_id string, rule_id string, passed boolean, message string")
    codes = sorted({w for text in rules.values() for w in re.findall(r"[a-z_]\w*", text, re.I)})
    wide = records.where(F.col("code").isin(codes)).groupBy("product_id").pivot("code", codes).agg(F.first("value_number"))
    said = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    found = quality.evaluate_rules(wide, {name: quality.rule_condition(text, codes) for name, text in rules.items()})
    return found.withColumn("message", said[F.col("rule_id")])


def _checks(judged: DataFrame, results: DataFrame, found: DataFrame) -> DataFrame:
    """What scores need of each product: rules passed and applicable, errors, outliers and numbers with peers."""
    none = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    parts = [
        results.select("product_id", F.col("passed").cast("long").alias("passed"), F.lit(1).cast("long").alias("applicable"), *none("errors", "outliers", "numeric")),
        found.where("level = 'error' and kind <> 'rule'").select("product_id", *none("passed", "applicable"), F.lit(1).cast("long").alias("errors"), *none("outliers", "numeric")),
        judged.where("out is not null").select("product_id", *none("passed", "applicable", "errors"), F.col("out").cast("long").alias("outliers"), F.lit(1).cast("long").alias("numeric")),
    ]
    names = ["passed", "applicable", "errors", "outliers", "numeric"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("product_id").agg(*[F.sum(n).alias(n) for n in names])


def lift(spark: SparkSession, root: str) -> DataFrame:
    """Scorecard of the last build beside that of the build before: metric, before, after, change; before is null for the first."""
    def long(card: DataFrame, name: str) -> DataFrame:
        return card.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in card.columns])).alias("x")).select("x.*")

    after = long(versions.read(spark, root, "scorecard"), "after")
    first = len(versions.published(spark, root)) < 2
    before = after.select("metric", F.lit(None).cast("double").alias("before")) if first else long(versions.read(spark, root, "scorecard", 1), "before")
    return before.join(after, "metric").select("metric", "before", "after", quality.round_half_up(F.col("after") - F.col("before"), 4).alias("change")).orderBy("metric")


def audit(spark: SparkSession, root: str) -> DataFrame:
    """Steps of all runs in order: what was read, written and refused."""
    return stored(spark, root, "audit", versions.AUDIT).orderBy("at", "step", "name")


def views(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the catalog, registered for SQL."""
    build_of = versions.published(spark, root)
    if not build_of:
        raise FileNotFoundError(f"nothing is built in {root} yet")
    found = tables(spark, root) | {name: spark.read.parquet(f"{build_of[-1]}/{name}") for name in BUILT}
    session.register(found)
    return found


def ask(spark: SparkSession, root: str, statement: str, args: list | None = None) -> DataFrame:
    """Rows of a reading statement over products, observations, golden, conflicts and scores."""
    views(spark, root)
    return session.read_sql(spark, statement, args)


def status(spark: SparkSession, root: str) -> DataFrame:
    """Sources by status, and rows of each table."""
    seen = stored(spark, root, "manifest", MANIFEST).groupBy(F.concat(F.lit("sources "), "status").alias("what")).agg(F.count("*").alias("n"))
    found = tables(spark, root)
    return seen.unionByName(table_summary(found).select(F.col("table_name").alias("what"), "n"))


def records(spark: SparkSession, root: str, manufacturer: str | None = None, category: str | None = None) -> DataFrame:
    """Products with their scores, by maker and part number; ``manufacturer`` is a part of the name."""
    found = views(spark, root)
    rows = found["products"].join(found["scores"].drop("is_family"), "product_id", "left")
    if manufacturer is not None:
        rows = rows.where(F.contains(F.lower("manufacturer"), F.lit(manufacturer.lower())))
    if category is not None:
        rows = rows.where(F.col("category_id") == category)
    return rows.orderBy(F.lower("manufacturer"), F.lower("mpn"), "product_id")


def show(spark: SparkSession, root: str, asked: str) -> DataFrame:
    """Golden values of the product with an id or a part number."""
    found = views(spark, root)
    one = looked_up(spark.createDataFrame([(asked,)], "asked string"), found["products"]).where("product_id is not null")
    facts = found["golden"].join(one.select("product_id"), "product_id", "left_semi").withColumns({"generated": F.lit(False), "inferred": F.lit(False)})
    return shown(exports.rendered(facts).withColumnRenamed("shown", "value")).select("code", "value", "confidence", "tag", "band", "source_id", "agreeing", "disagreeing", "severity").orderBy("code")


def find(spark: SparkSession, root: str, question: str, limit: int = 20) -> DataFrame:
    """Products that have words or numbers of a question in their identity or their values, best first."""
    found = views(spark, root)
    products = found["products"].withColumn("identity", F.concat_ws(" ", "manufacturer", "mpn"))
    facts = exports.rendered(found["golden"]).withColumns({"label": F.col("code"), "variant_defining": F.lit(False)})
    scores = token_scores(products, facts, question).withColumn("score", F.least(F.lit(1.0), F.col("raw") / 4))
    return scores.join(found["products"], "product_id").select("product_id", "manufacturer", "mpn", "score").orderBy(F.desc("score"), "product_id").limit(limit)


def review(spark: SparkSession, root: str, limit: int = 25) -> DataFrame:
    """Open questions of the catalog, most urgent first: critical conflicts and values of low confidence."""
    found = views(spark, root)
    weak = found["golden"].where(F.col("confidence") < REVIEW_CONFIDENCE)
    clash = found["conflicts"].where("severity = 'critical'").join(found["golden"].select("product_id", "code", "confidence"), ["product_id", "code"], "left")
    raised = flags(
        producer(clash, F.concat(F.lit("conflict_critical: sources disagree by "), "rule"), "critical", F.coalesce("confidence", F.lit(0.5)), "conflict_critical"),
        producer(weak, F.format_string("low_confidence: %.2f", "confidence"), "warning", F.col("confidence"), "low_confidence"),
    )
    return prioritised(raised, limit).join(found["products"].select("product_id", "manufacturer", "mpn"), "product_id", "left").orderBy(F.desc("priority"), "flag_id")


def correct(spark: SparkSession, root: str, product_id: str, code: str, value: str, reviewer: str) -> None:
    """Append a correction as human evidence; the next build lets it win. A number is taken as a number."""
    now = tables(spark, root)["observations"]
    number = F.when(F.lit(value).rlike(r"^\s*[-+]?[0-9,]*\.?[0-9]+\s*$"), normalize.parse_number(F.lit(value)))
    fix = spark.range(1).select(F.lit(product_id).alias("product_id"), F.lit(code).alias("code"), F.lit(1).alias("correction_seq"), number.alias("value_number"), F.when(number.isNull(), F.lit(value)).alias("value_text"), F.lit(reviewer).alias("reviewer"))
    own = corrected(now, fix).where(F.col("source_id") == f"human:{reviewer}").where((F.col("product_id") == product_id) & (F.col("code") == code))
    fresh = own.orderBy(F.desc("obs_seq")).limit(1).withColumn("obs_seq", F.col("obs_seq").cast("decimal(38,0)"))
    # human evidence is a source of its own, which the manifest has to name
    fresh.coalesce(1).write.mode("append").parquet(f"{root}/observations")
    done = stored(spark, root, "manifest", MANIFEST)
    batch = done.agg(F.coalesce(F.max("batch"), F.lit(0)).cast("int").alias("batch"))
    batch.select(F.lit(f"human:{reviewer}").alias("source_id"), F.lit("").alias("path"), F.lit("completed").alias("status"), "batch").write.mode("append").parquet(f"{root}/manifest")


def schema(spark: SparkSession, root: str) -> DataFrame:
    """Codes of each category with the number of products that have them."""
    found = views(spark, root)
    return found["golden"].join(found["products"].select("product_id", "category_id"), "product_id").groupBy("category_id", "code").agg(F.count("*").alias("products")).orderBy("category_id", "code")


def export(spark: SparkSession, root: str, target: str, kind: str, ready: bool = False) -> None:
    """Write a channel export: json (trade items), record (all that is known), csv (a column for each code) or xml (articles)."""
    found = views(spark, root)
    products = found["products"].join(found["scores"].select("product_id", "channel_ready"), "product_id", "left")
    products = exports.ready_only(products) if ready else products
    attributes = found["golden"]
    if kind == "json":
        exports.trade_items(products, attributes).select("item").write.mode("overwrite").text(target)
    elif kind == "record":
        clashes = found["conflicts"].select("product_id", "code", "rule", "severity")
        exports.record_items(products, attributes, clashes, found["observations"].select("product_id", "source_id")).select("item").write.mode("overwrite").text(target)
    elif kind == "csv":
        codes = [r.code for r in attributes.select("code").distinct().collect()]  # as many as the feed has columns
        exports.wide_feed(products, attributes, codes).write.mode("overwrite").option("header", "true").csv(target)
    elif kind == "xml":
        exports.write_articles(products, attributes, target)
    else:
        raise ValueError(f"unknown export {kind!r}")
