"""Property graph of products as an edge table: src, predicate, dst, confidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Predicates that hold both ways, and pairs that are each other's inverse.
SYMMETRIC = ["compatible_with"]
INVERSE = {"replaces": "replaced_by", "replaced_by": "replaces"}
#: Tasks that the pairs of one family are dealt to.
PAIR_SLOTS = 8
EDGE = ["src", "predicate", "dst", "confidence"]
#: Edges that a task should sort at most: some 60 MB.
TASK_EDGES = 500_000
#: Most tasks that are added for that: above so many Spark gathers what it deals in memory.
ADDED_TASKS = 200


def closed(edges: DataFrame, rows: int = 0) -> DataFrame:
    """Edges without loops, with mirrored and inverse ones, each once with its best confidence.

    Most edges come once, so a task that reads them would gather nearly all it reads in memory to drop few. They are
    dealt by edge to a given number of tasks instead, and each sorts its share, which needs less than a table of edges.
    They are as many as the session's shuffle partitions; rows, the number of edges as far as it is known, makes them
    more where a share would be larger than TASK_EDGES, so that a task's memory doesn't grow with the edges.
    """
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(ADDED_TASKS, math.ceil(rows / TASK_EDGES)))
    own = edges.where("src <> dst").select(*EDGE)
    back = F.when(F.col("predicate").isin(SYMMETRIC), F.col("predicate"))
    for name, inverse in INVERSE.items():
        back = back.when(F.col("predicate") == name, F.lit(inverse))
    mirrored = own.select(F.col("dst").alias("src"), back.alias("predicate"), F.col("src").alias("dst"), "confidence").where("predicate is not null")
    key = ["src", "predicate", "dst"]
    dealt = own.unionByName(mirrored).repartition(tasks, *key)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("confidence")))
    return dealt.withColumn("place", place).where("place = 1").select(*EDGE)


def build(products: DataFrame, sources: DataFrame, certifications: DataFrame, rows: int = 0) -> DataFrame:
    """Edges from products (product_id, category_id, base_id), their sources (product_id, source_id) and certifications (product_id, label, with a confidence if there is one).

    Products of one base are ``compatible_with`` each other; that edge runs between each and the family
    itself (``family:`` and its base), not between all pairs, which grow with the square of a family;
    ``family_pairs`` gives those. rows: about how many edges these make, for ``closed``.
    """
    def edge(rows: DataFrame, predicate: str, dst, confidence: float | Column = 1.0) -> DataFrame:
        sure = F.lit(confidence) if isinstance(confidence, float) else confidence
        return rows.select(F.col("product_id").alias("src"), F.lit(predicate).alias("predicate"), dst.alias("dst"), sure.cast("double").alias("confidence"))

    of_base = products.where("base_id is not null and base_id <> product_id")
    sure = F.col("confidence") if "confidence" in certifications.columns else F.lit(1.0)
    out = edge(products.where("category_id is not null"), "belongs_to", F.col("category_id"))
    out = out.unionByName(edge(of_base, "variant_of", F.col("base_id"), 0.9))
    out = out.unionByName(edge(sources, "documented_in", F.col("source_id")))
    out = out.unionByName(edge(certifications, "certified_by", F.concat(F.lit("cert:"), "label"), sure))
    out = out.unionByName(edge(of_base, "compatible_with", F.concat(F.lit("family:"), "base_id"), 0.6))
    return closed(out, rows)


def family_pairs(products: DataFrame) -> DataFrame:
    """Pairs of products with one base, smaller id first.

    Their number is the square of a family. A family is dealt to PAIR_SLOTS tasks, each of which pairs a share of its
    members with all of them, and the number of tasks is given, as pairs are many for the bytes of their products.
    """
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = products.select("base_id", F.col("product_id").alias("a"), F.pmod(F.xxhash64("product_id"), F.lit(PAIR_SLOTS)).alias("slot"))
    right = products.select("base_id", F.col("product_id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_SLOTS - 1).cast("long"))).alias("slot"))
    on = ["base_id", "slot"]
    return left.repartition(parts, *on).join(right.repartition(parts, *on), on).where("a < b").select("base_id", "a", "b")


def siblings(edges: DataFrame) -> DataFrame:
    """Products that are variants of the same base."""
    of = edges.where(F.col("predicate") == "variant_of")
    a, b = of.select("dst", F.col("src").alias("product")), of.select("dst", F.col("src").alias("sibling"))
    return a.join(b, "dst").where("product <> sibling").select(F.col("dst").alias("base"), "product", "sibling")


def base_of(edges: DataFrame) -> DataFrame:
    """The base of each product, the first by name where an edge table has several."""
    return edges.where(F.col("predicate") == "variant_of").groupBy(F.col("src").alias("product")).agg(F.min("dst").alias("base"))


def family(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Members of the family of each product asked for (column product): its base and all variants of that; a base has its variants."""
    bases = base_of(edges)
    own = asked.join(bases, "product", "left").select("product", F.coalesce("base", "product").alias("base"))
    variants = edges.where(F.col("predicate") == "variant_of").select(F.col("dst").alias("base"), F.col("src").alias("member"))
    return own.select("product", F.col("base").alias("member")).unionByName(own.join(variants, "base").select("product", "member")).distinct()


def neighbours(edges: DataFrame, node: str, predicate: str | None = None) -> DataFrame:
    if predicate is not None:
        edges = edges.where(F.col("predicate") == predicate)
    return edges.where(F.col("src") == node).select("predicate", F.col("dst").alias("node")).unionByName(edges.where(F.col("dst") == node).select("predicate", F.col("src").alias("node")))


def paths(edges: DataFrame, starts: DataFrame, predicates: list[str], depth: int = 3) -> DataFrame:
    """start, node, depth and path (the predicates on the way) for each node in reach, by the shortest way, the first path in order among those of one length."""
    steps = edges.where(F.col("predicate").isin(predicates)).select("src", "predicate", "dst").distinct()
    none = F.array().cast("array<string>")
    seen = frontier = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), none.alias("path"))
    for k in range(1, depth + 1):
        found = frontier.join(steps, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("predicate"))).alias("path"))
        frontier = found.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(k).alias("depth"), "path")
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def totals(edges: DataFrame) -> DataFrame:
    """Nodes, edges, and edges by predicate as a map: one row."""
    by_type = edges.groupBy("predicate").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "n")))).alias("by_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    return node_count(edges).crossJoin(F.broadcast(by_type)).select("nodes", "edges", "by_type")


def save(edges: DataFrame, path: str) -> None:
    edges.select(*EDGE).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a stored graph; lines that are no edges are skipped."""
    rows = spark.read.schema("src string, predicate string, dst string, confidence double, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null and src is not null and predicate is not null and dst is not null").select(*EDGE)


def reachable(edges: DataFrame, starts: DataFrame, depth: int = 3, predicates: list[str] | None = None) -> DataFrame:
    """Nodes in reach of start nodes (column start), with the least depth; one join for each step, nodes seen before are not followed."""
    steps = edges.where(F.col("predicate").isin(predicates)) if predicates else edges
    steps = steps.select("src", "dst").distinct()
    seen = frontier = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    for k in range(1, depth + 1):
        found = frontier.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = found.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen


def stats(edges: DataFrame) -> DataFrame:
    """Edges and distinct ends by predicate."""
    return edges.groupBy("predicate").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


def node_count(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).agg(F.count_distinct("node").alias("nodes"))
