"""Streams over rows of the test tables, run to their end; each must equal the batch form's SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.plans import catalog
from catalith.plans.catalog import table
from catalith.plans.catalog_queries import _NUMBER_GROUPS, _SCORE, _WINNERS, _round, _unix
from catalith.registry import ORACLE_SQL, query
from catalith.sources.kept import removed, shared_path
from catalith.streaming import arbitration, events

FILES, BATCHES = 4, 2
#: A task's share of the observations is kept under so many by more tasks than the session's, up to ADDED_TASKS of them.
TASK_ROWS, ADDED_TASKS = 500_000, 200
#: For a stream of few large batches: a file for each task, no shuffle stays when what needed it has ended, and executors keep no copy of the state between batches.
TIDY = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
#: A task for each file: stored observations are so small for their rows that Spark would give a task the rows of many.
APART = {"spark.sql.files.openCostInBytes": "128m"}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _as_stream(rows: DataFrame, name: str, files: int = FILES) -> DataFrame:
    """The rows, dealt into files by their hash, one a core at least, and read as a stream of batches of half the files."""
    path = shared_path(rows.sparkSession, name)
    files = max(files, rows.sparkSession.sparkContext.defaultParallelism)
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(path)


def _landed(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written once and dealt by their hash to two batches of files, read as a stream of those batches. They are not shuffled for that."""
    spark = rows.sparkSession
    rows.write.parquet(f"{path}/whole")
    whole = spark.read.schema(rows.schema).parquet(f"{path}/whole")
    with _settings(spark, APART):
        for k in range(BATCHES):
            whole.where(F.pmod(F.xxhash64(*whole.columns), F.lit(BATCHES)) == k).write.parquet(f"{path}/landed/{k}")
    removed(spark, f"{path}/whole")
    files = len(spark.read.parquet(f"{path}/landed/0").inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/landed/*")


@query("st_arbitration", f"WITH {_NUMBER_GROUPS}, {_WINNERS} SELECT product_id, 'discount' AS code, value_number, source_id, agreeing, disagreeing, n_groups, rule, severity, {_round(_SCORE, 4)} AS confidence FROM won")
def st_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = catalog.observations(spark, sf_dir), table(spark, sf_dir, "lineitem").count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(ADDED_TASKS, -(-n // TASK_ROWS)))
    landed, state, out = (shared_path(spark, name) for name in ("observations", "arbitration", "records"))
    with _settings(spark, arbitration.STORE | TIDY | {"spark.sql.shuffle.partitions": str(tasks)}):
        stream = _landed(rows, landed)
        with _settings(spark, APART):
            events.run_available(arbitration.arbitrated(stream), state, arbitration.written_batches(out, rows))
        found = arbitration.current(spark, out)
    removed(spark, landed, state)
    return found.select("product_id", "code", "value_number", "source_id", "agreeing", "disagreeing", F.col("groups").alias("n_groups"), "rule", "severity", "confidence")


def _last_batches(spark: SparkSession, stream: DataFrame, key: list[str], name: str) -> DataFrame:
    """Run a stream in update mode and keep the last row of each key."""
    out = shared_path(spark, name)

    def apply(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))
    return spark.read.parquet(out).withColumn("last", last).where("last = 1").drop("last", "batch")


def _windows(name: str, size: str, slide: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # files come in any order: nothing may be late
        stream = events.timed(_as_stream(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), name), "36500 days")
        return _unix(_last_batches(spark, events.windowed(stream, size, slide), ["start", "end", "event_type"], name))

    return run


query("st_stream_tumbling", ORACLE_SQL["st_tumbling"])(_windows("tumbling", "1 hour", None))
query("st_stream_sliding", ORACLE_SQL["st_sliding"])(_windows("sliding", "1 hour", "15 minutes"))


@query("st_stream_dedupe", ORACLE_SQL["st_dedupe"])
def st_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, out = events.timed(_as_stream(table(spark, sf_dir, "events"), "events"), "36500 days"), shared_path(spark, "first-events")
    first = events.deduplicated(stream, ["user_id", "event_type"]).select("user_id", "event_type")
    first.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "dedupe-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(first.schema).parquet(out)
