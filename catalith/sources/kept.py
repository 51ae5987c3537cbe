"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local run (tests) may leave that unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="catalith-"))
        found = "file://" + _own[0]
    return f"{found.rstrip('/')}/catalog/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read back: what reads them twice doesn't work them out twice, and a lost executor costs nothing done before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, name: str) -> DataFrame:
    """``kept``, unless the rows are read straight from files, columns and rows left out or worked out from a row at most."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    # a union, join, window or aggregate below makes its rows each time
    return df if plan.children().isEmpty() else kept(df, name)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to as many tasks as shuffles have, for work that takes long for the bytes it reads: small files would give it to a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
