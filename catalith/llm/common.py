"""What several corpus operators share: stored intermediate tables and skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: A key with more than 1/HOT_SHARE of all rows is looked up by broadcast; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 256
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir; a local run (tests) may leave it unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="catalith-"))
    return "file://" + _own_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/catalith/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def bounded_batches(spark: SparkSession) -> None:
    """Rows that reach Python at once: at most BATCH_ROWS, so that a batch of texts takes megabytes; a smaller setting stays."""
    if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, and a lost executor costs nothing done before."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _reads_files(df: DataFrame) -> bool:
    """Whether the rows are those of files, some left out at most, so that a row's place in its file tells it apart."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation")


def row_keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, whatever ids they have, so that verdicts find them; and that column's name.

    The key is the place in a Parquet file, a struct of the file's hash and the row's number: it is the same
    whenever and however the file is read. Rows that don't come straight from Parquet files are stored first.
    """
    row = free_name(df, "row_key")

    def keyed(rows: DataFrame) -> DataFrame:
        # the rows may have a column of that name themselves
        place = rows.metadataColumn("_metadata")
        return rows.select("*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(row))

    if _reads_files(df):
        try:
            return keyed(df), row
        except AnalysisException:  # files of another format have no row numbers
            pass
    return keyed(stored(df, "rows")), row


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """Left join of rows and a stored table with one row a key, where a key may hold any share of the rows.

    ``weight`` is the column of ``table`` with the key's number of rows, of ``total`` in all. Keys with
    more than 1/HOT_SHARE of the rows, fewer than HOT_SHARE by counting, are broadcast; the rest,
    none of which can fill a task, is joined by a shuffle. Keys are never null.
    """
    bound = max(total // HOT_SHARE, 1)
    hot = F.broadcast(table.where(F.col(weight) > bound))
    ordinary = rows.join(F.broadcast(table.where(F.col(weight) > bound).select(*keys)), [*keys], "left_anti")
    return rows.join(hot, [*keys], "inner").unionByName(ordinary.join(table.where(F.col(weight) <= bound), [*keys], "left"))


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """As ``attach``, but the plan of ``rows`` is run once, so that lookups can follow each other; no other columns may clash.

    Rows of broadcast keys go through the shuffle as well, dealt by all their columns.
    """
    bound = max(total // HOT_SHARE, 1)
    values = [c for c in table.columns if c not in keys and c != weight]
    hot = table.where(F.col(weight) > bound).select(*keys, F.struct(*values).alias("hot"))
    met = rows.join(F.broadcast(hot), [*keys], "left")
    met = met.withColumn("slot", F.when(F.col("hot").isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64(*rows.columns)))
    ordinary = table.where(F.col(weight) <= bound).select(*keys, F.xxhash64(*keys).alias("slot"), F.struct(*values).alias("cold"))
    found = met.join(ordinary, [*keys, "slot"], "left").withColumn("found", F.coalesce("hot", "cold"))
    return found.select(*rows.columns, *[F.col(f"found.{v}").alias(v) for v in values])
