"""Sets of tables that are replaced at once, and the audit of what each step wrote.

A build writes all its tables into a folder of its own and then one pointer file, whose name is a rising number;
it is made elsewhere and renamed last. Readers follow the pointer with the largest number, so they see the tables
of one build, and a build that is lost on the way changes nothing.
"""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

AUDIT = "step string, name string, rows long, refused long, seconds double, run string, at timestamp"


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Names of the pointers in order."""
    files, place = _folder(spark, f"{root}/pointers")
    if not files.exists(place):
        return []
    return sorted(name for s in files.listStatus(place) if (name := s.getPath().getName()).isdigit())


def published(spark: SparkSession, root: str) -> list[str]:
    """Folders of all published builds, oldest first."""
    files, place = _folder(spark, f"{root}/pointers")
    out = []
    for name in _pointers(spark, root):
        stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(place, name))
        try:
            out.append(f"{root}/built/{stream.readUTF()}")
        finally:
            stream.close()
    return out


class Version:
    """Tables of one build: ``write`` each, then ``publish`` all."""

    def __init__(self, spark: SparkSession, root: str, step: str = "build") -> None:
        self.spark, self.root, self.step = spark, root, step
        self.name = f"{step}-{uuid.uuid4().hex}"
        self.path = f"{root}/built/{self.name}"
        self.counts: dict[str, int] = {}
        self._seconds: dict[str, float] = {}

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Store a table and give it back as stored; its rows are counted on the way."""
        start, seen = time.time(), Observation(name)
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{name}")
        self.counts[name] = seen.get["rows"]
        self._seconds[name] = time.time() - start
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def publish(self) -> dict[str, int]:
        """Let readers see the tables; the number of rows of each."""
        record(self.spark, self.root, [(self.step, n, rows, 0, self._seconds[n], self.name) for n, rows in self.counts.items()])
        files, made = _folder(self.spark, f"{self.root}/pointers/_{self.name}")
        stream = files.create(made)
        stream.writeUTF(self.name)
        stream.close()
        last = _pointers(self.spark, self.root)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointers/{int(last[-1]) + 1 if last else 1:012d}")
        if files.exists(place) or not files.rename(made, place):
            raise RuntimeError("another build was published meanwhile")
        return self.counts


def read(spark: SparkSession, root: str, name: str, back: int = 0) -> DataFrame:
    """A table of the last published build, or of one ``back`` builds before."""
    builds = published(spark, root)
    if len(builds) <= back:
        raise FileNotFoundError(f"no build of {root} to read")
    return spark.read.parquet(f"{builds[-1 - back]}/{name}")


def record(spark: SparkSession, root: str, steps: list[tuple[str, str, int, int, float, str]]) -> None:
    """Append steps to the audit: step, name, rows, refused, seconds, run."""
    now = datetime.now(UTC)
    spark.createDataFrame([(*s, now) for s in steps], AUDIT).coalesce(1).write.mode("append").parquet(f"{root}/audit")
