"""Golden records of a stream of observations: what arbitration needs is state, so that a batch costs what it touches.

The state has one entry for each value and source of a product's attribute that was seen. Its size doesn't
grow with repeats, entries don't depend on the order of arrival, and the records made from them are
those of ``golden.golden_records`` over all observations so far. Entries are kept by Spark's own aggregation;
only those that a time to live forgets are kept in Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catalith.operators.golden import CARRIED, ENTRY, KEY, confidence, decided, group_stats, ranked, summaries

_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
#: The state store that keeps large state outside the heap; needed for transformWithState. Counting its rows would read each before it is written.
#: Entries of a product lie side by side and are alike, so larger blocks and zstd make them much smaller.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_ROCKS}.trackTotalNumberOfRows": "false", f"{_ROCKS}.compression": "zstd", f"{_ROCKS}.blockSizeKB": "32"}
_ENTRY = "number double, text string, members string, source_id string, first_seq long, n long, precedence double, method_rank double, best string, best_precedence double, best_rank double, best_seq long, human string, human_seq long, grave boolean"
_FIELDS = [f.split()[0] for f in _ENTRY.split(", ")]
_BEST = ["best_precedence", "best_rank", "best_seq"]


def merged(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
    """Two entries of one value and source as one; the same in any order."""
    out = dict(a)
    out["first_seq"], out["n"] = min(a["first_seq"], b["first_seq"]), a["n"] + b["n"]
    out["precedence"], out["method_rank"], out["grave"] = max(a["precedence"], b["precedence"]), max(a["method_rank"], b["method_rank"]), a["grave"] or b["grave"]
    rank = lambda e: (e["best_precedence"], e["best_rank"], -e["best_seq"])
    if rank(b) > rank(a):
        out |= {k: b[k] for k in ("best", *_BEST)}
    if b["human_seq"] is not None and (a["human_seq"] is None or b["human_seq"] > a["human_seq"]):
        out |= {"human": b["human"], "human_seq": b["human_seq"]}
    return out


class Arbitration(StatefulProcessor):
    """Map state of a key's entries; emits all entries of the keys that a batch touches."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "id string", _ENTRY, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: dict[str, dict[str, Any]] = {}
        for pdf in rows:
            for values in pdf[_FIELDS].astype(object).where(pdf[_FIELDS].notna(), None).itertuples(index=False):
                entry = dict(zip(_FIELDS, values, strict=True))
                # a number's text is exact: no two floats share their shortest one
                name = json.dumps([None if entry["number"] is None else repr(float(entry["number"])), entry["text"], entry["members"], entry["source_id"]])
                entry = {k: int(v) if k in ("first_seq", "n", "best_seq", "human_seq") and v is not None else bool(v) if k == "grave" else v for k, v in entry.items()}
                fresh[name] = merged(fresh[name], entry) if name in fresh else entry
        for name, entry in fresh.items():
            if self.entries.containsKey((name,)):
                entry = merged(dict(zip(_FIELDS, self.entries.getValue((name,)), strict=True)), entry)
            self.entries.updateValue((name,), tuple(entry[k] for k in _FIELDS))
        all_entries = [tuple(v) for _, v in self.entries.iterator()]
        out = pd.DataFrame(all_entries, columns=_FIELDS)
        for i, k in enumerate(KEY):
            out.insert(i, k, key[i])
        yield out

    def close(self) -> None:
        pass


def entries(observations: DataFrame) -> DataFrame:
    """One entry for each observation; columns as the state has them."""
    rows = ranked(observations)
    carried = F.to_json(F.struct(*[c for c in CARRIED if c in rows.columns], "method_rank"))
    members = F.to_json(F.array_sort(F.array_distinct("value_list"))) if "value_list" in rows.columns else F.lit(None).cast("string")
    number = F.when(~F.isnan("value_number"), F.col("value_number"))
    text = F.when(F.col("value_number").isNull() & (F.trim("value_text") != ""), F.col("value_text"))
    human = F.col("method") == "human"
    grave = F.coalesce(F.col("grave"), F.lit(False)) if "grave" in rows.columns else F.lit(False)
    precedence, rank, seq = F.col("precedence").cast("double"), F.col("method_rank").cast("double"), F.col("obs_seq").cast("long")
    values = [number, text, F.when(F.col("value_number").isNull(), members), F.col("source_id").cast("string"), seq, F.lit(1).cast("long"), precedence, rank, carried, precedence, rank, seq, F.when(human, carried), F.when(human, seq), grave]
    out = rows.select(*KEY, *[v.alias(name) for v, name in zip(values, _FIELDS, strict=True)])
    return out.where("number is not null or text is not null or members is not null")


def arbitrated(observations: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stream of the entries that each batch changes, for update mode; columns as ``golden.summaries`` has them.

    With ``ttl_ms`` an entry is forgotten so long after its last change, and each batch gives all entries of the keys
    that it touches. Every entry then goes through Python several times, which is for small streams only.
    """
    if ttl_ms is None:
        return summaries(observations)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in observations.select(*KEY).schema) + ", " + _ENTRY
    return entries(observations).groupBy(*KEY).transformWithStateInPandas(Arbitration(ttl_ms), schema, "Update", "ProcessingTime")


def records(touched: DataFrame, observations: DataFrame) -> DataFrame:
    """Golden records of entries with a time to live; ``observations`` tells the columns and types that a winner carries."""
    carried = ranked(observations).select(*[c for c in CARRIED if c in observations.columns], "method_rank").schema
    rows = touched.withColumns({"best": F.from_json("best", carried), "human": F.from_json("human", carried), "best_order": F.struct("best_precedence", "best_rank", -F.col("best_seq"))})
    return confidence(decided(group_stats(rows.drop(*_BEST))))


def written_batches(path: str, observations: DataFrame) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what each batch changes in a folder of its own, entries or, with a time to live, records; a batch that is run again replaces its folder."""

    def apply(touched: DataFrame, batch: int) -> None:
        rows = records(touched, observations) if "best_seq" in touched.columns else touched
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return apply


def current(spark: SparkSession, path: str) -> DataFrame:
    """The records of all keys, from the last state of what ``written_batches`` wrote."""
    rows = spark.read.parquet(path)
    made = "rule" in rows.columns
    # one exchange by key serves the choice of the last entries and all of arbitration; with a given number of parts it is
    # not cut down to the size of the files, as the work on a key is much more than its bytes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = F.max("batch").over(Window.partitionBy(*KEY, *([] if made else ENTRY)))
    found = rows.repartition(parts, *KEY).withColumn("last", last).where("batch = last").drop("last", "batch")
    return found if made else confidence(decided(group_stats(found)))
