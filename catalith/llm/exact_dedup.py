"""Exact deduplication with DataFrame functions only.

Texts are equal if they are the same after white space is deleted. Rows are grouped by a 128-bit hash of
that content and, inside the hash, by its very bytes, so two contents that share a hash stay apart. The
grouping combines map-side first: a group with any share of the rows reaches the shuffle as one row a
task. Of a group, the row with the longest original text stays, then the smallest id. Verdicts go back
to the documents by hash through a join that no large group can skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import attach, row_keyed, stored

WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Holds 2**63 minus any long, so also 2**64.
_BIG = 1 << 65
_HALF = 1 << 63


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def without_space(text: Column) -> Column:
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _keep_order(size: Column, doc_id: Column) -> Column:
    """One number that is larger for longer texts and, among those, for smaller ids, null ones last; decimals stay in hash aggregation."""
    # a null id counts as 2**63, which no long is
    known = F.coalesce(doc_id.cast("long").cast("decimal(20,0)"), _number(_HALF))
    return (size.cast("decimal(11,0)") * _number(_BIG) + (_number(_HALF) - known)).cast("decimal(38,0)")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct content: content_hash, text_sha256, group_size, keep_id."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        without_space(text).alias("content"),
        _keep_order(F.char_length(text), docs[id_col]).alias("rank"),
    )
    groups = rows.groupBy(F.unhex(F.md5("content")).alias("content_hash"), "content").agg(F.count("*").alias("group_size"), F.max("rank").alias("rank"))
    low = F.col("rank") % _number(_BIG)
    keep = F.when(low != 0, (_number(_HALF) - low).cast("long"))
    return groups.select("content_hash", F.unhex(F.sha2("content", 256)).alias("sha"), "group_size", keep.alias("keep_id"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256 of the content.

    Null and empty texts, and texts of white space alone, are equal to each other. Rows that repeat an
    id and a content get the same verdict, so they stay or go together. A null id comes after all others,
    and keep_id is null if only such rows have the content. An empty table gives an empty result; other
    columns are not read. Two contents with one content hash are told apart by bytes when grouped and
    by their SHA-256 when joined.
    """
    groups = stored(duplicate_groups(docs, id_col, text_col), "content-groups")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    hashed = docs.select(docs[id_col].cast("long").alias("id"), without_space(text).alias("content"))
    rows = stored(hashed.select("id", F.unhex(F.md5("content")).alias("content_hash"), F.unhex(F.sha2("content", 256)).alias("sha")), "content-hashes")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    return attach(rows, groups, ["content_hash", "sha"], "group_size", total).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each content, with all its columns: the longest text, then the smallest id, a null one last, then the first in the files.

    Ids may be null or repeat, and columns may have any names.
    """
    keyed, row = row_keyed(docs)
    text = F.coalesce(keyed[text_col].cast("string"), F.lit(""))
    rank = _keep_order(F.char_length(text), keyed[id_col])
    content = keyed.select(keyed[row].alias("row"), keyed[id_col].isNull().alias("no_id"), rank.alias("rank"), without_space(text).alias("content"))
    rows = stored(content.select("row", "no_id", "rank", F.unhex(F.md5("content")).alias("content_hash"), F.unhex(F.sha2("content", 256)).alias("sha")), "content-ranks")
    keys = ["content_hash", "sha"]
    groups = stored(rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.max("rank").alias("best")), "content-groups")
    best = attach(rows, groups, keys, "group_size", rows.count()).where("rank = best")
    kept = best.groupBy(*keys).agg(F.min(F.struct("no_id", "row")).alias("first")).select(F.col("first.row").alias(row))
    return keyed.join(kept, row, "left_semi").drop(row)


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY content ORDER BY size DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY content ORDER BY size DESC, doc_id) AS kept,
       sha256(content) AS text_sha256
FROM n
"""
