"""Source files: discovery with identity, feeds, web pages, product records; and skipping what was done."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.functions import identity, vocabulary
from catalith.sources.pages import page_structure

FRAGMENT = "source_id string, pos int, kind string, locator string, text string"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder with a known extension: path, source_id (from the content), content_type, source_kind, size; no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = identity.content_type(F.col("path"))
    return files.where(kind.isNotNull()).select("path", identity.source_id(F.col("content")).alias("source_id"), kind.alias("content_type"), identity.source_kind(F.col("path")).alias("source_kind"), F.col("length").alias("size"))


def pending(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources that the manifest (source_id, status) doesn't hold as completed."""
    return found.join(manifest.where(F.col("status") == "completed").select("source_id"), "source_id", "left_anti")


SEPARATORS = [",", ";", "\t", "|"]
#: Bytes of a feed's beginning that tell its separator.
SNIFFED = 8192


def separators(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and sep of feeds: of SEPARATORS, the one that the first line holds most often, the first of ties; a comma where it holds none."""
    heads = spark.read.format("binaryFile").load(paths).select("path", F.substring("content", 1, SNIFFED).cast("string").alias("head"))
    line = F.regexp_replace(F.substring_index("head", "\n", 1), "\"[^\"]*\"", "")
    counted = F.array(*[F.struct((-F.regexp_count(line, F.lit("[" + s + "]"))).alias("below"), F.lit(k).alias("place"), F.lit(s).alias("sep")) for k, s in enumerate(SEPARATORS)])
    return heads.select("path", F.array_min(counted)["sep"].alias("sep"))


SHEET = "path string, row int, cells array<string>"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[tuple[int, list[str]]]:
    """Rows of a workbook's first sheet that aren't blank, by their number, as texts; formulas give the value they were saved with."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(_NS + "t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_NS + "si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        out = []
        for row in ElementTree.fromstring(book.read(sheets[0])).iter(_NS + "row") if sheets else ():
            cells: dict[int, str] = {}
            for place, cell in enumerate(row.iter(_NS + "c")):
                letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                column = functools.reduce(lambda n, c: n * 26 + ord(c) - 64, letters, 0) - 1 if letters else place
                kind, value = cell.get("t"), cell.findtext(_NS + "v")
                if kind == "s" and value:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(_NS + "t"))
                if value and value.strip():
                    cells[column] = " ".join(value.split())
            if cells:
                out.append((int(row.get("r", len(out) + 1)), [cells.get(i, "") for i in range(max(cells) + 1)]))
        return out


def read_sheets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Key-value fragments of workbooks (.xlsx, .xlsm), as ``read_feed`` gives them: the first filled row names the columns. A file that is no workbook gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = sheet_rows(content.as_py())
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.string()))], ["path", "row", "cells"])

    rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, SHEET)
    header = rows.groupBy("path").agg(F.min_by("cells", "row").alias("header"), F.min("row").alias("first"))
    cells = rows.join(header, "path").where("row > first").select("path", F.col("row").cast("long").alias("row"), F.explode(F.arrays_zip("header", "cells")).alias("c"))
    return cells.select("path", "row", F.col("c.header").alias("key"), F.col("c.cells").alias("value")).where("value <> '' and key <> ''")


def mirrors(fragments: DataFrame) -> DataFrame:
    """The text of each source from its fragments in order: table rows as lines with bars, all else as paragraphs."""
    row = F.concat(F.lit("| "), F.replace("text", F.lit("\t"), F.lit(" | ")), F.lit(" |"))
    shown = F.when(F.col("kind").isin("table", "keyvalue"), row).when(F.col("kind") == "heading", F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", shown.alias("line"))))
    return fragments.groupBy("source_id").agg(F.array_join(F.transform(ordered, lambda f: f["line"]), "\n").alias("text"))


def read_mirrors(spark: SparkSession, folder: str) -> DataFrame:
    """source_id and text of stored mirrors, one text file each, named by its source."""
    whole = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return whole.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1).alias("source_id"), F.col("value").alias("text"))


def read_feed(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Key-value fragments of a delimited feed with a header: path, row (in the file, from 2), key, value; empty cells have none.

    Spark may split a large file: rows are counted within each block, and blocks before it are added.
    """
    lines = spark.read.option("header", "true").option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    names = lines.columns
    plain = {c: c.lstrip("\ufeff") for c in names}  # a byte order mark is no part of a name
    lines = lines.withColumns({"__path": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()})
    blocks = lines.groupBy("__path", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("__path", "__block", "__first", F.coalesce(earlier, F.lit(0)).alias("__before"))
    cells = F.array(*[F.struct(F.lit(plain[c]).alias("key"), F.trim(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\s+", " ")).alias("value")) for c in names])
    rows = lines.join(blocks, ["__path", "__block"])
    return rows.select(F.col("__path").alias("path"), (F.col("__at") - F.col("__first") + F.col("__before") + 2).alias("row"), F.explode(cells).alias("c")).select("path", "row", "c.*").where("value <> ''")


def html_fragments(source: str | None) -> list[tuple[str, str, str]]:
    """(kind, locator, text) of a page, a row of a table or a pair each: heading, tables, pairs, bullets, paragraphs of 40 characters or more."""
    out: list[tuple[str, str, str]] = []
    for f in page_structure(source, least_rows=1, least_pairs=1):
        if f.kind == "table":
            out += [(f.kind, f"{f.locator} tr:nth({k})", "\t".join(row)) for k, row in enumerate(f.cells, 1)]
        elif f.kind == "keyvalue":
            out += [(f.kind, f.locator, "\t".join(row)) for row in f.cells]
        else:
            out += [(f.kind, f.locator, line) for line in f.text.split("\n")]
    return out


def read_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Fragments of web pages in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *f) for i, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, f in enumerate(html_fragments(h.as_py()))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["source_id", "pos", "kind", "locator", "text"])

    return pages.select(F.col(id_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, FRAGMENT)


def headings(html_col: Column) -> Column:
    """First h1 of a page, without its markup."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html_col, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " "), r"\s+", " "))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Product records as JSON lines or files; broken ones are skipped."""
    rows = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


CELLED = ["source_id", "source_kind", "pos", "kind", "row_scoped", "cells", "text"]


def fragments(spark: SparkSession, found: DataFrame) -> DataFrame:
    """One table of the fragments of all sources that ``discover`` found and that can be read: CELLED.

    Feeds and workbooks give a key-value fragment a row; pages give headings, tables, pairs and texts, pairs
    that follow each other being one fragment. Other types give none.
    """
    path = F.regexp_replace("path", "^file:/+", "/")
    known = found.select(path.alias("path"), "source_id", "source_kind", "content_type")
    listed = [(r.path, r.content_type) for r in found.select("path", "content_type").toLocalIterator()]  # Spark lists the files of a read on the driver too
    pages = [p for p, kind in listed if kind == "html"]
    books = [p for p, kind in listed if kind == "tabular" and p.lower().endswith((".xlsx", ".xlsm"))]
    feeds = [p for p, kind in listed if kind == "tabular" and p not in set(books)]
    groups: dict[str, list[str]] = {}
    for r in separators(spark, feeds).collect() if feeds else []:
        groups.setdefault(r.sep, []).append(r.path)
    parts = [read_feed(spark, group, sep) for sep, group in groups.items()] + ([read_sheets(spark, books)] if books else [])
    out = []
    for cells in parts:
        rows = cells.withColumn("path", path).join(known, "path")
        pairs = F.collect_list(F.array("key", "value"))
        out.append(rows.groupBy("source_id", "source_kind", F.col("row").cast("int").alias("pos")).agg(pairs.alias("cells")).withColumns({"kind": F.lit("keyvalue"), "row_scoped": F.lit(True), "text": F.lit(None).cast("string")}).select(CELLED))
    if pages:
        whole = spark.read.format("binaryFile").load(pages).select(path.alias("path"), F.col("content").cast("string").alias("html")).join(known, "path")
        pieces = read_pages(whole, "source_id", "html")
        # rows of one table, and pairs that follow each other, are one fragment
        order = Window.partitionBy("source_id").orderBy("pos")
        group = F.concat("kind", F.regexp_extract("locator", r"^(table:nth\(\d+\))?", 1))
        kinded = pieces.withColumn("new", (group != F.lag(group).over(order)) | ~F.col("kind").isin("table", "keyvalue"))
        grouped = kinded.withColumn("block", F.sum(F.coalesce("new", F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        line = F.struct("pos", F.split("text", "\t").alias("cell"))
        table = grouped.groupBy("source_id", "block", "kind").agg(F.min("pos").alias("pos"), F.transform(F.array_sort(F.collect_list(line)), lambda x: x["cell"]).alias("rows"), F.min_by("text", "pos").alias("text"))
        celled = F.col("kind").isin("table", "keyvalue")
        kinds = known.select("source_id", "source_kind").distinct()
        out.append(table.join(kinds, "source_id").select("source_id", "source_kind", "pos", "kind", F.lit(False).alias("row_scoped"), F.when(celled, F.col("rows")).alias("cells"), F.when(~celled, F.col("text")).alias("text")).select(CELLED))
    if not out:
        return spark.createDataFrame([], "source_id string, source_kind string, pos int, kind string, row_scoped boolean, cells array<array<string>>, text string")
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def image_compliance(width: Column, height: Column, white: Column, size: Column) -> Column:
    """Everything in which an image falls short of what channels ask: an empty array is compliant."""
    notes = F.array(
        F.when((width < 800) | (height < 800), F.lit("below 800 x 800")),
        F.when(F.abs(width / height - 1) > 0.35, F.lit("aspect ratio")),
        F.when(~white, F.lit("background not white")),
        F.when(size > 8 * 1024 * 1024, F.lit("larger than 8 MiB")),
    )
    return F.array_compact(notes)


def known_kinds() -> list[str]:
    return sorted(vocabulary.SOURCE_PRECEDENCE)
