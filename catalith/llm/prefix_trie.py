"""Prefix trie of conversations by chained digests.

A turn is the SHA-256 of its role and text; texts go no further. The digest of a prefix chains those of its
turns, in blocks, so that a conversation of any length is chained by many tasks. Every prefix of every
conversation is a row; rows of equal depth and digest are a node. For sums over subtrees, what a
conversation's own nodes (those it is the least member of) hold goes to all their ancestors: within
its own nodes by runs of equal membership, above them by a row for each ancestor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import bounded_batches, looked_up, stored

GROUP = 5
BORROWED = 9
#: Turns, or blocks of them, that are chained together.
BLOCK = 64
#: Ids of one text when ends are hashed.
_CHUNK = 1 << 16


def _sha256(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def turn_digests(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, digest and bytes of the text for each row with an id; null roles and texts are empty."""
    role = F.encode(F.coalesce(conversations[role_col].cast("string"), F.lit("")), "UTF-8")
    text = F.encode(F.coalesce(conversations[text_col].cast("string"), F.lit("")), "UTF-8")
    own = _sha256(F.concat(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":")), "UTF-8"), role, text))
    rows = conversations.select(conversations[id_col].cast("long").alias("conv"), conversations[turn_col].cast("long").alias("turn"), own.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv is not null")


def positions(turns: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """conv, pos, digest, bytes; conv and its number of turns n; the number of all turns.

    Turns are sorted over all conversations by ranges; a place in a conversation is the distance from its
    first turn, so none is gathered in one task. Ties of turn go by digest.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    ranged = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    files = stored(ranged.drop("turn", "tie"), "turns")
    # a task writes one file, named by its number
    rows = files.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    # as many rows as files
    offsets = stored(rows.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("before")), "file-offsets")
    rows = rows.join(offsets, "file").select("conv", "digest", "bytes", (F.col("before") + F.col("at")).alias("at"))
    starts = stored(rows.groupBy("conv").agg(F.min("at").alias("start"), F.count("*").alias("n")), "conversations")
    total = starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = looked_up(rows, starts, ["conv"], "n", total)
    return stored(placed.select("conv", (F.col("at") - F.col("start")).alias("pos"), "digest", "bytes"), "placed"), starts.select("conv", "n"), total


def rebuilt(turns: DataFrame, group: int = GROUP, borrowed: int = BORROWED) -> tuple[DataFrame, DataFrame]:
    """conv, pos, digest, bytes, length of rebuilt conversations; and conv, length of all, turnless ones included.

    The first h turns of conversation c are those of conversation c - c % group, as many as there are, with
    h = crc32(c) % borrowed; c's own turns follow from its turn h on.
    """
    placed, sizes, total = positions(turns)
    base = F.col("conv") - F.col("conv") % group
    heads = placed.where((F.col("conv") == base) & (F.col("pos") < borrowed - 1)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    own_from = F.when(F.col("conv") == F.col("base"), 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % borrowed).cast("long")
    known = sizes.withColumn("base", base).join(heads, "base", "left").withColumn("own_from", own_from)
    known = known.withColumn("used", F.least("own_from", F.coalesce(F.size("head"), F.lit(0))).cast("long"))
    known = known.withColumn("length", F.col("used") + F.greatest(F.col("n") - F.col("own_from"), F.lit(0)))
    known = stored(known.select("conv", "n", "own_from", "used", "length", F.when(F.col("used") > 0, F.slice("head", 1, F.col("used").cast("int"))).alias("lent")), "rebuilt")
    own = looked_up(placed, known.select("conv", "n", "own_from", "used", "length"), ["conv"], "n", total).where("pos >= own_from")
    own = own.select("conv", (F.col("pos") - F.col("own_from") + F.col("used")).alias("pos"), "digest", "bytes", "length")
    lent = known.select("conv", "length", F.explode("lent").alias("x")).select("conv", "x.pos", "x.digest", "x.bytes", "length")
    return own.unionByName(lent), known.select("conv", "length")


def chained(rows: DataFrame, longest: int, block: int = BLOCK) -> DataFrame:
    """From conv, pos, element, bytes, length: also the digest of the prefix that ends there, that of the prefix before it (empty binary at pos 0), and the bytes of the prefix.

    Elements of a block are chained from its start; the digest of the whole is the hash of the digest of the
    blocks before and of that chain. Blocks are elements of a shorter sequence, which is chained alike.
    """
    empty = F.lit(b"")
    step = "struct<pos:bigint,element:binary,bytes:bigint,inner:binary,inner_before:binary,sum:bigint>"

    def add(acc: Column, x: Column) -> Column:
        inner = _sha256(F.concat(acc["inner"], x["element"]))
        total = acc["sum"] + x["bytes"]
        here = F.struct(x["pos"].alias("pos"), x["element"].alias("element"), x["bytes"].alias("bytes"), inner.alias("inner"), acc["inner"].alias("inner_before"), total.alias("sum"))
        return F.struct(inner.alias("inner"), total.alias("sum"), F.concat(acc["steps"], F.array(here)).alias("steps"))

    start = F.struct(empty.alias("inner"), F.lit(0).cast("long").alias("sum"), F.array().cast(f"array<{step}>").alias("steps"))
    blocks = rows.groupBy("conv", F.expr(f"pos div {block}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "element", "bytes"))).alias("items"), F.max("length").alias("length"))
    blocks = blocks.select("conv", "block", "length", F.aggregate("items", start, add).alias("chain"))
    if longest > block:
        blocks = stored(blocks, "blocks")
        whole = blocks.where(F.size("chain.steps") == block).select("conv", "length", F.col("block").alias("pos"), F.col("chain.inner").alias("element"), F.col("chain.sum").alias("bytes"))
        above = chained(whole, longest // block, block).select("conv", (F.col("pos") + 1).alias("block"), F.col("digest").alias("outer"), _sha256(F.concat("before", "element")).alias("last"), F.col("total").alias("outer_sum"))
        blocks = blocks.join(above, ["conv", "block"], "left")
    else:
        blocks = blocks.select("*", F.lit(None).cast("binary").alias("outer"), F.lit(None).cast("binary").alias("last"), F.lit(None).cast("long").alias("outer_sum"))
    outer = F.coalesce("outer", empty)
    x = blocks.select("conv", "length", outer.alias("outer"), F.coalesce("last", empty).alias("last"), F.coalesce("outer_sum", F.lit(0)).alias("outer_sum"), F.explode("chain.steps").alias("x"))
    before = F.when(F.octet_length("x.inner_before") == 0, F.col("last")).otherwise(_sha256(F.concat("outer", "x.inner_before")))
    return x.select("conv", "length", "x.pos", "x.element", "x.bytes", _sha256(F.concat("outer", "x.inner")).alias("digest"), before.alias("before"), (F.col("outer_sum") + F.col("x.sum")).alias("total"))


def prefixes(turns: DataFrame, group: int = GROUP, borrowed: int = BORROWED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """A row per rebuilt conversation and prefix: conv, depth, digest, before, bytes of the last text, total bytes, ends; and conv, length."""
    rows, known = rebuilt(turns, group, borrowed)
    longest = known.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    chain = chained(rows.withColumnRenamed("digest", "element"), longest, block)
    out = chain.select("conv", (F.col("pos") + 1).alias("depth"), "digest", "before", "bytes", "total", (F.col("pos") + 1 == F.col("length")).alias("ends"))
    none = F.lit(0).cast("long")
    roots = known.select("conv", none.alias("depth"), F.lit(b"").alias("digest"), F.lit(None).cast("binary").alias("before"), none.alias("bytes"), none.alias("total"), (F.col("length") == 0).alias("ends"))
    return stored(out.unionByName(roots), "prefixes"), known


def ends_hashed(ends: DataFrame) -> DataFrame:
    """From digest and conv: the SHA-256 of each digest's ids, in ascending order, joined by commas.

    Ids are sorted by ranges and joined to texts of up to 65536 first; a digest's texts then stream through one hash.
    """
    bounded_batches(ends.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, firsts, texts = [], [], []
        now, held = None, []

        def close() -> None:
            if held:
                digests.append(now)
                firsts.append(held[0])
                texts.append(",".join(map(str, held)))
                held.clear()

        for batch in batches:
            for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest != now or len(held) >= _CHUNK:
                    close()
                    now = digest
                held.append(conv)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], ["digest", "first", "ids"])
            digests, firsts, texts = [], [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], ["digest", "first", "ids"])

    def digest_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = digest, hashlib.sha256()
                state.update(text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["digest", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["digest", "ends_sha256"])

    texts = ends.select("digest", "conv").repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv").mapInArrow(join, "digest binary, first long, ids string")
    return texts.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(digest_texts, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = GROUP, borrowed: int = BORROWED, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows with a null id are no turns. A null turn comes first; equal turns of a conversation follow in the order of
    their digests, repeated rows are turns each. Null roles and texts are empty, as are empty ones. An empty
    table has no conversation and no node. Other columns are not read.
    """
    rows, known = prefixes(turn_digests(conversations, id_col, turn_col, role_col, text_col), group, borrowed, block)
    grouped = rows.groupBy("depth", "digest").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("before").alias("before"), F.max("bytes").alias("bytes"), F.max("total").alias("total"))
    grouped = stored(grouped, "nodes")
    children = grouped.where("before is not null").groupBy(F.col("before").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = stored(grouped.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes-children")
    n_rows, n_nodes = (x or 0 for x in nodes.agg(F.sum("n"), F.count("*")).first())

    # what the own nodes of each conversation hold, and how many prefixes it has above them
    none = F.lit(0).cast("long")
    own = nodes.groupBy("conv").agg(F.sum((F.col("n") - 1) * F.col("bytes")).alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaves"), F.count("*").alias("owned"))
    own = known.join(own, "conv", "left").select("conv", F.coalesce("saved", none).alias("saved"), F.coalesce("leaves", none).alias("leaves"), (F.col("length") + 1 - F.coalesce("owned", none)).alias("above"))
    own = stored(own, "own-sums")
    owners = nodes.select("digest", F.col("conv").alias("owner"), "n")
    above = looked_up(rows.select("conv", "digest"), owners, ["digest"], "n", n_rows).where("conv <> owner").select("conv", "digest")
    above = looked_up(above, own, ["conv"], "above", n_rows).where("saved > 0 or leaves > 0")
    lower = above.groupBy("digest").agg(F.sum("saved").alias("lower_saved"), F.sum("leaves").alias("lower_leaves"))

    # a conversation's own nodes with equal n follow each other and have the same members
    runs = nodes.groupBy("conv", "n").agg(F.max("total").alias("end"), F.min(F.col("total") - F.col("bytes")).alias("begin"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.count("*").alias("nodes"))
    # of each conversation at most as many as the square root of twice all prefixes
    of_conv = Window.partitionBy("conv")
    deeper = F.sum((F.col("n") - 1) * (F.col("end") - F.col("begin"))).over(of_conv.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    runs = stored(runs.select("conv", "n", "end", "nodes", F.coalesce(deeper, none).alias("deeper"), F.max("leaf").over(of_conv).alias("own_leaf")), "runs")
    parents = nodes.where("n_children > 0").select(F.col("digest").alias("before"), F.col("conv").alias("parent_conv"), F.col("n_children").alias("siblings"))
    out = looked_up(nodes, runs, ["conv", "n"], "nodes", n_nodes)
    # the root's prefix before it is null and meets no parent
    out = looked_up(out, parents, ["before"], "siblings", n_nodes)
    own_saved = (F.col("n") - 1) * (F.col("end") - F.col("total") + F.col("bytes")) + F.col("deeper")
    hashes = ends_hashed(rows.where("ends"))
    out = out.join(lower, "digest", "left").join(hashes, "digest", "left")
    return out.select(
        F.col("conv").alias(id_col),
        "depth",
        F.col("parent_conv").alias(f"parent_{id_col}"),
        F.col("n").alias("n_convs"),
        "n_children",
        (F.col("own_leaf") + F.coalesce("lower_leaves", none)).alias("n_leaves"),
        (own_saved + F.coalesce("lower_saved", none)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
