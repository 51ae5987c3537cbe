"""Catalog tables as views, and read-only SQL over them."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST = re.compile(r"^[\s(]*(select|with|show|describe|explain|values)\b", re.I)
_WRITES = re.compile(r"\b(insert|update|delete|merge|drop|create|alter|truncate|load|copy|cache|uncache|refresh|msck|grant|revoke|set|reset|use|add|analyze|call|reflect|java_method|try_reflect)\b", re.I)
#: Literals (raw ones first), quoted names and comments, in one scan, so that none can hide in another.
_HIDDEN = re.compile(r"""(?P<literal>\b[rR]'[^']*'|\b[rR]"[^"]*"|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>`(?:[^`]|``)*`)|--[^\n]*|/\*.*?\*/""", re.S)
_SUMMARY = re.compile(r"^\s*summarize\s+(\w+)\s*$", re.I)
_TABLE_INFO = re.compile(r"^\s*pragma\s+table_info\s*\(\s*'?(\w+)'?\s*\)\s*$", re.I)
_EXPLAIN = re.compile(r"^\s*explain\s+(?:(?:extended|codegen|cost|formatted)\s+)?(?=select|with|values|\()(.*)$", re.I | re.S)
#: Statements that list names, and the table they ask about.
_LISTS = re.compile(r"^\s*(?:show\s+(?:tables|views|columns\s+(?:in|from)\s+(\w+))|describe\s+(?:table\s+)?(\w+))\s*$", re.I)
#: Steps that a parsed statement may have.
_STEPS = set(
    "Aggregate AsOfJoin Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit Offset OneRowRelation Pivot Project Range Sample Sort SubqueryAlias"
    " Transpose Union UnionLoop Unpivot UnresolvedHint UnresolvedWith WithWindowDefinition".split()
)
_UNRESOLVED = {"UnresolvedRelation", "UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases"}
#: What a resolved plan may end in besides views.
_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef", "ResolvedInlineTable"}
#: Groups of built-in functions that only compute.
_GROUPS = {f"{g}_funcs" for g in "agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate string struct url variant window".split()}
_HARMLESS = {"range", "page_fragments", "typeof", "hll_sketch_estimate", "hll_union", "kll_sketch_get_quantile_double", "kll_sketch_merge_double", "kll_sketch_get_n_double", "uuid"}
#: Functions of this library that SQL may call: name -> parameters, type and body.
FUNCTIONS = {
    "squeezed": ("x STRING", "STRING", "regexp_replace(lower(x), '[^a-z0-9]', '')"),
    "collapsed": ("x STRING", "STRING", r"trim(regexp_replace(x, r'\s+', ' '))"),
    "label": ("x STRING", "STRING", r"trim(regexp_replace(regexp_replace(lower(x), r'\([^)]*\)', ' '), '[^a-z0-9]+', ' '))"),
    "numbers_agree": ("a DOUBLE, b DOUBLE", "BOOLEAN", "abs(a - b) <= 0.02D * greatest(abs(a), abs(b))"),
}


def register(tables: dict[str, DataFrame]) -> None:
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)


def register_functions(spark: SparkSession) -> None:
    """Make FUNCTIONS callable from SQL."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


def check_read_only(statement: str) -> str:
    """The statement, or ValueError unless it is a single read; literals and comments don't count."""
    bare = _HIDDEN.sub(lambda m: "''" if m["literal"] else m[0] if m["name"] else " ", statement)
    named = re.sub(r"`(?:[^`]|``)*`", "``", bare)
    if not bare.strip():
        raise ValueError("empty statement")
    if ";" in named.strip().rstrip(";"):
        raise ValueError("one statement at a time")
    # a quoted name may be that of a function
    if not _FIRST.match(bare) or _WRITES.search(bare) or re.search(r"\basof\s+join\b", named, re.I):
        raise ValueError("only reading statements are allowed")
    if re.search(r"\b`?(?:parquet|csv|json|orc|text|binaryfile|avro|xml)`?\s*\.\s*`", bare, re.I):
        raise ValueError("only registered tables can be read")
    return statement.strip().rstrip(";")


@functools.cache
def allowed_functions() -> frozenset[str]:
    """Built-in functions of the groups that only compute, and FUNCTIONS."""
    analysis = SparkContext._jvm.org.apache.spark.sql.catalyst.analysis
    found = set(FUNCTIONS) | _HARMLESS
    for kind in ("FunctionRegistry$", "TableFunctionRegistry$"):
        builtin = getattr(getattr(analysis, kind), "MODULE$").builtin()
        for name in _items(builtin.listFunction()):
            if builtin.lookupFunction(name).get().getGroup() in _GROUPS:
                found.add(name.funcName().lower())
    return frozenset(found)


def _items(sequence: JavaObject) -> Iterator[JavaObject]:
    it = sequence.iterator()
    while it.hasNext():
        yield it.next()


def _is_plan(node: JavaObject) -> bool:
    return is_instance_of(SparkContext._gateway, node, "org.apache.spark.sql.catalyst.plans.QueryPlan")


def _nodes(plan: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """All nodes of a plan and its expressions, subqueries included, with the names of their classes."""
    pending = [plan]
    while pending:
        node = pending.pop()
        kind = node.getClass()
        yield kind.getSimpleName(), node
        pending += [*_items(node.children()), *_items(node.innerChildren())]
        if _is_plan(node):
            pending += _items(node.expressions())


def check_plan(spark: SparkSession, statement: str) -> None:
    """ValueError unless the parsed statement consists of reading steps over registered tables, by their plain names, and of allowed functions."""
    names = allowed_functions()
    for kind, node in _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)):
        if kind.endswith("UnresolvedIdentifier"):
            raise ValueError("names can't be computed")
        if kind == "UnresolvedRelation" and node.multipartIdentifier().size() != 1:
            raise ValueError("only registered tables can be read")
        if _is_plan(node) and kind not in _STEPS | _UNRESOLVED:
            raise ValueError("only reading statements are allowed")
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            parts = [node.name().funcName()] if kind == "UnresolvedGenerator" else list(_items(node.nameParts() if kind == "UnresolvedFunction" else node.name()))
            if len(parts) != 1 or parts[0].lower() not in names:
                raise ValueError(f"function {'.'.join(parts)} isn't allowed")


def check_analysed(rows: DataFrame, registered: set[str]) -> DataFrame:
    """The rows, or ValueError if the resolved plan reads anything outside the registered views."""
    pending = [rows._jdf.queryExecution().analyzed()]
    while pending:
        node = pending.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View":
            if node.desc().identifier().table().lower() not in registered:
                raise ValueError("only registered tables can be read")
            continue
        below = [*_items(node.children()), *_items(node.innerChildren()), *_items(node.subqueries())]
        if not below and kind not in _LEAVES:
            raise ValueError("only registered tables can be read")
        pending += below
    return rows


def _registered(spark: SparkSession) -> set[str]:
    return {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}


def read_sql(spark: SparkSession, statement: str, args: list | None = None) -> DataFrame:
    """Rows of a reading statement; SUMMARIZE table and PRAGMA table_info(table) work too."""
    if m := _SUMMARY.match(statement):
        if m[1].lower() not in _registered(spark):
            raise ValueError("only registered tables can be read")
        return spark.table(m[1]).summary()
    if m := _TABLE_INFO.match(statement):
        if m[1].lower() not in _registered(spark):
            raise ValueError("only registered tables can be read")
        described = spark.sql(f"DESCRIBE TABLE {m[1]}").select(F.col("col_name").alias("name"), F.col("data_type").alias("type"))
        return described
    allowed, registered = check_read_only(statement), _registered(spark)
    if m := _EXPLAIN.match(allowed):
        check_plan(spark, m[1])
        check_analysed(spark.sql(m[1], args=args or []), registered)
        return spark.sql(allowed, args=args or [])
    if m := _LISTS.match(allowed):
        if (name := m[1] or m[2]) and name.lower() not in registered:
            raise ValueError("only registered tables can be read")
        return spark.sql(allowed)
    check_plan(spark, allowed)
    return check_analysed(spark.sql(allowed, args=args or []), registered)
