"""Structure of web pages in one pass: headings, tables with captions, definition lists, bullet lists, paragraphs, JSON-LD.

A page is read from left to right with a stack of the open elements that matter; text belongs to the innermost of
them. Every search goes forward only, so the time is linear in the page, whatever is left unclosed.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_FRAGMENT = "kind string, locator string, text string, caption string, cells array<array<string>>"
#: Elements that are left out with all they hold.
LEFT_OUT = frozenset("script style nav footer header noscript svg form".split())
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "noscript", "title")}
_INLINE = frozenset("a abbr b bdi bdo cite code data em font i kbd label mark q s samp small span strong sub sup time u var wbr".split())
_LISTS = frozenset(["ul", "ol"])
_HOLDERS = _LISTS | {"table", "dl"}
#: Elements that text belongs to, and the element that they can't be closed beyond.
_BOUND = {"li": _LISTS, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "caption": {"table"}, "p": _HOLDERS, "h1": _HOLDERS}
#: What an opening element closes.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "caption", "p"}, "th": {"td", "th", "caption", "p"}, "tr": {"td", "th", "tr", "caption", "p"}, "p": {"p"}}
_OPEN = re.compile(r"</?([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_LD = re.compile(r"type\s*=\s*[\"']?application/ld\+json", re.I)
_LARGE = re.compile(r"&#(?:[xX][0-9a-fA-F]{8,}|[0-9]{9,});?")
LONG_TEXT = 40
_LABEL_MARKS = frozenset(" /&().-_")


@dataclass
class _Element:
    name: str
    pieces: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    caption: str = ""
    term: str | None = None
    number: int = 0


@dataclass
class Fragment:
    kind: str
    locator: str
    text: str
    caption: str | None = None
    cells: list[list[str]] | None = None


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(what, name, text) for text, open, close and raw (content of a script and such)."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _OPEN.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        end = _tag_end(page, m.end())
        if end < 0:
            return
        name, attributes, at = m[1].lower(), page[m.end() : end], end + 1
        if page[lt + 1] == "/":
            yield "close", name, ""
            continue
        yield "open", name, attributes
        if name in _RAW and not attributes.endswith("/"):
            close = _RAW[name].search(page, at)
            end = close.start() if close else n
            yield "raw", name, page[at:end]
            at = end


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag, -1 if there is none; a quote that is never closed is a character."""
    while True:
        at = _PLAIN.match(page, at).end()
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at
        close = page.find(page[at], at + 1)
        at = at + 1 if close < 0 else close + 1


def _plain(pieces: list[str]) -> str:
    return " ".join(html.unescape(_LARGE.sub("�", "".join(pieces))).split())


def label_and_value(text: str, longest: int, spaced: bool) -> list[str] | None:
    """A short label, a colon or dash, and a value; a blank must follow the mark if ``spaced``."""
    for i, c in enumerate(text[: longest + 2]):
        if c in ":–—-" and (text[i + 1 : i + 2].isspace() or not spaced and c != "-"):
            label, value = text[:i].strip(), text[i + 1 :].strip()
            sound = 3 <= len(label) <= longest and label[0].isalpha() and all(x.isalnum() or x in _LABEL_MARKS for x in label)
            return [label, value] if sound and 0 < len(value) <= 160 else None
    return None


def flattened(value: Any) -> list[list[str]]:
    """Paths and values of a JSON record in order; an object with name and value is that pair; keys that begin with @ and nulls go."""
    out: list[list[str]] = []
    pending: list[tuple[str, Any]] = [("", value)]
    while pending:
        path, x = pending.pop()
        if isinstance(x, dict):
            if path and "name" in x and "value" in x:
                out.append([str(x["name"]), str(x["value"])])
            else:
                pending += [(f"{path}.{k}" if path else k, v) for k, v in reversed(x.items()) if not k.startswith("@")]
        elif isinstance(x, list):
            pending += [(path, v) for v in reversed(x)]
        elif x is not None:
            out.append([path, str(x)])
    return out


def _records(script: str) -> list[dict]:
    """Product records of a JSON-LD script; what can't be read gives none."""
    try:
        found = json.loads(script)
    except (ValueError, RecursionError):
        return []
    return [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict) and "Product" in str(x.get("@type", ""))]


def page_structure(page: str | None, least_rows: int = 2, least_pairs: int = 2) -> list[Fragment]:
    """Fragments of a page: heading (the first h1, else the title), JSON-LD records, tables, definition lists, lists, paragraphs.

    A table needs ``least_rows`` rows with text, and has its caption or its number. A list with ``least_pairs``
    bullets of label and value is key-value, else text. Short paragraphs of label and value are pooled at the
    end, others under 40 characters go. A nested table or list is a fragment of its own, and its text belongs to it alone.
    """
    stack: list[_Element] = []
    numbers: dict[str, int] = {}
    heading = title = None
    records: list[list[list[str]]] = []
    found: dict[str, list[tuple[int, Fragment]]] = {k: [] for k in ("table", "dl", "list", "p")}
    short: list[list[str]] = []
    left_out, depth, script = "", 0, False

    def done(e: _Element) -> None:
        nonlocal heading
        text = _plain(e.pieces)
        owner = next((x for x in reversed(stack) if x.name in _HOLDERS), None) if e.name in _BOUND and e.name not in ("p", "h1") else None
        if e.name == "h1":
            heading = heading or text or None
        elif e.name == "p" and text:
            numbers["p"] = numbers.get("p", 0) + 1
            if len(text) >= LONG_TEXT:
                found["p"].append((numbers["p"], Fragment("text", f"p:nth({numbers['p']})", text)))
            elif pair := label_and_value(text, 40, False):
                short.append(pair)
        elif e.name in ("td", "th") and owner and owner.name == "table":
            if not owner.rows:
                owner.rows.append([])
            owner.rows[-1].append(text)
        elif e.name == "caption" and owner:
            owner.caption = owner.caption or text
        elif e.name == "dt" and owner:
            owner.term = text
        elif e.name == "dd" and owner:
            if owner.term and text:
                owner.rows.append([owner.term, text])
            owner.term = None
        elif e.name == "li" and owner and text:
            owner.rows.append([text])
        elif e.name == "table":
            rows = [r for r in e.rows if any(r)]
            if len(rows) >= least_rows:
                found["table"].append((e.number, Fragment("table", f"table:nth({e.number})", "\n".join("\t".join(r) for r in rows), e.caption or f"Table {e.number}", rows)))
        elif e.name == "dl" and e.rows:
            found["dl"].append((e.number, Fragment("keyvalue", f"dl:nth({e.number})", "\n".join(map(": ".join, e.rows)), None, e.rows)))
        elif e.name in _LISTS and e.rows:
            pairs = [p for (text,) in e.rows if (p := label_and_value(text, 46, True))]
            kind, rows = ("keyvalue", pairs) if len(pairs) >= least_pairs else ("text", None)
            found["list"].append((e.number, Fragment(kind, f"ul:nth({e.number})", "\n".join(": ".join(r) for r in (rows or e.rows)), None, rows)))

    def close(names: set[str], bounds: frozenset[str] | set[str]) -> None:
        """Close the innermost open element of these names, and all inside it, unless a bound stands before it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                while len(stack) > k:
                    done(stack.pop())
                return
            if stack[k].name in bounds:
                return

    for what, name, text in _tokens(page or ""):
        if left_out:
            if script and what == "raw":
                records += [r for x in _records(text) if (r := flattened(x))]
            depth += (what == "open" and name == left_out) - (what == "close" and name == left_out)
            if depth == 0:
                left_out, script = "", False
        elif what == "text":
            if stack:
                stack[-1].pieces.append(text)
        elif what == "raw":
            if name == "title":
                title = title or _plain([text]) or None
        elif what == "open":
            if name in LEFT_OUT:
                left_out, depth, script = name, 1, name == "script" and bool(_LD.search(text))
                continue
            if name not in _INLINE:
                close({"p"}, _HOLDERS) if name not in ("br", "img", "input") and stack and stack[-1].name == "p" else None
                if stack:
                    stack[-1].pieces.append(" ")
            if name in _CLOSES:
                for _ in range(2):  # a cell, then its row
                    if stack and stack[-1].name in _CLOSES[name]:
                        done(stack.pop())
            if name in _HOLDERS:
                key = "list" if name in _LISTS else name
                numbers[key] = numbers.get(key, 0) + 1
                stack.append(_Element(name, number=numbers[key]))
            elif name == "tr":
                if owner := next((x for x in reversed(stack) if x.name in _HOLDERS), None):
                    owner.rows.append([]) if owner.name == "table" else None
            elif name in _BOUND and not (name in ("p", "h1") and stack and stack[-1].name not in _HOLDERS):
                stack.append(_Element(name))
        elif what == "close":
            if name in _HOLDERS:
                close({name}, set())
            elif name in _BOUND and name != "tr":
                close({name}, _BOUND[name])
            if stack and name not in _INLINE:
                stack[-1].pieces.append(" ")
    while stack:
        done(stack.pop())
    head = [Fragment("heading", "h1" if heading else "title", heading or title)] if heading or title else []
    linked = [Fragment("keyvalue", "script[type=application/ld+json]", "\n".join(map(": ".join, r)), None, r) for r in records]
    pooled = [Fragment("keyvalue", "p (pairs)", "\n".join(map(": ".join, short)), None, short)] if short else []
    # inner ones are closed first
    placed = [f for kind in ("table", "dl", "list", "p") for _, f in sorted(found[kind], key=lambda x: x[0])]
    return [*head, *linked, *placed, *pooled]


def page_fragments(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """source_id, pos and PAGE_FRAGMENT of each page's fragments, in order; a null or empty page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, f.kind, f.locator, f.text, f.caption, f.cells) for i, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, f in enumerate(page_structure(h.as_py()))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["source_id", "pos", "kind", "locator", "text", "caption", "cells"])

    return pages.select(F.col(id_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "source_id string, pos int, " + PAGE_FRAGMENT)


class _PageFragments:
    def eval(self, page: str) -> Iterator[tuple]:
        for f in page_structure(page):
            yield f.kind, f.locator, f.text, f.caption, f.cells


def register_parsers(spark: SparkSession) -> None:
    """Make page_fragments callable from SQL: SELECT f.* FROM pages, LATERAL page_fragments(html) f."""
    spark.udtf.register("page_fragments", F.udtf(_PageFragments, returnType=PAGE_FRAGMENT))
