"""Main text of web pages by differencing against the page with the nearest URL.

Every page becomes a list of text blocks. The different pages of a host are sorted by URL path; the lines of
a page are aligned with those of the nearest page in that order by longest common subsequence, and shared
lines are template, so they go. A page that shares most of the longer of the two is a copy and says
nothing about the template; then the nearest page beyond is asked. What markup itself declares to be no
article (menus, footers, adverts, forms, comments and so on) never becomes a block. An article element is a
prior only: a line inside it goes if the two nearest pages have it, one outside it if the nearest has it.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Hashable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import attach, bounded_batches, stored

#: Elements whose content is never main text.
DROPPED = frozenset("script style nav footer aside form noscript svg template iframe textarea canvas head title menu datalist audio video".split())
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe"])
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements often left open; they don't nest.
LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
ARTICLE = frozenset(["article", "main"])
#: In an article, ambiguous words are left to the differencing: only these whole class tokens, and these whole ids, are no content.
IN_ARTICLE = frozenset("ad ads advert advertisement sponsored comments comment-list comments-area comment-respond disqus newsletter newsletter-signup sidebar breadcrumb breadcrumbs pagination navbar navigation share-buttons sharing-buttons social-share social-links related-posts related-articles recommended-posts cookie-consent cookie-banner subscribe-box".split())
IN_ARTICLE_IDS = frozenset(["disqus_thread"])
#: Outside one, these whole class tokens and whole ids too; a word inside a longer name says nothing.
OUTSIDE = IN_ARTICLE | IN_ARTICLE_IDS | frozenset("advertising banner cookie cookies consent notice popup modal side menu nav masthead footer header site-footer site-header replies share sharing social related recommended subscribe pager skip skip-link promo promotion sponsor".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}")
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Two pages that share more than this part of the longer one are copies.
COPY_SHARE = 0.6
#: Line pairs of which an alignment holds all rows at once; it bounds memory only, every alignment is exact.
PIECE_PAIRS = 1 << 20


def _is_dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if tag in ("html", "body") or tag in ARTICLE or not attributes:
        return False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").strip()
        if name in ("class", "id"):
            known = OUTSIDE if not in_article else IN_ARTICLE if name == "class" else IN_ARTICLE_IDS
            if not known.isdisjoint(value.lower().split() if name == "class" else [value.lower()]):
                return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "hidden" or value.lower() == "true":
            return True
    return False


def _decoded(piece: str) -> str:
    """Text with its character references decoded; numbers beyond Unicode become the replacement character."""
    return html.unescape(_HUGE.sub("&#9999999", _ZEROS.sub("&#", piece))) if "&" in piece else piece


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """("", "", text), ("<", tag, attributes) and ("</", tag, "") in order, in one pass over any source.

    A quote that nothing closes is an ordinary character. If a tag's end is hidden in quotes up to the
    end of the source, quotes no longer count from there on. A bracket that opens no tag is text.
    """
    n, at, text_from = len(source), 0, 0
    final = {q: source.rfind(q) for q in "\"'>"}
    quotes = True
    while (open_ := source.find("<", at)) >= 0:
        if source.startswith("<!--", open_):
            end = source.find("-->", open_ + 4)
            end = n if end < 0 else end + 3
            found = None
        elif open_ > final[">"]:
            break
        elif source.startswith(("<!", "<?"), open_):
            end, found = source.find(">", open_) + 1, None
        elif (m := _TAG.match(source, open_)) is None:
            at = open_ + 1
            continue
        else:
            found, end = m, m.end()
            while quotes and end < n:
                end = _PLAIN.match(source, end).end()
                if end == n or source[end] == ">":
                    break
                end = (end if end == final[source[end]] else source.find(source[end], end + 1)) + 1
            if not quotes or end >= n:
                quotes, end = False, source.find(">", m.end())
            if end < 0:  # its end is behind the last bracket
                break
            end += 1
        if open_ > text_from:
            yield "", "", source[text_from:open_]
        if found:
            yield "</" if found[1] else "<", found[2].lower(), "" if found[1] else source[found.end() : end - 1]
            if found[2].lower() in RAW and not found[1]:
                close = re.compile(rf"</{re.escape(found[2])}\s*>", re.I).search(source, end)
                end = close.end() if close else n
        at = text_from = end
    if text_from < n:
        yield "", "", source[text_from:]


def page_blocks(source: str | None) -> list[tuple[str, bool]]:
    """Text blocks of a page in order, and whether each is inside an article element; none for null or empty html.

    Linear in the page, however its tags are nested: the open elements of each name, and those that hold
    back loose ends, are kept by their place on the stack.
    """
    if not source:
        return []
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool]] = []
    places: dict[str, list[int]] = {}
    marks, firm = [], []  # places of article elements, and of those that are neither loose nor inline
    dropped = 0

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                out.append((block, bool(marks)))

    def close(at: int) -> None:
        nonlocal dropped
        while len(stack) > at:
            tag, drop = stack.pop()
            dropped -= drop
            places[tag].pop()
            for held in (marks, firm):
                if held and held[-1] == len(stack):
                    held.pop()

    for kind, tag, value in tokens(source):
        if not kind:
            if not dropped:
                text.append(_decoded(value))
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        last = places[tag][-1] if places.get(tag) else -1
        if kind == "</":
            if last >= 0 and not (marks and marks[-1] > last and (tag in INLINE or tag in LOOSE)):
                close(last)
            continue
        if tag in VOID or tag in RAW or value.endswith("/"):
            continue
        drop = _is_dropped(tag, value, bool(marks))
        if tag in LOOSE and last > (firm[-1] if firm else -1):  # an open one of its kind ends here
            close(last)
        if drop or tag not in INLINE:
            places.setdefault(tag, []).append(len(stack))
            if tag in ARTICLE:
                marks.append(len(stack))
            if tag not in LOOSE and tag not in INLINE:
                firm.append(len(stack))
            stack.append((tag, drop))
            dropped += drop
    flush()
    return out


def _rows(x: Sequence[Hashable], y: Sequence[Hashable]) -> Iterator[int]:
    """After each line of x, the bits of y: where one is clear, a longest common subsequence with that much of y grows."""
    where: dict[Hashable, int] = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for line in x:
        hit = row & where.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(x: Sequence[Hashable], y: Sequence[Hashable]) -> np.ndarray:
    """Length of a longest common subsequence of x and each beginning of y."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):  # noqa: B007  the last one counts
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), count=len(y), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits == 0)])


def aligned(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[bool]:
    """For each line of a, whether a longest common subsequence with b holds it.

    Bit-parallel over b. Until a piece's rows take 128 kB, a is halved and b split where both halves have
    the most in common (Hirschberg), so memory is linear in the lines at any size.
    """
    held = [False] * len(a)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            held[a0] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            held[a1 - 1] = True
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            continue
        x, y = a[a0:a1], b[b0:b1]
        if len(x) > 1 and len(x) * len(y) > PIECE_PAIRS:
            half = len(x) // 2
            split = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
            todo += [(a0, a0 + half, b0, b0 + split), (a0 + half, a1, b0 + split, b1)]
            continue
        rows = list(_rows(x, y))
        i, j = len(x) - 1, len(y) - 1
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:
                j -= 1
            elif i and not rows[i - 1] >> j & 1:
                i -= 1
            else:
                held[a0 + i] = True
                i, j = i - 1, j - 1
    return held


@dataclass
class Page:
    """One of the different pages of a host: hashes and sizes of its lines, and whether it is a copy of the page before it."""

    host: str
    path: str
    lines: list[int]
    sizes: np.ndarray
    chained: bool = False

    def shared(self, other: Page) -> np.ndarray:
        """For each line, whether the other page has it in order."""
        if set(self.lines).isdisjoint(other.lines):
            return np.zeros(len(self.lines), bool)
        return np.array(aligned(self.lines, other.lines), bool)

    def copies(self, other: Page, shared: np.ndarray) -> bool:
        return bool(self.sizes[shared].sum() > COPY_SHARE * max(self.sizes.sum(), other.sizes.sum()))

    def follows(self, before: Page) -> bool:
        return self.host == before.host and self.copies(before, self.shared(before))


def runs(pages: list[Page]) -> list[int]:
    """Where each run of pages that are copies of the page before begins."""
    return [i for i, page in enumerate(pages) if not page.chained]


def edge_pages(pages: list[Page]) -> set[int]:
    """The pages of a partition that pages of others may need: both ends of its first and last three runs, its first and last three pages."""
    begins = runs(pages)
    begins = sorted({0, *begins})
    ends = [b - 1 for b in begins[1:]] + [len(pages) - 1]
    n = len(pages)
    return {*begins[:3], *ends[:3], *begins[-3:], *ends[-3:], *range(min(3, n)), *range(max(n - 3, 0), n)}


def template_lines(pages: list[Page], inside: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each asked page, by its place, the lines that are template; ``inside`` tells which of its lines an article element holds.

    Nearest are the pages next to the page's run of copies, of them the one with more of the path in
    common, then those next to their runs. A page that is a copy itself is passed over. A line is template if
    the nearest page has it; inside an article element, if the two nearest have it. Where all pages of
    the host are copies of each other, a line outside goes if the two pages next to it have it.
    """
    begins = runs(pages)
    run = np.searchsorted(begins, np.arange(len(pages)), "right") - 1
    ends = [b - 1 for b in begins[1:]] + [len(pages) - 1]
    for i, marked in inside.items():
        page, r = pages[i], int(run[i])
        found: list[np.ndarray] = []
        for step in (1, 2):
            near = [ends[r - step]] if r >= step else []
            near += [begins[r + step]] if r + step < len(begins) else []
            near = [j for j in near if pages[j].host == page.host]
            for j in sorted(near, key=lambda j: -len(os.path.commonprefix([page.path, pages[j].path]))):
                shared = page.shared(pages[j])
                if len(found) < 2 and not page.copies(pages[j], shared):
                    found.append(shared)
        if found:
            yield i, np.where(marked, found[0] & found[1] if len(found) > 1 else False, found[0])
            continue
        near = [j for j in (i - 1, i + 1, i - 2, i + 2) if 0 <= j < len(pages) and pages[j].host == page.host][:2]
        both = page.shared(pages[near[0]]) & page.shared(pages[near[1]]) if len(near) == 2 else np.zeros(len(marked), bool)
        yield i, both & ~marked


def url_key(url: Column) -> tuple[Column, Column]:
    """Host without www., and path without a last slash or .html; empty for a null or broken URL."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(?:www\.)?([^/?#:]*)(?::\d+)?([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    path = F.regexp_replace(F.regexp_extract(url, parts, 2), r"(?:/|\.html?)+$", "")
    return F.lower(F.regexp_extract(url, parts, 1)), path


_BLOCKS = "id long, url string, host string, path string, lines array<string>, inside array<boolean>, marks array<long>, sizes array<int>, d1 long, d2 long"
_ORDERED = "part int, pos int, host string, path string, marks array<long>, sizes array<int>, inside array<boolean>, d1 long, d2 long, n long, chained boolean, edge boolean, tail boolean"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kinds |= {f"array<{name}>": pa.list_(kind) for name, kind in kinds.items()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f[1]]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], [f[0] for f in fields])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pages, with a hash of each and a digest of host and blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            out = []
            for values in zip(*batch.slice(at, 500).columns, strict=True):
                ids, url, host, path, source = (v.as_py() for v in values)
                blocks = page_blocks(source)
                lines, inside = [t for t, _ in blocks], [i for _, i in blocks]
                coded = [t.encode("utf-8", "surrogatepass") for t in lines]
                marks = np.array([xxhash.xxh64_intdigest(t) for t in coded], np.uint64).view(np.int64)
                whole = xxhash.xxh3_128()
                for t in (host.encode(), bytes(inside), marks.tobytes()):
                    whole.update(len(t).to_bytes(8, "little") + t)
                d1, d2 = np.frombuffer(whole.digest(), "<i8").tolist()
                out.append((ids, url, host, path, lines, inside, marks, [len(t) for t in lines], d1, d2))
            yield _batch(out, _BLOCKS)


def _page(row: dict) -> Page:
    return Page(row["host"], row["path"], row["marks"], np.array(row["sizes"], np.int64), bool(row.get("chained")))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition with the place of each page, whether it is a copy of the one before, and whether other partitions need it."""
    part, rows, pages = TaskContext.get().partitionId(), [], []
    for batch in batches:
        for row in batch.to_pylist():
            page = _page(row)
            page.chained = bool(pages) and page.follows(pages[-1])
            pages.append(page)
            rows.append(row)
    edges = edge_pages(pages) if pages else set()
    for at in range(0, len(rows), 500):
        yield _batch([(part, at + k, *(row[c] for c in ("host", "path", "marks", "sizes", "inside", "d1", "d2", "n")), pages[at + k].chained, at + k in edges, at + k == len(rows) - 1) for k, row in enumerate(rows[at : at + 500])], _ORDERED)


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the last page of one partition and the first of the next, sorted by target: whether that is a copy of the former."""
    before: dict | None = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["part"] == row["target"]:
                out.append((row["target"], before is not None and before["target"] == row["target"] and _page(row).follows(_page(before))))
            before = row
        if out:
            yield _batch(out, "part int, tied boolean")


def sources(runs_of: list[int], tied: list[bool]) -> list[set[int]]:
    """For each partition in order, the others whose edge pages its own pages may be compared with.

    runs_of: runs that each partition has; tied: whether its first page is a copy of the page before. Beside the next two
    on each side these are the partitions that hold the three runs before and after its own; of a run
    that goes through many partitions, those in its middle are passed over.
    """
    m = len(runs_of)
    begin = list(range(m))  # where the run of a partition's first page begins
    for k in range(1, m):
        if tied[k]:
            begin[k] = k - 1 if runs_of[k - 1] > 1 else begin[k - 1]
    end = list(range(m))  # where the run of a partition's last page ends
    for k in range(m - 2, -1, -1):
        if tied[k + 1]:
            end[k] = k + 1 if runs_of[k + 1] > 1 else end[k + 1]
    out = []
    for k in range(m):
        found = {j for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < m}
        for step, far in ((-1, begin), (1, end)):
            at, have = k, 0
            while 0 <= at + step < m and have < 4:
                at += step
                found.add(at)
                if runs_of[at] == 1 and far[at] != at:
                    at = far[at]
                    found.add(at)
                have += max(runs_of[at] - 1, 1)
        out.append(found - {k})
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the pages of each target partition and the edge pages of others, in order: its pages that lose lines, with the lines that stay."""

    def settle(target: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        pages = [_page(r) for r in rows]
        for at, page in enumerate(pages):
            if at and page.host != pages[at - 1].host:
                page.chained = False
        inside = {k: np.array(r["inside"], bool) for k, r in enumerate(rows) if r["part"] == target}
        out = []
        for i, gone in template_lines(pages, inside):
            if gone.any():
                row = rows[i]
                out.append((row["d1"], row["d2"], row["n"], (~gone).tolist()))
        for at in range(0, len(out), 500):
            yield _batch(out[at : at + 500], "d1 long, d2 long, n long, stays array<boolean>")

    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["target"] != rows[0]["target"]:
                yield from settle(rows[0]["target"], rows)
                rows = []
            rows.append(row)
    if rows:
        yield from settle(rows[0]["target"], rows)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: its id, url, text and n_chars.

    Blocks are joined by two line feeds; the text is empty where nothing is left or html is null. A null
    URL counts as an empty host. Pages of a host with equal blocks, so also repeated rows, are compared as
    one, at the first of their paths, and get one text. An empty table gives an empty result; other columns
    are not read. Pages are sorted by range, so a large host is spread over tasks; of each range, the first
    and last pages go to the ranges next to it, so the text doesn't depend on where ranges end. The driver
    learns two numbers a range.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path = url_key(pages[url_col].cast("string"))
    narrow = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), host.alias("host"), path.alias("path"), pages[html_col].cast("string").alias("html"))
    blocks = stored(narrow.mapInArrow(_parse, _BLOCKS), "page-blocks")
    place = F.struct("path", "id")
    told = F.struct("host", "path", "id", "marks", "sizes", "inside")
    different = blocks.where(F.size("lines") > 0).groupBy("d1", "d2").agg(F.min_by(told, place).alias("p"), F.count("*").alias("n")).select("p.*", "d1", "d2", "n")
    order = ["host", "path", "id", "d1", "d2"]
    ordered = stored(different.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chain, _ORDERED), "page-order")
    # of each partition, the driver learns its number of runs, and whether the first goes on from the partition before
    parts = sorted((r.part, r.runs) for r in ordered.groupBy("part").agg(F.count_if(~F.col("chained")).alias("runs")).collect())
    names = [part for part, _ in parts]
    after = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "part int, target int")
    page = ["part", "target", "pos", "host", "path", "marks", "sizes", "chained"]
    meeting = ordered.where("pos = 0").withColumn("target", F.col("part")).select(page).unionByName(ordered.where("tail").join(after, "part").select(page))
    tied = stored(meeting.repartition("target").sortWithinPartitions("target", "part").mapInArrow(_ties, "part int, tied boolean"), "page-ties")
    ties = {r.part: r.tied for r in tied.collect()}
    needs = sources([runs_ for _, runs_ in parts], [ties[part] for part in names])
    sent = spark.createDataFrame([(names[j], names[k]) for k, found in enumerate(needs) for j in sorted(found)], "part int, target int")
    known = ordered.join(tied, "part").withColumn("chained", F.when(F.col("pos") == 0, F.col("tied")).otherwise(F.col("chained"))).drop("tied", "tail")
    own = known.withColumn("target", F.col("part")).drop("edge")
    met = own.unionByName(known.where("edge").drop("edge").join(sent, "part"))
    verdicts = stored(met.repartition("target").sortWithinPartitions("target", "part", "pos").mapInArrow(_judge, "d1 long, d2 long, n long, stays array<boolean>"), "page-verdicts")
    total = blocks.count()
    left = attach(blocks.select("id", "url", "lines", "d1", "d2"), verdicts, ["d1", "d2"], "n", total)
    own = F.when(F.col("stays").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: F.get("stays", i)))
    text = left.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(own, "\n\n").alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
