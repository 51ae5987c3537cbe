import os
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.llm import html_extract

SCHEMA = "page_id long, url string, html string, id int, host string, lines string, text int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", "y", 2) for i, u, h in rows], SCHEMA)


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=15), st.lists(st.sampled_from("abcd"), max_size=15))
def test_alignment_is_a_longest_common_subsequence(a, b):
    held = [x for x, hit in zip(a, html_extract.aligned(a, b), strict=True) if hit]
    rest = iter(b)
    assert all(x in rest for x in held)
    assert len(held) == brute_lcs(a, b)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";x(0);</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy <b>now</b></div><article><h1>Head &amp; line</h1><p><b>First
  {0}&nbsp;one.<br><p>Second <i>{0}</i> two.</p><div class="comments">I like it</div></article><aside>Side</aside><form>Send</form><footer>&copy; x</footer></body></html>"""


def test_marked_article(spark):
    rows = [(i, f"http://www.h.org/p/{i}", PAGE.format(w)) for i, w in enumerate(["alpha", "beta", "beta"])]
    got = {r.page_id: r for r in html_extract.main_text(frame(spark, rows)).collect()}
    for i, w in enumerate(["alpha", "beta", "beta"]):
        assert got[i].text == f"Head & line\n\nFirst {w} one.\n\nSecond {w} two."
        assert got[i].n_chars == len(got[i].text) and got[i].url == rows[i][1]


def test_template_without_marks(spark):
    r = random.Random(1)
    body = ["own words " + " ".join(str(r.random()) for _ in range(8)) for _ in range(6)]
    page = "<body><div>Site name</div><div>Top offer</div><div>{}</div><div>{}</div><div>All rights</div></body>"
    rows = [(i, f"http://site.org/{i}", page.format(body[2 * i], body[2 * i + 1])) for i in range(3)] + [(9, "http://lone.org/x", "<p>Just this")]
    got = {x.page_id: x.text for x in html_extract.main_text(frame(spark, rows)).collect()}
    assert got == {i: body[2 * i] + "\n\n" + body[2 * i + 1] for i in range(3)} | {9: "Just this"}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://[bad", ""), (None, "http://a.b/c", "<p>x &lt; y<p>z"), (4, "http://a.b/c", "a" * 300000), (5, "http://a.b/d", "<div><p>one</div>two<!-- open"), (6, "http://q.b/d", "<script>never closed"), (7, "http://r.b/d", "<p title='a>b'>kept</p>")]
    got = {x.page_id: x.text for x in html_extract.main_text(frame(spark, rows + [(7, "http://r.b/d", "<p title='a>b'>kept</p>")])).collect()}
    assert got == {1: "", 2: "", None: "x < y\n\nz", 4: "a" * 300000, 5: "one\n\ntwo", 6: "", 7: "kept"}
    assert html_extract.main_text(frame(spark, [])).count() == 0


def test_slugs_and_formulas_in_an_article_stay():
    page = """<article><h2 id="side-effects">Side effects</h2><p class="share-price">12 EUR</p><section id="related-work"><p>Work</p></section>
    <section class="notice-period"><p>Notice</p></section><p><math><mi>x</mi></math></p><button>Press</button><div class="box ads">Buy</div><div id="disqus_thread">Hm</div></article>"""
    assert [t for t, _ in html_extract.page_blocks(page)] == ["Side effects", "12 EUR", "Work", "Notice", "x", "Press"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=15), st.lists(st.sampled_from("abcd"), max_size=15), st.integers(1, 40))
def test_alignment_in_pieces_is_a_longest_common_subsequence(a, b, pairs):
    whole, html_extract.PIECE_PAIRS = html_extract.PIECE_PAIRS, pairs
    try:
        held = [x for x, hit in zip(a, html_extract.aligned(a, b), strict=True) if hit]
    finally:
        html_extract.PIECE_PAIRS = whole
    rest = iter(b)
    assert all(x in rest for x in held)
    assert len(held) == brute_lcs(a, b)


def test_long_pages_are_aligned_in_order():
    n = 17000  # n * n is over 2**28
    a = ["own", *map(str, range(n)), "last"]
    b = ["first", *map(str, range(n)), "end", "own"]
    assert html_extract.aligned(a, b) == [False, *[True] * n, False]


def texts(spark, rows, parts=None):
    pages = frame(spark, rows)
    return {x.page_id: x.text for x in html_extract.main_text(pages.repartition(parts) if parts else pages).collect()}


def prose(r, words=12):
    return "own " + " ".join(str(r.random()) for _ in range(words))


def test_the_alignment_decides_pages_with_an_article(spark):
    r = random.Random(5)
    card = "<div>Site name</div><article><p>Card {0}</p></article><div>{1}</div><div>{2}</div>"
    own = [(prose(r), prose(r)) for _ in range(4)]
    rows = [(i, f"http://card.org/{i}", card.format(i, *own[i])) for i in range(4)]
    news = [prose(r) for _ in range(4)]
    rows += [(10 + i, f"http://news.org/{i}", f"<main><div>Subscribe today</div><p>{news[i]}</p></main>") for i in range(4)]
    got = texts(spark, rows)
    assert got == {i: f"Card {i}\n\n" + "\n\n".join(own[i]) for i in range(4)} | {10 + i: news[i] for i in range(4)}


def test_runs_of_copies_and_short_pages(spark):
    r = random.Random(6)
    page = "<div>Site name and a rather long slogan of the site</div><div>{}</div><div>All rights are reserved by somebody, always</div>"
    a, b, c = prose(r), prose(r), prose(r)
    rows = [(i, f"http://run.org/b?x={i}", page.format(b)) for i in range(7)] + [(7, "http://run.org/a", page.format(a)), (8, "http://run.org/c", page.format(c))]
    near = [prose(r, 60) for _ in range(3)]
    # near copies of one article keep it, also in the middle of their run
    rows += [(20 + i, f"http://near.org/b?x={i}", page.format(near[1]) + f"<p>{i}{i}") for i in range(3)] + [(23, "http://near.org/a", page.format(near[0])), (24, "http://near.org/c", page.format(near[2]))]
    rows += [(30 + i, f"http://short.org/{i}", page.format(f"own {i}")) for i in range(4)]
    want = {i: b for i in range(7)} | {7: a, 8: c} | {20 + i: f"{near[1]}\n\n{i}{i}" for i in range(3)} | {23: near[0], 24: near[2]} | {30 + i: f"own {i}" for i in range(4)}
    assert texts(spark, rows) == want


def test_texts_do_not_depend_on_partitions(spark, monkeypatch):
    r = random.Random(7)
    page = "<div>Site {0}</div><article><p>Notice of {0}</p><p>{1}</p></article><div>Rights of {0}</div>"
    rows = [(i, f"http://h{i % 3}.org/{i // 6}?q={i}", page.format(i % 3, prose(r, 5 if i % 4 else 0))) for i in range(60)]
    found, kind = [], type(spark.range(1))
    by_range = kind.repartitionByRange
    for parts in (1, 2, 7, 40):
        monkeypatch.setattr(kind, "repartitionByRange", lambda df, *order, n=parts: by_range(df, n, *order))
        found.append(texts(spark, rows))
    assert all(x == found[0] for x in found)
    assert all("Site" not in t and "Notice" not in t and "Rights" not in t for t in found[0].values())


HOSTILE = {
    "unclosed quotes": "<a '" * 250_000,
    "both quotes": "<a \"'" * 200_000,
    "quotes that hide every end": "<a '>' " * 150_000,
    "nested and never closed": "<div>" * 200_000,
    "ends of what isn't open": "<div>" * 100_000 + "</span></ul>" * 50_000,
    "ends held back by an article": "<p><article>" + "<div>" * 50_000 + "</p>" * 100_000,
    "loose": "<div><p>" * 100_000,
    "brackets": "<!" * 300_000 + "<a" * 300_000,
    "a number of half a million digits": "<p>&#" + "1" * 500_000 + ";",
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_bad_markup_takes_linear_time(kind):
    start = time.process_time()
    html_extract.page_blocks(HOSTILE[kind])
    assert time.process_time() - start < 4  # about 0.3 s; a second pass for each tag would take minutes


def test_quotes_and_references():
    assert [t for t, _ in html_extract.page_blocks("<p title='a>b' x=\">\">one &#00065;&#99999999999;<p a='b>two")] == ["one A�", "two"]
    assert [t for t, _ in html_extract.page_blocks("3 < 4 <5 <p>x<b")] == ["3 < 4 <5", "x<b"]


def brute_texts(pages):
    """The rules of the module's docstring, over all pages at once; lines shared by two pages are in one order, so sets tell what is shared."""
    parsed = {}
    for i, url, source in pages:
        m = re.match(r"https?://(?:www\.)?([^/?#]*)([^?#]*)", url)
        parsed[i] = (m[1], re.sub(r"(?:/|\.html?)+$", "", m[2]), tuple(html_extract.page_blocks(source)))
    different = {}
    for i, (host, path, blocks) in sorted(parsed.items()):
        if blocks:
            different[host, blocks] = min(different.get((host, blocks), (path, i)), (path, i))
    stays = {}
    for host in {h for h, _ in different}:
        order = sorted((place, blocks) for (h, blocks), place in different.items() if h == host)
        lines = [[t for t, _ in blocks] for _, blocks in order]
        size = [sum(len(t.encode()) for t in x) for x in lines]

        def shared(a, b, lines=lines):
            return {t for t in lines[a] if t in lines[b]}

        def copies(a, b, shared=shared, size=size):
            return sum(len(t.encode()) for t in shared(a, b)) > 0.6 * max(size[a], size[b])

        groups = []
        for k in range(len(order)):
            if groups and copies(k, k - 1):
                groups[-1].append(k)
            else:
                groups.append([k])
        for g, group in enumerate(groups):
            for k in group:
                votes = []
                for step in (1, 2):
                    near = ([groups[g - step][-1]] if g >= step else []) + ([groups[g + step][0]] if g + step < len(groups) else [])
                    near.sort(key=lambda j, k=k: -len(os.path.commonprefix([order[k][0][0], order[j][0][0]])))
                    votes += [shared(k, j) for j in near if not copies(k, j)]
                if votes:
                    gone = {(t, m) for t, m in order[k][1] if t in votes[0] and (not m or len(votes) > 1 and t in votes[1])}
                else:
                    near = [j for j in (k - 1, k + 1, k - 2, k + 2) if 0 <= j < len(order)][:2]
                    gone = {(t, m) for t, m in order[k][1] if not m and len(near) == 2 and all(t in shared(k, j) for j in near)}
                stays[host, order[k][1]] = [t for t, m in order[k][1] if (t, m) not in gone]
    return {i: "\n\n".join(stays.get((host, blocks), [])) for i, (host, _, blocks) in parsed.items()}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_whole_query_against_brute_force(spark, parts):
    r = random.Random(parts)
    frames = [[f"{side} {host} {k} of the site" for k in range(6)] for host in range(3) for side in ("head", "foot")]
    pages = []
    for i in range(90):
        host = r.randrange(3)
        head, foot = ([t for t in frames[2 * host + side] if r.random() < 0.7] for side in (0, 1))
        own = [prose(r, r.randint(1, 9)) for _ in range(r.randint(0, 5))]
        if pages and r.random() < 0.3:
            _, _, source = r.choice(pages)
            source = source if r.random() < 0.5 else source.replace("own", "own copy", 1)
        else:
            body = "".join(f"<p>{t}</p>" for t in own)
            body = f"<article>{body}<p>{foot.pop(0) if foot else 'x'}</p></article>" if r.random() < 0.5 else body
            source = "".join(f"<div>{t}</div>" for t in head) + body + "".join(f"<div>{t}</div>" for t in foot)
        pages.append((i, f"http://www.site{host}.org/{r.choice('ab')}/{r.randint(0, 60)}{r.choice(['', '/', '.html', '?q=1'])}", source))
    assert texts(spark, pages, parts) == brute_texts(pages)


@pytest.mark.parametrize("seed", range(40))
def test_ranges_need_no_more_than_their_sources(seed):
    """Verdicts from a range's own pages and the edge pages of its sources are those from all pages, runs through many ranges included."""
    r = random.Random(seed)
    pages, run = [], 0
    for _ in range(r.randint(1, 14)):
        host, length = f"h{len(pages) // r.choice([9, 30, 1000])}", r.choice([1, 1, 1, 2, 3, 12])
        for _ in range(length):
            lines = [r.randint(0, 3) for _ in range(r.randint(0, 2))] + [1000 * run + k for k in range(50, 70)] + [10**6 + len(pages)]
            pages.append(html_extract.Page(host, f"/{len(pages):04d}", lines, np.ones(len(lines), np.int64)))
        run += 1
    whole = [html_extract.Page(p.host, p.path, p.lines, p.sizes) for p in pages]
    for a, b in zip(whole, whole[1:], strict=False):
        b.chained = b.follows(a)
    inside = {k: np.zeros(len(p.lines), bool) for k, p in enumerate(whole)}
    want = {k: gone.tolist() for k, gone in html_extract.template_lines(whole, inside)}
    cuts = sorted(r.sample(range(1, len(pages)), min(len(pages) - 1, r.randint(0, 20))))
    parts = [list(range(a, b)) for a, b in zip([0, *cuts], [*cuts, len(pages)], strict=True)]
    edges = []
    for part in parts:
        own = [html_extract.Page(p.host, p.path, p.lines, p.sizes, whole[k].chained and k > part[0]) for k, p in ((k, pages[k]) for k in part)]
        edges.append([part[i] for i in sorted(html_extract.edge_pages(own))])
    runs = [sum(not whole[k].chained or k == part[0] for k in part) for part in parts]
    needs = html_extract.sources(runs, [whole[part[0]].chained for part in parts])
    got = {}
    for at, part in enumerate(parts):
        taken = sorted({*part, *(k for j in needs[at] for k in edges[j])})
        listed = [html_extract.Page(pages[k].host, pages[k].path, pages[k].lines, pages[k].sizes, whole[k].chained) for k in taken]
        for i, page in enumerate(listed):
            if i and page.host != listed[i - 1].host or not i:
                page.chained = False
        mine = {i: inside[k] for i, k in enumerate(taken) if k in set(part)}
        got |= {taken[i]: gone.tolist() for i, gone in html_extract.template_lines(listed, mine)}
    assert got == want
    assert max(map(len, needs)) <= 16


def test_words_inside_longer_names_are_no_chrome(spark):
    """On a page without an article element, headings and blocks with ordinary names stay; whole names of chrome go."""
    blocks = ['<h2 id="side-effects">Known effects of it</h2>', '<section id="related-work"><p>Earlier work on this.</p></section>', '<p class="share-price">It closed at nine.</p>', '<div class="notice-period">Three months.</div>', "<p>Plain words.</p>"]
    chrome = ['<div class="ad x">Buy this</div>', '<div id="sidebar">Links</div>', '<div class="comments">Reader says</div>', '<div class="cookie-consent">We use them</div>']
    page = "<html><body>" + "".join(blocks + chrome) + "</body></html>"
    got = html_extract.main_text(spark.createDataFrame([(1, "http://a.org/x", page)], "page_id long, url string, html string")).first().text
    assert got.split("\n\n") == ["Known effects of it", "Earlier work on this.", "It closed at nine.", "Three months.", "Plain words."]
