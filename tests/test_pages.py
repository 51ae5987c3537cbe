"""The structural page parser: what it finds, and that no markup makes it slow."""

import time

import pytest

from catalith import session
from catalith.sources import files, pages

PAGE = """<html><head><title>T</title><script type="application/ld+json">[{"@type":["Product"],"name":"X","gone":null,"on":true,"offers":{"price":5,"a":[1,{"deep":{"er":"v"}}]},
"additionalProperty":[{"@type":"PropertyValue","name":"Poles","value":3}]},{"@type":"Person","name":"no"}]</script><script type=application/ld+json>{broken</script></head>
<nav><ul><li>skip: me<li>and: this</ul></nav><h1>Big &amp; <b>h</b>ead</h1><h1>second</h1>
<table><caption>Specs</caption><tr><th>Poles<td>2<tr><td>Curve</td><td>C<br>x<table><tr><td>in</td></tr><tr><td>ner</td></tr></table></td></tr></table><table><tr><td>one</table>
<dl><dt>Width<dd>17 mm<dt>Empty<dd><dt>H<dd>9</dl><ul><li>Curve: C<li><p>Rated - 5 A</p><ol><li>inner: x</ol></li><li>plain</ul>
<p>Maker: Acme<p>Part No:X-1</p><p>-25 to 60<p>short<p>long text long text long text long text long text <form><p>dropped dropped dropped dropped dropped dropped</p></form></html>"""


def test_structure():
    got = [(f.kind, f.locator, f.caption, f.cells or f.text) for f in pages.page_structure(PAGE)]
    assert got == [
        ("heading", "h1", None, "Big & head"),
        ("keyvalue", "script[type=application/ld+json]", None, [["name", "X"], ["on", "True"], ["offers.price", "5"], ["offers.a", "1"], ["offers.a.deep.er", "v"], ["Poles", "3"]]),
        ("table", "table:nth(1)", "Specs", [["Poles", "2"], ["Curve", "C x"]]),
        ("table", "table:nth(2)", "Table 2", [["in"], ["ner"]]),
        ("keyvalue", "dl:nth(1)", None, [["Width", "17 mm"], ["H", "9"]]),
        ("keyvalue", "ul:nth(1)", None, [["Curve", "C"], ["Rated", "5 A"]]),
        ("text", "ul:nth(2)", None, "inner: x"),
        ("text", "p:nth(5)", None, "long text long text long text long text long text"),
        ("keyvalue", "p (pairs)", None, [["Maker", "Acme"], ["Part No", "X-1"]]),
    ]
    assert pages.page_structure(None) == pages.page_structure("") == [] and pages.page_structure("<title>Only</title>")[0].text == "Only"


@pytest.mark.parametrize("bad", ["<svg>", "<!--", "<ul><li>", "<table><tr><td>", '<p "', "<a '", "<dl><dt>", "<p>", "</li>", "<", "<script>", "<title>", "<ul>", "<li><p>x", "&#99999999999999999999;"])
def test_linear_on_broken_markup(bad):
    def took(n):
        start = time.process_time()
        pages.page_structure(bad * n)
        return time.process_time() - start

    took(1000)
    assert took(40_000) < 30 * max(took(4000), 0.02)


def test_callable_from_sql(spark):
    rows = spark.createDataFrame([("a", PAGE), ("b", None), ("c", "")], "page_id string, html string")
    pages.register_parsers(spark)
    session.register({"some_pages": rows})
    got = session.read_sql(spark, "SELECT page_id AS source_id, f.* FROM some_pages, LATERAL page_fragments(html) f")
    want = pages.page_fragments(rows, "page_id", "html")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.drop("pos").collect())) and got.count() == 9


def test_rows_of_a_page_one_by_one():
    got = files.html_fragments("<h1>A</h1><table><tr><td>Poles<td>2</table><ul><li>Curve: C</ul>")
    assert got == [("heading", "h1", "A"), ("table", "table:nth(1) tr:nth(1)", "Poles\t2"), ("keyvalue", "ul:nth(1)", "Curve\tC")]
