import json
import zipfile

import pytest

from catalith import engine
from catalith.__main__ import main

FEED = "manufacturer,mpn,category,width,finish\nAcme Inc,MPN A-1,pumps,{w},matt\nAcme,B 2,pumps,7,\n,C3,pumps,1,x\n"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("catalog")
    (base / "feeds").mkdir()
    for name, w in (("one_datasheet.csv", "12.5"), ("two_pricelist.csv", "13.5")):
        (base / "feeds" / name).write_text(FEED.format(w=w))
    (base / "required.csv").write_text("category_id,channel,code,variant_defining\npumps,core,width,false\npumps,ecommerce,finish,false\n")
    place = f"{base}/tables"
    assert engine.ingest(spark, f"{base}/feeds", place) == 2
    assert engine.ingest(spark, f"{base}/feeds", place) == 0
    main(["--root", place, "build", f"{base}/required.csv"])
    return place


def test_feeds_become_products_once(spark, root):
    assert {(r.manufacturer, r.mpn) for r in engine.tables(spark, root)["products"].collect()} == {("Acme Inc", "MPN A-1"), ("Acme", "B 2")}
    assert engine.tables(spark, root)["observations"].count() == 6


def test_sources_are_arbitrated_by_kind(spark, root):
    got = {(r.mpn, r.code): (r.value_number, r.value_text) for r in engine.ask(spark, root, "SELECT mpn, code, value_number, value_text FROM golden JOIN products USING (product_id)").collect()}
    assert got == {("MPN A-1", "width"): (12.5, None), ("MPN A-1", "finish"): (None, "matt"), ("B 2", "width"): (7.0, None)}
    assert [(r.code, r.n) for r in engine.ask(spark, root, "SELECT code, count(*) AS n FROM conflicts GROUP BY code").collect()] == [("width", 1)]


def test_scores_and_reading_only(spark, root):
    rows = engine.ask(spark, root, "SELECT mpn, completeness_core, completeness_ecommerce, channel_ready FROM scores JOIN products USING (product_id) ORDER BY mpn").collect()
    assert [tuple(r) for r in rows] == [("B 2", 1.0, 0.5, False), ("MPN A-1", 1.0, 1.0, True)]
    with pytest.raises(ValueError):
        engine.ask(spark, root, "DROP TABLE golden")


def test_exports(spark, root, tmp_path):
    for kind in ("json", "csv", "xml"):
        engine.export(spark, root, str(tmp_path / kind), kind, ready=kind == "json")
    items = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert [i["mpn"] for i in items] == ["MPN A-1"]
    wide = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert {"width", "finish"} <= set(wide.columns) and wide.count() == 2
    with pytest.raises(ValueError):
        engine.export(spark, root, str(tmp_path / "no"), "pdf")


def test_an_empty_catalog(spark, tmp_path):
    assert {n: t.count() for n, t in engine.tables(spark, str(tmp_path / "none")).items()} == {"products": 0, "observations": 0}


def workbook(path, rows):
    """A workbook with shared and inline strings, a number and a blank row."""
    texts = sorted({c for row in rows for c in row if isinstance(c, str)})
    body = ""
    for n, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{chr(65 + i)}{n}" t="s"><v>{texts.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{chr(65 + i)}{n}"><v>{c}</v></c>' for i, c in enumerate(row) if c is not None)
        body += f'<row r="{n}">{cells}</row>'
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><r><t>{t[:2]}</t></r><r><t>{t[2:]}</t></r></si>" for t in texts) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")


def test_separators_marks_and_workbooks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('﻿manufacturer;mpn;note\nAcme;S-1;"x, y"\n', "utf-8")
    (tmp_path / "in" / "b.tsv").write_text("manufacturer\tmpn\tnote\nAcme\tT-1\tz\n")
    workbook(tmp_path / "in" / "c.xlsx", [["manufacturer", "mpn", None, "note"], [], ["Acme", "X-1", None, 17.5], ["Acme", "X-2"]])
    (tmp_path / "in" / "d.xlsx").write_bytes(b"no workbook")
    root = f"{tmp_path}/t"
    assert engine.ingest(spark, f"{tmp_path}/in", root) == 4
    now = engine.tables(spark, root)
    assert {r.mpn for r in now["products"].collect()} == {"S-1", "T-1", "X-1", "X-2"}
    assert {(r.code, r.value_number, r.value_text) for r in now["observations"].collect()} == {("note", None, "x, y"), ("note", None, "z"), ("note", 17.5, None)}


def test_reading_commands(spark, root, capsys):
    for command in (["status"], ["list", "--manufacturer", "acme"], ["show", "mpn a1"], ["search", "matt 12.5"], ["review"], ["schema"], ["query", "SUMMARIZE golden"]):
        main(["--root", root, *command])
    out = capsys.readouterr().out
    assert "sources completed" in out and "12.5" in out and "MPN A-1" in out and "finish" in out
    assert [(r.mpn, round(r.score, 3)) for r in engine.find(spark, root, "matt 12.5").collect()] == [("MPN A-1", 0.45)]  # (.3 + .3 + 1.2) / 4


def test_a_correction_wins_the_next_build(spark, root, tmp_path):
    import shutil

    copy = f"{tmp_path}/tables"
    shutil.copytree(root, copy)
    one = engine.tables(spark, copy)["products"].where("mpn = 'B 2'").first().product_id
    main(["--root", copy, "correct", one, "width", "9.25", "--reviewer", "ann"])
    required = spark.createDataFrame([("pumps", "core", "width", False)], "category_id string, channel string, code string, variant_defining boolean")
    engine.build(spark, copy, required)
    won = engine.views(spark, copy)["golden"].where(f"product_id = '{one}' and code = 'width'").first()
    assert (won.value_number, won.source_id, won.method) == (9.25, "human:ann", "human")
    engine.views(spark, root)  # the views of the other tests


def test_mirrors(spark, tmp_path):
    from catalith.sources import files

    rows = [("s", 1, "table", "x", "Poles\t2"), ("s", 0, "heading", "x", "Head"), ("s", 2, "text", "x", "Words.")]
    made = files.mirrors(spark.createDataFrame(rows, files.FRAGMENT)).first()
    assert (made.source_id, made.text) == ("s", "# Head\n| Poles | 2 |\nWords.")
    (tmp_path / "src_1.md").write_text(made.text)
    assert [tuple(r) for r in files.read_mirrors(spark, f"file://{tmp_path}").collect()] == [("src_1", made.text)]
