"""Spreadsheets of both kinds, and images: found, stored by content, described, put back."""

import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from arborlake.operators import store as ST
from arborlake.plans import catalog
from arborlake.plans import models as M
from arborlake.sources import images as IM
from arborlake.sources import parsers as P
from verify import rows_of

OFFICE = "urn:oasis:names:tc:opendocument:xmlns"
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def ods(*tables):
    return zipped(**{"content.xml": f'<x xmlns:table="{OFFICE}:table:1.0" xmlns:office="{OFFICE}:office:1.0" xmlns:text="{OFFICE}:text:1.0">{"".join(tables)}</x>'})


def cell(text, n=1):
    return f'<table:table-cell office:value-type="string" table:number-columns-repeated="{n}"><text:p>{text}</text:p></table:table-cell>'


def line(*cells, n=1):
    return f'<table:table-row table:number-rows-repeated="{n}">{"".join(cells)}</table:table-row>'


def shown(events):
    return [(kind, text) for kind, _, text, _ in events]


def test_ods_cells_and_runs():
    typed = '<table:table-cell office:value-type="{0}" office:{1}="{2}"/>'
    values = [typed.format("float", "value", "1e-7"), typed.format("currency", "value", "2.0"), typed.format("boolean", "boolean-value", "true"), typed.format("date", "date-value", "2024-01-02")]
    text = '<table:table-cell office:value-type="string"><office:annotation><text:p>note</text:p></office:annotation><text:p>a<text:s text:c="2"/>b</text:p><text:p>c</text:p></table:table-cell>'
    empty = '<table:table-cell table:number-columns-repeated="16000"/>'
    sheet = f'<table:table table:name="S">{line(empty, n=3)}{line("<table:table-cell/>", *(cell(c) for c in "pqrst"), empty)}{line("<table:table-cell/>", *values, text)}{line(cell(""), cell("x", 2), n=2)}{line(empty, n=1_000_000)}</table:table>'
    got = shown(P.ods_events(ods(sheet, '<table:table table:name="E"/>')))
    assert got[:4] == [("section", "S (4 rows × 5 cols)"), ("table", "S (4 rows × 5 cols)"), ("table_row", "p | q | r | s | t"), ("table_row", "p: 0.0000001 | q: 2 | r: true | s: 2024-01-02 | t: a  b\nc")]
    assert got[4:] == [("table_row", "p: x | q: x")] * 2 + [("section", "E (0 rows × 0 cols)"), ("table", "E (0 rows × 0 cols)"), ("table_row", "")]


def test_sheets_show_500_rows_of_their_range():
    late = f'<table:table table:name="S">{line("<table:table-cell/>", n=700)}{line(cell("h"))}{line(cell("v"), n=2_000_000)}</table:table>'
    got = P.sheet_events(ods(late))
    assert got[0][2] == "S (2000001 rows × 1 cols)" and shown(got)[3:] == [("table_row", "h: v")] * 499
    assert json.loads(got[1][3])["size"] == "499 rows × 1 cols"
    gaps = f'<table:table table:name="S">{line(cell("h"))}{line(n=2)}{line("<table:table-cell/>", cell("v"))}</table:table>'
    assert shown(P.ods_events(ods(gaps)))[2:] == [("table_row", "h | "), ("table_row", " | "), ("table_row", " | "), ("table_row", ": v")]
    assert P.sheet_events(None) == P.sheet_events(b"") == P.sheet_events(b"\xd0\xcf\x11\xe0") == P.sheet_events(ods()[:-30]) == P.ods_events(zipped(**{"content.xml": "<x"})) == []


def test_sheet_nodes_have_all_rows(spark, tmp_path):
    # the query and its SQL showed the first 500 rows of a sheet; 700 and 599 orders, the latter in runs of one to three
    orders = [(1, k, "1-URGENT") for k in range(700)] + [(2, k, "5-LOW") for k in range(1000, 1599)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    df = catalog.sheet_nodes(spark, str(tmp_path))
    got = rows_of(df.columns, df.collect())
    rel = duckdb.sql(catalog.SQL["sheet_nodes"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'"))
    assert got == rows_of(rel.columns, rel.fetchall())
    assert df.groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 703), (2, 3 + sum(k % 3 + 1 for k in range(1000, 1599)))]
    # blank rows between others are shown as well, and those of every sheet; a run is handed on as it is read
    sheet = f'<table:table table:name="S">{line(cell("h"))}{line(n=600)}{line(cell("v"), n=3)}</table:table>'
    whole = list(P.whole_sheet_events(ods(sheet, sheet)))
    assert shown(whole[:606]) == shown(whole[606:]) and shown(whole[3:606]) == [("table_row", "")] * 600 + [("table_row", "h: v")] * 3
    assert len(P.sheet_events(ods(sheet, sheet))) == 1004
    late = P.whole_sheet_events(ods(f'<table:table table:name="S">{line(cell("v"), n=2_000_000_000)}</table:table>'))
    assert shown([next(late) for _ in range(5)])[0] == ("section", "S (2000000000 rows × 1 cols)")


def test_xlsx_labels_errors_and_bad_sheets(spark):
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = '<row r="3"><c r="B3" t="s"><v>0</v></c><c r="AB3" t="b"><v>1</v></c></row><row r="5"><c r="B5" t="e"><v>#DIV/0!</v></c><c r="AB5"><v>1E-7</v></c></row>'
    data = zipped(**{
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/><sheet name="C" r:id="r3"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><r Id="r1" Target="worksheets/1.xml"/><r Id="r2" Target="worksheets/2.xml"/><r Id="r3" Target="/xl/worksheets/3.xml"/></R>', "xl/sharedStrings.xml": f"<sst {s}><si><t>k</t></si></sst>",
        "xl/worksheets/1.xml": f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>", "xl/worksheets/2.xml": "<worksheet", "xl/worksheets/3.xml": f"<worksheet {s}><sheetData/></worksheet>",
    })
    got = shown(P.sheet_events(data))
    assert got[0][1] == "A (3 rows × 27 cols)" and got[2][1].startswith("k | ") and got[2][1].endswith(" | true") and got[4][1] == "k: #ERR:Div0 | true: 0.0000001" and got[5][1] == "C (0 rows × 0 cols)"
    docs = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"junk"))], "doc_id long, data binary")
    assert {r.doc_id: r["count"] for r in P.parse(docs, "spreadsheet").groupBy("doc_id").count().collect()} == {1: 9, 2: 1, 3: 1}
    first = P.table_details(docs, "data", P.sheet_events).orderBy("pos").first()
    assert first["pos"] == 2 and first["summary"].startswith("2 rows × 27 cols\nColumns: k, ")


@pytest.fixture(scope="module")
def images(spark):
    rows = [("a", "1.png", bytearray(PNG + b"1")), ("a", "2.png", bytearray(PNG + b"2")), ("b", "1.png", bytearray(PNG + b"1")), ("b", "1.png", bytearray(PNG + b"1")), ("c", "1.jpg", bytearray(JPEG)), ("d", "x", None), ("e", "y", bytearray(b""))]
    return spark.createDataFrame(rows, "doc_id string, path string, data binary").selectExpr("doc_id", "path", "'image/png' AS mime_type", "data", "CAST(NULL AS INT) AS width", "CAST(NULL AS INT) AS height", "1 AS extra")


def test_images_by_file_type(spark):
    doc = bytearray(zipped(**{"word/media/i.jpg": JPEG, "word/media/n.txt": b"no", "word/document.xml": "<x/>"}))
    files = spark.createDataFrame([("a", "A.DOCX", doc), ("b", "b.pdf", bytearray(b"%PDF")), ("c", "c.md", doc), ("d", "d", None), ("e", None, doc), ("f", "f.docx", None)], "doc_id string, name string, data binary")
    assert [(r.doc_id, r.path, r.width, r.height) for r in IM.images_of(files).collect()] == [("a", "word/media/i.jpg", 7, 5)]
    pdf = lambda df: df.selectExpr("doc_id", "'p' AS path", "'image/jpeg' AS mime_type", "data", "1 AS width", "2 AS height")
    assert sorted(r.doc_id for r in IM.images_of(files, pdf).collect()) == ["a", "b"]
    known = [(bytearray(x),) for x in (PNG, JPEG, b"GIF89a", b"RIFF0000WEBP", b"BM12", b"RIFF0000WAVE", b"")]
    assert [r[0] for r in spark.createDataFrame(known, "d binary").select(IM.image_type(F.col("d"))).collect()] == ["image/png", "image/jpeg", "image/gif", "image/webp", "image/bmp", None, None]


def test_images_are_stored_once(spark, images, tmp_path):
    sink = str(tmp_path / "sink")
    assert IM.save_images(images.filter("doc_id = 'a'"), sink, 0) and not IM.save_images(images, sink, 0)
    assert IM.save_images(images, sink, 1) and IM.save_images(images, sink, 2)
    content, places = IM.read_images(spark, sink)
    assert sorted(r.data for r in content.collect()) == sorted([PNG + b"1", PNG + b"2", JPEG, b""])
    assert sorted((r.doc_id, r.path) for r in places.collect()) == [("a", "1.png"), ("a", "2.png"), ("b", "1.png"), ("c", "1.jpg"), ("e", "y")]
    assert content.filter(IM.image_id(F.col("data")) != F.col("image_id")).count() == 0
    assert IM.save_images(images.limit(0), sink, 3) and IM.read_images(spark, sink)[0].count() == 4


def test_images_are_described_once_and_put_back(spark, images, tmp_path):
    def vision(mime_type, data):
        with open(tmp_path / "asked", "ab") as f:
            f.write(b"%d\n" % len(data))
        if mime_type == "image/jpeg":
            raise RuntimeError("refused")
        return f" seen {data[-1:].decode()}\n"

    content = images.withColumn("image_id", IM.image_id(F.col("data")))
    said = IM.describe(content, vision, 14)
    got = sorted((r.description or "", r.error or "") for r in said.collect())
    assert got == [("", "no data"), ("", "not an image"), ("", "too large: 15 bytes"), ("seen 1", ""), ("seen 2", "")]
    assert (tmp_path / "asked").read_bytes().split() == [b"9", b"9"]
    assert [r.error for r in IM.describe(content.filter("doc_id = 'c'"), vision).collect()] == ["RuntimeError: refused"]
    assert IM.describe(content.limit(0), vision).collect() == []
    nodes = spark.createDataFrame([("a", 1, None), ("a", 2, "old"), ("b", 1, "old"), ("c", 1, "old"), (None, 1, "old")], "doc_id string, pos int, summary string")
    at = spark.createDataFrame([("a", 1, "1.png"), ("a", 1, "2.png"), ("a", 1, "1.png"), ("b", 1, "1.png"), ("c", 1, "1.jpg"), (None, 1, "1.png")], "doc_id string, pos int, path string")
    out = IM.described_nodes(nodes, at, content.select("doc_id", "path", "image_id"), said)
    assert sorted((r.doc_id or "", r.pos, r.summary, r.described) for r in out.collect()) == [("", 1, "old", False), ("a", 1, "seen 1", True), ("a", 2, "old", False), ("b", 1, "seen 1", True), ("c", 1, "old", False)]
    again = ST.describe_image(out, spark.createDataFrame([("a", 2, "")], "doc_id string, pos int, description string"))
    assert sorted((r.doc_id or "", r.pos, r.summary, r.described) for r in again.collect())[1:3] == [("a", 1, "seen 1", True), ("a", 2, "", True)]


def test_vision_models(monkeypatch):
    with pytest.raises(ValueError, match="takes no images"):
        IM.vision_model("groq")
    asked = []

    class Seer(M.Echo):
        def chat(self, messages, tools=None):
            asked.append(messages)
            return M.Response("a chart")

    monkeypatch.setitem(M._REGISTRY, "google", Seer)
    assert IM.vision_model("google")("image/png", b"abc") == "a chart"
    assert asked[0][0]["role"] == "system" and asked[0][1]["content"][0]["image_url"]["url"] == "data:image/png;base64,YWJj"
