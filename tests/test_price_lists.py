"""Golden cases of written price lists, and a round trip of quoted tables."""

import csv
import io
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemill.sources import price_lists as pl

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(sheet, strings="", formats="", styles="", props=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://x/r">{props}<sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/second.xml"/></Relationships>')
        z.writestr("xl/worksheets/second.xml", f"<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {NS}><numFmts>{formats}</numFmts><cellXfs>{styles}</cellXfs></styleSheet>")
    return out.getvalue()


STRINGS = "<si><t>Наименование товара</t></si><si><r><t>Tan</t></r><r><t>narx (UZS)*</t></r><rPh><t>x</t></rPh></si><si><t xml:space='preserve'> Насос </t></si>"
FORMATS = '<numFmt numFmtId="170" formatCode="dd\\.mm\\.yyyy&quot; г&quot;"/><numFmt numFmtId="171" formatCode="[h]:mm:ss"/><numFmt numFmtId="172" formatCode="0.00&quot; dys&quot;"/><numFmt numFmtId="173" formatCode="[Red]#,##0"/>'
STYLES = "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 170, 171, 172, 173, 20, 22))
SHEET = """
<row r="1"><c r="A1" t="inlineStr"><is><t>Price list</t></is></c></row>
<row r="3"><c r="B3" t="s"><v>0</v></c><c r="D3" t="s"><v>1</v></c><c r="AA3" t="str"><v>Other</v></c></row>
<row r="4"><c r="B4" t="s"><v>2</v></c><c r="D4"><v>1500.0</v></c><c r="E4" s="1"><v>45292</v></c><c r="F4" s="2"><v>59</v></c><c r="G4" s="3"><v>1.5</v></c></row>
<row r="5"/>
<row r="6"><c r="B6" t="b"><v>1</v></c><c r="D6" s="4"><v>0.1</v></c><c r="E6" s="5"><v>7</v></c><c r="F6" s="6"><v>0.75</v></c><c r="G6" s="7"><v>45292.5</v></c><c r="H6" t="e"><v>#N/A</v></c><c r="AA6"><f>1+1</f><v>2</v></c></row>"""


def test_typed_cells():
    first, second = pl.listed(book(SHEET, STRINGS, FORMATS, STYLES), "list.xlsx")
    kinds = lambda row: [(c["place"], c["kind"], c["text"]) for c in row["cells"]]
    assert (first["line"], first["name"], first["cost_price"], first["status"]) == (4, "Насос", "1500", "ok")
    assert kinds(first)[2:] == [(4, "date", "2024-01-01"), (5, "date", "1900-02-28"), (6, "duration", "36:00:00")]
    assert (second["line"], second["name"], second["cost_price"]) == (6, "true", "0.1")
    assert kinds(second)[2:] == [(4, "number", "7"), (5, "time", "18:00:00"), (6, "date", "2024-01-01T12:00:00"), (7, "error", "#N/A"), (26, "number", "2")]


def test_calendar_of_1904():
    (row,) = pl.listed(book('<row><c t="inlineStr"><is><t>name</t></is></c></row><row><c s="1"><v>1</v></c></row>', styles=STYLES, props='<workbookPr date1904="1"/>'), "")
    assert row["name"] == "1904-01-02"


@pytest.mark.parametrize("header, field", [
    ("Tannarx (UZS)*", "cost_price"), ("Tannarx, so'm", "cost_price"), ("Narx, so‘m", "price"), ("Ед. изм.", "unit"), ("O‘lchov birligi", "unit"),
    ("ОСТАТОК  на складе:", "stock_qty"), ("№", None), ("", None), ("Kod", None), ("Цена закупки, сум", "cost_price"), ("Sotuv narxi", "price"),
])
def test_fields(header, field):
    assert pl.field_of(header) == field


def test_text_tables():
    text = 'Прайс; на 2024\r\n"Наименование";"Остаток";Цена\r\n"Кольцо; ""золото""\r\nпара";5;"1,5"\r\n;;\r\nБолт;;2\r\n'
    got = [(r["line"], r["name"], r["stock_qty"], r["price"]) for r in pl.listed(text.encode("cp1251"), "a.csv")]
    assert got == [(3, 'Кольцо; "золото"\r\nпара', "5", "1,5"), (5, "Болт", None, "2")]
    assert [r["name"] for r in pl.listed("﻿Name\tQty\nA,b;c\t1".encode(), "")] == ["A,b;c"]


def test_statuses(spark):
    cases = {"a.csv": b"Kod,Summa\n1,2\n", "b": b"", "c": None, "d.xls": b"x", "e.xlsx": b"PK\x03\x04bad", "f.txt": b"name\n\n", "g": b"name\nx", "h.csv": b"name," + b"x" * 200_000 + b"\nring,1"}
    files = spark.createDataFrame([(k, v, 1) for k, v in cases.items()], "path string, content binary, status int")
    got = {(r.path, r.status, r.line, r.name) for r in pl.price_rows(files).collect()}
    assert got == {("a.csv", "no_header", None, None), ("b", "empty", None, None), ("c", "empty", None, None), ("d.xls", "unsupported", None, None),
                   ("e.xlsx", "unreadable", None, None), ("g", "ok", 2, "x"), ("h.csv", "unreadable", None, None)}


@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=8)), max_size=8), st.sampled_from(",;\t"))
def test_round_trip(rows, delimiter):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=delimiter, quoting=csv.QUOTE_ALL).writerows([("name", "qty"), *rows])
    want = [(a.strip() or None, b.strip() or None) for a, b in rows if a.strip() or b.strip()]
    assert [(r["name"], r["stock_qty"]) for r in pl.listed(out.getvalue().encode(), "")] == want
