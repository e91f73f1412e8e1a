"""Price lists read by executors: quoted text tables and typed spreadsheet cells.

A file is one row of a binaryFile frame and at most 25 MB, so it is one task's work;
its rows leave the task in blocks. What a file can't give is told by its status.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

# Written names of columns, encodings in the order they are tried, and the
# numbers of a spreadsheet's own formats of dates and times.
COLUMNS = {
    "name": [
        "nomi", "nom", "nomlanishi", "mahsulot", "mahsulot nomi", "tovar", "tovar nomi", "mahsulot/xizmat", "xizmat nomi",
        "наименование", "название", "товар", "наименование товара", "продукт",
        "name", "product", "product name", "item", "item name", "title",
    ],
    "keywords": [
        "xususiyatlari", "xususiyati", "xususiyat", "xossalari", "tavsifi", "tavsif", "kalit so'zlar", "kalit so'z", "izoh",
        "характеристики", "характеристика", "свойства", "описание", "ключевые слова", "примечание",
        "properties", "attributes", "features", "keywords", "description", "specs", "spec",
    ],
    "unit": [
        "o'lchov birligi", "olchov birligi", "o'lchov", "birligi", "birlik", "единица измерения", "ед. изм.", "ед изм", "ед.изм", "единица",
        "unit", "uom", "measure", "measurement unit",
    ],
    "stock_qty": [
        "qoldiq", "qoldig'i", "ombor qoldig'i", "ombordagi qoldiq", "zaxira", "miqdor", "miqdori", "soni", "mavjud",
        "остаток", "остатки", "остаток на складе", "количество", "кол-во", "наличие", "запас",
        "stock", "qty", "quantity", "balance", "on hand", "in stock", "stock qty", "available",
    ],
    "cost_price": [
        "tannarx", "tannarxi", "tan narx", "xarid narxi", "kirim narxi", "себестоимость", "закупочная цена", "цена закупки", "закуп",
        "cost", "cost price", "unit cost", "purchase price",
    ],
    "price": ["narx", "narxi", "sotuv narxi", "sotish narxi", "цена", "цена продажи", "продажная цена", "стоимость", "price", "sale price", "selling price"],
    "category_code": ["kategoriya", "kategoriyasi", "toifa", "категория", "категории", "category", "category code"],
    "currency": ["valyuta", "valyutasi", "валюта", "currency", "cur"],
}
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "cp1252")
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}

MOST_BYTES, MOST_UNPACKED, HEADER_ROWS, BLOCK = 25 << 20, 400 << 20, 10, 5_000
Cell = tuple[str, str] | None  # kind (text, number, date, time, duration, boolean, error) and text


class Unreadable(ValueError):
    """A file that isn't a price list; the message is its status."""


def header_form(c: object) -> str:
    """A column's written name without case, notes in brackets, marks and kinds of apostrophes."""
    t = unicodedata.normalize("NFKC", str(c)).lower()
    t = re.sub("[‘’ʻʼ`´]", "'", t)
    t = re.sub(r"\([^)]*\)|[*:;#№]", " ", t)
    return " ".join(t.split()).strip(" .,-_")


_FORMS = {header_form(n): field for field, names in reversed(COLUMNS.items()) for n in names}
_LONGEST = sorted((n for n in _FORMS if len(n) >= 3), key=lambda n: (-len(n), list(COLUMNS).index(_FORMS[n])))


def field_of(header: object) -> str | None:
    """The field that a written name means: the same name, else the longest name in it."""
    form = header_form(header)
    return _FORMS.get(form) or next((_FORMS[n] for n in _LONGEST if n in form), None)


def columns_of(cells: list[Cell]) -> dict[str, int]:
    """The first column of each field."""
    found: dict[str, int] = {}
    for k, cell in enumerate(cells):
        field = field_of(cell[1]) if cell else None
        if field:
            found.setdefault(field, k)
    return found


def header_of(rows: list[list[Cell]]) -> tuple[int, dict[str, int]] | None:
    """The row, of the first ten, that names the name's column and most fields; the first of equals."""
    named = [(len(found), -n, found) for n, cells in enumerate(rows[:HEADER_ROWS]) if "name" in (found := columns_of(cells))]
    best = max(named, key=lambda x: x[:2], default=None)
    return best and (-best[1], best[2])


def decoded(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise Unreadable("encoding_unknown")


def text_rows(content: bytes) -> Iterator[list[Cell]]:
    """Rows of a table with quoted fields, which may hold delimiters, quotes and line ends.

    The delimiter is the one of , ; tab under which the first rows name most fields,
    then the one that parts the first row most.
    """
    text = decoded(content)
    read = lambda d: csv.reader(io.StringIO(text, newline=""), delimiter=d)
    typed = lambda row: [("text", c.strip()) if c.strip() else None for c in row]

    def known(delimiter: str) -> tuple[int, int]:
        head = [typed(row) for row, _ in zip(read(delimiter), range(HEADER_ROWS))]
        found = header_of(head)
        return len(found[1]) if found else 0, len(head[0]) if head else 0

    try:
        for row in read(max(",;\t", key=known)):
            yield typed(row)
    except csv.Error as e:  # a field of more than 131,072 characters
        raise Unreadable("unreadable") from e


def _is_date_format(code: str) -> str | None:
    """What a format code shows a number as: date, time, duration or (None) a number."""
    if re.search(r"\[(?:h+|m+|s+)\]", code, re.I):
        return "duration"
    code = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]', "", code.split(";")[0]).lower()
    if re.search("[dy]", code):
        return "date"
    return "time" if re.search("[hs]", code) else "date" if "m" in code else None


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


class Sheet:
    """The first sheet of a workbook, as typed cells; formulas by their stored values."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        if sum(i.file_size for i in self.zip.infolist()) > MOST_UNPACKED:
            raise Unreadable("too_large")
        names = set(self.zip.namelist())
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        first = next(e for e in book.iter() if _local(e) == "sheet")
        own = next(v for k, v in first.attrib.items() if k.endswith("}id"))
        links = ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = next(e.get("Target") for e in links if e.get("Id") == own)
        self.path = posixpath.normpath(posixpath.join("xl", target)).lstrip("/") if not target.startswith("/") else target[1:]
        self.from_1904 = any(_local(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        self.strings = self._strings() if "xl/sharedStrings.xml" in names else []
        self.shown = self._shown() if "xl/styles.xml" in names else []

    def _strings(self) -> list[str]:
        return [self._text(e) for e in ET.fromstring(self.zip.read("xl/sharedStrings.xml")) if _local(e) == "si"]

    @staticmethod
    def _text(element) -> str:
        """Text of all runs, without how it is read aloud."""
        aloud = {id(t) for r in element.iter() if _local(r) == "rPh" for t in r.iter()}
        return "".join(t.text or "" for t in element.iter() if _local(t) == "t" and id(t) not in aloud)

    def _shown(self) -> list[str | None]:
        """For each cell style what its numbers are shown as."""
        styles = ET.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if _local(e) == "numFmt"}
        kinds = []
        for e in (x for xfs in styles if _local(xfs) == "cellXfs" for x in xfs):
            n = int(e.get("numFmtId", 0))
            given = {18: "time", 19: "time", 20: "time", 21: "time", 45: "time", 46: "duration", 47: "time"}.get(n, "date" if n in DATE_FORMATS else None)
            kinds.append(_is_date_format(own[n]) if n in own else given)
        return kinds

    def _number(self, text: str, style: int) -> Cell:
        value = float(text)
        shown = self.shown[style] if style < len(self.shown) else None
        if shown is None or value < 0:
            return "number", str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
        span = timedelta(seconds=round(value * 86_400))
        if shown == "duration" or (shown == "time" and value >= 1):
            seconds = int(span.total_seconds())
            return "duration", f"{seconds // 3600}:{seconds // 60 % 60:02}:{seconds % 60:02}"
        if value < 1:
            return "time", (datetime(1900, 1, 1) + span).strftime("%H:%M:%S")
        # the older calendar has a 29 February 1900
        day = datetime(1904, 1, 1) if self.from_1904 else datetime(1899, 12, 31 if value < 60 else 30)
        try:
            at = day + span
        except OverflowError:
            return "number", repr(value)
        return "date", at.date().isoformat() if (at.hour, at.minute, at.second) == (0, 0, 0) else at.isoformat()

    def _cell(self, c) -> Cell:
        kind, value = c.get("t", "n"), next((e.text for e in c if _local(e) == "v"), None)
        if kind == "inlineStr":
            text = next((self._text(e) for e in c if _local(e) == "is"), "").strip()
            return ("text", text) if text else None
        if value is None or not value.strip():
            return None
        if kind == "s":
            text = self.strings[int(value)].strip()
            return ("text", text) if text else None
        if kind == "n":
            return self._number(value, int(c.get("s", 0)))
        if kind == "b":
            return "boolean", "true" if value.strip() == "1" else "false"
        return {"e": "error", "d": "date"}.get(kind, "text"), value.strip()

    def rows(self) -> Iterator[list[Cell]]:
        with self.zip.open(self.path) as f:
            line = 0
            for _, e in ET.iterparse(f):
                if _local(e) != "row":
                    continue
                number = int(e.get("r", line + 1))
                for _ in range(min(number - line - 1, HEADER_ROWS)):  # rows left out are blank
                    yield []
                cells: list[Cell] = []
                for c in (x for x in e if _local(x) == "c"):
                    name = re.match("[A-Z]+", c.get("r", ""))
                    at = len(cells)
                    if name:
                        at = 0
                        for letter in name[0]:
                            at = at * 26 + ord(letter) - 64
                        at -= 1
                    cells.extend([None] * (min(at, 16_384) + 1 - len(cells)))
                    cells[at] = self._cell(c)
                yield cells
                line = number
                e.clear()


def file_rows(content: bytes | None, path: str = "") -> Iterator[list[Cell]]:
    """Rows of a written price list, by its extension, else by its first bytes."""
    if not content:
        raise Unreadable("empty")
    if len(content) > MOST_BYTES:
        raise Unreadable("too_large")
    name = path.lower()
    if name.endswith((".xls", ".xlsm", ".ods")):
        raise Unreadable("unsupported")
    if not name.endswith(".xlsx") and (name.endswith((".csv", ".txt", ".tsv")) or content[:2] != b"PK"):
        yield from text_rows(content)
        return
    try:
        yield from Sheet(content).rows()
    except (zipfile.BadZipFile, ET.ParseError, KeyError, StopIteration, IndexError, TypeError, RuntimeError) as e:
        raise Unreadable("unreadable") from e


FIELDS = tuple(COLUMNS)
SCHEMA = "path string, status string, line int, " + ", ".join(f"{f} string" for f in FIELDS) + ", cells array<struct<place:int,kind:string,text:string>>"


def listed(content: bytes | None, path: str = "") -> Iterator[dict]:
    """Rows below the header, by field and as all cells; blank rows are left out. A row
    that only tells the status stands for a file without a header or that can't be read."""
    bad = lambda status: dict.fromkeys(FIELDS) | {"status": status, "line": None, "cells": None}
    rows, head = file_rows(content, path), []
    try:
        for _, cells in zip(range(HEADER_ROWS), rows):
            head.append(cells)
        found = header_of(head)
        if found is None:
            yield bad("no_header")
            return
        at, columns = found
        for line, cells in enumerate((c for part in (head, rows) for c in part), 1):
            if line <= at + 1 or not any(cells):
                continue
            told = {f: cells[k][1] if k < len(cells) and cells[k] else None for f, k in columns.items()}
            every = [{"place": k, "kind": c[0], "text": c[1]} for k, c in enumerate(cells) if c]
            yield dict.fromkeys(FIELDS) | told | {"status": "ok", "line": line, "cells": every}
    except Unreadable as e:
        yield bad(str(e))


def price_rows(files: DataFrame) -> DataFrame:
    """Rows of the price lists of a binaryFile frame (path, content), with the line of
    each. Null and empty files have the status empty; a file that breaks in the middle
    gives the rows before and then its status. Other columns are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                block: list[dict] = []
                for row in listed(None if content is None else bytes(content), path or ""):
                    block.append({"path": path} | row)
                    if len(block) == BLOCK:
                        yield pd.DataFrame(block, columns=names).astype({"line": "Int32"})
                        block = []
                if block:
                    yield pd.DataFrame(block, columns=names).astype({"line": "Int32"})

    return files.select("path", "content").mapInPandas(read, SCHEMA)
