"""Readers of what platforms publish: paged records, nested JSON, files, price lists."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# First bytes of formats, and column names of price lists by field.
MAGIC = {
    "25504446": "pdf", "504B0304": "zip", "D0CF11E0A1B11AE1": "ole2", "526172211A07": "rar",
    "377ABCAF271C": "7z", "7B5C727466": "rtf", "1F8B": "gz",
}
HEADERS = {
    "name": ["name", "nomi", "наименование", "название", "mahsulot", "товар"],
    "unit": ["unit", "birlik", "ед", "единица"],
    "stock": ["stock", "qoldiq", "остаток", "количество"],
    "cost": ["cost", "tannarx", "себестоимость", "цена"],
    "currency": ["currency", "valyuta", "валюта"],
    "category": ["category", "kategoriya", "категория"],
}


class PagedJson(DataSource):
    """Format "paged_json": landed pages of a paged interface, page_<n>.json under
    path, a folder or its URI, a partition for each page. Options: path, pages, and rows,
    the field with the records. Reading stops at no page, so missing pages fail;
    ``sources.paging`` finds the end itself."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, position int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _Page(InputPartition):
    pass


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pages, self.rows = options["path"], int(options["pages"]), options.get("rows", "rows")

    def partitions(self) -> list[InputPartition]:
        return [_Page(n) for n in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, path = fs.FileSystem.from_uri(f"{self.path}/page_{partition.value}.json")
        with system.open_input_stream(path) as f:
            found = json.loads(f.read())[self.rows]
        for k, record in enumerate(found):
            yield partition.value, k, json.dumps(record, sort_keys=True, ensure_ascii=False)


def without_repeats(pages: DataFrame) -> DataFrame:
    """Records that a platform gave on several pages, once each."""
    return pages.dropDuplicates(["record"])


def format_of(content: Column) -> Column:
    """A file's format by its first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 8))
    found = F.lit(None).cast("string")
    for magic, name in MAGIC.items():
        found = F.when(head.startswith(magic), name).otherwise(found)
    return found


def _inner_text(content: bytes, kind: str) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if re.fullmatch(kind, n)]
        parts = [z.read(n).decode("utf-8", "replace") for n in sorted(names)]
    text = re.sub(r"</(?:w:p|row|si)>", "\n", "\n".join(parts))
    return re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", " ", text)).strip()


def document_text(content: bytes | None, most: int = 25 << 20) -> tuple[str | None, str]:
    """(text, status) of a text, DOCX, XLSX, HTML or zipped document."""
    if not content:
        return None, "empty"
    if len(content) > most:
        return None, "too_large"
    try:
        if content[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
                if "word/document.xml" in names:
                    return _inner_text(content, r"word/document\.xml"), "ok"
                if "xl/workbook.xml" in names:
                    return _inner_text(content, r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml"), "ok"
                inner = [document_text(z.read(n), most) for n in names if z.getinfo(n).file_size <= most]
            texts = [t for t, s in inner if s == "ok" and t]
            return ("\n".join(texts), "ok") if texts else (None, "unreadable")
        if content[:4] in (b"%PDF", b"\xd0\xcf\x11\xe0", b"Rar!"):
            return None, "unsupported"
        text = decoded(content)
        return (re.sub(r"<[^>]+>", " ", text) if re.match(r"\s*<(?:!doctype|html)", text, re.I) else text), "ok"
    except (zipfile.BadZipFile, KeyError, RuntimeError):
        return None, "unreadable"


def decoded(content: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1251"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("cp1252", "replace")


def file_texts(files: DataFrame) -> DataFrame:
    """path, text and status of a binaryFile frame, in Arrow batches."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [document_text(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": [t for t, _ in found], "status": [s for _, s in found]})

    return files.select("path", "content").mapInPandas(read, "path string, text string, status string")


def sniff_table(content: bytes) -> tuple[int, dict[str, int], list[list[str]]]:
    """Header row, columns by field, and the rows below, of a written price list.

    The delimiter is the one of ; , tab that parts most header cells; the header
    is the row of the first ten with a name and most known columns.
    """
    lines = decoded(content).splitlines()
    best: tuple[int, int, dict[str, int], str] = (0, -1, {}, ";")
    for delimiter in ";,\t":
        for n, line in enumerate(lines[:10]):
            cells = [c.strip().strip('"').lower() for c in line.split(delimiter)]
            columns = {f: k for f, names in HEADERS.items() for k, c in enumerate(cells) if c in names}
            if "name" in columns and len(columns) > best[0]:
                best = (len(columns), n, columns, delimiter)
    if best[1] < 0:
        raise ValueError("no row of the first ten names a column for the name")
    return best[1], best[2], [[c.strip().strip('"') for c in x.split(best[3])] for x in lines[best[1] + 1 :] if x.strip()]


def validated(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Errors and warnings of imported rows (line, name, stock, cost, currency, category)."""
    from pyspark.sql.window import Window

    from tidemill.functions.numbers import parse_number

    first = F.row_number().over(Window.partitionBy(F.lower(F.trim("name"))).orderBy("line"))
    known = categories.select(F.col("category").alias("known")).distinct()
    r = rows.withColumn("_n", first).join(known, F.col("category") == F.col("known"), "left")
    bad = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "") & (parse_number(F.col(c)).isNull() | (parse_number(F.col(c)) < 0))
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    errors = F.array(
        F.when(blank, "name_missing"), F.when(F.length("name") > 500, "name_long"), F.when(~blank & (F.col("_n") > 1), "name_repeated"),
        F.when(bad("stock"), "stock_invalid"), F.when(bad("cost"), "cost_invalid"), F.when(~F.col("currency").rlike("^[A-Za-z]{3}$"), "currency_invalid"),
    )
    warnings = F.array(F.when(F.col("category").isNotNull() & F.col("known").isNull(), "category_unknown"))
    keep = lambda a: F.filter(a, lambda x: x.isNotNull())
    return r.select("line", "name", keep(errors).alias("errors"), keep(warnings).alias("warnings"))


def found_files(record: Column) -> Column:
    """Every {"id": …, "meta": …} of a JSON record at any depth: id and path, once each."""

    @F.pandas_udf("array<struct<id:string,path:string>>")
    def walk(records: pd.Series) -> pd.Series:
        def visit(node, path):
            if isinstance(node, dict):
                if isinstance(node.get("id"), str) and isinstance(node.get("meta"), dict):
                    yield node["id"], path
                for k, v in node.items():
                    yield from visit(v, f"{path}.{k}" if path else k)
            elif isinstance(node, list):
                for k, v in enumerate(node):
                    yield from visit(v, f"{path}[{k}]")

        def all_of(text):
            try:
                found = dict(reversed(list(visit(json.loads(text), "")))) if text else {}
            except ValueError:
                found = {}
            return [{"id": i, "path": p} for i, p in sorted(found.items())]

        return records.map(all_of)

    return walk(record)
