import io
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.functions import numbers, text
from tidemill.operators import decisions
from tidemill.sources import records
from tidemill.streaming import cycles


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_fold_and_variants(spark):
    assert column(spark, ["Ёлка Объезд ЩЫ", None, ""], text.fold) == ["елка обезд ши", None, ""]
    assert text.variants_of("  ") == [] and text.variants_of(None) == []
    assert text.variants_of("shkaf")[:2] == ["shkaf", "шкаф"]
    assert {"цемент", "цемент"} <= set(text.variants_of("tsement"))
    assert "kompyuter" in text.variants_of("компютер") or "kompyuter" in text.variants_of("kompyuter")
    assert all(len(text.variants_of(w)) <= 6 for w in ("cccccc", "сталь", "o'zbek"))
    assert column(spark, ["shkaf", None], text.variants) == [text.variants_of("shkaf"), []]


def test_starts_word(spark):
    got = column(spark, ["большой шкаф", "подшкафник", "Shkaf!", None], lambda c: F.coalesce(text.starts_word(c, "shkaf"), F.lit(False)))
    assert got == [True, False, True, False]


def test_clean_and_quality(spark):
    assert column(spark, ["a\x07\tb \r\n\r\n\r\n\r\nc ", None], text.clean) == ["a b\n\nc", None]
    assert column(spark, ["short", "1234567890" * 4, "letters " * 9, None], text.quality) == ["empty", "unreadable", "ok", "empty"]
    assert column(spark, ["привет мир привет мир привет", "hello there hello there you", "abc", None], text.guess_language) == ["ru", "uz", None, None]
    assert column(spark, [" a ;b|a,\n,c", None], text.keywords) == [["a", "b", "c"], None]


def test_trigram_likeness(spark):
    df = spark.createDataFrame([("ring", "ring"), ("ring", "bolt"), ("", "")], "a string, b string")
    got = [r.y for r in df.select(text.jaccard(text.trigrams(F.col("a")), text.trigrams(F.col("b"))).alias("y")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0


@pytest.mark.parametrize("body", ["", "  ", "word " * 10, "Sentence one. " * 400, "x" * 5000, "para\n\n" * 700])
def test_chunks_cover_text(body):
    spans = text.chunks(body)
    if not body.strip():
        assert spans == []
        return
    assert spans[0][0] == 0 and spans == sorted(spans)
    assert all(b - a <= 1000 for a, b in spans)
    assert all(c <= b for (_, b), (c, _) in zip(spans, spans[1:]))
    assert body[spans[-1][1] :].strip() == "" or len(body) - spans[-1][1] < 80


def test_round2(spark):
    got = column(spark, [1.005, -1.005, 2.675, None, float("nan"), float("inf"), 0.0], numbers.round2, "double")
    assert got == [1.01, -1.01, 2.68, 0.0, 0.0, 0.0, 0.0]


def test_numbers(spark):
    got = column(spark, ["1 234,50", "1.234,50", "1,234.50", "12", "10-15", "abc", "", None, "-3,5", "1,234"], numbers.parse_number)
    assert got == [Decimal("1234.5"), Decimal("1234.5"), Decimal("1234.5"), 12, None, None, None, None, Decimal("-3.5"), 1234]
    got = column(spark, [" 660.00 шт", "3 000.00 т", "3 720 порция", "10-15 шт", "2 x 3 шт", "по требованию", "-", None, "1.00 усл. ед"], numbers.parse_amount)
    assert got == [660, 3000, 3720, None, None, None, None, None, 1]
    assert column(spark, ["Шт.", "кв. м", "T", "whatever", None], numbers.unit) == ["dona", "m2", "t", "whatever", None]
    assert column(spark, ["150 kun", "-7x", "none", None], numbers.first_integer) == [150, -7, None, None]
    assert column(spark, ["3 %", "до 12,5 процентов", "x"], numbers.percent) == [3.0, 12.5, None]


def test_dates(spark):
    got = column(spark, ["2024-02-03", "03.02.2024", "03/02/2024", "45325", "soon", None], lambda c: numbers.parse_date(c).cast("string"))
    assert got == ["2024-02-03"] * 4 + [None, None]


def test_waterfall_golden_values(spark):
    row = dict(cost_base=650.0, logistics_percent=0.0, logistics_fixed=20.0, risk_percent=0.0, risk_fixed=30.0, markup_percent=0.0, vat_percent=0.0, manual_price=None, budget=600.0)
    bad = row | {"vat_percent": 101.0, "markup_percent": -1.0}
    kinds = ", ".join(f"{k} double" for k in row)
    got = decisions.waterfall(spark.createDataFrame([tuple(row.values()), tuple(bad.values())], kinds)).collect()
    assert (got[0].total_cost, got[0].final_price, got[0].budget_left) == (700.0, 700.0, -100.0)
    assert got[0].warnings == ["over_budget", "zero_profit"] and got[0].errors == []
    assert got[1].errors == ["markup_percent_negative", "vat_range"] and got[1].total_cost is None


def test_paged_source(spark, tmp_path):
    for n, rows in enumerate([[{"id": 1}, {"id": 2}], [{"id": 2}]]):
        (tmp_path / f"page_{n}.json").write_text(json.dumps({"rows": rows}))
    spark.dataSource.register(records.PagedJson)
    df = spark.read.format("paged_json").option("path", str(tmp_path)).option("pages", 2).load()
    assert df.count() == 3 and records.without_repeats(df).count() == 2


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document><w:p><w:t>{body}</w:t></w:p></w:document>")
    return out.getvalue()


def test_file_texts(spark, tmp_path):
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.docx", docx("inside"))
    for name, content in {"a.docx": docx("hello"), "b.zip": outer.getvalue(), "c.txt": "привет".encode("cp1251"), "d.pdf": b"%PDF-1.4", "e.zip": b"PK\x03\x04bad"}.items():
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in records.file_texts(files).collect()}
    assert got == {"a.docx": ("hello", "ok"), "b.zip": ("inside", "ok"), "c.txt": ("привет", "ok"), "d.pdf": (None, "unsupported"), "e.zip": (None, "unreadable")}
    kinds = {r.path.rsplit("/", 1)[1]: r.f for r in files.select("path", records.format_of(F.col("content")).alias("f")).collect()}
    assert kinds == {"a.docx": "zip", "b.zip": "zip", "c.txt": None, "d.pdf": "pdf", "e.zip": "zip"}


def test_import(spark):
    header, columns, rows = records.sniff_table("Price list\nНаименование;Остаток;Цена\nRing;5;1,5\n".encode("cp1251"))
    assert header == 1 and columns == {"name": 0, "stock": 1, "cost": 2} and rows == [["Ring", "5", "1,5"]]
    with pytest.raises(ValueError):
        records.sniff_table(b"Kod,Summa\n1,2\n")
    lines = [(1, "Ring", "5", "1", "UZS", "a"), (2, " ", "1", "1", "UZS", "a"), (3, "ring", "10-15", "-4", "UZ", "zz")]
    df = spark.createDataFrame(lines, "line int, name string, stock string, cost string, currency string, category string")
    got = {r.line: (r.errors, r.warnings) for r in records.validated(df, spark.createDataFrame([("a",)], "category string")).collect()}
    assert got == {1: ([], []), 2: (["name_missing"], []), 3: (["name_repeated", "stock_invalid", "cost_invalid", "currency_invalid"], ["category_unknown"])}


def test_found_files(spark):
    nested = json.dumps({"a": [{"id": "u1", "meta": {}}, {"b": {"id": "u2", "meta": {"x": 1}}}], "c": {"id": 5, "meta": {}}})
    got = column(spark, [nested, "no json", None], records.found_files)
    assert [[(f.id, f.path) for f in x] for x in got] == [[("u1", "a[0]"), ("u2", "a[1].b")], [], []]


EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = cycles.failed_logins(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("failed").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda r: (r.user_id, r.start, r.failures)
    assert sorted(map(key, spark.table("failed").collect())) == sorted(map(key, cycles.failed_logins(batch).collect()))
    run = stream.writeStream.foreachBatch(cycles.upsert_into(str(tmp_path / "out"), ["user_id"])).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = max(int(p.name[1:]) for p in (tmp_path / "out").iterdir())
    assert spark.read.parquet(str(tmp_path / "out" / f"v{last}")).count() == batch.select("user_id").distinct().count()


def test_written_numbers(spark):
    texts = ["12 34", "1,2,3", "12 dona", "0,500", "1 234 567,80", "5 dona 3 quti", "1.234.567", "12,5", "-", "+7", None, "1.2,3,4"]
    got = column(spark, texts, numbers.number_of)
    assert [None if x.value is None else float(x.value) for x in got] == [None, None, 12, 500, 1234567.8, None, 1234567, 12.5, None, 7, None, None]
    assert [x.error for x in got] == ["blanks", "form", None, None, None, "several", None, None, None, None, None, "form"]
    assert column(spark, ["около 3 000,5 кг", "none", None], numbers.lenient_amount) == [Decimal("3000.5"), None, None]


def test_prefix_join_of_any_length(spark):
    from tidemill.operators import matching

    goods = spark.createDataFrame([(1, "10.AB.01"), (2, "10"), (3, "1")], "id int, good_code string")
    codes = spark.createDataFrame([("10.A",), ("1",), ("10.AB.01",), ("10",)], "code string")
    got = sorted((r.id, r.code) for r in matching.by_code(goods, codes).collect())
    assert got == [(1, "1"), (1, "10"), (1, "10.A"), (1, "10.AB.01"), (2, "1"), (2, "10"), (3, "1")]


def test_six_places_as_the_sql_writes_them(spark):
    """Ties to even and exact values: 1/128 ends in a half, 0.0000015 is less than it looks in single precision."""
    import struct

    import duckdb

    from tidemill.functions import numbers

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    xs = [single(x) for x in (1 / 128, 3 / 128, -1 / 128, 5 / 128, 0.1234565, -0.0000001, 0.0, 12345.678, 1e12, 0.5000005, 0.0000015, 0.7654315)] + [single(i * 1e-6 + 5e-7) for i in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x float")
    got = [r[0] for r in df.coalesce(1).select(numbers.six_places(df.x)).collect()]
    assert got == [duckdb.sql(f"SELECT printf('%.6f', {x!r}::FLOAT::DOUBLE)").fetchall()[0][0] for x in xs]
