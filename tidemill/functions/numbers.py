"""Numbers, dates and units as they are written in tenders and price lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of units, and the words for periods with their days.
UNITS = {
    "dona": ["шт", "штук", "шт-к", "дона", "dona", "pcs", "pc", "ta", "ед", "единица"],
    "komplekt": ["компл", "комплект", "тўплам", "туплам", "to'plam", "toplam", "набор", "set", "komplekt"],
    "kg": ["кг", "kg", "килограмм", "kilogramm"],
    "t": ["т", "t", "тонна", "tonna", "ton"],
    "l": ["л", "l", "литр", "litr"],
    "m": ["м", "m", "метр", "metr"],
    "m2": ["м2", "m2", "кв м", "kv m"],
    "m3": ["м3", "m3", "куб м", "kub m"],
    "upak": ["упак", "упаковка", "пачка", "quti", "коробка", "box", "pack", "paket"],
    "shartli": ["услед", "усл ед", "уе", "шартли бирлик", "шартли", "усл"],
    "porsiya": ["порция", "порц", "porsiya", "portsiya"],
    "flakon": ["флакон", "фл", "доз", "доза", "flakon"],
    "obyekt": ["объект", "obyekt", "obekt"],
}
PERIODS = {"week": 7, "hafta": 7, "нед": 7, "month": 30, "oy": 30, "мес": 30, "year": 365, "yil": 365, "год": 365}


def round2(x: Column) -> Column:
    """To cents, half away from zero, with room for binary error; no number is 0."""
    x = F.coalesce(x.cast("double"), F.lit(0.0))
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
    return F.signum(x) * F.floor(F.abs(x) * 100 + 1e-9 + 0.5) / 100 + F.lit(0.0)


def first_integer(c: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"-?\d+", 0), F.lit("")), F.lit("S999999999999999999")).cast("long")


#: Cells that stand for nothing.
BLANKS = ["", "-", "—", "–", "n/a", "na", "null", "none", "nan"]


def number_of(c: Column) -> Column:
    """A written number as a struct: value, and error where there is none (no_number, several, blanks, form).

    Blanks group thousands only, three digits each; of . and , the later one is the
    decimal sign; a comma alone is one unless it parts thousands; several dots part
    thousands. Words may follow a number, other numbers may not. Empty cells are null
    without an error.
    """
    s = F.trim(F.regexp_replace(c, "[\u00a0\u202f\u2009 ]", " "))
    lead = F.regexp_extract(s, r"^([+-]?\d[\d .,]*)", 1)
    tail = F.substr(s, F.length(lead) + 1)
    token = F.regexp_replace(F.trim(lead), "^[+-]", "")
    grouped = ~token.contains(" ") | token.rlike(r"^\d{1,3}( \d{3})+([.,]\d+)?$")
    close = F.regexp_replace(token, " ", "")
    dots, commas = F.regexp_count(close, F.lit(r"\.")), F.regexp_count(close, F.lit(","))
    comma_last = F.instr(F.reverse(close), ",") < F.instr(F.reverse(close), ".")
    without = lambda sign: F.replace(close, F.lit(sign), F.lit(""))
    plain = (
        F.when((dots > 0) & (commas > 0), F.when(comma_last, F.replace(without("."), F.lit(","), F.lit("."))).otherwise(without(",")))
        .when(commas > 0, F.when(close.rlike(r"^\d{1,3}(,\d{3})+$"), without(",")).otherwise(F.replace(close, F.lit(","), F.lit("."))))
        .when(dots > 1, without("."))
        .otherwise(close)
    )
    error = (
        F.when(F.lower(s).isin(BLANKS) | s.isNull(), None)
        .when(lead == "", "no_number")
        .when(tail.rlike(r"\d"), "several")
        .when(~grouped, "blanks")
        .when(~plain.rlike(r"^\d+\.?\d*$"), "form")
    )
    value = F.when(error.isNull() & (lead != ""), F.concat(F.when(lead.startswith("-"), "-").otherwise(""), plain).try_cast("decimal(38,10)"))
    return F.struct(value.alias("value"), error.alias("error"))


def parse_number(c: Column) -> Column:
    """The value of number_of, null where there is none."""
    return number_of(c)["value"]


def lenient_amount(c: Column) -> Column:
    """The first number of a text, whatever is around it."""
    s = F.regexp_replace(F.regexp_extract(c, r"\d+(?:[ \u00a0]\d{3})*(?:[.,]\d+)?", 0), "[ \u00a0]", "")
    return F.when(s != "", F.replace(s, F.lit(","), F.lit(".")).try_cast("decimal(38,10)"))


def parse_amount(c: Column) -> Column:
    """The one quantity at the start of a text; null if there is none or a second number follows."""
    s = F.trim(F.regexp_replace(c, "[   ]", " "))
    token = F.trim(F.regexp_extract(s, r"^(\d[\d ]*(?:[.,]\d+)?)", 1))
    tail = F.substr(s, F.length(F.regexp_extract(s, r"^(\d[\d ]*(?:[.,]\d+)?)", 1)) + 1)
    grouped = ~token.contains(" ") | token.rlike(r"^\d{1,3}( \d{3})+([.,]\d+)?$")
    number = F.regexp_replace(F.regexp_replace(token, " ", ""), ",", ".")
    return F.when((token != "") & ~tail.rlike(r"(?<![\w.])\d") & grouped, number.try_cast("decimal(38,10)"))


def unit(c: Column) -> Column:
    """The canonical unit, or the cleaned text where it isn't known."""
    s = F.translate(F.lower(F.trim(c)), "ўқҳғ.-_/", "укхг    ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    known = {f: k for k, forms in UNITS.items() for f in forms}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(names, s), F.try_element_at(names, F.regexp_replace(s, " ", "")), F.nullif(s, F.lit("")))


def to_days(term: Column, period: Column) -> Column:
    """A term in days; a month has 30, a year 365, what isn't known counts as days."""
    days = F.lit(1)
    for stem, n in PERIODS.items():
        days = F.when(F.lower(period).startswith(stem), n).otherwise(days)
    return F.bround(term.cast("double") * days).cast("long")


def percent(c: Column) -> Column:
    """The first percentage of a text."""
    s = F.nullif(F.regexp_extract(c, r"(\d+(?:[.,]\d+)?)\s*(?:%|foiz|процент)", 1), F.lit(""))
    return F.regexp_replace(s, ",", ".").cast("double")


def parse_date(c: Column) -> Column:
    """Dates in six written forms, or as a spreadsheet's day number."""
    forms = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyy.MM.dd")
    serial = F.when(c.rlike(r"^\d{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), F.expr("0") + F.coalesce(F.try_to_number(c, F.lit("99999")).cast("int"), F.lit(0))))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in forms], serial)


def validity(until: Column, perpetual: Column, today: Column, soon: int = 30) -> Column:
    """A document's state on a day: ok, expiring_soon, expired or missing."""
    left = F.datediff(until, today)
    return (
        F.when(F.coalesce(perpetual, F.lit(False)), "ok")
        .when(until.isNull(), "missing")
        .when(left < 0, "expired")
        .when(left <= soon, "expiring_soon")
        .otherwise("ok")
    )


def six_places(x: Column) -> Column:
    """A single-precision number as text with six decimals, by its exact value as C writes it, halves
    to even. (Java's format rounds the shortest decimal form half up.) A million times such
    a number is exact in double precision."""
    d = x.cast("float").cast("double")
    text = F.format_string("%.6f", F.rint(d * 1e6) / 1e6)
    return F.when(F.isnan(d), "nan").when(F.abs(d) == float("inf"), F.when(d > 0, "inf").otherwise("-inf")).when(d.isNotNull(), text)
