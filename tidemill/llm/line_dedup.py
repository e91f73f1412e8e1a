"""Line dedup by site-relative frequency, in DataFrame operations.

A line counts once for each page of its host that holds it. Lines on more than
``ratio`` of a host's pages, and on ``min_pages`` at least, are boilerplate and
go from every page of that host.

Lines are parted by \\n and compared without the blanks around them; blank ones
always stay. Null texts stay null and have no line, but their page counts; null
hosts form a host of their own; repeated rows are pages of their own. A page
whose lines all go keeps an empty text. An empty table gives no rows; further
columns, whatever their names, go along inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import stored

RATIO = 0.05
MIN_PAGES = 5
#: Boilerplate lines that are broadcast at most (about 30 bytes each); more are
#: joined by host, pages of a host dealt over SALTS parts.
BROADCAST_LINES = 100_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _host(host_col: str) -> Column:
    """Null hosts as one host that no other name can equal."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{host_col}`").cast("string")), F.lit(""))


def boilerplate(
    docs: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """host, line (its hash) and pages of the lines that a host repeats too often.

    A host has at most its mean number of lines a page / ratio of them.
    """
    pages = docs.select(_host(host_col).alias("host"), F.col(f"`{text_col}`").alias("text"))
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("host", F.explode(own).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    often = counts.filter(F.col("pages") >= min_pages).join(totals, "host")
    return often.filter(F.col("pages") > ratio * F.col("total")).select("host", "line", "pages")


def dedup(
    docs: DataFrame,
    host_col: str,
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """Struct ``row`` with all columns of docs, ``kept`` text, ``n_lines`` and ``n_dropped``."""
    found = stored(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    drops = found.groupBy("host").agg(F.collect_set("line").alias("drop"))
    rows = docs.select(F.struct("*").alias("row"), _host(host_col).alias("host"))
    if found.count() <= broadcast_lines:
        rows = rows.join(F.broadcast(drops), "host", "left")
    else:
        salted = drops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.col(f"row.`{text_col}`")), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(salted, ["host", "salt"], "left")
    lines = _lines(F.col(f"row.`{text_col}`"))
    # the page's own boilerplate first, so that a line isn't sought in all of the host's
    own = F.when(F.col("drop").isNotNull(), F.array_intersect(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), _key), "drop"))
    rows = rows.select("row", lines.alias("lines"), own.alias("own"))
    left = F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("own", _key(x)))
    rows = rows.select("row", "lines", F.when(F.size("own") > 0, left).otherwise(F.col("lines")).alias("left"))
    return rows.select(
        "row",
        F.array_join("left", "\n").alias("kept"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op4(docs: DataFrame) -> DataFrame:
    return dedup(docs, "source").select(
        "row.doc_id",
        F.when(F.col("row.text").isNotNull(), F.col("n_lines")).otherwise(0).alias("n_lines"),
        F.when(F.col("row.text").isNotNull(), F.col("n_dropped")).otherwise(0).alias("n_dropped"),
        F.col("kept").alias("text"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents without boilerplate lines, all columns kept and n_chars brought up to date."""
    kept = dedup(docs, "source")
    new = {"text": F.col("kept"), "n_chars": F.coalesce(F.length("kept").cast("long"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
