"""Secret scanning over an incremental ledger of blobs, in DataFrame operations.

A text's SHA-256 names its blob. The ledger holds, for each pair of blob and
version of the rules, what was found; only pairs that it lacks are scanned, each
blob once however many paths hold it, and findings are joined back to all paths.

Null texts are the empty blob, in which nothing is found. Repeated rows are
paths of their own, and each version of a document is one: its row carries what tells
it. An empty table gives no rows; further columns go along inside ``row``.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import stored

_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Fixed values, in order of listing: kind, pattern, group that has a least length, that length.
RULES = [
    ("assign", "(?i)" + _ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@", 0, 9),
]
BASE = ("assign", "access", "hex")

_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches as spans in code points, from the matches and what lies between them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit"), tested.alias("tested"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))

    def add(done: Column, part: Column) -> Column:
        begin = done["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        long = F.coalesce(F.length(part["tested"]) >= least, F.lit(False))
        return F.struct(
            end.alias("at"), F.when(long, F.concat(done["found"], F.array(span))).otherwise(done["found"]).alias("found")
        )

    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(text.rlike(pattern), F.aggregate(parts, start, add, lambda done: done["found"])).otherwise(none)


def version_of(rules=RULES) -> str:
    """The name of rules in the ledger: whatever changes in them changes it."""
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob and its spans, for each row with blob and text."""
    found = [_spans(F.col("text"), i, *rule) for i, rule in enumerate(rules)]
    return blobs.select("blob", F.array_sort(reduce(F.concat, found)).alias("spans"))


#: Columns of a ledger.
LEDGER = f"blob binary, version string, spans array<{_SPAN}>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def update(docs: DataFrame, ledger: DataFrame | None, text_col: str = "text", rules=RULES) -> DataFrame:
    """New rows of the ledger: every unseen pair of blob and version of the rules, scanned once."""
    version = version_of(rules)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blobs = docs.select(blob_of(text).alias("blob"), text.alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("version") == version).select("blob"), "blob", "left_anti")
    found = scan(blobs.dropDuplicates(["blob"]), rules)
    return stored(found.select("blob", F.lit(version).alias("version"), "spans"), "ledger")


def findings(docs: DataFrame, ledger: DataFrame, carry: list[str], text_col: str = "text", rules=RULES) -> DataFrame:
    """Struct ``row`` with the carried columns, and the spans that the ledger has for its blob."""
    version = version_of(rules)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    paths = docs.select(row, blob_of(F.col(f"`{text_col}`")).alias("blob"))
    # blobs without findings need no join: they get the empty list
    own = ledger.filter((F.col("version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    none = F.array().cast(f"array<{_SPAN}>")
    return paths.join(own, "blob", "left").select("row", F.coalesce("spans", none).alias("spans"))


def op8(docs: DataFrame) -> DataFrame:
    found = findings(docs, update(docs, None), ["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "row.doc_id",
        *[count(k) for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
