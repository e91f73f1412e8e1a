"""What a tender demands: rows of the register and of rules in one table, kept over runs, and the gate before decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import review
from tidemill.operators.company import EDGES, REVIEWED, RULES, requirements

# Fixed values.
TRUST = 0.85
NAME_CHARS = 2000
DECIDED = ("approved", "corrected")

#: One row of the table for each of these; nulls are a value.
KEY = ["tender_id", "source", "method", "ref", "position_no", "name"]
#: What an extraction writes; the rest is what people made of it.
WRITTEN = ["value", "qty", "unit", "mandatory", "confidence", "status"]
KEPT = ["corrected_value", "note"]


def numbered(rows: DataFrame, parents: list[str], order: list[str], block: Column | None, name: str) -> DataFrame:
    """Rows numbered from 1 along ``order`` within their parents. A parent's blocks are
    numbered apart and moved by the sizes of earlier ones, so that a parent with most rows
    is many tasks' work; ``block`` must never fall along the order. Without blocks a parent is
    one task's, and rows that are dealt by a parent already are not shuffled."""
    if block is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*parents).orderBy(*order)).cast("long"))
    cut = rows.withColumn("_block", block)
    earlier = Window.partitionBy(*parents).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    own = {p: f"_parent_{p}" for p in parents} | {"_block": "_b"}
    sizes = cut.groupBy(*parents, "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    sizes = sizes.select(*[F.col(c).alias(o) for c, o in own.items()], "_before")
    inside = F.row_number().over(Window.partitionBy(*parents, "_block").orderBy(*order))
    both = cut.withColumn("_inside", inside).join(sizes, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()]))
    return both.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_block", "_before", "_inside", *own.values())


def _shaped(rows: DataFrame, apart: tuple[str, ...], **columns) -> DataFrame:
    types = dict(ref="long", position_no="long", value="string", qty="decimal(18,3)", unit="string", mandatory="boolean", confidence="double", status="string")
    cast = lambda c: columns.get(c, F.col(c)).cast(types[c]).alias(c) if c in types else columns.get(c, F.col(c)).alias(c)
    nothing = [F.lit(None).cast("string").alias(c) for c in KEPT]
    return rows.select(*apart, *map(cast, KEY + WRITTEN), *nothing)


def from_register(goods: DataFrame, order: list[str], block: Column | None, apart: tuple[str, ...] = ()) -> DataFrame:
    """The register's own positions (tender_id, name, amount, unit): official, so approved
    and sure, and asked for without being a condition. A position without a name is named
    by its number; positions without a tender belong to none and stay out. Registers of
    several runs in one table are told ``apart`` by columns, which are kept."""
    rows = numbered(goods.filter("tender_id IS NOT NULL"), [*apart, "tender_id"], order, block, "position_no")
    name = F.nullif(F.substring(F.trim("name"), 1, NAME_CHARS), F.lit(""))
    return _shaped(
        rows, apart, source=F.lit("register"), method=F.lit("register"), ref=F.lit(None), name=F.coalesce(name, F.concat(F.lit("position "), F.col("position_no").cast("string"))),
        value=F.lit(None), qty=F.col("amount"), mandatory=F.lit(False), confidence=F.lit(1.0), status=F.lit("approved"),
    )


def from_rules(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES, edges: tuple[str, str] = EDGES, apart: tuple[str, ...] = ()) -> DataFrame:
    """What the rules find in documents (tender_id, doc_id, text): conditions to be reviewed,
    numbered among the values of their name in a document, blanks 0. Null texts hold none.
    Columns that tell runs ``apart`` are kept."""
    rows = requirements(docs.filter("tender_id IS NOT NULL"), [*apart, "tender_id", "doc_id"], rules=rules, place=True, edges=edges)
    return _shaped(
        rows, apart, source=F.lit("document"), method=F.lit("rules"), ref=F.col("doc_id"), position_no=F.col("place"),
        qty=F.lit(None), unit=F.lit(None), mandatory=F.lit(True), status=F.lit("pending"),
    )


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after an extraction, one row for each of KEY. What was extracted is
    replaced. A decision stays with the value it was made of: of another value it falls back
    to pending, with both values in the note; a corrected value stays. Rows that the
    extraction no longer has stay as they were. Of repeated rows the greatest counts."""
    return merged(old.select(F.lit(False).alias("today"), *KEY, *WRITTEN, *KEPT).unionByName(new.select(F.lit(True).alias("today"), *KEY, *WRITTEN, *[F.lit(None).cast("string").alias(c) for c in KEPT])))


def merged(rows: DataFrame) -> DataFrame:
    """``merge`` of rows of both runs in one table, ``today`` being the later one. They meet as groups
    in place of a join, so that rows that are dealt by tender already are not shuffled."""
    both = rows.groupBy(*KEY).agg(
        F.max(F.when(~F.col("today"), F.struct(*WRITTEN, *KEPT))).alias("_old"),
        F.max(F.when(F.col("today"), F.struct(*WRITTEN))).alias("_new"),
    )
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    decided = is_old & is_new & ~F.col("_old.status").eqNullSafe(F.lit("pending"))
    changed = decided & ~F.col("_old.value").eqNullSafe(F.col("_new.value"))
    status = F.when(changed, "pending").when(decided, F.col("_old.status")).otherwise(F.coalesce("_new.status", "_old.status"))
    shown = lambda side: F.coalesce(f"{side}.value", F.lit("-"))
    note = F.when(changed, F.concat(F.lit("value changed: "), shown("_old"), F.lit(" -> "), shown("_new"))).otherwise(F.col("_old.note"))
    return both.select(
        *KEY, *[F.when(is_new, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in WRITTEN[:-1]],
        status.alias("status"), F.col("_old.corrected_value").alias("corrected_value"), note.alias("note"),
    )


def item_id() -> Column:
    """KEY as one value, for decisions to name."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in KEY])


#: A single decision beside rows.
SINGLE = "struct<seq:bigint,status:string,corrected:string>"


def decide(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows after decisions in order, as ``review.states`` has them; what is approved before them isn't pending to bulk ones."""
    items = rows.select("tender_id", item_id().alias("item_id"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(SINGLE).alias("_single"))
    # the tender stands in an item's name
    named = F.split_part("item_id", F.lit("|"), F.lit(1)).try_cast("long")
    single = decisions.filter("item_id IS NOT NULL").select(named.alias("tender_id"), "item_id", F.struct("seq", "status", "corrected").cast(SINGLE).alias("_single"))
    return decided(items.unionByName(single, allowMissingColumns=True), decisions)


def decided(entries: DataFrame, bulk: DataFrame, of: Column | None = None, salts: int = 16) -> DataFrame:
    """``decide`` of rows (tender_id, item_id, _row) and single decisions (tender_id, item_id, _single) in one
    table. ``of`` tells of a row whether decisions are of it; all by default. They meet in sorted passes,
    so that what is dealt by tender already is not shuffled; with ``salts`` a tender's rows meet its bulk decisions in so many parts."""
    corrected = review.written("_single.corrected")
    made = F.when(review.holds(F.col("_single.status"), corrected), F.struct(F.col("_single.seq").alias("seq"), F.col("_single.status").alias("status"), corrected.alias("corrected")))
    last = F.max(made).over(Window.partitionBy("tender_id", "item_id"))
    columns = entries.schema["_row"].dataType.names
    carry = {c: f"_row_{c}" for c in columns if c != "tender_id"}  # the tender stays a column of its own, as rows are dealt by it
    own = entries.withColumn("_last", last).filter("_row IS NOT NULL").select(
        "item_id", "tender_id", F.coalesce("_row.status", F.lit("pending")).alias("_first"),
        F.struct(*[F.col(f"_row.{c}").alias(o) for c, o in carry.items()]).alias("_carry"), "_last", F.lit(None).cast("struct<seq:bigint,blind:string>").alias("_blind"),
    )
    moving = ("status", "corrected_value")
    after = review.after_bulk(own, bulk, salts, tuple(carry.values())).select(
        "tender_id", *[F.col(o).alias(c) for c, o in carry.items() if c not in moving], "decided_by",
        *[F.struct(F.col(carry[c]).alias("was"), F.col(c).alias("made")).alias(f"_{c}") for c in moving],
    )
    moved = F.col("decided_by").isNotNull() & (F.lit(True) if of is None else of)
    return after.select(*[F.when(moved, F.col(f"_{c}.made")).otherwise(F.col(f"_{c}.was")).alias(c) if c in moving else F.col(c) for c in columns])


def trusted(rows: DataFrame, least: float = TRUST) -> DataFrame:
    """The rows that decisions may rest on, with the corrected value where there is one:
    decided ones, and sure enough ones that are not rejected. No state is no trust."""
    held = (F.col("status") != "rejected") & (F.col("status").isin(*DECIDED) | (F.col("confidence") >= least))
    return rows.filter(held).withColumn("value", F.coalesce("corrected_value", "value"))


def short_form(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """A row for each tender: how many rows are not rejected, and of them documents',
    mandatory, unsure, pending and decided ones; and for each kind the value of the best
    row: a decided one, then the surest, then the first. Partial aggregates only."""
    live = rows.filter(F.col("status") != "rejected")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    value = F.coalesce("corrected_value", "value")
    decided = F.col("status").isin(*DECIDED)
    rank = F.struct(decided, F.col("confidence"), -F.col("position_no"), -F.col("ref"), value)
    return live.groupBy("tender_id").agg(
        F.count("*").alias("n"), count(F.col("source") == "document").alias("of_documents"), count(F.col("mandatory")).alias("mandatory"),
        count(F.col("confidence") < REVIEWED).alias("unsure"), count(F.col("status") == "pending").alias("pending"), count(decided).alias("decided"),
        *[F.max_by(value, F.when(F.col("name") == k, rank)).alias(k) for k in kinds],
    )


def prints(rows: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """n, min_confidence and print of what was written of each tender, and of each run where columns tell them
    ``apart``. The print is the count and two exact sums of hashes, so that the order of rows
    and the number of tasks don't change it, and no tender's rows are brought together."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in KEY[1:] + WRITTEN[:-1]]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *text).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(*apart, "tender_id").agg(F.count("*").alias("n"), F.min("confidence").alias("min_confidence"), F.concat_ws(":", F.count("*"), total(1), total(2)).alias("print"))


def status_of(n: Column, nothing: str = "no_text") -> Column:
    return F.when(n.isNull(), nothing).otherwise("ok")


def runs(rows: DataFrame, tenders: DataFrame, nothing: str = "no_text") -> DataFrame:
    """The log of an extraction: for each tender (tender_id) that it was run over status,
    n, min_confidence and print, ``nothing`` being the status of one without rows."""
    own = tenders.select("tender_id").filter("tender_id IS NOT NULL").distinct().join(prints(rows), "tender_id", "left")
    return own.select("tender_id", status_of(F.col("n"), nothing).alias("status"), F.coalesce("n", F.lit(0)).alias("n"), "min_confidence", "print")


def renewed(rows: DataFrame, log: DataFrame, before: DataFrame) -> DataFrame:
    """The rows of tenders whose print is another than that of the run before: only those are written again."""
    was = before.select("tender_id", F.col("print").alias("_was"))
    other = log.join(was, "tender_id", "left").filter(~F.col("print").eqNullSafe(F.col("_was"))).select("tender_id")
    return rows.join(other, "tender_id", "left_semi")


def is_due(close_at: Column, run: Column, text: Column, now: str) -> Column:
    """Whether a tender is open and no run (its status) was over it, or one that found no text while there is some now."""
    is_open = close_at.isNull() | (close_at > F.lit(now).cast("timestamp"))
    return is_open & (run.isNull() | F.coalesce((run == "no_text") & text, F.lit(False)))


def due(tenders: DataFrame, log: DataFrame, with_text: DataFrame, now: str) -> DataFrame:
    """Tenders (tender_id, close_at) that are due."""
    text = with_text.select("tender_id", F.lit(True).alias("_text")).distinct()
    known = tenders.join(log.select("tender_id", F.col("status").alias("_run")), "tender_id", "left").join(text, "tender_id", "left")
    return known.filter(is_due(F.col("close_at"), F.col("_run"), F.col("_text"), now)).drop("_run", "_text")
