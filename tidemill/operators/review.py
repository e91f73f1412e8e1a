"""Human review: states out of ordered decisions, and the sample that a pilot begins with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
STATES = ("pending", "approved", "rejected", "corrected")
BULK_STATES = ("approved", "rejected")
LONGEST_VALUE = 2000


def written(c: Column | str) -> Column:
    """A written value without white space around it, cut to its longest; null if nothing is left."""
    own = F.substring(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), 1, LONGEST_VALUE)
    return F.nullif(own, F.lit(""))


def holds(status: Column, corrected: Column) -> Column:
    """Whether a single decision is one: of a known state, and a correction with a value."""
    return status.isin(*STATES) & ((status != "corrected") | corrected.isNotNull())


def states(items: DataFrame, decisions: DataFrame, salts: int = 16, initial: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """What decisions in order of seq make of items (item_id, tender_id), which are pending
    before them or in the state that ``initial`` gives.

    A decision (seq, item_id, tender_id, status, corrected, blind) is of one item, or with a
    null item_id of all items of the tender that are pending then. ``corrected`` needs a
    value and other states clear it; the first blind value stays, whatever comes later.
    Decisions of an unknown state, corrections without a value and bulk ones other than
    approved and rejected are void, blind value included. seq must be total: of equal ones a
    bulk decision comes first, and of single ones the larger row counts.

    Returns item_id, tender_id, status, corrected_value, blind_value, decided_by (single,
    bulk or null), decided_seq and the columns to ``carry``. Only the last single decision
    of an item and the first bulk one after it can tell, so nothing is folded row by row:
    single ones are a partial aggregate, and bulk ones meet salted parts of a tender in one
    sorted pass.
    """
    d = decisions.withColumns({"corrected": written("corrected"), "blind": written("blind")})
    single = d.filter(F.col("item_id").isNotNull() & holds(F.col("status"), F.col("corrected")))
    last = single.groupBy("item_id").agg(
        F.max(F.struct("seq", "status", "corrected")).alias("_last"),
        F.min(F.when(F.col("blind").isNotNull(), F.struct("seq", "blind"))).alias("_blind"),
    )
    first = F.coalesce(F.lit(None) if initial is None else initial, F.lit("pending"))
    own = items.select("item_id", "tender_id", first.alias("_first"), F.struct(*carry, F.lit(0).alias("_")).alias("_carry")).join(last, "item_id", "left")
    return after_bulk(own, d, salts, carry)


def after_bulk(own: DataFrame, d: DataFrame, salts: int, carry: tuple[str, ...]) -> DataFrame:
    """The second half of ``states``: items (item_id, tender_id, _first, _carry) with their last single
    decision (_last) and first blind value (_blind), and what bulk decisions make of them. Items and
    decisions that are dealt by tender already are not shuffled again."""
    parts = [F.col("tender_id"), F.pmod(F.xxhash64("item_id"), F.lit(salts)).cast("int").alias("_salt"), F.col("_last.seq").alias("_seq")]
    rows = own.select("item_id", *parts, "_first", "_carry", "_last", "_blind", F.lit(None).cast("struct<seq:bigint,status:string>").alias("_bulk"))
    bulk = d.filter(F.col("item_id").isNull() & F.col("tender_id").isNotNull() & F.col("status").isin(*BULK_STATES))
    bulk = bulk.select(
        "tender_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.col("seq").alias("_seq"),
        F.struct(F.col("seq").cast("long").alias("seq"), "status").alias("_bulk"), F.lit(True).alias("_is_bulk"),
    )
    # from the latest back, so that the last bulk decision met is the first one after the row
    back = Window.partitionBy("tender_id", "_salt").orderBy(F.desc_nulls_last("_seq"), F.col("_is_bulk").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(bulk, allowMissingColumns=True).withColumn("_next", F.last("_bulk", ignorenulls=True).over(back)).filter("_is_bulk IS NULL")
    status = F.coalesce("_last.status", "_first")
    by_bulk = (status == "pending") & F.col("_next").isNotNull()
    return both.select(
        "item_id", "tender_id",
        F.when(by_bulk, F.col("_next.status")).otherwise(status).alias("status"),
        F.when(status == "corrected", F.col("_last.corrected")).alias("corrected_value"),
        F.col("_blind.blind").alias("blind_value"),
        F.when(by_bulk, "bulk").when(F.col("_last").isNotNull(), "single").alias("decided_by"),
        F.when(by_bulk, F.col("_next.seq")).otherwise(F.col("_last.seq").cast("long")).alias("decided_seq"),
        *[F.col(f"_carry.{c}").alias(c) for c in carry],
    )


def pilot(tenders: DataFrame, now: str, each: int = 10, blind: int = 10, seed: str = "0.42") -> DataFrame:
    """A pilot's tenders (id, close_at, totalcost): the nearest deadlines, those of the
    smallest seeded hash, the dearest, ``each`` of a stratum at most and once in all (the
    first stratum keeps it), dealt out stratum by stratum; the first ``blind`` are blind.

    The hash is of seed and id alone, so that partitions don't change the sample; ties go
    to the smaller id, and of rows with one id the earliest deadline counts. Each stratum is a distributed top k; the rest is 3 x each rows."""
    order = {
        "deadline": (F.col("close_at") > F.lit(now).cast("timestamp"), [F.asc("close_at")]),
        "random": (F.lit(True), [F.asc("_hash")]),
        "value": (F.col("totalcost").isNotNull(), [F.desc("totalcost")]),
    }
    once = tenders.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("close_at", "totalcost")).alias("t"))
    t = once.select("id", "t.*", F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))).alias("_hash"))
    picked = None
    for n, (name, (held, by)) in enumerate(order.items()):
        top = t.filter(held).orderBy(*by, "id").limit(each)
        top = top.select("id", F.lit(name).alias("stratum"), F.lit(n).alias("_n"), F.row_number().over(Window.partitionBy(F.lit(n)).orderBy(*by, "id")).alias("_rank"))
        picked = top if picked is None else picked.unionByName(top)
    once = picked.groupBy("id").agg(F.min(F.struct("_n", "_rank", "stratum")).alias("p")).select("id", "p.*")
    dealt = once.withColumn("_round", F.row_number().over(Window.partitionBy("_n").orderBy("_rank")))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_round", "_n"))
    return dealt.select("id", "stratum", place.alias("place")).withColumn("mode", F.when(F.col("place") <= blind, "blind").otherwise("anchored"))
