"""Decisions and money: pricing, stock, qualification, checklists, requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.numbers import round2, validity

def waterfall(df: DataFrame) -> DataFrame:
    """The price of each row from its cost, each step rounded to cents.

    Columns in: cost_base, logistics_percent, logistics_fixed, risk_percent,
    risk_fixed, markup_percent, vat_percent, manual_price, budget. A negative
    input, or VAT over 100, makes an error and no figures.
    """
    inputs = ["cost_base", "logistics_percent", "logistics_fixed", "risk_percent", "risk_fixed", "markup_percent", "vat_percent", "manual_price"]
    checks = [F.when(F.coalesce(F.col(c), F.lit(0)) < 0, F.lit(f"{c}_negative")) for c in inputs]
    errors = F.filter(F.array(*checks, F.when(F.col("vat_percent") > 100, F.lit("vat_range"))), lambda x: x.isNotNull())
    c = F.col
    steps = {
        "cost_base": c("cost_base"),
        "logistics": c("cost_base") * c("logistics_percent") / 100.0 + c("logistics_fixed"),
        "risk": (c("cost_base") + c("logistics")) * c("risk_percent") / 100.0 + c("risk_fixed"),
        "total_cost": c("cost_base") + c("logistics") + c("risk"),
        "markup": c("total_cost") * c("markup_percent") / 100.0,
        "price_ex_vat": c("total_cost") + c("markup"),
        "vat": c("price_ex_vat") * c("vat_percent") / 100.0,
        "recommended": c("price_ex_vat") + c("vat"),
        "final_price": F.coalesce(c("manual_price"), c("recommended")),
        "final_ex_vat": c("final_price") / (1.0 + c("vat_percent") / 100.0),
        "profit": c("final_ex_vat") - c("total_cost"),
    }
    out = df.withColumn("errors", errors)
    for name, value in steps.items():
        out = out.withColumn(name, round2(value))
    out = out.withColumn("profit_percent", F.when(c("final_ex_vat") != 0, round2(c("profit") / c("final_ex_vat") * 100)).otherwise(0.0))
    out = out.withColumn("budget_left", F.when(c("budget").isNotNull(), round2(c("budget") - c("final_price"))))
    ok = F.size("errors") == 0
    for name in [*steps, "profit_percent", "budget_left"]:
        out = out.withColumn(name, F.when(ok, c(name)))
    warn = F.array(F.when(c("budget_left") < 0, "over_budget"), F.when(c("profit") < 0, "loss").when(c("profit") == 0, "zero_profit"))
    return out.withColumn("warnings", F.filter(warn, lambda x: x.isNotNull()))


def allocate(positions: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Stock given out to positions in order: product_id, required, stock, unit_ok in;
    status and shortfall out. Positions without a usable unit, quantity or stock
    take nothing; the first one that stock doesn't cover takes what is left.

    The running need of a product is what earlier blocks need in all, and a window sum
    inside the block, so that a product that most positions ask for is many tasks' work.
    The order must be total, and ``block`` must never fall along it.
    """
    usable = F.coalesce(F.col("unit_ok"), F.lit(False)) & F.col("required").isNotNull() & F.col("stock").isNotNull()
    rows = positions.withColumns({"_block": block, "_own": F.when(usable, F.col("required")).otherwise(0)})
    earlier = Window.partitionBy("product_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("product_id", "_block").agg(F.sum("_own").alias("_sum"))
    sums = sums.select(F.col("product_id").alias("_p"), F.col("_block").alias("_b"), F.sum("_sum").over(earlier).alias("_before"))
    inside = Window.partitionBy("product_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.join(sums, F.col("product_id").eqNullSafe(F.col("_p")) & F.col("_block").eqNullSafe(F.col("_b")))
    out = both.withColumn("_need", F.coalesce("_before", F.lit(0)) + F.sum("_own").over(inside))
    enough = (F.col("required") == 0) | (F.col("_need") <= F.col("stock"))
    short = F.least(F.col("required"), F.col("_need") - F.col("stock"))
    return out.withColumn("status", F.when(~usable, "unknown").when(enough, "enough").otherwise("short")).withColumn(
        "shortfall", F.when(usable & ~enough, short)
    ).drop("_need", "_own", "_before", "_block", "_p", "_b")


def qualify(df: DataFrame) -> DataFrame:
    """Criteria of a company against a tender, and a decision: any confirmed failure
    is no_go, three met and no risk go, all else review. A failure that no one
    has confirmed is a risk.

    Columns in: missing_documents, lead_days, delivery_days, capacity, cost,
    advance_percent, experience, experience_needed, confirmed, area_path, regions
    (paths that the company works in), certificates_held and certificates_needed.
    """
    fail = F.when(F.col("confirmed"), "fail").otherwise("risk")
    c = F.col
    criteria = {
        "documents": F.when(c("missing_documents").isNull(), "unknown").when(c("missing_documents") == 0, "ok").otherwise(fail),
        "delivery": F.when(c("lead_days").isNull() | c("delivery_days").isNull(), "unknown").when(c("lead_days") <= c("delivery_days"), "ok").otherwise(fail),
        "finance": F.when(c("capacity").isNull() | c("cost").isNull(), "unknown").when(c("cost") > c("capacity"), "fail").otherwise("ok"),
        "payment": F.when(c("advance_percent").isNull(), "unknown").when(c("advance_percent") >= 30, "ok").otherwise("risk"),
        "experience": F.when(c("experience_needed").isNull() | c("experience").isNull(), "unknown").when(c("experience") >= c("experience_needed"), "ok").otherwise(fail),
        "region": F.when(c("area_path").isNull() | (F.coalesce(F.size("regions"), F.lit(0)) <= 0), "unknown").when(F.exists("regions", lambda r: (c("area_path") == r) | c("area_path").startswith(F.concat(r, F.lit(".")))), "ok").otherwise("risk"),
        "safety": F.when(c("certificates_needed").isNull() | (F.size("certificates_needed") == 0), "unknown").when(F.size(F.array_except("certificates_needed", F.coalesce("certificates_held", F.array().cast("array<string>")))) == 0, "ok").otherwise(fail),
    }
    out = df
    for name, status in criteria.items():
        out = out.withColumn(name, status)
    count = lambda s: sum(((F.col(n) == s).cast("int") for n in criteria), F.lit(0))
    decision = F.when(count("fail") > 0, "no_go").when((count("ok") >= 3) & (count("risk") == 0), "go").otherwise("review")
    return out.withColumn("decision", decision)


def checklist(required: DataFrame, documents: DataFrame, today: str) -> DataFrame:
    """The best document of each required type (doc_type, company): valid before
    expiring, expired and missing ones, perpetual first, then the latest expiry."""
    rank = F.expr("CASE state WHEN 'ok' THEN 0 WHEN 'expiring_soon' THEN 1 WHEN 'expired' THEN 2 ELSE 3 END")
    state = validity(F.col("valid_until"), F.col("perpetual"), F.lit(today).cast("date"))
    both = required.join(documents, ["company", "doc_type"], "left").withColumn("state", F.when(F.col("doc_id").isNull(), "missing").otherwise(state))
    w = Window.partitionBy("company", "doc_type").orderBy(rank, F.desc_nulls_last("perpetual"), F.desc_nulls_last("valid_until"), "doc_id")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
