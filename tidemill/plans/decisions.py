"""Pricing, stock, qualification, checklists, text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import numbers, text as tx
from tidemill.operators import decisions as op
from tidemill.plans.registry import query
from tidemill.sources.tables import goods, table, tenders

R2 = "sign({x}) * floor(abs({x}) * 100 + 1e-9 + 0.5) / 100"
r2 = lambda x: R2.format(x=f"({x})")


@query(f"""
i AS (SELECT tender_id, sum({r2('amount::DOUBLE * 12.345')}) AS c0 FROM goods GROUP BY 1),
a AS (SELECT tender_id, {r2('c0')} AS cost_base, (tender_id % 5)::DOUBLE AS lp, (tender_id % 9)::DOUBLE AS rp, (tender_id % 30)::DOUBLE AS mp,
  CASE WHEN tender_id % 11 = 0 THEN 1000.0 END AS manual, CASE WHEN tender_id % 3 = 0 THEN 2000.0 END AS budget FROM i),
b AS (SELECT *, {r2('cost_base * lp / 100.0 + 10.5')} AS logistics FROM a),
c AS (SELECT *, {r2('(cost_base + logistics) * rp / 100.0 + 0')} AS risk FROM b),
d AS (SELECT *, {r2('cost_base + logistics + risk')} AS total_cost FROM c),
e AS (SELECT *, {r2('total_cost * mp / 100.0')} AS markup FROM d),
f AS (SELECT *, {r2('total_cost + markup')} AS price_ex_vat FROM e),
g AS (SELECT *, {r2('price_ex_vat * 12.0 / 100.0')} AS vat FROM f),
h AS (SELECT *, {r2('price_ex_vat + vat')} AS recommended FROM g),
j AS (SELECT *, {r2('coalesce(manual, recommended)')} AS final_price FROM h),
k AS (SELECT *, {r2('final_price / (1.0 + 12.0 / 100.0)')} AS final_ex_vat FROM j),
l AS (SELECT *, {r2('final_ex_vat - total_cost')} AS profit FROM k)
SELECT tender_id, total_cost, recommended, final_price, profit, {r2('budget - final_price')} AS budget_left,
  coalesce(budget - final_price < -0.004, FALSE) AS over_budget FROM l""")
def pricing_waterfall(spark, sf_dir):
    """Every step rounded, a manual price over the recommended one."""
    item = numbers.round2(F.col("amount").cast("double") * 12.345)
    i = goods(spark, sf_dir).groupBy("tender_id").agg(F.sum(item).alias("c0"))
    d = lambda n: (F.col("tender_id") % n).cast("double")
    inputs = i.select(
        "tender_id", numbers.round2(F.col("c0")).alias("cost_base"), d(5).alias("logistics_percent"), F.lit(10.5).alias("logistics_fixed"),
        d(9).alias("risk_percent"), F.lit(0.0).alias("risk_fixed"), d(30).alias("markup_percent"), F.lit(12.0).alias("vat_percent"),
        F.when(d(11) == 0, 1000.0).alias("manual_price"), F.when(d(3) == 0, 2000.0).alias("budget"),
    )
    out = op.waterfall(inputs)
    return out.select("tender_id", "total_cost", "recommended", "final_price", "profit", "budget_left", F.array_contains("warnings", "over_budget").alias("over_budget"))


POSITIONS = """
p AS (SELECT tender_id, lot_id, product_id, amount, totalcost, CASE WHEN lot_id = 7 THEN NULL ELSE amount END AS required,
  CASE WHEN product_id % 13 = 0 THEN NULL ELSE (product_id % 400)::DECIMAL(18,3) END AS stock, product_id % 17 <> 0 AS unit_ok FROM goods),
u AS (SELECT *, coalesce(unit_ok AND required IS NOT NULL AND stock IS NOT NULL, FALSE) AS usable FROM p),
w AS (SELECT *, sum(CASE WHEN usable THEN required ELSE 0 END) OVER (PARTITION BY product_id ORDER BY tender_id, lot_id, totalcost, amount ROWS UNBOUNDED PRECEDING) AS need FROM u)"""


@query(f"""{POSITIONS}
SELECT product_id, CASE WHEN NOT usable THEN 'unknown' WHEN required = 0 OR need <= stock THEN 'enough' ELSE 'short' END AS status, count(*) AS n,
  sum(CASE WHEN usable AND NOT (required = 0 OR need <= stock) THEN least(required, need - stock) END)::DOUBLE AS shortfall
FROM w GROUP BY ALL""")
def stock_allocation(spark, sf_dir):
    """A shared stock given out in order as a running window sum."""
    g = goods(spark, sf_dir)
    positions = g.select(
        "tender_id", "lot_id", "product_id", "amount", "totalcost", F.when(F.col("lot_id") != 7, F.col("amount")).alias("required"),
        F.when(F.col("product_id") % 13 != 0, (F.col("product_id") % 400).cast("decimal(18,3)")).alias("stock"), (F.col("product_id") % 17 != 0).alias("unit_ok"),
    )
    # tenders of one block come one after the other
    out = op.allocate(positions, ["tender_id", "lot_id", "totalcost", "amount"], F.floor(F.col("tender_id") / 4096))
    return out.groupBy("product_id", "status").agg(F.count("*").alias("n"), F.sum("shortfall").cast("double").alias("shortfall"))


@query("""
x AS (SELECT id, id % 4 AS missing, id % 25 AS lead, CASE WHEN id % 6 > 0 THEN id % 31 END AS delivery, 200000.0 AS capacity, totalcost::DOUBLE AS cost,
  CASE WHEN id % 3 > 0 THEN id % 60 END AS advance, id % 9 AS exp, CASE WHEN id % 2 = 0 THEN 3 END AS needed, id % 5 <> 0 AS confirmed, area_path,
  id % 3 AS held, id % 4 AS certs FROM tenders),
c AS (SELECT *, CASE WHEN confirmed THEN 'fail' ELSE 'risk' END AS f FROM x),
s AS (SELECT id, [CASE WHEN missing = 0 THEN 'ok' ELSE f END, CASE WHEN delivery IS NULL THEN 'unknown' WHEN lead <= delivery THEN 'ok' ELSE f END,
  CASE WHEN cost > capacity THEN 'fail' ELSE 'ok' END, CASE WHEN advance IS NULL THEN 'unknown' WHEN advance >= 30 THEN 'ok' ELSE 'risk' END,
  CASE WHEN needed IS NULL THEN 'unknown' WHEN exp >= needed THEN 'ok' ELSE f END,
  CASE WHEN area_path IS NULL THEN 'unknown' WHEN area_path = '1' OR starts_with(area_path, '1.') OR starts_with(area_path, '3.') THEN 'ok' ELSE 'risk' END,
  CASE WHEN certs = 0 THEN 'unknown' WHEN held >= 1 AND (certs < 3 OR held = 2) THEN 'ok' ELSE f END] AS l FROM c)
SELECT id, CASE WHEN list_contains(l, 'fail') THEN 'no_go' WHEN len(list_filter(l, lambda y: y = 'ok')) >= 3 AND NOT list_contains(l, 'risk') THEN 'go' ELSE 'review' END AS decision FROM s""")
def qualification_decision(spark, sf_dir):
    """Seven criteria by case expressions, one decision for each tender."""
    i = F.col("id")
    held = F.when(i % 3 == 2, F.array(F.lit("fire"), F.lit("works"))).when(i % 3 == 1, F.array(F.lit("works")))
    needed = F.when(i % 4 == 3, F.array(F.lit("works"), F.lit("fire"))).when(i % 4 > 0, F.array(F.lit("works")))
    x = tenders(spark, sf_dir).select(
        "id", (i % 4).alias("missing_documents"), (i % 25).alias("lead_days"), F.when(i % 6 > 0, i % 31).alias("delivery_days"), F.lit(200000.0).alias("capacity"),
        F.col("totalcost").cast("double").alias("cost"), F.when(i % 3 > 0, i % 60).alias("advance_percent"), (i % 9).alias("experience"),
        F.when(i % 2 == 0, F.lit(3)).alias("experience_needed"), (i % 5 != 0).alias("confirmed"),
        "area_path", F.array(F.lit("1"), F.lit("3")).alias("regions"), held.alias("certificates_held"), needed.alias("certificates_needed"),
    )
    return op.qualify(x).select("id", "decision")


@query("""
r AS (SELECT c_custkey AS company, unnest(['license', 'charter', 'audit']) AS doc_type FROM customer),
d AS (SELECT o_orderkey AS doc_id, o_custkey AS company, CASE o_orderkey % 3 WHEN 0 THEN 'license' WHEN 1 THEN 'charter' ELSE 'other' END AS doc_type,
  o_orderkey % 10 = 0 AS perpetual, CASE WHEN o_orderkey % 8 > 0 THEN o_orderdate::DATE END AS valid_until FROM orders),
s AS (SELECT r.company, r.doc_type, doc_id, perpetual, valid_until, CASE WHEN doc_id IS NULL THEN 'missing' WHEN perpetual THEN 'ok' WHEN valid_until IS NULL THEN 'missing'
  WHEN valid_until < DATE '1998-07-01' THEN 'expired' WHEN valid_until <= DATE '1998-07-31' THEN 'expiring_soon' ELSE 'ok' END AS state
  FROM r LEFT JOIN d ON d.company = r.company AND d.doc_type = r.doc_type),
n AS (SELECT *, row_number() OVER (PARTITION BY company, doc_type ORDER BY CASE state WHEN 'ok' THEN 0 WHEN 'expiring_soon' THEN 1 WHEN 'expired' THEN 2 ELSE 3 END,
  perpetual DESC NULLS LAST, valid_until DESC NULLS LAST, doc_id) AS k FROM s)
SELECT company, doc_type, doc_id, state FROM n WHERE k = 1""", views=False)
def checklist_best_doc(spark, sf_dir):
    """The best document of each required type."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    docs = o.select(
        k.alias("doc_id"), F.col("o_custkey").alias("company"), F.when(k % 3 == 0, "license").when(k % 3 == 1, "charter").otherwise("other").alias("doc_type"),
        (k % 10 == 0).alias("perpetual"), F.when(k % 8 > 0, F.col("o_orderdate").cast("date")).alias("valid_until"),
    )
    need = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company"), F.explode(F.array(*map(F.lit, ("license", "charter", "audit")))).alias("doc_type"))
    return op.checklist(need, docs, "1998-07-01").select("company", "doc_type", "doc_id", "state")


@query("""
SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '(?i)licen[sc]e')) AS licences,
  nullif(regexp_extract(text, '(?i)version\\s+([0-9]+)', 1), '') AS version FROM documents""", views=False)
def requirement_regex_counts(spark, sf_dir):
    """What patterns count in each text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"), F.regexp_count("text", F.lit("(?i)licen[sc]e")).cast("long").alias("licences"),
        F.nullif(F.regexp_extract("text", r"(?i)version\s+([0-9]+)", 1), F.lit("")).alias("version"),
    )


@query("SELECT doc_id, translate(replace(replace(lower(text), 'ь', ''), 'ъ', ''), 'эёыйщ', 'ееииш') AS folded FROM documents", views=False)
def text_fold(spark, sf_dir):
    """X1."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'),
  '[\\x00-\\x08\\x0b-\\x1f\\x7f]', ' ', 'g'), '[ \\t\u00a0]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM documents""", views=False)
def text_clean(spark, sf_dir):
    """X10."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query("""
x AS (SELECT doc_id, text, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS n FROM documents)
SELECT doc_id, CASE WHEN length(text) < 20 THEN 'empty' WHEN n < 40 THEN 'unreadable' ELSE 'ok' END AS state, greatest(1, length(text) // 4) AS tokens FROM x""", views=False)
def quality_gate(spark, sf_dir):
    """X12, X15."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.quality(F.col("text")).alias("state"), tx.token_estimate(F.col("text")).alias("tokens"))


@query("""
x AS (SELECT doc_id, length(regexp_replace(text, '[^\u0400-\u04ff]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents)
SELECT doc_id, CASE WHEN c + l < 20 THEN NULL WHEN c >= 2 * l THEN 'ru' WHEN l >= 2 * c THEN 'uz' END AS guess FROM x""", views=False)
def lang_guess(spark, sf_dir):
    """X13."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.guess_language(F.col("text")).alias("guess"))


@query("""
SELECT conv_id, sum(length(text) // 4)::BIGINT AS tokens, round(sum(CASE role WHEN 'assistant' THEN length(text) // 4 * 15 ELSE length(text) // 4 * 3 END) / 1000000.0, 6) AS cost
FROM conversations GROUP BY 1""", views=False)
def token_cost(spark, sf_dir):
    """What a conversation costs by token prices."""
    n = F.floor(F.length("text") / 4)
    c = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return c.agg(F.sum(n).alias("tokens"), F.round(F.sum(F.when(F.col("role") == "assistant", n * 15).otherwise(n * 3)) / 1000000.0, 6).alias("cost"))


@query()
def translit_variants(spark, sf_dir):
    """Spellings of part names in both alphabets."""
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", tx.variants(F.col("p_name")).alias("variants"))


@query()
def chunk_documents(spark, sf_dir):
    """Spans for retrieval, cut at sentence and paragraph ends."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(tx.chunked(F.col("text"))).alias("chunk_no", "span"))
    return d.select("doc_id", "chunk_no", "span.start", "span.end", F.sha2(F.expr("substring(text, span.start + 1, span.end - span.start)"), 256).alias("hash"))
