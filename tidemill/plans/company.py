"""Queries of a company's own work: isolation, imports, states, matches, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import numbers
from tidemill.operators import company as op
from tidemill.operators.search import is_open
from tidemill.plans.registry import query
from tidemill.plans.search import OPEN
from tidemill.sources.tables import AS_OF, goods, table, tenders


@query("SELECT o_orderkey AS id, o_totalprice AS cost FROM orders WHERE o_custkey = 7", views=False)
def tenant_rows(spark, sf_dir):
    """what one company sees of a private table."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "company")
    return op.own(o, 7).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("cost"))


@query("""
i AS (SELECT DISTINCT product_id % 5 AS company, lower(trim(name)) AS k FROM goods),
e AS (SELECT DISTINCT p_size % 5 AS company, lower(trim(p_name)) AS k, 1 AS had FROM part)
SELECT company, count(*) FILTER (WHERE had IS NULL) AS inserted, count(had) AS updated FROM i LEFT JOIN e USING (company, k) GROUP BY 1""")
def import_forecast(spark, sf_dir):
    """A scoped import by names, as a forecast of what it inserts and updates."""
    incoming = goods(spark, sf_dir).select((F.col("product_id") % 5).alias("company"), "name")
    existing = table(spark, sf_dir, "part").select((F.col("p_size") % 5).cast("long").alias("company"), F.col("p_name").alias("name"))
    return op.forecast(op.scoped_upsert(existing, incoming, "company", "name"), "company")


STEPS = {"view": "open", "click": "search", "purchase": "decide", "error": "change"}


def _steps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    step = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in STEPS.items()])
    return e.select("event_id", "user_id", F.col("ts").alias("at"), step.alias("step"))


@query("""
s AS (SELECT user_id AS routing_id, min(ts) FILTER (WHERE event_type = 'view') AS o, max(ts) FILTER (WHERE event_type = 'purchase') AS d, max(ts) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY 1)
SELECT routing_id, CASE WHEN d IS NOT NULL THEN 'closed' WHEN o IS NOT NULL THEN 'in_progress' ELSE 'new' END AS status,
  c IS NOT NULL AND (d IS NULL OR c > d) AS changed FROM s""", views=False)
def routing_states(spark, sf_dir):
    """Routings opened, decided and changed again."""
    return op.routed(_steps(spark, sf_dir).withColumnRenamed("user_id", "routing_id")).select("routing_id", "status", "changed")


@query("""
s AS (SELECT user_id % 20 AS company, event_id % 50 AS key, event_type, row_number() OVER w AS n,
  coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 20, event_id % 50 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row
  FROM events WINDOW w AS (PARTITION BY user_id % 20, event_id % 50 ORDER BY ts, event_id)),
o AS (SELECT *, min(CASE WHEN event_type = 'view' THEN n END) OVER (PARTITION BY company, key, row) AS opened_at FROM s)
SELECT company, key, row, bool_or(event_type = 'view') AS opened, bool_or(event_type = 'purchase') AS closed,
  count(*) FILTER (WHERE event_type = 'click' AND n > opened_at) AS searches FROM o GROUP BY ALL HAVING opened OR closed""", views=False)
def coding_decisions(spark, sf_dir):
    """One open decision a key, its searches, closed or made closed."""
    s = _steps(spark, sf_dir).select((F.col("user_id") % 20).alias("company"), (F.col("event_id") % 50).alias("key"), "step", "at", "event_id")
    return op.decision_rows(s, ["company", "key"], ["at", "event_id"]).select("company", "key", "row", "opened", "closed", "searches")


@query("""
v AS (SELECT lower(p_name) AS key, lpad(p_size::VARCHAR, 2, '0') AS code, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': CASE l_returnflag WHEN 'A' THEN 'confirmed' ELSE 'rejected' END} AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N'),
d AS (SELECT key, code, max(s).d AS state FROM v GROUP BY ALL)
SELECT p_partkey AS product_id, d.code, state FROM part JOIN d ON key = lower(p_name)""", views=False)
def code_confirmations(spark, sf_dir):
    """The last word on each code, for all products of the same name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.lower("p_name").alias("key"), F.lpad(F.col("p_size").cast("string"), 2, "0").alias("code"))
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'")
    state = F.when(F.col("l_returnflag") == "A", "confirmed").otherwise("rejected").alias("state")
    votes = li.join(p, F.col("l_partkey") == F.col("product_id")).select("key", "code", "l_shipdate", "l_orderkey", "l_linenumber", state)
    return op.confirmed(votes, p.drop("code"), ["l_shipdate", "l_orderkey", "l_linenumber"])


@query(f"""
p AS (SELECT DISTINCT tender_id, lot_id FROM goods),
r AS (SELECT l_orderkey AS tender_id, l_linenumber AS lot_id, count(*) AS rejected FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT tender_id, lot_id, coalesce(rejected, 0) AS rejected, CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS is_open
FROM p LEFT JOIN r USING (tender_id, lot_id) LEFT JOIN (SELECT id FROM tenders WHERE {OPEN}) t ON t.id = tender_id""")
def pilot_reviews(spark, sf_dir):
    """Positions with their reviews and whether their tender is open, by two keys."""
    p = goods(spark, sf_dir).select("tender_id", "lot_id").distinct()
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    r = li.groupBy(F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("lot_id")).agg(F.count("*").alias("rejected"))
    t = tenders(spark, sf_dir).filter(is_open(AS_OF)).select(F.col("id").alias("tender_id"), F.lit(1).alias("is_open"))
    return p.join(r, ["tender_id", "lot_id"], "left").join(t, "tender_id", "left").na.fill(0, ["rejected", "is_open"])


@query("""
h AS (SELECT o_custkey AS company, list(DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'license' WHEN 1 THEN 'charter' ELSE 'other' END) AS held FROM orders GROUP BY 1)
SELECT c_custkey AS company, array_to_string(list_sort(list_filter(['license', 'charter', 'audit'], lambda x: NOT list_contains(coalesce(held, []), x))), ',') AS missing
FROM customer LEFT JOIN h ON company = c_custkey""", views=False)
def missing_documents(spark, sf_dir):
    """U4: required document types less those a company has."""
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "license").when(k % 3 == 1, "charter").otherwise("other")
    held = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.collect_set(kind).alias("held"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company")).join(held, "company", "left")
    need = F.array(*map(F.lit, ("license", "charter", "audit")))
    return c.select("company", F.array_join(F.array_sort(F.array_except(need, F.coalesce("held", F.array().cast("array<string>")))), ",").alias("missing"))


@query("""
SELECT doc_id, CASE WHEN contains(c, ' bank guarantee ') OR contains(c, ' guarantee letter ') THEN 'guarantee' WHEN contains(c, ' recommendation ') THEN 'reference' WHEN contains(c, ' certificate ') THEN 'certificate'
  WHEN contains(c, ' reference ') THEN 'reference' WHEN contains(c, ' charter ') THEN 'charter' WHEN contains(c, ' licence ') OR contains(c, ' license ') THEN 'license' END AS kind
FROM (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}'']+', ' ', 'g') || ' ' AS c FROM documents)""", views=False)
def document_types(spark, sf_dir):
    """The type of document that a free text names."""
    return table(spark, sf_dir, "documents").select("doc_id", op.document_type(F.col("text")).alias("kind"))


COMPARED = f"""
g AS (SELECT tender_id, count(*) AS positions, sum(totalcost) AS cost, count(*) FILTER (WHERE amount <= product_id % 40) AS covered FROM goods GROUP BY 1),
t AS (SELECT id, totalcost, currency, close_at, coalesce(positions, 0) AS positions, coalesce(cost, 0) AS cost, coalesce(covered, 0) AS covered,
  CASE WHEN {OPEN} THEN date_diff('day', TIMESTAMP '{AS_OF}', close_at) END AS days_left FROM tenders LEFT JOIN g ON tender_id = id)"""


def _compared(spark, sf_dir):
    g = goods(spark, sf_dir).groupBy(F.col("tender_id").alias("id")).agg(
        F.count("*").alias("positions"), F.sum("totalcost").alias("cost"), F.count_if(F.col("amount") <= F.col("product_id") % 40).alias("covered")
    )
    left = F.when(is_open(AS_OF), F.datediff("close_at", F.lit(AS_OF).cast("timestamp")).cast("long"))
    return tenders(spark, sf_dir).join(g, "id", "left").withColumn("days_left", left).na.fill(0, ["positions", "cost", "covered"])


@query(f"""{COMPARED}
SELECT id, positions, cost::DOUBLE AS cost, covered, days_left, CASE WHEN positions > 0 THEN round(100.0 * covered / positions, 1) END AS stock_percent,
  (totalcost - cost)::DOUBLE AS budget_left, row_number() OVER (PARTITION BY currency ORDER BY cost, id) AS cheapest FROM t""")
def tender_comparison(spark, sf_dir):
    """Tenders side by side: price, stock, time left and place among those of a currency."""
    t = _compared(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("currency").orderBy("cost", "id")).cast("long")
    percent = F.when(F.col("positions") > 0, F.round(100.0 * F.col("covered") / F.col("positions"), 1))
    return t.select("id", "positions", F.col("cost").cast("double").alias("cost"), "covered", "days_left", percent.alias("stock_percent"), (F.col("totalcost") - F.col("cost")).cast("double").alias("budget_left"), place.alias("cheapest"))


@query(f"""{COMPARED}
SELECT id, 'positions' AS fact, positions::VARCHAR AS value FROM t
UNION ALL SELECT id, 'days_left', days_left::VARCHAR FROM t WHERE days_left IS NOT NULL
UNION ALL SELECT id, 'stock', CASE WHEN covered = positions THEN 'all' WHEN covered = 0 THEN 'none' ELSE 'part' END FROM t WHERE positions > 0
UNION ALL SELECT id, 'budget', CASE WHEN cost > totalcost THEN 'over' ELSE 'within' END FROM t WHERE positions > 0""")
def fact_sheet(spark, sf_dir):
    """The facts that a decision on a tender rests on; what isn't known is no fact."""
    t = _compared(spark, sf_dir)
    some = F.col("positions") > 0
    facts = {
        "positions": F.col("positions").cast("string"),
        "days_left": F.col("days_left").cast("string"),
        "stock": F.when(some, F.when(F.col("covered") == F.col("positions"), "all").when(F.col("covered") == 0, "none").otherwise("part")),
        "budget": F.when(some, F.when(F.col("cost") > F.col("totalcost"), "over").otherwise("within")),
    }
    listed = F.array(*[F.struct(F.lit(k).alias("fact"), v.alias("value")) for k, v in facts.items()])
    return t.select("id", F.explode(listed).alias("f")).select("id", "f.*").filter("value IS NOT NULL")


@query("""SELECT event_id, concat_ws(' ', event_type, json_extract_string(props, '$.k'), json_extract_string(props, '$.none'), array_to_string(string_split(event_type, 'i'), ' ')) AS ai_text FROM events""", views=False)
def ai_text(spark, sf_dir):
    """What a record says in one text, missing parts left out."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k"), F.get_json_object("props", "$.none"), F.array_join(F.split("event_type", "i"), " ")).alias("ai_text"))


@query("""
SELECT p_partkey AS id, 'spec' AS file, p_name AS path, p_type AS name, NULL::VARCHAR AS ext, p_size::VARCHAR AS sizes FROM part
UNION ALL SELECT p_partkey, 'photo', p_brand, NULL, 'jpg', NULL FROM part WHERE p_size % 2 = 0""", views=False)
def named_files(spark, sf_dir):
    """Files found by the endings of their fields' names."""
    p = table(spark, sf_dir, "part")
    photo = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")
    fields = F.create_map(F.lit("spec_path"), "p_name", F.lit("spec_name"), "p_type", F.lit("spec_sizes"), F.col("p_size").cast("string"), F.lit("photo_path"), photo, F.lit("photo_ext"), F.lit("jpg"))
    return p.select(F.col("p_partkey").alias("id"), F.explode(op.named_files(fields)).alias("f")).select("id", "f.*")


@query("""
SELECT o_orderkey AS id, CASE WHEN (f + r + INTERVAL 5 HOUR)::DATE = (o_orderdate + INTERVAL 30 DAY)::DATE THEN f + r ELSE (o_orderdate + INTERVAL 30 DAY)::DATE + INTERVAL 86399 SECOND - INTERVAL 5 HOUR END AS close_at
FROM (SELECT o_orderkey, o_orderdate, o_orderdate + INTERVAL 29 DAY AS f, to_seconds((o_orderkey * 3601) % 200000) AS r FROM orders)""", views=False)
def precise_deadlines(spark, sf_dir):
    """P10: when deadlines given as days end."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    close = op.precise_close_at(day, (F.col("o_orderkey") * 3601) % 200000, F.col("o_orderdate") + F.expr("INTERVAL 29 DAYS"))
    return o.select(F.col("o_orderkey").alias("id"), close.alias("close_at"))


@query("SELECT area_id, coalesce(nullif(CASE WHEN level = 1 THEN name END, ''), nullif(trim(lower(name)), ''), '#' || area_id) AS shown FROM areas")
def shown_names(spark, sf_dir):
    """The first name that there is."""
    from tidemill.sources.tables import areas

    a = areas(spark, sf_dir)
    first = F.nullif(F.when(F.col("level") == 1, F.col("name")), F.lit(""))
    return a.select("area_id", F.coalesce(first, F.nullif(F.trim(F.lower("name")), F.lit("")), F.concat(F.lit("#"), "area_id")).alias("shown"))


@query("""
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN quality IS NULL THEN 0 ELSE 1 END, CASE WHEN n_chars >= 3000 AND doc_id % 5 = 0 THEN 0 ELSE 1 END, n_chars, doc_id) AS place
FROM documents LEFT JOIN labels USING (doc_id)""", views=False)
def spot_checks(spark, sf_dir):
    """What is pending first, every fifth of the surest before the others."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels")
    order = [F.col("quality").isNotNull(), ~((F.col("n_chars") >= 3000) & (F.col("doc_id") % 5 == 0)), "n_chars", "doc_id"]
    place = F.row_number().over(Window.partitionBy("source").orderBy(*order)).cast("long")
    return d.join(lab, "doc_id", "left").select("doc_id", "source", place.alias("place"))


@query("SELECT id, floor(totalcost / 10000)::BIGINT AS score FROM tenders ORDER BY score DESC, CASE WHEN id % 4 > 0 THEN close_at END ASC NULLS LAST, id LIMIT 50")
def top_matches(spark, sf_dir):
    """The best scores, the nearest deadline first, those without one last."""
    t = tenders(spark, sf_dir).select("id", F.floor(F.col("totalcost") / 10000).cast("long").alias("score"), F.when(F.col("id") % 4 > 0, F.col("close_at")).alias("close_at"))
    return t.orderBy(F.desc("score"), F.asc_nulls_last("close_at"), "id").limit(50).select("id", "score")


@query("SELECT id, source FROM tenders WHERE status = 'open' AND source IN ('1-URGENT', '2-HIGH') AND totalcost >= 100000")
def etl_scope(spark, sf_dir):
    """the rows that a run's flags ask for; flags left out ask for all."""
    return op.scoped(tenders(spark, sf_dir), status="open", source=["1-URGENT", "2-HIGH"], totalcost=(100000, None), currency=None).select("id", "source")


@query("""
SELECT doc_id, TRY_CAST(replace(regexp_replace(nullif(regexp_extract(text, '[0-9]+(?:[  ][0-9]{3})*(?:[.,][0-9]+)?'), ''), '[  ]', '', 'g'), ',', '.') AS DECIMAL(38,10))::DOUBLE AS amount FROM documents""", views=False)
def first_amounts(spark, sf_dir):
    """The first number of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", numbers.lenient_amount(F.col("text")).cast("double").alias("amount"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings", views=False)
def vector_literals(spark, sf_dir):
    """V5: vectors as text, six decimals each."""
    parts = F.transform("embedding", numbers.six_places)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("literal"))


@query("""SELECT tender_id, name, unit, sum(amount)::DOUBLE AS amount, 1.0::DOUBLE AS confidence, 'approved' AS status FROM goods GROUP BY tender_id, name, unit""")
def registry_requirements(spark, sf_dir):
    """What the register itself asks for is approved."""
    g = goods(spark, sf_dir).groupBy("tender_id", "name", "unit").agg(F.sum("amount").cast("double").alias("amount"))
    return g.select("*", F.lit(1.0).alias("confidence"), F.lit("approved").alias("status"))


@query("""
t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user') AS a, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant') AS b FROM conversations GROUP BY 1),
w AS (SELECT conv_id, coalesce(list_has_any(regexp_extract_all(a, '[0-9]+'), regexp_extract_all(b, '[0-9]+')), FALSE) AS n,
  len(list_intersect(list_filter(string_split_regex(lower(a), '[^a-z]+'), lambda x: length(x) >= 5), list_filter(string_split_regex(lower(b), '[^a-z]+'), lambda x: length(x) >= 5))) AS k FROM t)
SELECT conv_id, n OR coalesce(k, 0) >= 2 AS covered FROM w""", views=False)
def method_coverage(spark, sf_dir):
    """Whether what one side says is covered by the other."""
    side = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(side("user").alias("a"), side("assistant").alias("b"))
    return c.select("conv_id", F.coalesce(op.covered(F.col("a"), F.col("b")), F.lit(False)).alias("covered"))


@query()
def requirement_rules(spark, sf_dir):
    """The numbers, blanks and terms of delivery that rules find in each text."""
    return op.requirements(table(spark, sf_dir, "documents"), ["doc_id"])


@query("""
c AS (SELECT DISTINCT lpad(p_size::VARCHAR, 2, '0') || '.' || upper(p_type[1:2]) AS code FROM part WHERE p_partkey % 3 > 0),
w AS (SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', 1)]) AS term FROM part WHERE p_partkey % 3 = 0),
g AS (SELECT DISTINCT tender_id, lot_id, name, good_code FROM goods),
h AS (SELECT tender_id, lot_id, name, 100 AS score FROM g JOIN c ON starts_with(good_code, code) UNION ALL SELECT tender_id, lot_id, name, 60 FROM g JOIN w ON contains(lower(name), lower(term))),
b AS (SELECT tender_id, lot_id, name, max(score) AS score FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY score DESC, lot_id, name) AS n FROM b)
SELECT tender_id, max(score) AS score, count(*) AS n_positions, string_agg(name, ', ' ORDER BY n) FILTER (WHERE n <= 6) AS shown FROM r GROUP BY 1""")
def catalog_match(spark, sf_dir):
    """A catalogue of coded and codeless products against all tenders."""
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."), F.upper(F.substring("p_type", 1, 2)))
    terms = F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1))))
    return op.catalog_match(goods(spark, sf_dir), p.select(F.when(F.col("p_partkey") % 3 > 0, code).alias("code"), terms.alias("term")))


@query("""
w AS (SELECT unnest(string_split(lower(p_type), ' ')) AS term FROM part UNION ALL SELECT unnest(string_split(lower(p_name), ' ')) FROM part),
n AS (SELECT term, count(*) AS n FROM w WHERE length(term) BETWEEN 3 AND 25 GROUP BY 1)
SELECT term, n, (SELECT greatest(0, count(*) - 400) FROM n) AS cut FROM n ORDER BY n DESC, length(term) DESC, term LIMIT 400""", views=False)
def term_plan(spark, sf_dir):
    """The terms of a catalogue to search for, and how many are cut."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.concat(F.split(F.lower("p_type"), " "), F.split(F.lower("p_name"), " "))).alias("term"))
    return op.term_plan(words)


@query("""
p AS (SELECT DISTINCT left(good_code, 5) AS code, '  ' || lower(name) || ' ' AS p FROM goods),
t AS (SELECT code, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g, ['  g', ' ge', 'gea', 'ear', 'ar '] AS q FROM p)
SELECT code, round(max(len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q)))), 6) AS likeness FROM t GROUP BY 1""")
def trigram_codes(spark, sf_dir):
    """Codes by the likeness of their names to a term."""
    return op.trigram_codes(goods(spark, sf_dir), "gear").select("code", F.round("likeness", 6).alias("likeness"))


@query("""
p AS (SELECT left(coalesce(nullif(split_part(lower(p_name), ' ', 2), ''), lower(p_name)), 30) AS term, count(*) AS products, count(*) FILTER (WHERE p_size > 40) AS coded FROM part GROUP BY 1),
d AS (SELECT word AS term, count(DISTINCT tender_id) AS demand FROM (SELECT DISTINCT tender_id, unnest(string_split(lower(name), ' ')) AS word FROM goods) GROUP BY 1)
SELECT term, products, coalesce(demand, 0) AS demand, CASE WHEN coded = products THEN 'coded' WHEN demand IS NULL THEN 'no_demand' WHEN coded > 0 THEN 'part' ELSE 'open' END AS bucket FROM p LEFT JOIN d USING (term)""")
def coding_queue(spark, sf_dir):
    """The terms of a catalogue to be coded, with demand, in four buckets that leave none out."""
    second = F.coalesce(F.nullif(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(2)), F.lit("")), F.lower("p_name"))
    p = table(spark, sf_dir, "part").groupBy(F.substring(second, 1, 30).alias("term")).agg(F.count("*").alias("products"), F.count_if(F.col("p_size") > 40).alias("coded"))
    words = goods(spark, sf_dir).select("name").distinct().select("name", F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("term"))
    asked = words.join(p.select("term"), "term", "left_semi")
    d = goods(spark, sf_dir).select("tender_id", "name").join(asked, "name").groupBy("term").agg(F.countDistinct("tender_id").alias("demand"))
    bucket = F.when(F.col("coded") == F.col("products"), "coded").when(F.col("demand").isNull(), "no_demand").when(F.col("coded") > 0, "part").otherwise("open")
    return p.join(d, "term", "left").select("term", "products", F.coalesce("demand", F.lit(0)).alias("demand"), bucket.alias("bucket"))
