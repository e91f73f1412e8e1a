"""Search, cards, queues and nested views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import search as op
from tidemill.plans.registry import query
from tidemill.sources.tables import AS_OF, areas, goods, table, tenders

OPEN = f"status = 'open' AND (close_at IS NULL OR close_at > TIMESTAMP '{AS_OF}')"


@query(f"""
SELECT id, status, totalcost::DOUBLE AS totalcost, currency, area_path FROM tenders
WHERE {OPEN} AND (area_path = '2' OR starts_with(area_path, '2.')) AND currency IN ('BUILDING')
ORDER BY totalcost DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20""")
def search_page(spark, sf_dir):
    """Filters, whitelisted order with a total tie-break, one page."""
    found = tenders(spark, sf_dir).filter(op.filters(AS_OF, "open", region="2", currency="BUILDING"))
    return op.page(found, "-totalcost", 20, 20).select("id", "status", F.col("totalcost").cast("double").alias("totalcost"), "currency", "area_path")


@query(f"SELECT count(*) AS total FROM tenders WHERE {OPEN} AND (area_path = '2' OR starts_with(area_path, '2.'))")
def search_total(spark, sf_dir):
    """O2: the total beside a page, without the card's columns."""
    return tenders(spark, sf_dir).filter(op.filters(AS_OF, "open", region="2")).agg(F.count("*").alias("total"))


@query(f"""
g AS (SELECT tender_id AS id, count(DISTINCT lot_id) AS n_lots, sum(totalcost) AS goods_cost,
    array_to_string(list_sort(list(DISTINCT name))[1:6], ', ') AS goods_preview FROM goods GROUP BY 1)
SELECT t.id, status, a.name AS region_name, goods_preview, n_lots, goods_cost::DOUBLE AS goods_cost
FROM tenders t LEFT JOIN g USING (id) LEFT JOIN areas a ON a.area_id = t.area_path WHERE {OPEN}""")
def tender_cards(spark, sf_dir):
    """Cards from pre-aggregated goods and broadcast dimensions."""
    found = op.cards(tenders(spark, sf_dir).filter(op.is_open(AS_OF)), goods(spark, sf_dir), areas(spark, sf_dir))
    return found.select("id", "status", "region_name", "goods_preview", "n_lots", F.col("goods_cost").cast("double").alias("goods_cost"))


@query("""
SELECT id, currency FROM tenders t
WHERE EXISTS (SELECT 1 FROM goods g WHERE g.tender_id = t.id AND (contains(lower(g.name), 'bolt') OR contains(lower(g.name), 'ring')))""")
def product_filter(spark, sf_dir):
    """Tenders with a good of any of the products."""
    return op.with_product(tenders(spark, sf_dir), goods(spark, sf_dir), ["bolt", "ring"]).select("id", "currency")


@query("""
SELECT id, company_name FROM tenders t
WHERE contains(lower(company_name), '0007') OR EXISTS (SELECT 1 FROM goods g WHERE g.tender_id = t.id AND contains(lower(g.name), 'widget'))""")
def free_text_search(spark, sf_dir):
    """one text over buyer and goods."""
    return op.free_text(tenders(spark, sf_dir), goods(spark, sf_dir), "0007").unionByName(
        op.free_text(tenders(spark, sf_dir), goods(spark, sf_dir), "widget")
    ).dropDuplicates(["id"]).select("id", "company_name")


@query(f"""
SELECT id, CASE WHEN status IN ('finished') THEN 'status' WHEN close_at <= TIMESTAMP '{AS_OF}' THEN 'deadline' END AS reason FROM tenders""")
def closed_reason(spark, sf_dir):
    """F9."""
    return tenders(spark, sf_dir).select("id", op.closed_reason(AS_OF, ("finished",)).alias("reason"))


@query(f"""
SELECT id, CASE WHEN close_at > TIMESTAMP '{AS_OF}' THEN 1 ELSE 0 END AS is_live, rn AS place FROM (
  SELECT *, row_number() OVER (ORDER BY (close_at > TIMESTAMP '{AS_OF}') DESC, close_at, id DESC) AS rn FROM tenders) WHERE rn <= 50""")
def work_queue(spark, sf_dir):
    """Live first, nearest deadline, newest id; a queue's next batch."""
    alive = F.when(op.live(AS_OF), 1).otherwise(0)
    top = tenders(spark, sf_dir).select("id", "close_at", alive.alias("is_live")).orderBy(F.desc("is_live"), "close_at", F.desc("id")).limit(50)
    # fifty rows at most are numbered in one place
    place = F.row_number().over(Window.orderBy(F.desc("is_live"), "close_at", F.desc("id")))
    return top.select("id", "is_live", place.cast("long").alias("place"))


@query("SELECT status, source, count(*) AS n, count(*) FILTER (WHERE close_at IS NOT NULL) AS with_deadline FROM tenders GROUP BY ALL")
def status_crosstab(spark, sf_dir):
    """S15."""
    return tenders(spark, sf_dir).groupBy("status", "source").agg(F.count("*").alias("n"), F.count("close_at").alias("with_deadline"))


@query("""
l AS (SELECT tender_id, lot_id, string_agg(name || '=' || n, ';' ORDER BY name) AS items FROM (
  SELECT tender_id, lot_id, name, count(*) AS n FROM goods GROUP BY ALL) GROUP BY ALL)
SELECT tender_id, string_agg(lot_id || ':' || items, ' ' ORDER BY lot_id) AS lots FROM l GROUP BY 1""")
def nested_detail(spark, sf_dir):
    """Lots with their goods as one nested value for each tender."""
    items = goods(spark, sf_dir).groupBy("tender_id", "lot_id", "name").agg(F.count("*").alias("n"))
    lots = items.groupBy("tender_id", "lot_id").agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("items"))
    nested = lots.groupBy("tender_id").agg(F.array_sort(F.collect_list(F.struct("lot_id", "items"))).alias("lots"))
    shown = F.transform("lots", lambda x: F.concat(x["lot_id"].cast("string"), F.lit(":"), F.array_join(F.transform(x["items"], lambda i: F.concat(i["name"], F.lit("="), i["n"].cast("string"))), ";")))
    return nested.select("tender_id", F.array_join(shown, " ").alias("lots"))


@query("""
SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k_sum, count(DISTINCT props->>'k') AS k_distinct
FROM events GROUP BY 1""", views=False)
def json_fields(spark, sf_dir):
    """Fields of JSON records by a declared schema."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"), F.countDistinct("p.k").alias("k_distinct"))


@query("""
SELECT event_id, nullif(trim(props->>'k'), '') AS k_text, try_cast(props->>'k' AS BIGINT) AS k_int, nullif(trim(props->>'none'), '') AS none
FROM events""", views=False)
def field_bag(spark, sf_dir):
    """Fields of a bag by name, as text and as whole numbers; blank and missing ones are null."""
    bag = F.from_json("props", "map<string,string>")
    text = lambda key: F.nullif(F.trim(F.col("bag")[key]), F.lit(""))
    e = table(spark, sf_dir, "events").select("event_id", bag.alias("bag"))
    return e.select("event_id", text("k").alias("k_text"), text("k").try_cast("long").alias("k_int"), text("none").alias("none"))
