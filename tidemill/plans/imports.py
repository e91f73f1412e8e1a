"""Price lists, product choice and pilots over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import decisions, patterns
from tidemill.plans.registry import query
from tidemill.sources import price_lists
from tidemill.sources.tables import goods, table

LINES = 500  # of a written price list


@query(f"""
SELECT '/list_' || (p_partkey // {LINES}) || '.csv' AS path, (p_partkey % {LINES} + 3)::INT AS line, p_name || '; "' || p_type || '"' AS name, p_brand || chr(10) || p_size AS keywords,
  CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 400)::VARCHAR END AS stock_qty, (p_retailprice::DECIMAL(18,2))::VARCHAR AS price
FROM part""", views=False)
def price_list_rows(spark, sf_dir):
    """Price lists written of the catalogue, in quotes, 500 products each,
    and read again as files are: decoded, delimiter and header found, fields by name."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    p = table(spark, sf_dir, "part")
    cells = [
        F.col("p_partkey"), F.concat("p_name", F.lit('; "'), "p_type", F.lit('"')), F.concat("p_brand", F.lit("\n"), F.col("p_size").cast("string")),
        F.when(F.col("p_partkey") % 7 > 0, F.col("p_partkey") % 400), F.col("p_retailprice").cast("decimal(18,2)"),
    ]
    lines = p.select(F.floor(F.col("p_partkey") / LINES).alias("file"), "p_partkey", F.concat_ws(";", *map(quoted, cells)).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\r\n")
    head = F.lit("Прайс-лист\r\nКод;Наименование;Характеристики;Остаток;Цена, сум\r\n")
    files = lines.groupBy("file").agg(F.encode(F.concat(head, body), "utf-8").alias("content"))
    found = price_lists.price_rows(files.select(F.format_string("/list_%d.csv", "file").alias("path"), "content"))
    return found.select("path", "line", "name", "keywords", "stock_qty", "price")


PRODUCTS = """
p AS (SELECT p_partkey AS product_id, p_partkey % 400 AS stock, unnest([p_name, split_part(p_name, ' ', 2), CASE WHEN p_partkey % 2 = 0 THEN left(p_name, 5) END, '']) AS term FROM part WHERE p_partkey % 3 = 0),
best AS (SELECT name, product_id, term, row_number() OVER (PARTITION BY name ORDER BY length(term) DESC, product_id, term) AS n
  FROM (SELECT DISTINCT name FROM goods) JOIN p ON term <> '' AND contains(' ' || name, ' ' || term)),
chosen AS (SELECT name, product_id, term FROM best WHERE n = 1)"""


def _chosen(spark, sf_dir):
    """Names of goods with the product that is chosen for them; names and one or two words are the terms."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0")
    some = F.when(F.col("p_partkey") % 2 == 0, F.substring("p_name", 1, 5))
    terms = F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)), some, F.lit(""))
    return patterns.longest(goods(spark, sf_dir), part.select(F.col("p_partkey").alias("product_id"), terms.alias("terms")))


@query(f"{PRODUCTS} SELECT * FROM chosen")
def product_choice(spark, sf_dir):
    """The product of the catalogue for each name of a position, by its longest term."""
    return _chosen(spark, sf_dir)


@query(f"""{PRODUCTS},
u AS (SELECT g.tender_id, g.lot_id, g.totalcost, g.amount, g.product_id AS good, c.product_id, c.product_id % 400 AS stock, CASE WHEN lot_id <> 7 THEN amount END AS required FROM goods g LEFT JOIN chosen c USING (name)),
w AS (SELECT *, sum(coalesce(required, 0)) OVER (PARTITION BY product_id ORDER BY tender_id, lot_id, totalcost, amount, good ROWS UNBOUNDED PRECEDING) AS need FROM u WHERE product_id IS NOT NULL)
SELECT product_id, CASE WHEN required IS NULL THEN 'unknown' WHEN required = 0 OR need <= stock THEN 'enough' ELSE 'short' END AS status, count(*) AS n,
  sum(CASE WHEN required > 0 AND need > stock THEN least(required, need - stock) END)::DOUBLE AS shortfall FROM w GROUP BY ALL
UNION ALL SELECT NULL, 'unmatched', count(*), NULL FROM u WHERE product_id IS NULL HAVING count(*) > 0""")
def stock_by_term(spark, sf_dir):
    """Positions find their product by its longest term, then share its stock in order."""
    g = goods(spark, sf_dir).withColumnRenamed("product_id", "good").join(_chosen(spark, sf_dir), "name", "left")
    rows = g.withColumns({"required": F.when(F.col("lot_id") != 7, F.col("amount")), "stock": (F.col("product_id") % 400).cast("decimal(18,3)"), "unit_ok": F.lit(True)})
    out = decisions.allocate(rows.filter("product_id IS NOT NULL"), ["tender_id", "lot_id", "totalcost", "amount", "good"], F.floor(F.col("tender_id") / 4096))
    found = out.groupBy("product_id", "status").agg(F.count("*").alias("n"), F.sum("shortfall").cast("double").alias("shortfall"))
    none = rows.filter("product_id IS NULL").groupBy("product_id").agg(F.lit("unmatched").alias("status"), F.count("*").alias("n"), F.lit(None).cast("double").alias("shortfall"))
    return found.unionByName(none)
