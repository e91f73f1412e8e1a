"""Upserts, queues, samples and run ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import ledger as op
from tidemill.plans.registry import query
from tidemill.sources.tables import goods, money, table, tenders

OLD = "old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice::DECIMAL(18,2) AS cost, o_orderdate AS first_seen FROM orders WHERE o_orderkey % 3 <> 0)"
NEW = "new AS (SELECT o_orderkey AS id, 'X' AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice::DECIMAL(18,2) + 1 END AS cost, o_orderdate + INTERVAL 9 DAY AS first_seen FROM orders WHERE o_orderkey % 2 = 0)"


def _sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), money("o_totalprice").alias("cost"), F.col("o_orderdate").alias("first_seen"))
    new = o.filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("id"), F.lit("X").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, (money("o_totalprice") + 1).cast("decimal(18,2)")).alias("cost"),
        (F.col("o_orderdate") + F.expr("INTERVAL 9 DAYS")).alias("first_seen"),
    )
    return old, new


def _shown(df):
    return df.select("id", "status", F.col("cost").cast("double").alias("cost"), F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


SHOWN = "id, status, cost::DOUBLE AS cost, strftime(first_seen, '%Y-%m-%d') AS first_seen"


@query(f"""{OLD}, {NEW},
m AS (SELECT id, n.status, n.cost, coalesce(o.first_seen, n.first_seen) AS first_seen FROM new n LEFT JOIN old o USING (id)
  UNION ALL SELECT id, status, cost, first_seen FROM old WHERE id NOT IN (SELECT id FROM new))
SELECT {SHOWN} FROM m""", views=False)
def upsert_merge(spark, sf_dir):
    """K1: replaced by key, the first sight kept."""
    return _shown(op.upsert(*_sides(spark, sf_dir), ["id"], keep=("first_seen",)))


@query(f"""{OLD}, {NEW},
m AS (SELECT id, coalesce(n.status, o.status) AS status, coalesce(n.cost, o.cost) AS cost, coalesce(n.first_seen, o.first_seen) AS first_seen FROM old o FULL JOIN new n USING (id))
SELECT {SHOWN} FROM m""", views=False)
def patch_upsert(spark, sf_dir):
    """A null leaves what was there."""
    return _shown(op.patch(*_sides(spark, sf_dir), ["id"]))


@query(f"{OLD}, {NEW}, m AS (SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)) SELECT {SHOWN} FROM m", views=False)
def insert_ignore(spark, sf_dir):
    """K3."""
    return _shown(op.insert_new(*_sides(spark, sf_dir), ["id"]))


@query(f"""{OLD}, {NEW}
SELECT id, coalesce(n.status, o.status) AS status, CASE WHEN o.status <> n.status THEN o.status END AS old_status,
  coalesce(o.status <> n.status, FALSE) AS changed FROM old o FULL JOIN new n USING (id)""", views=False)
def change_flag(spark, sf_dir):
    """K7: what changed, and what it was."""
    return op.flag_changes(*_sides(spark, sf_dir), ["id"], "status")


@query(f"""{OLD}, {NEW},
r AS (SELECT id, cost, CASE WHEN id % 5 = 0 THEN 'approved' ELSE 'pending' END AS review FROM old)
SELECT id, coalesce(n.cost, r.cost)::DOUBLE AS cost,
  CASE WHEN n.cost IS NOT NULL AND n.cost IS DISTINCT FROM r.cost THEN 'pending' ELSE coalesce(review, 'pending') END AS review,
  CASE WHEN n.cost IS NOT NULL AND n.cost IS DISTINCT FROM r.cost AND coalesce(review <> 'pending', FALSE) THEN 'value changed' END AS note
FROM r FULL JOIN new n USING (id)""", views=False)
def state_upsert(spark, sf_dir):
    """A changed value puts its review back."""
    old, new = _sides(spark, sf_dir)
    old = old.withColumn("review", F.when(F.col("id") % 5 == 0, "approved").otherwise("pending"))
    found = op.review_again(old, new, ["id"], "cost")
    return found.withColumn("cost", F.col("cost").cast("double"))


@query("""
n AS (SELECT tender_id, lot_id, name, totalcost FROM goods WHERE tender_id % 7 = 0 AND lot_id = 1),
m AS (SELECT tender_id, lot_id, name, totalcost FROM goods WHERE tender_id NOT IN (SELECT tender_id FROM n) UNION ALL SELECT * FROM n)
SELECT tender_id, count(*) AS n, sum(totalcost)::DOUBLE AS cost FROM m GROUP BY 1""")
def replace_children(spark, sf_dir):
    """K2, K8."""
    g = goods(spark, sf_dir).select("tender_id", "lot_id", "name", "totalcost")
    m = op.replace_children(g, g.filter("tender_id % 7 = 0 AND lot_id = 1"), "tender_id")
    return m.groupBy("tender_id").agg(F.count("*").alias("n"), F.sum("totalcost").cast("double").alias("cost"))


@query("""
SELECT user_id, event_type, count(*) AS calls, sum(value::DECIMAL(18,2))::DOUBLE AS tokens FROM events GROUP BY ALL""", views=False)
def counter_upsert(spark, sf_dir):
    """K4: counters of two batches added by key."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lit(1).cast("long").alias("calls"), F.col("value").cast("decimal(18,2)").alias("tokens"))
    keys = ["user_id", "event_type"]
    batch = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    return op.add(batch(0), batch(1), keys).withColumn("tokens", F.col("tokens").cast("double"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""", views=False)
def keep_last_dedupe(spark, sf_dir):
    """The last record of each key."""
    return op.keep_last(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("""
SELECT id, CASE WHEN status = 'open' AND close_at <= TIMESTAMP '1998-07-01' AND source IN ('1-URGENT', '2-HIGH') THEN 'expired' ELSE status END AS status FROM tenders""")
def expire_stale(spark, sf_dir):
    """K9: late open tenders of the sources whose run succeeded."""
    late = (F.col("status") == "open") & (F.col("close_at") <= F.lit("1998-07-01").cast("timestamp")) & F.col("source").isin("1-URGENT", "2-HIGH")
    return tenders(spark, sf_dir).select("id", F.when(late, "expired").otherwise(F.col("status")).alias("status"))


@query("""
SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 3 HOUR THEN 'failed' ELSE event_type END AS state
FROM events WHERE ts >= TIMESTAMP '2024-01-05'""", views=False)
def close_stale_runs(spark, sf_dir):
    """Runs open too long fail; rows past retention go."""
    e = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-05").cast("timestamp"))
    stale = (F.col("event_type") == "view") & (F.col("ts") < F.lit("2024-01-15").cast("timestamp") - F.expr("INTERVAL 3 HOURS"))
    return e.select("event_id", F.when(stale, "failed").otherwise(F.col("event_type")).alias("state"))


@query("""
o AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE turn < 2 GROUP BY 1)
SELECT c.conv_id, c.turn, (coalesce(last, -1) + row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.text))::BIGINT AS seq
FROM conversations c LEFT JOIN o USING (conv_id) WHERE c.turn >= 2""", views=False)
def sequence_numbers(spark, sf_dir):
    """New messages numbered on from what is there."""
    c = table(spark, sf_dir, "conversations")
    last = c.filter("turn < 2").groupBy("conv_id").agg(F.max("turn").alias("last"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return c.filter("turn >= 2").join(last, "conv_id", "left").select("conv_id", "turn", (F.coalesce("last", F.lit(-1)) + n).cast("long").alias("seq"))


@query("""
r AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY totalcost DESC, id) AS n FROM tenders)
SELECT source, id, n AS round FROM r WHERE n <= 10""")
def round_robin_sample(spark, sf_dir):
    """Ten of each stratum, to be dealt out in rounds."""
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("totalcost"), "id"))
    return tenders(spark, sf_dir).select("source", "id", n.cast("long").alias("round")).filter("round <= 10")


@query("""
r AS (SELECT tender_id, name, totalcost, lot_id, product_id, amount, row_number() OVER (PARTITION BY tender_id ORDER BY totalcost DESC, name, lot_id, product_id, amount) AS n FROM goods)
SELECT tender_id, left('Tender ' || tender_id || ' | ' || string_agg(name, ' | ' ORDER BY n), 1200) AS text FROM r WHERE n <= 40 GROUP BY 1""")
def tender_text_top40(spark, sf_dir):
    """A tender's text from its forty dearest goods."""
    n = F.row_number().over(Window.partitionBy("tender_id").orderBy(F.desc("totalcost"), "name", "lot_id", "product_id", "amount"))
    top = goods(spark, sf_dir).withColumn("n", n).filter("n <= 40").groupBy("tender_id").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("g"))
    text = F.concat(F.lit("Tender "), F.col("tender_id").cast("string"), F.lit(" | "), F.array_join(F.transform("g", lambda x: x["name"]), " | "))
    return top.select("tender_id", F.substring(text, 1, 1200).alias("text"))


@query("""
d AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS was FROM documents)
SELECT doc_id, h AS hash, was IS NULL AS is_new FROM d WHERE h IS DISTINCT FROM was""", views=False)
def hash_incremental(spark, sf_dir):
    """What is new or changed by its hash."""
    was = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).when(F.col("doc_id") % 7 == 0, None).otherwise(F.sha2("text", 256))
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), was.alias("was"))
    return d.filter(~F.col("hash").eqNullSafe(F.col("was"))).select("doc_id", "hash", F.col("was").isNull().alias("is_new"))
