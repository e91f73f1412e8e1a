"""Review states and the pilot sample over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import review as op
from tidemill.plans.registry import query
from tidemill.sources.tables import AS_OF, dealt, table, tenders


@query("""
e AS (SELECT event_id AS seq, CASE WHEN event_type <> 'error' THEN user_id * 100 + event_id % 100 END AS item_id, user_id AS tender_id,
  ['approved', 'rejected', 'corrected', 'pending', 'unknown'][event_id % 5 + 1] AS status, CASE WHEN event_id % 3 > 0 THEN ' v' || event_id END AS corrected, CASE WHEN event_id % 4 = 0 THEN event_type END AS blind FROM events),
s AS (SELECT * FROM e WHERE item_id IS NOT NULL AND status <> 'unknown' AND (status <> 'corrected' OR corrected IS NOT NULL)),
b AS (SELECT * FROM e WHERE item_id IS NULL AND status IN ('approved', 'rejected')),
l AS (SELECT item_id, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(coalesce(trim(corrected), ''), seq) AS corrected, arg_min(blind, seq) FILTER (blind IS NOT NULL) AS blind FROM s GROUP BY 1),
i AS (SELECT o_orderkey AS item_id, o_custkey AS tender_id, l.seq, coalesce(l.status, 'pending') AS status, l.corrected, l.blind FROM orders LEFT JOIN l ON l.item_id = o_orderkey),
n AS (SELECT i.item_id, min(struct_pack(seq := b.seq, status := b.status)) AS f FROM i JOIN b ON b.tender_id = i.tender_id AND b.seq > coalesce(i.seq, -1) WHERE i.status = 'pending' GROUP BY 1)
SELECT item_id, tender_id, coalesce(f.status, i.status) AS status, CASE WHEN i.status = 'corrected' THEN corrected END AS corrected_value, blind AS blind_value,
  CASE WHEN f IS NOT NULL THEN 'bulk' WHEN seq IS NOT NULL THEN 'single' END AS decided_by, coalesce(f.seq, seq) AS decided_seq FROM i LEFT JOIN n USING (item_id)""", views=False)
def review_states(spark, sf_dir):
    """Reviews out of ordered single and bulk decisions, blind values kept.
    Orders stand for requirements, buyers for tenders, the log for decisions."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, (*op.STATES[1:], "pending", "unknown"))), (F.col("event_id") % 5 + 1).cast("int"))
    decisions = e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("user_id") * 100 + F.col("event_id") % 100).alias("item_id"), F.col("user_id").alias("tender_id"),
        status.alias("status"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(" v"), F.col("event_id").cast("string"))).alias("corrected"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("blind"),
    )
    return op.states(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("tender_id")), decisions)


@query(f"""
p AS (
  (SELECT id, 0 AS n, 'deadline' AS stratum, row_number() OVER (ORDER BY close_at, id) AS r FROM tenders WHERE close_at > TIMESTAMP '{AS_OF}' QUALIFY r <= 10) UNION ALL
  (SELECT id, 1, 'random', row_number() OVER (ORDER BY md5('0.42:' || id), id) AS r FROM tenders QUALIFY r <= 10) UNION ALL
  (SELECT id, 2, 'value', row_number() OVER (ORDER BY totalcost DESC, id) AS r FROM tenders WHERE totalcost IS NOT NULL QUALIFY r <= 10)),
o AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY r) AS round FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1)),
d AS (SELECT id, stratum, (row_number() OVER (ORDER BY round, n))::INT AS place FROM o)
SELECT *, CASE WHEN place <= 10 THEN 'blind' ELSE 'anchored' END AS mode FROM d""")
def pilot_sample(spark, sf_dir):
    """Nearest deadlines, a seeded sample and the dearest tenders, once each, dealt in rounds."""
    t = tenders(spark, sf_dir).select("id", "close_at", "totalcost")
    return op.pilot(dealt(t, "id", table(spark, sf_dir, "orders")), AS_OF)
