"""Statistics, taxonomies and operational figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import search, stats as op
from tidemill.plans.registry import query
from tidemill.plans.search import OPEN
from tidemill.sources.tables import AS_OF, areas, goods, table, tenders

dbl = lambda c: F.col(c).cast("double").alias(c)


def _open(spark, sf_dir):
    return tenders(spark, sf_dir).filter(search.is_open(AS_OF))


@query(f"""
x AS (SELECT split_part(area_path, '.', 1) AS area_id, currency, count(*) AS n, sum(totalcost) AS cost FROM tenders WHERE {OPEN} GROUP BY ALL)
SELECT name AS region, sum(n)::BIGINT AS n_tenders,
  string_agg(currency || ' ' || n || ' ' || cost, '; ' ORDER BY currency NULLS LAST) AS by_currency
FROM x LEFT JOIN areas USING (area_id) GROUP BY name""")
def stats_by_region(spark, sf_dir):
    """A4: region and currency first, then regions with their currencies in order."""
    first = _open(spark, sf_dir).groupBy(F.split_part("area_path", F.lit("."), F.lit(1)).alias("area_id"), "currency").agg(F.count("*").alias("n"), F.sum("totalcost").alias("cost"))
    named = first.join(F.broadcast(areas(spark, sf_dir)), "area_id", "left")
    item = F.struct(F.col("currency").isNull().alias("last"), "currency", F.concat_ws(" ", "currency", F.col("n").cast("string"), F.col("cost").cast("string")).alias("shown"))
    return named.groupBy(F.col("name").alias("region")).agg(
        F.sum("n").alias("n_tenders"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["shown"]), "; ").alias("by_currency")
    )


@query(f"SELECT currency, count(*) AS n, coalesce(sum(totalcost), 0)::DOUBLE AS cost FROM tenders WHERE {OPEN} GROUP BY 1")
def stats_by_currency(spark, sf_dir):
    """A3."""
    return _open(spark, sf_dir).groupBy("currency").agg(F.count("*").alias("n"), F.coalesce(F.sum("totalcost"), F.lit(0)).cast("double").alias("cost"))


@query(f"""
SELECT CASE WHEN a.area_id LIKE '%.1_' THEN a.name END AS locality, count(*) AS n, sum(totalcost)::DOUBLE AS cost
FROM tenders t LEFT JOIN areas a ON a.area_id = t.area_path WHERE {OPEN} AND (area_path = '1' OR starts_with(area_path, '1.')) GROUP BY 1""")
def stats_locality_null_bucket(spark, sf_dir):
    """A5: known localities by name, all others in one row without a name."""
    t = _open(spark, sf_dir).filter(search.under(F.col("area_path"), "1"))
    named = t.join(F.broadcast(areas(spark, sf_dir)), F.col("area_path") == F.col("area_id"), "left")
    locality = F.when(F.col("area_id").rlike(r"\.1.$"), F.col("name"))
    return named.groupBy(locality.alias("locality")).agg(F.count("*").alias("n"), F.sum("totalcost").cast("double").alias("cost"))


@query("SELECT area_path, status, currency, count(*) AS n, sum(totalcost)::DOUBLE AS cost FROM tenders GROUP BY ALL")
def area_status_currency(spark, sf_dir):
    """A1."""
    return tenders(spark, sf_dir).groupBy("area_path", "status", "currency").agg(F.count("*").alias("n"), F.sum("totalcost").cast("double").alias("cost"))


@query("""
SELECT unit AS category, count(*) AS n, sum(totalcost)::DOUBLE AS cost FROM goods GROUP BY 1 ORDER BY cost DESC NULLS LAST, category LIMIT 5""")
def top_categories(spark, sf_dir):
    """A2."""
    return goods(spark, sf_dir).groupBy(F.col("unit").alias("category")).agg(F.count("*").alias("n"), F.sum("totalcost").cast("double").alias("cost")).orderBy(F.desc_nulls_last("cost"), "category").limit(5)


@query(f"""
SELECT name, count(DISTINCT tender_id) AS n_tenders FROM goods WHERE tender_id IN (SELECT id FROM tenders WHERE {OPEN})
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def product_frequency(spark, sf_dir):
    """A6."""
    own = goods(spark, sf_dir).join(_open(spark, sf_dir).select(F.col("id").alias("tender_id")), "tender_id", "left_semi")
    return own.groupBy("name").agg(F.countDistinct("tender_id").alias("n_tenders")).orderBy(F.desc("n_tenders"), "name").limit(30)


@query("""
c AS (SELECT DISTINCT tender_id, left(good_code, 5) AS code FROM goods),
x AS (SELECT tender_id, code FROM c UNION SELECT tender_id, left(code, 2) FROM c)
SELECT code, count(DISTINCT tender_id) AS n_tenders FROM x GROUP BY 1""")
def category_rollup(spark, sf_dir):
    """Distinct tenders of each category, parents with their children's."""
    rows = goods(spark, sf_dir).select("tender_id", F.explode(op.prefixes(F.col("good_code"), (2, 5))).alias("code"))
    return rows.groupBy("code").agg(F.countDistinct("tender_id").alias("n_tenders"))


@query(f"""
x AS (SELECT left(good_code, n) AS code, tender_id, name FROM goods, (VALUES (2), (5), (8)) AS l(n)),
k AS (SELECT code, name, count(*) AS k FROM x GROUP BY ALL),
p AS (SELECT code, sum(k)::BIGINT AS n_positions, array_to_string(list(name ORDER BY k DESC, name)[1:8], ', ') AS names FROM k GROUP BY 1),
o AS (SELECT code, count(DISTINCT tender_id) AS n_open FROM x WHERE tender_id IN (SELECT id FROM tenders WHERE {OPEN}) GROUP BY 1)
SELECT code, CASE length(code) WHEN 8 THEN left(code, 5) WHEN 5 THEN left(code, 2) END AS parent, n_positions, coalesce(n_open, 0) AS n_open, names
FROM p LEFT JOIN o USING (code)""")
def goodcode_dictionary(spark, sf_dir):
    """A12, A13, J8."""
    found = op.dictionary(goods(spark, sf_dir), _open(spark, sf_dir))
    return found.withColumn("names", F.array_join("names", ", "))


@query(f"""
SELECT a.area_id, a.name, count(t.id) AS n, sum(t.totalcost)::DOUBLE AS cost
FROM areas a LEFT JOIN (SELECT * FROM tenders WHERE {OPEN}) t ON t.area_path = a.area_id OR starts_with(t.area_path, a.area_id || '.')
GROUP BY ALL""")
def path_prefix_join(spark, sf_dir):
    """The hierarchy join as an equi-join on exploded paths."""
    return op.by_area(areas(spark, sf_dir), _open(spark, sf_dir)).select("area_id", "name", "n", dbl("cost"))


@query("""
SELECT event_type, event_id, user_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""", views=False)
def latest_run_per_source(spark, sf_dir):
    """The latest run of each source."""
    return op.latest(table(spark, sf_dir, "events"), ["event_type"], F.desc("ts"), F.desc("event_id")).select("event_type", "event_id", "user_id", "value")


@query("""
d AS (SELECT (epoch_us(min(shipped_at)) - epoch_us(any_value(publicated_at))) / 86400000000.0 AS days, tender_id
  FROM goods JOIN tenders ON id = tender_id GROUP BY tender_id)
SELECT count(*) AS n, round(quantile_cont(days, 0.5), 6) AS median_days, round(100.0 * count(*) FILTER (days <= 30) / count(*), 1) AS soon_share FROM d""")
def detection_median(spark, sf_dir):
    """Median latency and the share within a bound."""
    first = goods(spark, sf_dir).groupBy("tender_id").agg(F.min("shipped_at").alias("first"))
    d = first.join(tenders(spark, sf_dir), F.col("id") == F.col("tender_id")).select(((F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(F.col("publicated_at").cast("timestamp"))) / 86400000000.0).alias("days"))
    return d.agg(
        F.count("*").alias("n"),
        F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY days)"), 6).alias("median_days"),
        F.round(F.lit(100.0) * F.count_if(F.col("days") <= 30) / F.count("*"), 1).alias("soon_share"),
    )


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE length(text) < 500) AS short, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs,
  sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents""", views=False)
def corpus_stats(spark, sf_dir):
    """One pass over the corpus."""
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("total"), F.count_if(F.length("text") < 500).alias("short"), F.countDistinct("source").alias("sources"),
        F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"),
    )


@query("""
SELECT source, count(*) AS total, count(*) FILTER (WHERE v.vec_id IS NULL) AS unvectorised, sum(n_chars)::BIGINT AS chars
FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = doc_id GROUP BY source""", views=False)
def unvectorised(spark, sf_dir):
    """Documents of each source that no vector stands for yet."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")).distinct().withColumn("has", F.lit(True))
    return d.join(v, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("has").isNull()).alias("unvectorised"), F.sum("n_chars").alias("chars"))


@query("""
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE ts > n.at - INTERVAL 24 HOUR) AS day_new, count(DISTINCT user_id) AS users,
  round((epoch(max(n.at)) - epoch(min(ts))) / 86400.0, 6) AS age_days FROM events, (SELECT max(ts) AS at FROM events) n GROUP BY event_type""", views=False)
def freshness(spark, sf_dir):
    """What came in the last day before the latest record, and the age of the oldest."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "ts")
    at = e.agg(F.max("ts")).first()[0]
    at = F.lit(at).cast("timestamp_ntz") if dict(e.dtypes)["ts"] == "timestamp_ntz" else F.lit(at)
    age = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(86400e6)
    return e.groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("ts") > at - F.expr("INTERVAL 24 HOURS")).alias("day_new"), F.countDistinct("user_id").alias("users"), F.round(age, 6).alias("age_days")
    )


BANDS = "CASE WHEN value >= 85 THEN 'high' WHEN value >= 60 THEN 'mid' ELSE 'low' END"


@query(f"""
SELECT {BANDS} AS band, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS differs,
  round(100.0 * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*), 0), 1) AS percent
FROM events WHERE event_type IN ('error', 'view') GROUP BY 1""", views=False)
def review_disagreement(spark, sf_dir):
    """Disagreement by band of confidence."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "view"))
    differs = F.count_if(F.col("event_type") == "error")
    return e.groupBy(F.expr(BANDS).alias("band")).agg(F.count("*").alias("n"), differs.alias("differs"), F.round(100.0 * differs / F.nullif(F.count("*"), F.lit(0)), 1).alias("percent"))


@query("""
x AS (SELECT source, status, count(*) AS n, count(*) FILTER (WHERE totalcost > 200000) AS agreed FROM tenders GROUP BY ALL)
SELECT source, status, n, CASE WHEN n >= 10 THEN round(100.0 * agreed / n, 1) END AS percent FROM x""")
def routing_agreement(spark, sf_dir):
    """Agreement by method and decision, withheld under ten decisions."""
    agreed = F.count_if(F.col("totalcost") > 200000)
    n = F.count("*")
    return tenders(spark, sf_dir).groupBy("source", "status").agg(n.alias("n"), F.when(n >= 10, F.round(100.0 * agreed / n, 1)).alias("percent"))


@query("""
s AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM events GROUP BY 1),
x AS (SELECT user_id, n, (epoch_us(b) - epoch_us(a)) / 1000000.0 / nullif(n - 1, 0) AS per_item FROM s)
SELECT count(*) AS users, round(avg(per_item), 2) AS mean_s, round(quantile_cont(per_item, 0.5), 2) AS median_s,
  round(min(per_item), 2) AS least_s, round(max(per_item), 2) AS most_s, sum(n)::BIGINT AS items FROM x""")
def review_speed(spark, sf_dir):
    """Opened and closed once for each key, seconds for each item."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    x = s.withColumn("per_item", (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1000000.0 / F.nullif(F.col("n") - 1, F.lit(0)))
    return x.agg(
        F.count("*").alias("users"), F.round(F.avg("per_item"), 2).alias("mean_s"),
        F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY per_item)"), 2).alias("median_s"),
        F.round(F.min("per_item"), 2).alias("least_s"), F.round(F.max("per_item"), 2).alias("most_s"), F.sum("n").alias("items"),
    )


@query("""
k AS (SELECT c_custkey, count(o_orderkey) AS n, count(DISTINCT o_orderpriority) AS p, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey AS company_id, ((c_name IS NOT NULL)::INT + (c_acctbal > 0)::INT + (c_mktsegment <> 'MACHINERY')::INT + (n > 0)::INT + (n >= 10)::INT
  + (p >= 3)::INT + coalesce((m > 300000)::INT, 0) + (c_nationkey IS NOT NULL)::INT)::BIGINT AS score
FROM customer JOIN k USING (c_custkey)""", views=False)
def profile_completeness(spark, sf_dir):
    """How many of eight parts of a profile are there."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("p"), F.max("o_totalprice").alias("m"))
    j = c.join(k, "c_custkey", "left").na.fill(0, ["n", "p"])
    parts = ["c_name IS NOT NULL", "c_acctbal > 0", "c_mktsegment <> 'MACHINERY'", "n > 0", "n >= 10", "p >= 3", "m > 300000", "c_nationkey IS NOT NULL"]
    score = sum((F.coalesce(F.expr(x).cast("int"), F.lit(0)) for x in parts), F.lit(0))
    return j.select(F.col("c_custkey").alias("company_id"), score.cast("long").alias("score"))


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low,
  (SELECT count(*) FROM (SELECT user_id FROM events f WHERE f.event_type = e.event_type GROUP BY user_id HAVING count(*) > 1)) AS repeated
FROM events e GROUP BY 1""", views=False)
def decision_metrics(spark, sf_dir):
    """Conditional counts and keys that occur more than once."""
    e = table(spark, sf_dir, "events")
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"))
    again = e.groupBy("event_type", "user_id").count().filter("count > 1").groupBy("event_type").agg(F.count("*").alias("repeated"))
    return counts.join(again, "event_type", "left").na.fill(0, ["repeated"])


@query("""
m AS (SELECT user_id, sum(value::DECIMAL(18,2)) AS spent, count(*) AS calls FROM events WHERE date_trunc('month', ts) = TIMESTAMP '2024-01-01' GROUP BY 1)
SELECT user_id, spent::DOUBLE AS spent, calls, CASE WHEN user_id % 10 = 0 THEN 20000 ELSE 5000 END::DOUBLE AS quota,
  spent > CASE WHEN user_id % 10 = 0 THEN 20000 ELSE 5000 END AS over FROM m""")
def spend_vs_quota(spark, sf_dir):
    """Spending of the month against a quota with a default."""
    e = table(spark, sf_dir, "events").filter(F.date_trunc("month", "ts") == F.lit("2024-01-01").cast("timestamp"))
    m = e.groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("spent"), F.count("*").alias("calls"))
    quota = F.when(F.col("user_id") % 10 == 0, 20000).otherwise(5000)
    return m.select("user_id", dbl("spent"), "calls", quota.cast("double").alias("quota"), (F.col("spent") > quota).alias("over"))


@query("""
w AS (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 15 HOUR AND ts <= TIMESTAMP '2024-01-10 00:00:00'),
s AS (SELECT user_id, max(ts) AS last_ok FROM w WHERE event_type = 'signup' GROUP BY 1)
SELECT w.user_id, count(*) AS failures FROM w LEFT JOIN s USING (user_id)
WHERE event_type = 'error' AND (last_ok IS NULL OR w.ts > last_ok) GROUP BY 1""")
def login_throttle(spark, sf_dir):
    """Failures in a window since the last success."""
    at = F.lit("2024-01-10 00:00:00").cast("timestamp")
    w = table(spark, sf_dir, "events").filter((F.col("ts") > at - F.expr("INTERVAL 15 HOURS")) & (F.col("ts") <= at))
    ok = w.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("last_ok"))
    failed = w.filter("event_type = 'error'").join(ok, "user_id", "left").filter("last_ok IS NULL OR ts > last_ok")
    return failed.groupBy("user_id").agg(F.count("*").alias("failures"))


@query(f"SELECT id FROM tenders t WHERE {OPEN} AND (NOT EXISTS (SELECT 1 FROM goods g WHERE g.tender_id = t.id) OR EXISTS (SELECT 1 FROM goods g WHERE g.tender_id = t.id AND g.unit = 'PROMO'))")
def pending_anti(spark, sf_dir):
    """What has no run, or one that has to be repeated."""
    t, g = _open(spark, sf_dir).select("id"), goods(spark, sf_dir).select(F.col("tender_id").alias("id"), "unit")
    return t.join(g, "id", "left_anti").unionByName(t.join(g.filter("unit = 'PROMO'"), "id", "left_semi"))
