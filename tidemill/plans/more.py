"""Further operators: dimensions, queues, notices, suggestions, excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import canonical, numbers, terms
from tidemill.functions.text import FOLD_FROM, FOLD_TO
from tidemill.operators import stats
from tidemill.plans.registry import query
from tidemill.plans.search import OPEN
from tidemill.sources.tables import AS_OF, areas, goods, table, tenders

#: Statuses that a tender does not leave.
TERMINAL = ("finished",)


@query("SELECT area_id, len(string_split(area_id, '.')) AS level, CASE WHEN contains(area_id, '.') THEN split_part(area_id, '.', 1) END AS parent, name FROM areas")
def area_levels(spark, sf_dir):
    """Level and parent of each node by its path."""
    a = areas(spark, sf_dir)
    parent = F.when(F.contains("area_id", F.lit(".")), F.split_part("area_id", F.lit("."), F.lit(1)))
    return a.select("area_id", F.size(F.split("area_id", r"\.")).cast("long").alias("level"), parent.alias("parent"), "name")


@query("SELECT status AS status_code, 'tender' AS domain, status = 'finished' AS is_terminal, count(*) AS tenders FROM tenders GROUP BY status")
def statuses(spark, sf_dir):
    """The dimension of statuses, which of them are final, and their tenders."""
    by = tenders(spark, sf_dir).groupBy(F.col("status").alias("status_code")).agg(F.count("*").alias("tenders"))
    return by.select("status_code", F.lit("tender").alias("domain"), F.col("status_code").isin(*TERMINAL).alias("is_terminal"), "tenders")


@query("""
m AS (SELECT l_partkey AS id, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END::DECIMAL(18,3)) AS moved FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN m.id IS NOT NULL THEN moved ELSE p_size END::DOUBLE AS stock, m.id IS NOT NULL AS by_movement
FROM part LEFT JOIN m ON m.id = p_partkey""", views=False)
def stock_override(spark, sf_dir):
    """Stock by movements where there are any, else the imported one."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    signed = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("decimal(18,3)")
    m = li.filter("l_partkey % 2 = 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(signed).alias("moved"))
    j = p.join(m, "p_partkey", "left")
    return j.select(F.col("p_partkey").alias("id"), F.coalesce(F.col("moved").cast("double"), F.col("p_size").cast("double")).alias("stock"), F.col("moved").isNotNull().alias("by_movement"))


@query("""
SELECT tender_id, count(*) FILTER (WHERE k) AS services, count(*) FILTER (WHERE NOT k) AS products FROM (
  SELECT tender_id, left(good_code, 2) IN ('33', '35', '41', '42', '43', '45') OR regexp_matches(unit, '(?i)^(promo|std)') OR regexp_matches(name, '(?i)repair|service') AS k FROM goods) GROUP BY 1""")
def kind_classifier(spark, sf_dir):
    """F8: services by division, unit or name; all else products."""
    k = F.substring("good_code", 1, 2).isin("33", "35", "41", "42", "43", "45") | F.col("unit").rlike("(?iu)^(promo|std)") | F.col("name").rlike("(?iu)repair|service")
    return goods(spark, sf_dir).groupBy("tender_id").agg(F.count_if(k).alias("services"), F.count_if(~k).alias("products"))


@query("""
SELECT lang, count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (WHERE quality = 0) AS rejected,
  round(100.0 * count(l.doc_id) / count(*), 1) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""", views=False)
def review_queue_rollup(spark, sf_dir):
    """A queue's counts and how much of it is reviewed."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").withColumn("has", F.lit(1))
    return d.join(lab, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n"), F.count("has").alias("labelled"), F.count_if(F.col("quality") == 0).alias("rejected"), F.round(100.0 * F.count("has") / F.count("*"), 1).alias("coverage")
    )


@query("SELECT label, count(*) AS n, count(*) FILTER (WHERE nullif(vec_id % 4, 3) IS DISTINCT FROM 2) AS stale FROM embeddings GROUP BY 1", views=False)
def staleness(spark, sf_dir):
    """Vectors made against another than the active centroid."""
    own = F.nullif(F.col("vec_id") % 4, F.lit(3))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(~own.eqNullSafe(F.lit(2))).alias("stale"))


@query(f"""
h AS (SELECT left(good_code, 5) AS code, name, tender_id, t.id AS open_id FROM goods LEFT JOIN (SELECT id FROM tenders WHERE {OPEN}) t ON t.id = tender_id WHERE contains(name, 'ring')),
s AS (SELECT code, array_to_string(list_sort(list(DISTINCT name))[1:5], ', ') AS samples, count(*) AS n_pos, count(DISTINCT open_id) AS n_open FROM h GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY n_pos DESC, code) AS place FROM s ORDER BY place LIMIT 20""")
def code_search(spark, sf_dir):
    """Codes whose goods have a name, with evidence and open demand."""
    g = goods(spark, sf_dir).filter(F.contains("name", F.lit("ring")))
    from tidemill.operators.search import is_open

    opened = tenders(spark, sf_dir).filter(is_open(AS_OF)).select(F.col("id").alias("open_id"))
    h = g.join(opened, F.col("tender_id") == F.col("open_id"), "left").groupBy(F.substring("good_code", 1, 5).alias("code"))
    s = h.agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 5), ", ").alias("samples"), F.count("*").alias("n_pos"), F.countDistinct("open_id").alias("n_open"))
    top = s.orderBy(F.desc("n_pos"), "code").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_pos"), "code")).cast("long"))


@query("""
c AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1),
w AS (SELECT e.user_id, min(e.ts) AS since FROM events e JOIN c USING (user_id) WHERE e.ts >= last - INTERVAL 30 MINUTE GROUP BY 1)
SELECT user_id, count(*) AS fresh, count(*) FILTER (WHERE event_id % 3 <> 0) AS unsent FROM events JOIN w USING (user_id) WHERE ts >= since GROUP BY 1""", views=False)
def notify_candidates(spark, sf_dir):
    """What is new since the last cycle began, less what was sent."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    last = F.max("ts").over(Window.partitionBy("user_id"))
    recent = e.withColumn("last", last).filter(F.col("ts") >= F.col("last") - F.expr("INTERVAL 30 MINUTES"))
    since = recent.groupBy("user_id").agg(F.min("ts").alias("since"))
    sent = e.filter("event_id % 3 = 0").select("event_id", F.lit(True).alias("sent"))
    fresh = e.join(since, "user_id").filter("ts >= since").join(sent, "event_id", "left")
    return fresh.groupBy("user_id").agg(F.count("*").alias("fresh"), F.count_if(F.col("sent").isNull()).alias("unsent"))


@query("""
s AS (SELECT unnest(['ring', 'bolt', 'lamp']) AS word),
t AS (SELECT DISTINCT tender_id, unnest(string_split(name, ' ')) AS word FROM goods)
SELECT s.word, count(t.tender_id) AS n FROM s LEFT JOIN t ON t.word = s.word GROUP BY 1""")
def saved_search_counts(spark, sf_dir):
    """Tenders that each saved search finds, those without any staying."""
    s = spark.createDataFrame([("ring",), ("bolt",), ("lamp",)], "word string")
    t = goods(spark, sf_dir).select("tender_id", F.explode(F.split("name", " ")).alias("word")).distinct()
    return s.join(t, "word", "left").groupBy("word").agg(F.count("tender_id").alias("n"))


@query("SELECT doc_id, CASE WHEN quality = 1 OR (quality IS NULL AND n_chars >= 3000) THEN 1 ELSE 0 END AS trusted FROM documents LEFT JOIN labels USING (doc_id)", views=False)
def trusted_gate(spark, sf_dir):
    """Approved, or sure enough and not rejected."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    ok = (F.col("quality") == 1) | (F.col("quality").isNull() & (F.col("n_chars") >= 3000))
    return d.join(lab, "doc_id", "left").select("doc_id", F.when(ok, 1).otherwise(0).alias("trusted"))


@query(f"""
SELECT id, date_diff('day', TIMESTAMP '{AS_OF}', close_at) AS days_left, source FROM tenders WHERE {OPEN} AND close_at < TIMESTAMP '{AS_OF}' + INTERVAL 60 DAY""")
def routing_queue(spark, sf_dir):
    """Live decisions with the days left."""
    from tidemill.operators.search import is_open

    at = F.lit(AS_OF).cast("timestamp")
    t = tenders(spark, sf_dir).filter(is_open(AS_OF) & (F.col("close_at") < at + F.expr("INTERVAL 60 DAYS")))
    return t.select("id", F.datediff("close_at", at).cast("long").alias("days_left"), "source")


@query("""
d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents),
t AS (SELECT *, sum(n_chars) OVER (PARTITION BY source) AS total FROM d WHERE n <= 8)
SELECT doc_id, source, least(n_chars, 1000 + floor(12000.0 * n_chars / total)::BIGINT) AS share, n_chars > 1000 + floor(12000.0 * n_chars / total) AS partial FROM t""", views=False)
def context_budget(spark, sf_dir):
    """Eight documents of each group share a budget, a base and a part by size."""
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", n.alias("n")).filter("n <= 8")
    share = 1000 + F.floor(12000.0 * F.col("n_chars") / F.sum("n_chars").over(Window.partitionBy("source")))
    return d.select("doc_id", "source", F.least("n_chars", share).alias("share"), (F.col("n_chars") > share).alias("partial"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id * 7 WHEN event_id % 4 = 1 THEN user_id * 30 WHEN event_id % 4 = 2 THEN user_id * 365 ELSE user_id END AS days FROM events""", views=False)
def term_days(spark, sf_dir):
    """Terms in days by their period."""
    e = table(spark, sf_dir, "events")
    period = F.element_at(F.array(*map(F.lit, ("weeks", "Months", "years", "days"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", numbers.to_days(F.col("user_id"), period).alias("days"))


@query("""
SELECT id, CASE WHEN id % 5 = 0 THEN id % 7 WHEN id % 3 = 0 THEN id % 11 ELSE 15 END::DOUBLE AS markup, CASE WHEN id % 2 = 0 THEN id % 4 ELSE 5 END::DOUBLE AS risk FROM tenders""")
def input_precedence(spark, sf_dir):
    """An override before what was saved, before the tender's, before settings."""
    i = F.col("id")
    override, saved = F.when(i % 5 == 0, i % 7), F.when(i % 3 == 0, i % 11)
    return tenders(spark, sf_dir).select("id", F.coalesce(override, saved, F.lit(15)).cast("double").alias("markup"), F.coalesce(F.when(i % 2 == 0, i % 4), F.lit(5)).cast("double").alias("risk"))


@query("""
r AS (SELECT id, CASE regexp_replace(lower(n), '[^a-z]', '', 'g') WHEN 'unitedkingdom' THEN 'GB' WHEN 'unitedstates' THEN 'US' END AS code FROM (
  SELECT n_nationkey AS id, n_name AS n FROM nation))
SELECT * FROM r""", views=False)
def region_alias(spark, sf_dir):
    """Codes by a normalised alias, from a small broadcast table."""
    alias = spark.createDataFrame([("unitedkingdom", "GB"), ("unitedstates", "US")], "alias string, code string")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.regexp_replace(F.lower("n_name"), "[^a-z]", "").alias("alias"))
    return n.join(F.broadcast(alias), "alias", "left").select("id", "code")


@query()
def lexical_rank(spark, sf_dir):
    """Documents by cover density of two prefixes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), r"[^\p{L}\p{N}]+").alias("tokens"))
    return d.select("doc_id", F.round(terms.cover_rank(F.col("tokens"), ["the", "and"]), 6).alias("rank"))


@query()
def term_keys(spark, sf_dir):
    """Keys that inflected spellings share."""
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", terms.term_key(F.col("p_name")).alias("key"))


@query()
def document_excerpts(spark, sf_dir):
    """What kinds of documents a text names, and the words around them."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", terms.documents_named(F.col("text")).alias("kinds"), terms.excerpt(F.col("text"), ["licen", "certif"]).alias("spans"))


#: Words that stand in for documents, as the texts at hand name hardly any.
PLACED: terms.Rules = {
    "from": ((("from", "with"), ("von", "und")), ("that",)),
    "for": ((("these", "other"), ("for",)), ("this",)),
    "licence": ((("licen",), ("certif",)), ()),
}
_WAYS = ", ".join(
    f"('{kind}', {i}, '{way[0]}', {repr(way[1]) if way[1:] else 'NULL'}, {repr(void[0]) if void else 'NULL'})"
    for kind, (ways, void) in PLACED.items() for i, way in enumerate(ways)
)


@query(f"""
r(kind, way, a, b, void) AS (VALUES {_WAYS}),
d AS (SELECT doc_id, lower(text) AS t FROM documents),
p AS (SELECT doc_id, stem, string_split(t, stem) AS parts FROM d, (SELECT a AS stem FROM r UNION SELECT b FROM r WHERE b IS NOT NULL) WHERE contains(t, stem)),
o AS (SELECT doc_id, stem, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: len(x)))::BIGINT + (i - 1) * len(stem))) AS pos FROM p),
n AS (
  SELECT doc_id, kind, way, a, b, void, f.pos, min(struct_pack(gap := abs(s.pos - f.pos), pos := s.pos)) FILTER (s.pos IS NOT NULL) AS near
  FROM r JOIN o f ON f.stem = a LEFT JOIN (SELECT doc_id AS doc, stem AS other, pos FROM o) s ON doc = doc_id AND other = b AND abs(s.pos - f.pos) <= {terms.REACH} GROUP BY ALL),
h AS (
  SELECT *, least(pos, coalesce(near.pos, pos)) AS low, greatest(pos + len(a), coalesce(near.pos + len(b), 0)) AS high FROM n WHERE b IS NULL OR near IS NOT NULL),
k AS (
  SELECT h.*, row_number() OVER (PARTITION BY doc_id, kind ORDER BY way, pos) AS place FROM h JOIN d USING (doc_id)
  WHERE void IS NULL OR NOT contains(substr(t, greatest(0, low - {terms.AROUND}) + 1, high + {terms.AROUND} - greatest(0, low - {terms.AROUND})), void))
SELECT doc_id, kind, low::INT AS "start", high::INT AS "end", CASE WHEN b IS NULL THEN 70 ELSE 90 END AS confidence FROM k WHERE place = 1""", views=False)
def required_documents(spark, sf_dir):
    """What kinds of documents each text asks for, where, and how sure that is."""
    d = table(spark, sf_dir, "documents").select("doc_id", terms.documents_asked(F.lower("text"), PLACED).alias("found"))
    return d.select("doc_id", F.inline("found"))


_STEMS = sorted({stem for ways, void in PLACED.values() for stem in [*void, *(x for way in ways for x in way)]})
_STEM_ROWS = ", ".join(f"('{stem}', '{s}')" for stem in _STEMS for s in canonical.stem_spellings(stem))
_GONE = FOLD_FROM[len(FOLD_TO) :] + canonical.APOSTROPHES.replace("'", "''")


@query(f"""
r(kind, way, a, b, void) AS (VALUES {_WAYS}),
s(stem, spelling) AS (VALUES {_STEM_ROWS}),
d AS (SELECT doc_id, text, list_filter(range(1, len(c) + 1), lambda i: NOT contains('{_GONE}', lower(c[i]))) AS kept,
  regexp_replace(translate(lower(text), '{canonical.NEAR_FROM}{FOLD_FROM[: len(FOLD_TO)]}', '{canonical.NEAR_TO}{FOLD_TO}'), '[{_GONE}]', '', 'g') AS t FROM (SELECT doc_id, text, string_split(text, '') AS c FROM documents)),
p AS (SELECT doc_id, stem, spelling, string_split(t, spelling) AS parts FROM d JOIN s ON contains(t, spelling)),
o AS (SELECT doc_id, stem, length(spelling) AS n, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(spelling))) AS pos FROM p),
n AS (
  SELECT doc_id, kind, way, b, void, f.pos, f.n, min(struct_pack(gap := abs(s.pos - f.pos), pos := s.pos, n := s.n)) FILTER (s.pos IS NOT NULL) AS near
  FROM r JOIN o f ON f.stem = a LEFT JOIN (SELECT doc_id AS doc, stem AS other, n, pos FROM o) s ON doc = doc_id AND other = b AND abs(s.pos - f.pos) <= {terms.REACH} GROUP BY ALL),
h AS (SELECT *, least(pos, coalesce(near.pos, pos)) AS low, greatest(pos + n, coalesce(near.pos + near.n, 0)) AS high FROM n WHERE b IS NULL OR near IS NOT NULL),
k AS (
  SELECT h.*, row_number() OVER (PARTITION BY doc_id, kind ORDER BY way, pos, n) AS place FROM h JOIN d USING (doc_id)
  WHERE void IS NULL OR NOT EXISTS (SELECT 1 FROM s WHERE stem = void AND contains(substr(t, greatest(0, low - {terms.AROUND}) + 1, high + {terms.AROUND} - greatest(0, low - {terms.AROUND})), spelling))),
e AS (SELECT doc_id, kind, b, low, high, text, kept, kept[greatest(0, low - {canonical.SHOWN}) + 1] AS f, kept[least(len(kept), high + {canonical.SHOWN} + 1)] AS l FROM k JOIN d USING (doc_id) WHERE place = 1)
SELECT doc_id, kind, (kept[low + 1] - 1)::INT AS "start", kept[high]::INT AS "end", CASE WHEN b IS NULL THEN 70 ELSE 90 END AS confidence,
  CASE WHEN f > 1 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, f, l - f + 1), '\\s+', ' ', 'g')) || CASE WHEN l < length(text) THEN '…' ELSE '' END AS evidence
FROM e""", views=False)
def document_evidence(spark, sf_dir):
    """What kinds of documents each raw text asks for in any alphabet, and the
    raw text that says so, by a map from the canonical text back."""
    d = table(spark, sf_dir, "documents").select("doc_id", canonical.evidence(F.col("text"), PLACED).alias("found"))
    return d.select("doc_id", F.inline("found"))


@query()
def message_packing(spark, sf_dir):
    """Turns of a conversation packed in order into messages of a size limit."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", terms.messages(F.transform("t", lambda x: x["text"])).alias("messages"))
