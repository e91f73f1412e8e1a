"""Full-text questions against all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators import lexical as op
from tidemill.operators import retrieval
from tidemill.plans.registry import query
from tidemill.sources.tables import table

#: Letters that a question's terms have at least.
LONG = 8


def _questions(spark, sf_dir) -> DataFrame:
    """Of each benchmark item all its long words as one question (any of them), and the two
    longest as another (both of them)."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= LONG))
    longest = F.transform(F.slice(F.array_sort(F.transform("w", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 2), lambda x: x["w"])
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).filter("size(w) > 2")
    ways = F.explode(F.array(F.struct((F.col("item_id") * 2).alias("query"), F.col("w").alias("w")), F.struct((F.col("item_id") * 2 + 1).alias("query"), longest.alias("w"))))
    return b.select(ways.alias("q")).select("q.query", F.array_join("q.w", " ").alias("question"))


@query(rf"""
b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= {LONG})) AS w FROM benchmark),
q AS (
  SELECT item_id * 2 AS query, len(w) AS groups, unnest(w) AS token, 1 AS mask FROM b WHERE len(w) > 2
  UNION ALL SELECT item_id * 2 + 1, 2, list_sort(list_transform(w, lambda x: {{'n': -length(x), 'w': x}}))[1].w, 1 FROM b WHERE len(w) > 2
  UNION ALL SELECT item_id * 2 + 1, 2, list_sort(list_transform(w, lambda x: {{'n': -length(x), 'w': x}}))[2].w, 2 FROM b WHERE len(w) > 2),
t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, i AS pos, w[i] AS token FROM t, unnest(range(1, len(w) + 1)) AS u(i)),
h AS (SELECT query, groups, doc_id, pos, mask, lag(pos) OVER l AS before, lag(mask) OVER l AS other FROM p JOIN q USING (token) WINDOW l AS (PARTITION BY query, doc_id ORDER BY pos)),
s AS (SELECT query, doc_id, round(0.1 * sum(CASE WHEN groups <> 2 THEN 1.0::DOUBLE WHEN other + mask = 3 THEN 1.0::DOUBLE / (pos - before) ELSE 0 END), 9) AS score FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query, doc_id, score, rank FROM r WHERE rank <= 20""", views=False)
def lexical_search(spark, sf_dir):
    """The 20 best whole texts of each question, by cover density."""
    found = op.search(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), ["doc_id"], 20)
    return found.select("query", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query()
def chunk_search(spark, sf_dir):
    """The ten best chunks of all texts for each question."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(tx.chunked(F.col("text"))).alias("span"))
    chunks = d.select("doc_id", F.col("span.start").alias("start"), F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start")).alias("text"))
    return op.search(chunks, _questions(spark, sf_dir), ["doc_id", "start"], 10)


@query(rf"""
b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= {LONG})) AS w FROM benchmark),
c AS (SELECT vec_id, source, text, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON doc_id = vec_id),
a AS (SELECT vec_id AS query, source, v, w FROM c JOIN b ON item_id = (vec_id // 50) % 40 WHERE vec_id % 50 = 0 AND len(w) > 2),
s AS (SELECT query, c.vec_id AS near, round(list_dot_product(a.v, c.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(c.v, c.v))), 9) AS cos FROM a JOIN c USING (source) WHERE c.vec_id <> query),
sr AS (SELECT query, near, row_number() OVER (PARTITION BY query ORDER BY cos DESC, near) AS semantic FROM s),
t AS (SELECT vec_id, source, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')) AS token FROM c),
l AS (SELECT query, vec_id AS near, count(*) AS n FROM t JOIN (SELECT query, source, unnest(w) AS token FROM a) USING (source, token) WHERE vec_id <> query GROUP BY ALL),
lr AS (SELECT query, near, row_number() OVER (PARTITION BY query ORDER BY n DESC, near) AS lexical FROM l),
f AS (SELECT query, near, coalesce(1.0::DOUBLE / (60 + semantic), 0) + coalesce(1.0::DOUBLE / (60 + lexical), 0) AS score, lexical IS NOT NULL AS lexical
  FROM (FROM sr WHERE semantic <= 30) FULL OUTER JOIN (FROM lr WHERE lexical <= 30) USING (query, near)),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, near) AS place FROM f)
SELECT query, near, round(score, 9) AS score, lexical, place FROM p WHERE place <= 8""", views=False)
def tender_hybrid(spark, sf_dir):
    """For each vector of the query set the best of its own source's texts, by
    meaning and by words; a benchmark item's long words are the question."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    chunks = e.select("vec_id", "embedding").join(d.select(F.col("doc_id").alias("vec_id"), "source", "text"), "vec_id")
    asked = _questions(spark, sf_dir).filter("query % 2 = 0").select((F.col("query") / 2).cast("long").alias("item"), "question")
    questions = chunks.filter("vec_id % 50 = 0").withColumn("item", F.floor(F.col("vec_id") / 50) % 40).join(asked, "item")
    found = retrieval.within_group(chunks, questions.select("vec_id", "source", "embedding", "question"), "source")
    return found.select("query", "near", "score", "lexical", F.col("place").cast("long").alias("place"))
