"""Codes suggested for a catalogue.

Vectors stand in by number: that of a code with division D and letters XY is D * 9 +
the place of X in ABCDEFGHI..., that of a product 460 + its number modulo 40.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import coding as op
from tidemill.operators import search
from tidemill.plans.registry import query
from tidemill.plans.search import OPEN
from tidemill.sources.tables import AS_OF, goods, stored, table, tenders

#: What category a product's type stands for.
CATEGORIES = {"ECONOMY": "oziq", "STANDARD": "metall", "PROMO": "transport/avto", "MEDIUM": "qurilish", "LARGE": "tibbiyot", "SMALL": "nothing"}
_CATEGORIES = ", ".join(map(str, CATEGORIES.items()))
_FAMILIES = ", ".join(str((c.split("/")[0], d)) for d, c in op.CATEGORY_OF_DIVISION.items())
_GRAMS = "list_distinct(flatten(list_transform(string_split(lower({0}), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


@query(f"""
live AS (SELECT id FROM tenders WHERE {OPEN}),
vol AS (SELECT left(good_code, 5) AS code, count(DISTINCT tender_id) AS n_open FROM goods JOIN live ON id = tender_id GROUP BY 1),
nam AS (
  SELECT code, name, place FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, name) AS place FROM (
    SELECT left(good_code, 5) AS code, name, count(*) AS n FROM goods GROUP BY ALL)) JOIN vol USING (code) WHERE place <= 8),
prod AS (
  SELECT min(p_partkey) AS product_id, p_name, [p_name, split_part(p_name, ' ', 2)] AS terms, arg_min(p_type, p_partkey) AS kind FROM part GROUP BY p_name),
cat(kind, category) AS (VALUES {_CATEGORIES}),
fam(parent, division) AS (VALUES {_FAMILIES}),
ng AS (SELECT name, {_GRAMS.format("name")} AS a FROM (SELECT DISTINCT name FROM nam)),
tg AS (SELECT term, {_GRAMS.format("term")} AS b FROM (SELECT DISTINCT unnest(terms) AS term FROM prod)),
sim AS (SELECT name, term, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS likeness FROM ng, tg),
tri AS (
  SELECT product_id, code, round(max(likeness), 9) AS x FROM (SELECT product_id, unnest(terms) AS term FROM prod) JOIN sim USING (term) JOIN nam USING (name)
  WHERE likeness >= 0.3 GROUP BY ALL),
txt AS (SELECT code, string_split(string_agg(lower(name), ' ' ORDER BY place), ' ') AS w FROM nam GROUP BY code),
pos AS (SELECT code, i AS pos, w[i] AS token FROM txt, unnest(range(1, len(w) + 1)) AS u(i)),
ask AS (SELECT product_id, split_part(p_name, ' ', 1) AS token, 1 AS mask FROM prod UNION ALL SELECT product_id, split_part(p_name, ' ', 2), 2 FROM prod),
hit AS (SELECT product_id, code, pos, mask, lag(pos) OVER l AS before, lag(mask) OVER l AS other FROM pos JOIN ask USING (token) WINDOW l AS (PARTITION BY product_id, code ORDER BY pos)),
wrd AS (SELECT * FROM (SELECT product_id, code, round(0.1 * sum(CASE WHEN other + mask = 3 THEN 1.0::DOUBLE / (pos - before) ELSE 0 END), 9) AS x FROM hit GROUP BY ALL) WHERE x > 0),
cv AS (SELECT code, code_id, embedding::DOUBLE[] AS v FROM (SELECT code, left(code, 2)::INT * 9 + ascii(code[4]) - 65 AS code_id FROM vol) JOIN embeddings ON vec_id = code_id),
cid AS (SELECT DISTINCT code_id, v FROM cv),
cc AS (SELECT a.code_id, round({_COS.format("a.v", "b.v")}, 6) AS cos, b.code_id AS other FROM cid a JOIN cid b ON a.code_id <> b.code_id),
bia AS (SELECT code_id, round(avg(cos), 6) AS bias FROM (SELECT *, row_number() OVER (PARTITION BY code_id ORDER BY cos DESC, other) AS n FROM cc) WHERE n <= 10 GROUP BY 1 HAVING count(*) >= 3),
vec AS (
  SELECT product_id, code, round(round({_COS.format("e.embedding::DOUBLE[]", "v")}, 6) - coalesce(bias, 0), 6) AS x
  FROM prod JOIN embeddings e ON vec_id = 460 + product_id % 40, cv LEFT JOIN bia USING (code_id)),
al AS (
  SELECT 'words' AS signal, product_id, code, row_number() OVER (PARTITION BY product_id ORDER BY x DESC, code) AS rank FROM wrd
  UNION ALL SELECT 'trigrams', product_id, code, row_number() OVER (PARTITION BY product_id ORDER BY x DESC, code) FROM tri
  UNION ALL SELECT 'vectors', product_id, code, row_number() OVER (PARTITION BY product_id ORDER BY x DESC, code) FROM vec),
fus AS (
  SELECT product_id, code, list_sort(list(signal)) AS signals, sum((1.0::DOUBLE / (60 + rank))::DECIMAL(18,15))::DOUBLE AS score FROM al WHERE rank <= 40 GROUP BY ALL),
rat AS (
  SELECT product_id, code, round(score + CASE WHEN division IS NOT NULL THEN 1.0::DOUBLE / 61 ELSE 0 END + least(n_open, 50) * 0.00001::DOUBLE, 9) AS score,
    array_to_string(CASE WHEN division IS NOT NULL THEN list_append(signals, 'family') ELSE signals END, ',') AS signals
  FROM fus JOIN vol USING (code) JOIN prod USING (product_id) JOIN cat USING (kind) LEFT JOIN fam ON parent = split_part(category, '/', 1) AND division = left(code, 2)),
plc AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, code) AS place FROM rat)
SELECT product_id, code, score, signals, place FROM plc WHERE place <= 8""")
def code_suggestion(spark, sf_dir):
    """The codes suggested for each product, from the words of the codes'
    names, trigrams in both alphabets and vectors less hub bias, with the category's family as a prior."""
    part, e = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings")
    live = tenders(spark, sf_dir).filter(search.is_open(AS_OF)).select(F.col("id").alias("tender_id")).distinct()
    code = F.substring("good_code", 1, 5).alias("code")
    # each list and each block of its queries reads these again: a row for each code, eight for its names, one for each product
    volumes = stored(goods(spark, sf_dir, live).select(code, "tender_id").groupBy("code").agg(F.countDistinct("tender_id").alias("n_open")), "volumes")
    counted = goods(spark, sf_dir).select(code, "name").groupBy("code", "name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "name"))
    names = stored(counted.join(volumes.select("code"), "code", "left_semi").withColumn("place", place).filter("place <= 8"), "names")
    kinds = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    prod = part.groupBy("p_name").agg(F.min("p_partkey").alias("product_id"), F.min_by("p_type", "p_partkey").alias("kind"))
    prod = prod.select("product_id", F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(2))).alias("terms"), kinds[F.col("kind")].alias("category"), (460 + F.col("product_id") % 40).alias("vec_id"))
    prod = stored(prod, "products")
    vectors = e.select("vec_id", F.col("embedding").alias("v"))
    code_id = F.substring("code", 1, 2).cast("long") * 9 + F.ascii(F.substring("code", 4, 1)) - 65
    coded = stored(volumes.select("code", code_id.alias("vec_id")).join(vectors, "vec_id").withColumnRenamed("vec_id", "code_id"), "coded")
    asked = stored(prod.select("product_id", "vec_id").join(vectors, "vec_id"), "asked")
    lists = {
        "words": op.by_words(prod, names),
        "trigrams": op.by_trigrams(prod, names),
        "vectors": op.by_vectors(asked, coded),
    }
    return op.suggested(prod, lists, volumes).select("product_id", "code", "score", "signals", F.col("place").cast("long").alias("place"))
