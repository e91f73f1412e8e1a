"""Codes suggested for products: ranked lists fused, with a prior for a category's family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import lexical, patterns, retrieval

K, CAP, LIMIT, LEAST = 60, 40, 8, 0.3
#: What belonging to the family is worth (a first place), and each open tender up to so many.
PRIOR, VOLUME, MOST_OPEN = 1.0 / (K + 1), 1e-5, 50

# The category of each two-digit division of the classification of activities.
CATEGORY_OF_DIVISION = {
    "01": "qishloq", "02": "qishloq", "03": "qishloq",
    "10": "oziq", "11": "oziq", "56": "oziq",
    "20": "kimyo", "22": "kimyo", "23": "qurilish/material",
    "24": "metall", "25": "metall",
    "26": "elektronika", "27": "elektr", "28": "mashina", "33": "mashina",
    "29": "transport/avto", "30": "transport/boshqa", "45": "transport/avto",
    "49": "transport/xizmat", "50": "transport/xizmat", "51": "transport/xizmat", "52": "transport/xizmat", "53": "transport/xizmat",
    "31": "mebel",
    "21": "tibbiyot", "32": "tibbiyot", "86": "tibbiyot", "87": "tibbiyot", "88": "tibbiyot",
    "41": "qurilish/umumiy", "42": "qurilish/umumiy", "43": "qurilish/umumiy",
    "58": "it", "59": "it", "60": "it", "61": "it", "62": "it", "63": "it",
    "64": "konsalting", "65": "konsalting", "66": "konsalting",
    "69": "konsalting", "70": "konsalting", "71": "konsalting", "72": "konsalting", "73": "konsalting", "74": "konsalting", "75": "konsalting",
    "77": "konsalting", "78": "konsalting", "79": "konsalting", "80": "konsalting", "82": "konsalting",
    "81": "kommunal", "95": "kommunal", "96": "kommunal",
    "85": "talim",
}
OTHER = "boshqa"


def category_of(code: Column) -> Column:
    """The category of a good's code by its division."""
    known = F.create_map(*[F.lit(x) for pair in CATEGORY_OF_DIVISION.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.substring(code, 1, 2)), F.lit(OTHER))


def divisions(spark: SparkSession) -> DataFrame:
    """parent and division, the inverse: all divisions of categories under a parent (fixed, below 100 rows)."""
    return spark.createDataFrame([(c.split("/")[0], d) for d, c in CATEGORY_OF_DIVISION.items()], "parent string, division string")


def _ranked(rated: DataFrame, by: str, cap: int) -> DataFrame:
    order = Window.partitionBy("product_id").orderBy(F.desc(by), "code")
    return rated.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select("product_id", "code", "rank")


def by_trigrams(products: DataFrame, names: DataFrame, cap: int = CAP, least: float = LEAST) -> DataFrame:
    """Codes by the likest of their names (code, name) to any spelling of the products' terms."""
    own = products.select("product_id", F.explode("terms").alias("term"))
    spelled = patterns.spellings(own).filter(F.length("spelling") >= 3)
    near = patterns.alike(names, spelled.select(F.col("spelling").alias("term")), least).withColumnRenamed("term", "spelling")
    codes = near.join(names.select("code", "name").distinct(), "name").groupBy("spelling", "code").agg(F.max("likeness").alias("likeness"))
    rated = codes.join(spelled, "spelling").join(own, "term").groupBy("product_id", "code").agg(F.round(F.max("likeness"), 9).alias("likeness"))
    return _ranked(rated, "likeness", cap)


def by_words(products: DataFrame, names: DataFrame, cap: int = CAP) -> DataFrame:
    """Codes whose names as one text answer the product's name as a question."""
    texts = names.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), " ").alias("text"))
    questions = products.select(F.col("product_id").alias("query"), F.col("terms")[0].alias("question"))
    return lexical.search(texts, questions, ["code"], cap).select(F.col("query").alias("product_id"), "code", "rank")


def by_vectors(products: DataFrame, codes: DataFrame, cap: int = CAP) -> DataFrame:
    """Codes by cosine less hub bias: products with product_id and v, codes with code, code_id
    and v; codes of one code_id share a vector."""
    own = codes.select("code_id", "v").dropDuplicates(["code_id"])
    bias = retrieval.hub_bias(retrieval.nearest(own, own, 10, key="code_id", column="v").withColumn("cos", F.round("cos", 6)))
    rated = own.join(bias.select(F.col("vec_id").alias("code_id"), F.round("bias", 6).alias("bias")), "code_id", "left")
    # a product's number is none of a code's
    asked = products.filter("v IS NOT NULL").select((-1 - F.col("product_id")).alias("code_id"), "v")
    near = retrieval.nearest(rated, asked, cap, key="code_id", column="v", bias="bias")
    rated = near.join(codes.select(F.col("code_id").alias("near"), "code"), "near").select((-1 - F.col("query")).alias("product_id"), "code", "cos")
    return _ranked(rated, "cos", cap)


def suggested(products: DataFrame, lists: dict[str, DataFrame], volumes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best codes of each product with score and signals, from ranked lists of (product_id, code, rank).

    A code in any list counts, so this is their full outer join. Products come with
    category, volumes with code and n_open; a code of the category's family gets PRIOR.
    """
    spark = products.sparkSession
    named = [df.select("product_id", "code", F.col("rank").cast("long").alias("rank"), F.lit(name).alias("signal")) for name, df in lists.items()]
    both = reduce(DataFrame.unionByName, named).groupBy("product_id", "code")
    fused = both.agg(F.array_sort(F.collect_set("signal")).alias("signals"), F.sum((1.0 / (K + F.col("rank"))).cast("decimal(18,15)")).cast("double").alias("score"))
    family = products.select("product_id", F.split_part("category", F.lit("/"), F.lit(1)).alias("parent")).join(F.broadcast(divisions(spark)), "parent")
    family = family.select("product_id", "division", F.lit(True).alias("own"))
    rated = fused.withColumn("division", F.substring("code", 1, 2)).join(family, ["product_id", "division"], "left").join(volumes, "code", "left")
    prior = F.when(F.col("own"), PRIOR).otherwise(0.0)
    score = F.round(F.col("score") + prior + F.least(F.coalesce("n_open", F.lit(0)), F.lit(MOST_OPEN)) * VOLUME, 9)
    signals = F.when(F.col("own"), F.array_append("signals", F.lit("family"))).otherwise(F.col("signals"))
    rows = rated.select("product_id", "code", score.alias("score"), F.array_join(signals, ",").alias("signals"))
    order = Window.partitionBy("product_id").orderBy(F.desc("score"), "code")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
