"""Ranked full-text search for a set of questions on a positional inverted index.

A question is groups of alternatives (functions.terms.term_groups): one or two groups
must all be met, of more any. Alternatives meet postings by the word or its beginning,
and no question meets a text without a common word.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import terms as tm
from tidemill.functions import text as tx

#: What a place in a text weighs.
WEIGHT = 0.1
#: Alternatives of all questions that are broadcast to the postings; more are joined by a shuffle.
FEW = 200_000


def alternatives(questions: DataFrame, carry: list[str]) -> DataFrame:
    """query, carry, groups (their number), grp, word and prefix (whether it is a
    beginning), from query and question."""

    @F.pandas_udf("array<array<string>>")
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(tm.term_groups)

    rows = questions.select("query", *carry, parsed("question").alias("_parsed")).select("query", *carry, F.size("_parsed").alias("groups"), F.posexplode("_parsed").alias("grp", "words"))
    word, own = F.col("word"), ["query", *carry, "groups", "grp"]
    return rows.select(*own, F.explode("words").alias("word")).select(*own, F.regexp_replace(word, r":\*$", "").alias("word"), word.endswith(":*").alias("prefix"))


def postings(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, pos and token of every word of the folded texts; nulls have none."""
    words = F.filter(F.split(tx.fold(F.col(text_col)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return texts.select(*keys, F.posexplode(words).alias("pos", "token"))


def density(hits: Column) -> Column:
    """Cover density of two groups from (pos, mask) in order: for each shortest stretch that
    has both, one over its length; a word of both groups is a stretch of its own."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).cast("long").alias("mask"), F.lit(0.0).alias("sum"))

    def step(last: Column, hit: Column) -> Column:
        gap = (hit["pos"] - last["pos"]).cast("double")
        more = F.when(hit["mask"] == 3, 1.0).when((last["mask"] + hit["mask"] == 3) & (last["mask"] > 0), 1.0 / gap).otherwise(0.0)
        return F.struct(hit["pos"].alias("pos"), hit["mask"].alias("mask"), (last["sum"] + more).alias("sum"))

    return F.aggregate(hits, zero, step)["sum"]


def search(texts: DataFrame, questions: DataFrame, keys: list[str], k: int, text_col: str = "text", within: str | None = None, few: int = FEW) -> DataFrame:
    """The k best texts of each question: query, keys, score and rank; ties by the keys.

    ``within`` names a column of both: a question is asked among the texts of its own
    value only, and no others are read further. A text's places are brought together,
    never those of more texts. Up to ``few`` alternatives of all questions come over the
    driver and are broadcast, so that texts are read once and no posting is shuffled that
    nobody asks for; more are joined by a shuffle.
    """
    spark, group = texts.sparkSession, [within] if within else []
    if within:
        texts = texts.join(questions.select(within).distinct(), within, "left_semi")
    index, asked = postings(texts, [*keys, *group], text_col), alternatives(questions, group)
    mask = F.when(F.col("groups") > 2, F.lit(1)).otherwise(F.col("grp") + 1).cast("long")
    own = ["prefix", "word", *group, "query", "groups"]
    asked = asked.select(*own, mask.alias("mask")).groupBy(*own).agg(F.bit_or("mask").alias("mask"))
    rows = asked.limit(few + 1).collect()
    if len(rows) <= few:
        met = F.broadcast(spark.createDataFrame(rows, asked.schema))
        lengths = sorted({len(r["word"]) for r in rows if r["prefix"]})
    else:
        met, lengths = asked, tm.PREFIX_LENGTHS
    # a word is asked for as a whole, and by its beginnings where there are such
    ways = [F.struct(F.lit(False).alias("prefix"), F.col("token").alias("word"))]
    ways += [F.struct(F.lit(True).alias("prefix"), F.when(F.length("token") >= n, F.substring("token", 1, n)).alias("word")) for n in lengths]
    words = index.select(*keys, *group, "pos", F.explode(F.array(*ways)).alias("way")) if lengths else index.select(*keys, *group, "pos", ways[0].alias("way"))
    hits = words.select(*keys, *group, "pos", "way.prefix", "way.word").join(met, ["prefix", "word", *group])
    if lengths:
        hits = hits.groupBy("query", "groups", *keys, "pos").agg(F.bit_or("mask").alias("mask"))
    hits = hits.groupBy("query", "groups", *keys).agg(F.array_sort(F.collect_list(F.struct("pos", "mask"))).alias("hits"))
    score = F.when(F.col("groups") == 2, density(F.col("hits"))).otherwise(F.size("hits").cast("double")) * WEIGHT
    rated = hits.select("query", *keys, F.round(score, 9).alias("score")).filter("score > 0")
    order = Window.partitionBy("query").orderBy(F.desc("score"), *keys)
    return rated.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
