"""Terms in names: containment over all spellings, and likeness, by an index of grams.

Names and terms are compared once each, however many rows have them. A spelling is
looked for only in names that have its rarest gram (three letters; the whole
spelling where it is shorter), and each such name is then read in full, so what is
found is what reading every name for every spelling would find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import terms as tm
from tidemill.functions import text as tx

GRAM = 3


def _grams(c: Column, n: int) -> Column:
    """Distinct stretches of n characters; none of a shorter text."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def spellings(terms: DataFrame) -> DataFrame:
    """term and spelling, folded, in both alphabets; blank terms have none."""
    own = terms.select("term").filter("trim(term) <> ''").distinct()
    return own.select("term", F.explode(tx.variants(F.col("term"))).alias("spelling"))


def contained(names: DataFrame, terms: DataFrame, starts: bool = False) -> DataFrame:
    """Distinct (name, term): the folded name has a spelling of the term anywhere, or
    where ``starts`` at the beginning of a word. Nulls and blank terms meet nothing."""
    own = names.select("name").filter("name IS NOT NULL").distinct().select("name", tx.fold(F.col("name")).alias("folded"))
    spelled = spellings(terms)
    sizes = range(1, GRAM + 1)
    index = own.select("name", "folded", F.explode(F.concat(*[_grams(F.col("folded"), n) for n in sizes])).alias("gram"))
    of = F.coalesce(*[F.when(F.length("spelling") >= n, _grams(F.col("spelling"), n)) for n in reversed(sizes)])
    asked = spelled.select("spelling").distinct().select("spelling", F.explode(of).alias("gram"))
    common = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no name has settles that its spellings are nowhere
    rarest = asked.join(common, "gram", "left").groupBy("spelling").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    rarest = rarest.filter("best.n > 0").select("spelling", "best.gram")
    found = index.join(rarest, "gram").filter(F.contains("folded", "spelling"))
    if starts:
        found = found.filter(F.rlike("folded", F.concat(F.lit(r"(?U)\b\Q"), F.replace("spelling", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))))
    return found.select("name", "spelling").join(spelled, "spelling").select("name", "term").distinct()


def alike(names: DataFrame, terms: DataFrame, least: float = 0.3) -> DataFrame:
    """(name, term, likeness) of all pairs whose word trigrams are alike enough. Pairs
    without a common trigram have likeness 0 and are never made."""
    grams = lambda df, key: df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("g", tm.word_trigrams(F.col(key))).select(key, F.size("g").alias(f"n_{key}"), F.explode("g").alias("gram"))
    common = grams(names, "name").join(grams(terms, "term"), "gram").groupBy("name", "term", "n_name", "n_term").agg(F.count("*").alias("n"))
    rated = common.withColumn("likeness", F.col("n") / (F.col("n_name") + F.col("n_term") - F.col("n")))
    return rated.filter(F.col("likeness") >= least).select("name", "term", "likeness")


def longest(names: DataFrame, products: DataFrame) -> DataFrame:
    """name, product_id and term: of the products (product_id, terms) that have a term at
    the beginning of a word of the name, the one with the longest term as it is written;
    of equals the smallest product, then the first term by letters. Names without one are
    left out, and null, blank or repeated terms and names change nothing.

    A term is settled to its smallest product before it meets any name, so a term that
    most products share is one row there, and each name keeps only its best.
    """
    owner = products.select("product_id", F.explode("terms").alias("term")).groupBy("term").agg(F.min("product_id").alias("product_id"))
    best = F.min(F.struct((-F.length("term")).alias("_shorter"), "product_id", "term")).alias("best")
    return contained(names, owner, starts=True).join(owner, "term").groupBy("name").agg(best).select("name", "best.product_id", "best.term")
