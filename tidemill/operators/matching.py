"""Relevance: profile scores, catalogue matches by code and by name, attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators.patterns import contained
from tidemill.operators.search import under

KEYWORD, REGION, BUDGET, CURRENCY = 60.0, 20.0, 15.0, 5.0


def profile_score(keywords=(), regions=(), currency=None, least=None, most=None, blob: str = "blob") -> Column:
    """0 to 100: keywords found, region, budget and currency; what a profile leaves
    open counts half."""
    hits = [tx.starts_word(F.col(blob), k).cast("int") for k in keywords]
    score = KEYWORD * reduce(lambda a, b: a + b, hits) / len(hits) if hits else F.lit(0.0)
    if regions:
        hit = reduce(lambda a, b: a | b, [under(F.col("area_path"), r) for r in regions])
        score = score + F.when(hit, REGION).otherwise(0.0)
    else:
        score = score + REGION / 2
    if least is None and most is None:
        score = score + BUDGET / 2
    else:
        cost = F.col("totalcost").cast("double")
        fits = (F.lit(True) if least is None else cost >= least) & (F.lit(True) if most is None else cost <= most)
        unknown = cost.isNull() | (F.lit(False) if currency is None else ~F.col("currency").eqNullSafe(F.lit(currency)))
        score = score + F.when(unknown, BUDGET / 2).when(fits, BUDGET).otherwise(0.0)
    if currency is None:
        return F.bround(score + CURRENCY / 2)
    return F.bround(score + F.when(F.col("currency").eqNullSafe(F.lit(currency)), CURRENCY).otherwise(0.0))


def by_code(goods: DataFrame, codes: DataFrame, lengths=None) -> DataFrame:
    """Goods under each row's code: a prefix join as an equi-join on the prefixes of
    the lengths that codes have, which are read from them (no more than the longest
    code has characters) unless given. Products of one code are best summed up before."""
    if lengths is None:
        lengths = sorted(r["n"] for r in codes.select(F.length("code").alias("n")).distinct().collect() if r["n"]) or [1]
    own = goods.select("*", F.explode(F.array_compact(F.array(*[F.when(F.length("good_code") >= n, F.substring("good_code", 1, n)) for n in lengths]))).alias("code"))
    return own.join(codes, "code")


def claimed(goods: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Positions (keys and good_code, once each) with claimants, how many products their
    code falls under (code, products, first), and first_claimant, the smallest of them. A
    position's code tells all of it, so that is found once for each code and no position is grouped again."""
    known = by_code(goods.select("good_code").distinct(), codes).groupBy("good_code").agg(F.sum("products").alias("claimants"), F.min("first").alias("first_claimant"))
    return goods.select(*keys, "good_code").distinct().join(known, "good_code").select(*keys, "good_code", "claimants", "first_claimant")


def by_name(goods: DataFrame, terms: DataFrame, starts: bool = False) -> DataFrame:
    """Goods whose name has a term in any spelling, or has it where a word starts."""
    return goods.join(contained(goods, terms, starts), "name")


def _by_set(tenders: DataFrame, goods: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products of the same codes, or without codes of the same terms, meet the same tenders:
    (product_id, how, set) with the smallest such product for the set, and (how, set,
    tender_id), once each. Distinct codes, names and terms are looked for once, then dealt to sets."""
    coded, how = F.size("codes") > 0, F.when(F.size("codes") > 0, "code").when(F.size("codes") < 1, "name")
    own = products.select("product_id", how.alias("how"), F.when(coded, F.col("codes")).otherwise(F.col("terms")).alias("items")).filter("how IS NOT NULL")
    own = own.groupBy("product_id", "how").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    sets = own.groupBy("how", "items").agg(F.min("product_id").alias("set"))
    members = own.join(sets, ["how", "items"]).select("product_id", "how", "set")
    items = lambda how, item: sets.filter(F.col("how") == how).select("set", F.explode("items").alias(item))
    codes, terms = items("code", "code"), items("name", "term")
    of_code = by_code(goods.select("good_code").distinct(), codes).groupBy("good_code").agg(F.collect_set("set").alias("sets"))
    named = contained(goods.select("name").union(tenders.select("name")), terms, starts=True).join(terms, "term")
    of_name = named.groupBy("name").agg(F.collect_set("set").alias("sets"))
    names = goods.select("tender_id", "name").unionByName(tenders.select("tender_id", "name"))

    def met(rows: DataFrame, how: str) -> DataFrame:
        # a tender's sets are told apart in its own row, so that no pair is shuffled
        own = rows.groupBy("tender_id").agg(F.array_distinct(F.flatten(F.collect_set("sets"))).alias("sets"))
        return own.select(F.lit(how).alias("how"), F.explode("sets").alias("set"), "tender_id")

    by_codes = met(goods.select("tender_id", "good_code").join(of_code, "good_code"), "code")
    return members, by_codes.unionByName(met(names.join(of_name, "name"), "name"))


def by_product(tenders: DataFrame, goods: DataFrame, products: DataFrame) -> DataFrame:
    """product_id, tender_id and how they match: "code" where a good's code starts with
    one of the product's; "name" where a product without codes has its name or a keyword
    at the start of a word of a good's or the tender's name.

    Tenders come as tender_id and name, products as product_id, codes and terms (arrays). The result has a row for each pair; ``tenders_by_product`` counts them
    without making them.
    """
    members, met = _by_set(tenders, goods, products)
    return members.join(met, ["how", "set"]).select("product_id", "tender_id", "how")


def tenders_by_product(tenders: DataFrame, goods: DataFrame, products: DataFrame) -> DataFrame:
    """product_id, how, the number of tenders that ``by_product`` finds and the earliest of
    them: counted for each set of codes or terms, then dealt to its products."""
    members, met = _by_set(tenders, goods, products)
    counted = met.groupBy("how", "set").agg(F.count("*").alias("tenders"), F.min("tender_id").alias("earliest"))
    return members.join(counted, ["how", "set"]).select("product_id", "how", "tenders", "earliest")


def attributed(goods: DataFrame, products: DataFrame, keys: list[str], least: float = 0.05) -> DataFrame:
    """For each claimed position (keys, good_code, name) its product: the only claimant,
    or the likest by trigrams if any is likely enough.

    Products come as product_id, code and product_name. Each distinct name of a good
    meets each distinct product name of its codes once, however many positions and
    products have them.
    """
    names = products.groupBy("code", "product_name").agg(F.count("*").alias("products"), F.min("product_id").alias("first"))
    names = names.withColumn("_product", tx.trigrams(F.col("product_name")))
    own = goods.select("good_code", "name").distinct().withColumn("_good", tx.trigrams(F.col("name")))
    rated = by_code(own, names).withColumn("likeness", tx.jaccard(F.col("_good"), F.col("_product")))
    best = rated.groupBy("good_code", F.col("name").alias("_name")).agg(
        F.max(F.struct("likeness", (-F.col("first")).alias("minus"), "product_name")).alias("best"), F.sum("products").alias("claimants")
    )
    sure = F.when(F.col("claimants") == 1, "certain").when(F.col("best.likeness") >= least, "likeliest").otherwise("unattributed")
    found = best.select("good_code", "_name", (-F.col("best.minus")).alias("product_id"), "best.product_name", "best.likeness", "claimants", sure.alias("attribution"))
    positions = goods.select(*keys, "good_code", "name").distinct().withColumnRenamed("good_code", "_code")
    joined = positions.join(found, (F.col("_code") == F.col("good_code")) & F.col("name").eqNullSafe(F.col("_name")))
    return joined.select("product_id", *keys, "good_code", "name", "product_name", "likeness", "claimants", "attribution")
