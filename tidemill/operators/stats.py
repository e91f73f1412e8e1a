"""Aggregates: two-level statistics, roll-ups along paths and codes, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ancestors(path: Column, sep: str = ".") -> Column:
    """A path and all it lies under, top first: a hierarchy join becomes an equi-join."""
    parts = F.split(path, f"\\{sep}")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), sep))


def prefixes(code: Column, lengths: tuple[int, ...] = (2, 5, 8)) -> Column:
    """A code's prefixes of the lengths that codes have."""
    own = F.array(*[F.substring(code, 1, n) for n in lengths])
    return F.array_distinct(F.filter(own, lambda x: F.length(x) <= F.length(code)))


def by_area(areas: DataFrame, tenders: DataFrame) -> DataFrame:
    """Count and cost of the tenders under each area; areas without any stay, and
    tenders without a path make a row without an area."""
    counted = tenders.select(F.explode_outer(ancestors(F.col("area_path"))).alias("area_id"), "totalcost")
    counted = counted.groupBy("area_id").agg(F.count("*").alias("n"), F.sum("totalcost").alias("cost"))
    joined = areas.join(counted, "area_id", "full_outer")
    return joined.select("area_id", "name", F.coalesce("n", F.lit(0)).alias("n"), "cost")


def dictionary(goods: DataFrame, open_ids: DataFrame, top: int = 8) -> DataFrame:
    """A row for each code prefix: positions, distinct open tenders, parent, most frequent names."""
    rows = goods.select(F.explode(prefixes(F.col("good_code"))).alias("code"), "tender_id", "name")
    names = rows.groupBy("code", "name").agg(F.count("*").alias("k"))
    named = names.groupBy("code").agg(
        F.sum("k").alias("n_positions"),
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "name"))), 1, top).alias("names"),
    )
    opened = rows.join(open_ids.select(F.col("id").alias("tender_id")), "tender_id", "left_semi")
    opened = opened.groupBy("code").agg(F.countDistinct("tender_id").alias("n_open"))
    parent = F.when(F.length("code") == 8, F.substring("code", 1, 5)).when(F.length("code") == 5, F.substring("code", 1, 2))
    return named.join(opened, "code", "left").select(
        "code", parent.alias("parent"), "n_positions", F.coalesce("n_open", F.lit(0)).alias("n_open"), F.transform("names", lambda x: x["name"]).alias("names")
    )
