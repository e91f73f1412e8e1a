"""Upserts, state machines and retention over tables that are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.stats import latest


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of their key, but for the columns kept from the old."""
    o, n = F.struct(*old.columns).alias("_o"), F.struct(*new.columns).alias("_n")
    both = old.select(*keys, o).join(new.select(*keys, n), keys, "full_outer")

    def value(c: str) -> Column:
        if c in keep:
            return F.coalesce(F.col(f"_o.{c}"), F.col(f"_n.{c}"))
        return F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))

    return both.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


def patch(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values where they are given, old ones where they are null."""
    o, n = old.select(*keys, F.struct(*old.columns).alias("_o")), new.select(*keys, F.struct(*new.columns).alias("_n"))
    return o.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"_n.{c}", f"_o.{c}").alias(c) for c in old.columns if c not in keys])


def add(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counters summed by key."""
    values = [c for c in old.columns if c not in keys]
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is already there are ignored, repeated new ones too."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that come in are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new)


def keep_last(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return latest(rows, keys, *order)


def flag_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """New values with the old one beside it and whether it changed; others as they were."""
    o, n = old.select(*keys, F.col(value).alias("_o")), new.select(*keys, F.col(value).alias("_n"))
    both = o.join(n, keys, "full_outer")
    changed = F.col("_o").isNotNull() & F.col("_n").isNotNull() & ~F.col("_o").eqNullSafe(F.col("_n"))
    return both.select(*keys, F.coalesce("_n", "_o").alias(value), F.when(changed, F.col("_o")).alias(f"old_{value}"), changed.alias("changed"))


def review_again(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A reviewed row whose value comes in changed is pending again, with a note."""
    o = old.select(*keys, F.col(value).alias("_o"), "review")
    both = o.join(new.select(*keys, F.col(value).alias("_n")), keys, "full_outer")
    changed = F.col("_n").isNotNull() & ~F.col("_n").eqNullSafe(F.col("_o"))
    reviewed = F.coalesce(F.col("review") != "pending", F.lit(False))
    return both.select(
        *keys,
        F.coalesce("_n", "_o").alias(value),
        F.when(changed, "pending").otherwise(F.coalesce("review", F.lit("pending"))).alias("review"),
        F.when(changed & reviewed, "value changed").alias("note"),
    )
