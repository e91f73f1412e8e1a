"""Faceted search over tenders: predicates, cards, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as tx

SORTS = ("close_at", "publicated_at", "totalcost", "id")


def live(as_of: str) -> Column:
    return F.col("close_at").isNull() | (F.col("close_at") > F.lit(as_of).cast("timestamp"))


def is_open(as_of: str) -> Column:
    return (F.col("status") == "open") & live(as_of)


def under(path: Column, root: str | Column, sep: str = ".") -> Column:
    """Whether a materialised path is a node or lies under it."""
    root = F.lit(root) if isinstance(root, str) else root
    return (path == root) | F.startswith(path, F.concat(root, F.lit(sep)))


def filters(as_of: str, status=None, region=None, currency=None, source=None) -> Column:
    """The conjunction of the filters that are given; open implies a live deadline."""
    parts = [F.lit(True)]
    if status == "open":
        parts.append(is_open(as_of))
    elif status:
        parts.append(F.col("status") == status)
    if region:
        parts.append(under(F.col("area_path"), region))
    if currency:
        parts.append(F.col("currency") == currency)
    if source:
        parts.append(F.col("source") == source)
    return reduce(lambda a, b: a & b, parts)


def with_product(tenders: DataFrame, goods: DataFrame, terms: list[str]) -> DataFrame:
    """Tenders with a good whose name has any spelling of any term."""
    hit = reduce(lambda a, b: a | b, [tx.contains_any(F.col("name"), t) for t in terms])
    return tenders.join(goods.filter(hit).select(F.col("tender_id").alias("id")).distinct(), "id", "left_semi")


def free_text(tenders: DataFrame, goods: DataFrame, term: str) -> DataFrame:
    """Tenders whose buyer, or one of whose goods, has any spelling of the term."""
    own = tenders.filter(tx.contains_any(F.col("company_name"), term)).select("id")
    by_goods = goods.filter(tx.contains_any(F.col("name"), term)).select(F.col("tender_id").alias("id"))
    return tenders.join(own.union(by_goods).distinct(), "id", "left_semi")


def ordered(sort: str | None) -> list[Column]:
    """"name" or "-name" of a known column, nulls last, the newest id first on ties."""
    name = (sort or "").lstrip("-")
    if name not in SORTS:
        sort, name = "-publicated_at", "publicated_at"
    c = F.col(name)
    return [c.desc_nulls_last() if sort.startswith("-") else c.asc_nulls_last(), F.col("id").desc()]


def page(found: DataFrame, sort: str | None, limit: int, offset: int) -> DataFrame:
    return found.orderBy(*ordered(sort)).offset(offset).limit(max(1, min(200, limit)))


def cards(tenders: DataFrame, goods: DataFrame, areas: DataFrame, preview: int = 6) -> DataFrame:
    """Tenders with their region's name, lots, and the first distinct goods by name."""
    own = goods.groupBy(F.col("tender_id").alias("id")).agg(
        F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, preview), ", ").alias("goods_preview"),
        F.countDistinct("lot_id").alias("n_lots"),
        F.sum("totalcost").alias("goods_cost"),
    )
    names = areas.select(F.col("area_id").alias("area_path"), F.col("name").alias("region_name"))
    return tenders.join(own, "id", "left").join(F.broadcast(names), "area_path", "left")


def closed_reason(as_of: str, terminal: tuple[str, ...]) -> Column:
    """Why a tender can't be bid for: its status, then its deadline; null if it can."""
    late = F.col("close_at").isNotNull() & (F.col("close_at") <= F.lit(as_of).cast("timestamp"))
    return F.when(F.col("status").isin(*terminal), "status").when(late, "deadline")
