"""Procurement tables, and how the synthetic tables stand in for them.

orders are tenders, lineitem with part their goods, nation in region the area
tree, part the catalogue and its brands' suppliers, events the operational log.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-07-01 00:00:00"
#: Rows of a large table for each part that it is dealt into; what is below MANY parts is left to Spark.
ROWS, MANY = 500_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where none is set and
    all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """Rows dealt by a key into parts by the number of rows of a stored table, which its files'
    footers tell. Left to itself Spark brings parts of one size together until they fill a
    part of the shuffle, which is millions of narrow rows to be sorted and hashed in one task."""
    parts = of.count() // ROWS
    return rows.repartition(parts, key) if parts >= MANY else rows


def crowded(rows: DataFrame, key: str, least: int = ROWS, slots: int = 2**16) -> DataFrame:
    """The keys (key) that have so many rows at least; few, as they share the rows. Rows are counted by a hash
    of the key first, so that only keys of full slots are counted one by one."""
    held = rows.select(F.col(key).alias("key"), F.pmod(F.xxhash64(key), F.lit(slots)).alias("_slot")).filter("key IS NOT NULL")
    full = held.groupBy("_slot").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("_slot")
    return held.join(F.broadcast(full), "_slot", "left_semi").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("key")


def money(c: Column | str) -> Column:
    """Exact to the cent, so sums don't depend on their order."""
    return F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")


def as_double(c: Column) -> Column:
    return c.cast("double")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area_id as a materialised path "region.nation", level, parent and name."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select(F.col("r_regionkey").cast("string").alias("area_id"), F.col("r_name").alias("name"), F.lit(1).alias("level"))
    low = n.select(
        F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("area_id"),
        F.col("n_name").alias("name"),
        F.lit(2).alias("level"),
    )
    return top.unionByName(low)


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    where = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("currency"),
        F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("area_path"),
    )
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "finished").otherwise("paused")
    return o.join(where, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"),
        status.alias("status"),
        money("o_totalprice").alias("totalcost"),
        "currency",
        "area_path",
        "company_name",
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderdate").alias("publicated_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("close_at"),
    )


def goods(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, but: DataFrame | None = None) -> DataFrame:
    """All goods, or only those of tenders (tender_id), or all but those of some; the others are left before anything is looked up for them."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    own = li if of is None else li.join(of, F.col("l_orderkey") == F.col("tender_id"), "left_semi")
    own = own if but is None else own.join(but, F.col("l_orderkey") == F.col("tender_id"), "left_anti")
    code = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."), F.upper(F.substring("p_type", 1, 2)), F.lit("."), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    part = p.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("unit"), code.alias("good_code"))
    return dealt(own, "l_partkey", li).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("tender_id"),
        F.col("l_linenumber").alias("lot_id"),
        F.col("l_partkey").alias("product_id"),
        "name",
        "unit",
        "good_code",
        F.col("l_quantity").cast("decimal(18,3)").alias("amount"),
        money("l_extendedprice").alias("totalcost"),
        F.col("l_shipdate").alias("shipped_at"),
    )


# The same views in SQL for the oracle.
SQL = """
areas AS (
  SELECT r_regionkey::VARCHAR AS area_id, r_name AS name, 1 AS level FROM region
  UNION ALL SELECT n_regionkey::VARCHAR || '.' || n_nationkey::VARCHAR, n_name, 2 FROM nation),
tenders AS (
  SELECT o_orderkey AS id,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'paused' END AS status,
    o_totalprice::DECIMAL(18,2) AS totalcost, c_mktsegment AS currency,
    n_regionkey::VARCHAR || '.' || n_nationkey::VARCHAR AS area_path, c_name AS company_name,
    o_orderpriority AS source, o_orderdate AS publicated_at, o_orderdate + INTERVAL 30 DAY AS close_at
  FROM orders LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey),
goods AS (
  SELECT l_orderkey AS tender_id, l_linenumber AS lot_id, l_partkey AS product_id, p_name AS name, p_type AS unit,
    lpad(p_size::VARCHAR, 2, '0') || '.' || upper(p_type[1:2]) || '.' || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS good_code,
    l_quantity::DECIMAL(18,3) AS amount, l_extendedprice::DECIMAL(18,2) AS totalcost, l_shipdate AS shipped_at
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
