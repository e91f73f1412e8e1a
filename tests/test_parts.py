from tidemill.operators import matching
from tidemill.sources import tables


def test_large_tables_are_dealt_by_their_rows(spark, tmp_path):
    """A part of so many rows whatever the table's size, small tables as they are, and the same rows."""
    spark.range(0, 30 * tables.ROWS, 1, 4).selectExpr("id % 1000 AS key").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert tables.dealt(stored, "key", stored).rdd.getNumPartitions() == 30
    assert tables.dealt(stored, "key", stored).count() == 30 * tables.ROWS
    few = stored.limit(10)
    assert tables.dealt(few, "key", few) is few


def test_positions_are_claimed_by_their_code(spark):
    goods = spark.createDataFrame([(1, 1, "11.2"), (1, 1, "11.2"), (1, 2, "11.3"), (2, 1, "12"), (3, 1, None), (None, 1, "11.2")], "tender_id long, lot_id long, good_code string")
    codes = spark.createDataFrame([("11", 4, 7), ("11.2", 2, 3), ("13", 1, 1)], "code string, products long, first long")
    got = {tuple(r) for r in matching.claimed(goods, codes, ["tender_id", "lot_id"]).collect()}
    assert got == {(1, 1, "11.2", 6, 3), (1, 2, "11.3", 4, 7), (None, 1, "11.2", 6, 3)}


def test_goods_of_some_tenders(spark):
    """A tender's goods once, however often it is named, and none of no tender."""
    sf = "/root/testdata/sf0.001"
    of = spark.createDataFrame([(3,), (3,), (7,), (None,), (-1,)], "tender_id long")
    got = sorted(map(tuple, tables.goods(spark, sf, of).collect()))
    assert got and got == sorted(map(tuple, tables.goods(spark, sf).filter("tender_id IN (3, 7)").collect()))
