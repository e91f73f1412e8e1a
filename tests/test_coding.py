from tidemill.operators import coding
from tidemill.plans import QUERIES


def test_families(spark):
    """A category's divisions are those of all categories under its parent."""
    rows = coding.divisions(spark).collect()
    own = lambda parent: {r.division for r in rows if r.parent == parent}
    assert own("tibbiyot") == {"21", "32", "86", "87", "88"}
    assert {"29", "30", "45", "49"} <= own("transport") and own("boshqa") == set()
    got = spark.createDataFrame([("21.10",), ("99.1",), ("",), (None,)], "code string").select(coding.category_of("code").alias("c")).collect()
    assert [r.c for r in got] == ["tibbiyot", "boshqa", "boshqa", "boshqa"]


def test_fusion_keeps_codes_of_any_list(spark):
    lists = {
        "words": spark.createDataFrame([(1, "21.10", 2), (1, "31.01", 1), (2, "31.01", 1)], "product_id long, code string, rank int"),
        "vectors": spark.createDataFrame([(1, "21.10", 1), (1, "99.00", 2)], "product_id long, code string, rank int"),
    }
    products = spark.createDataFrame([(1, "tibbiyot"), (2, None), (3, "mebel")], "product_id long, category string")
    volumes = spark.createDataFrame([("21.10", 3), ("31.01", 500)], "code string, n_open long")
    got = {(r.product_id, r.code): (r.score, r.signals, r.place) for r in coding.suggested(products, lists, volumes).collect()}
    assert got == {
        (1, "21.10"): (round(1 / 62 + 1 / 61 + 1 / 61 + 3e-5, 9), "vectors,words,family", 1),
        (1, "31.01"): (round(1 / 61 + 5e-4, 9), "words", 2),
        (1, "99.00"): (round(1 / 62, 9), "vectors", 3),
        (2, "31.01"): (round(1 / 61 + 5e-4, 9), "words", 1),
    }


def test_lists_meet_both_alphabets(spark):
    products = spark.createDataFrame([(1, ["nasos suv", "kabel"]), (2, [None, "zzz"])], "product_id long, terms array<string>")
    names = spark.createDataFrame([("28.13", "насос", 1), ("28.13", "suv", 2), ("27.32", "кабель медный", 1), ("01.11", "suv nasosi emas", 1)], "code string, name string, place int")
    tri = {(r.product_id, r.code): r["rank"] for r in coding.by_trigrams(products, names).collect()}
    assert set(tri) >= {(1, "28.13"), (1, "27.32")} and all(p == 1 for p, _ in tri)
    assert [(r.product_id, r.code) for r in coding.by_words(products, names).collect()] == [(1, "28.13")]


def test_vectors_are_corrected_by_their_hubs(spark):
    """A code that is near to every other one loses to one that is only near to the product."""
    codes = spark.createDataFrame([(1, "hub", [1.0, 1.0]), (2, "a", [1.0, 0.9]), (3, "b", [0.9, 1.0]), (4, "c", [1.0, 0.8]), (5, "own", [1.0, -0.2]), (5, "same", [1.0, -0.2])], "code_id long, code string, v array<double>")
    products = spark.createDataFrame([(7, [1.0, 0.35]), (8, None)], "product_id long, v array<double>")
    got = sorted((r["rank"], r.code) for r in coding.by_vectors(products, codes).collect())
    assert [c for _, c in got][:2] == ["own", "same"] and len(got) == 6


def test_lists_read_no_goods_again(spark):
    """What the lists share is settled once, so the plan that fuses them reads none of the large tables."""
    read = QUERIES["code_suggestion"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [f for f in read if f.startswith("file:///root/testdata")]
