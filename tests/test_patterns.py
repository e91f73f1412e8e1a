import re

from tidemill.functions import text as tx
from tidemill.operators import matching, patterns

NAMES = [
    "Насос центробежный", "nasos suv uchun", "Стол письменный", "столб бетонный", "престол", "IP-камера Hikvision DS-2", "Кабель медный", "kabel mis 3x2", "ўқув қўлланма",
    "o'quv qo'llanma", "Щебень", "sheben", "ПОДЪЁМНИК", "podyomnik", "a", "", None, "50% (qora) [x]*", "stol stol", "Бумага А4", "qog'oz A4", r"odd \E end", "кабельный стол",
]
TERMS = ["nasos", "стол", "stol", "hikvision ds", "kabel", "кабель медный", "o'quv", "щебень", "подъемник", "A4", "%", "(qora", "a", "з", "4", "", "  ", None, "nowhere at all", r"\E e", "ka", "bum"]


def brute(test):
    fold = lambda x: x.lower().translate(str.maketrans(dict(zip("эёыйщ", "ееииш")) | {"ь": None, "ъ": None}))
    return {(n, t) for n in NAMES if n is not None for t in TERMS if t and t.strip() for v in tx.variants_of(t) if test(v, fold(n))}


def test_contained_equals_contains_over_all_spellings(spark):
    names = spark.createDataFrame([(n, 1) for n in NAMES * 2], "name string, term int").repartition(3)
    terms = spark.createDataFrame([(t,) for t in TERMS * 2], "term string")
    got = {tuple(r) for r in patterns.contained(names, terms).collect()}
    assert got == brute(lambda v, n: v in n)
    assert ("Насос центробежный", "nasos") in got and ("nasos suv uchun", "nasos") in got and ("престол", "stol") in got
    starts = {tuple(r) for r in patterns.contained(names, terms, starts=True).collect()}
    assert starts == brute(lambda v, n: re.search(r"\b" + re.escape(v), n))
    assert ("престол", "stol") not in starts and ("столб бетонный", "stol") in starts


def test_alike_equals_all_pairs(spark):
    def grams(x):
        return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", x.lower()) for i in range(len(w) + 1)}

    names, terms = [n for n in NAMES if n], ["kabel mis", "stol", "кабель", "qora", "?"]
    got = {(r.name, r.term): r.likeness for r in patterns.alike(spark.createDataFrame([(n,) for n in NAMES], "name string"), spark.createDataFrame([(t,) for t in terms], "term string"), 0.2).collect()}
    want = {(n, t): len(grams(n) & grams(t)) / len(grams(n) | grams(t)) for n in names for t in terms if grams(n) | grams(t)}
    assert got == {k: v for k, v in want.items() if v >= 0.2}


def test_products_by_code_or_name(spark):
    """A product with codes never falls back to its name; the tender's own name counts."""
    goods = spark.createDataFrame([(1, "Насос", "28.13.11"), (2, "престол", "31.01.12"), (3, "tok", None), (4, "стол", "31.09.13")], "tender_id long, name string, good_code string")
    tenders = spark.createDataFrame([(1, "x"), (2, None), (3, "stollar xaridi"), (5, "nasos kerak")], "tender_id long, name string")
    products = spark.createDataFrame([(10, ["28.13"], ["nasos"]), (11, [], ["stol", "none"]), (12, ["99"], ["stol"]), (13, [], []), (14, [], [None, " "])], "product_id long, codes array<string>, terms array<string>")
    got = {tuple(r) for r in matching.by_product(tenders, goods, products).collect()}
    assert got == {(10, 1, "code"), (11, 3, "name"), (11, 4, "name")}


def test_no_rows(spark):
    names, terms = spark.createDataFrame([], "name string"), spark.createDataFrame([("x",)], "term string")
    assert patterns.contained(names, terms).count() == patterns.alike(names, terms).count() == 0
    assert patterns.contained(terms.withColumnRenamed("term", "name"), names.withColumnRenamed("name", "term")).count() == 0


def test_longest_term_picks_the_product(spark):
    products = [(3, ["kompyuter", None, " "]), (2, ["kompyuter sichqonchasi", "sichqoncha"]), (1, ["kompyuter", "kompyuter"]), (4, ["stol"]), (5, None), (9, ["насос"])]
    names = ["Kompyuter sichqonchasi qora", "КОМПЬЮТЕР", "Kompyuter", "престол", "Столб", None, "", "nasoslar", "Kompyuter", "umumiy"]
    df = spark.createDataFrame([(n, "x", 7) for n in names], "name string, term string, product_id int")
    got = {r.name: (r.product_id, r.term) for r in patterns.longest(df, spark.createDataFrame(products, "product_id int, terms array<string>")).collect()}
    # "стол" begins "Столб", as word starts are all that is asked
    want = {"Kompyuter sichqonchasi qora": (2, "kompyuter sichqonchasi"), "Kompyuter": (1, "kompyuter"), "Столб": (4, "stol"), "nasoslar": (9, "насос")}
    assert {k: v for k, v in got.items() if k != "КОМПЬЮТЕР"} == want
    none = spark.createDataFrame([], "product_id int, terms array<string>")
    assert patterns.longest(df, none).count() == 0


def test_products_of_one_set_are_counted_once(spark):
    """Counts per product equal those of the pairs, and pairs are not made for them: 300 products share each set."""
    goods = spark.createDataFrame([(t, "stol temir"[: 4 + t % 7], f"{t % 3}1.02") for t in range(60)] * 2 + [(None, "stol", "11")], "tender_id long, name string, good_code string")
    tenders = spark.createDataFrame([(t, None if t % 2 else "temir") for t in range(70)], "tender_id long, name string")
    own = [(n, [] if n % 3 else ["11", "21.0"][: n % 2 + 1], ["stol", "temir"][: n % 2 + 1]) for n in range(900)]
    products = spark.createDataFrame([*own, (5, ["01"], None), (None, None, None)], "product_id long, codes array<string>, terms array<string>")
    pairs = {}
    for r in matching.by_product(tenders, goods, products).collect():
        pairs.setdefault((r.product_id, r.how), []).append(r.tender_id)
    assert all(len(v) == len(set(v)) for v in pairs.values()) and (5, "code") in pairs and (5, "name") in pairs
    counted = matching.tenders_by_product(tenders, goods, products)
    assert {(r.product_id, r.how): (r.tenders, r.earliest) for r in counted.collect()} == {k: (len(v), min(x for x in v if x is not None)) for k, v in pairs.items()}
    _, met = matching._by_set(tenders, goods, products)
    assert met.count() < 400
