"""What belongs to one company, against plain versions and small cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.operators import company, decisions, retrieval


def test_requirements_by_brute_force(spark):
    texts = [
        "Warranty of not less than 12 months. Delivery within 30 days.", "Аванс 15 %. Warranty. 12 months", None, "",
        "Гарантийный срок на основные узлы: статоры, роторы составляет 24 месяца", "30 days after delivery; 30 days of delivery",
        "warranty ____ months and penalty 0.5 %", "CIF Tashkent or DAP, CIFX", "kafolat muddati 18 oy, jarima 3 foiz", "warranty " + "x" * 200 + " 12 months",
    ]
    rng = random.Random(4)
    words = "warranty delivery 12 30 months days . experience 5 years penalty 7 % ____ hours response".split()
    texts += [" ".join(rng.choice(words) for _ in range(25)) for _ in range(60)]
    got = company.requirements(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"]).collect()
    want = set()
    for i, t in enumerate(texts):
        for name, rule in company.RULES.items() if t else ():
            after, before, blank = (re.compile(p, re.I) for p in company.rule_patterns(*rule))
            want |= {(i, name, v, 0.75, "extracted") for p in (after, before) for v in p.findall(t)}
            want |= {(i, name, None, 0.40, "needs_review")} if blank.search(t) else set()
        want |= {(i, "incoterms", v, 0.75, "extracted") for v in re.findall(r"\b(" + "|".join(company.INCOTERMS) + r")\b", t or "")}
    assert {(r.i, r.name, r.value, r.confidence, r.status) for r in got} == want and len(got) == len(want)
    by = {(r.i, r.name): r.value for r in got}
    assert (by[0, "warranty_months"], by[0, "delivery_days"], by[1, "advance_percent"], by[4, "warranty_months"]) == ("12", "30", "15", "24")
    assert (1, "warranty_months") not in by and (9, "warranty_months") not in by and by[6, "warranty_months"] is None


def test_isolation(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "company int, x string")
    assert [r.x for r in company.own(df, 2).collect()] == ["b"]
    with pytest.raises(ValueError):
        company.own(df, None)


def test_import_without_doing_it(spark):
    had = spark.createDataFrame([(1, "Ring"), (2, "Bolt")], "company int, name string")
    new = spark.createDataFrame([(1, "ring "), (1, "RING"), (1, "Bolt"), (2, "nut")], "company int, name string")
    got = {r.company: (r.inserted, r.updated) for r in company.forecast(company.scoped_upsert(had, new, "company", "name"), "company").collect()}
    assert got == {1: (1, 1), 2: (1, 0)}


def test_decision_rows_by_brute_force(spark):
    rng = random.Random(9)
    steps = [(rng.randrange(3), i, rng.choice(["open", "search", "decide", "change"])) for i in range(200)]
    want = []
    for key in range(3):
        row, now = 0, None
        for k, _, step in steps:
            if k != key:
                continue
            if step == "open" and now is None:
                now = [key, row, True, False, 0]
            elif step == "search" and now:
                now[4] += 1
            elif step == "decide":
                now = now or [key, row, False, False, 0]
                want.append((*now[:3], True, now[4]))
                row, now = row + 1, None
        if now:
            want.append(tuple(now))
    got = company.decision_rows(spark.createDataFrame(steps, "key int, n int, step string"), ["key"], ["n"]).collect()
    assert sorted((r.key, r.row, r.opened, r.closed, r.searches) for r in got) == sorted(want)


def test_document_types(spark):
    texts = ["Licence", "Sertifikat № 5", "see the BANK-guarantee", "kafolat   xati", "licences", None, "", "устав общества"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [r.y for r in df.select("i", company.document_type(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == ["license", "certificate", "guarantee", "guarantee", None, None, None, "charter"]


def test_seven_criteria(spark):
    row = dict(missing_documents=0, lead_days=5, delivery_days=10, capacity=100.0, cost=50.0, advance_percent=30, experience=3, experience_needed=2, confirmed=True,
               area_path="1.2", regions=["1"], certificates_held=["fire"], certificates_needed=["fire"])
    cases = [({}, "go"), ({"area_path": "10"}, "review"), ({"certificates_held": None}, "no_go"), ({"certificates_held": [], "confirmed": False}, "review"),
             ({"area_path": None, "certificates_needed": None}, "go"), ({"cost": 200.0, "confirmed": False}, "no_go"), ({"regions": None}, "go")]
    schema = ("missing_documents int, lead_days int, delivery_days int, capacity double, cost double, advance_percent int, experience int, experience_needed int, "
              "confirmed boolean, area_path string, regions array<string>, certificates_held array<string>, certificates_needed array<string>, n int")  # fmt: skip
    rows = [(*(row | change).values(), n) for n, (change, _) in enumerate(cases)]
    got = [r.decision for r in decisions.qualify(spark.createDataFrame(rows, schema)).orderBy("n").collect()]
    assert got == [want for _, want in cases]


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, [0.0] * 8), (201, None)]
    rows += [(300, rows[0][1])]  # a tie with its copy
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    whole = sorted(map(tuple, retrieval.nearest(df, df.filter("vec_id % 10 = 0"), 4).select("query", "near", "rank").collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    assert sorted(map(tuple, retrieval.nearest(df, df.filter("vec_id % 10 = 0"), 4).select("query", "near", "rank").collect())) == whole
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    own = {i: v for i, v in rows if v and any(v)}
    want = []
    for q in (i for i in own if i % 10 == 0):
        order = sorted((-round(cos(own[q], v), 9), i) for i, v in own.items() if i != q)[:4]
        want += [(q, i, n + 1) for n, (_, i) in enumerate(order)]
    assert whole == sorted(want)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_allocation_by_brute_force(spark, width):
    """A running sum in blocks is the sum along the order, for a product with most positions too."""
    rng = random.Random(width)
    stock = {0: 90, 1: 12, 2: None, None: 5}
    rows = []
    for i in range(300):
        p = rng.choice([0, 0, 0, 0, 1, 2, None])
        rows.append((i, p, rng.choice([None, 0, 1, 2, 3]), stock[p], rng.choice([True, True, True, False, None])))
    need, want = dict.fromkeys(stock, 0), {}
    for i, p, required, had, unit_ok in rows:
        if not unit_ok or required is None or had is None:
            want[i] = ("unknown", None)
            continue
        need[p] += required
        want[i] = ("enough", None) if not required or need[p] <= had else ("short", min(required, need[p] - had))
    df = spark.createDataFrame(rows, "n int, product_id int, required int, stock int, unit_ok boolean").withColumn("need", F.lit("x"))
    got = decisions.allocate(df, ["n"], F.floor(F.col("n") / width))
    assert got.columns == [*df.columns, "status", "shortfall"]
    assert {r.n: (r.status, r.shortfall) for r in got.collect()} == want and len({s for s, _ in want.values()}) == 3
    assert decisions.allocate(df.limit(0), ["n"], F.lit(0)).count() == 0
