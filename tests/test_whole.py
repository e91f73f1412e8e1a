"""Queries over all rows of their tables: SQL without its cuts, and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.functions import terms
from tidemill.operators import matching as op
from tidemill.plans import QUERIES


def grams(s):
    return {f"  {s.lower()} "[i : i + 3] for i in range(len(s) + 1)}


def test_attribution_by_brute_force(spark):
    words = "ring bolt gear lamp pump".split()
    products = [(i, ["10", "10.AB", "20.CD", "20.CD.07"][i % 4], f"{words[i % 5]} {words[i * 3 % 5]}") for i in range(40)] + [(99, "30", "zzz")]
    goods = [(i % 9, i, ["10.AB.01", "20.CD.07", "40.XX.00", "30.ZZ.01"][i % 4], f"{words[i % 5]} {words[i * 2 % 5]} x") for i in range(60)]
    got = op.attributed(
        spark.createDataFrame(goods + goods[:5], "tender_id int, lot_id int, good_code string, name string"),
        spark.createDataFrame(products, "product_id int, code string, product_name string"), ["tender_id", "lot_id"],
    ).collect()
    want = {}
    for tender, lot, code, name in goods:
        claims = sorted((-len(grams(name) & grams(p)) / len(grams(name) | grams(p)), i) for i, c, p in products if c in (code[:2], code[:5], code))
        if claims:
            kind = "certain" if len(claims) == 1 else "likeliest" if -claims[0][0] >= 0.05 else "unattributed"
            want[tender, lot, code, name] = (claims[0][1], round(-claims[0][0], 9), len(claims), kind)
    assert {(r.tender_id, r.lot_id, r.good_code, r.name): (r.product_id, round(r.likeness, 9), r.claimants, r.attribution) for r in got} == want
    assert len(got) == len(want)


def test_attribution(spark):
    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    code = lambda p: f"{p.p_size:02d}.{p.p_type[:2].upper()}"
    own = {p.p_partkey: p for p in parts}
    got = QUERIES["position_match"](spark, sf).collect()
    places = {(r.l_orderkey, r.l_linenumber, r.l_partkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()}
    assert len(got) == len(places) and {(r.tender_id, r.lot_id) for r in got} == {p[:2] for p in places}
    by_place = {(r.tender_id, r.lot_id, r.good_code, r.name): r for r in got}
    for tender, lot, key in sorted(places)[:500]:
        good = own[key]
        r = by_place[tender, lot, f"{code(good)}.{key % 100:02d}", good.p_name]
        claims = [p for p in parts if code(p) == code(good)]
        assert r.claimants == len(claims)
        # a good is of a product: nothing is liker than its own name
        assert (r.product_id, r.likeness) == (min(p.p_partkey for p in claims if grams(p.p_name) == grams(good.p_name)), 1.0)
        assert r.attribution == ("certain" if len(claims) == 1 else "likeliest")


def cover_rank(tokens, prefixes):
    where = [[i for i, t in enumerate(tokens) if t.startswith(p)] for p in prefixes]
    holds = lambda a, b: all(any(a <= i <= b for i in w) for w in where)
    ends = sorted({i for w in where for i in w})
    stretches = [(a, b) for a in ends for b in ends if a <= b and holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)]
    return sum(1 / (b - a + 1) for a, b in stretches)


@pytest.mark.parametrize("prefixes", [["the"], ["the", "and"], ["a", "b", "ab"]])
def test_cover_rank_by_brute_force(spark, prefixes):
    rng = random.Random(7)
    texts = [["and", "x", "the"], ["the", "and", "the"], ["the", "the"], [], ["there", "and", "", "the"]]
    texts += [[rng.choice("the and x a b ab abc then".split()) for _ in range(rng.randrange(40))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, tokens array<string>")
    got = {r.i: r.y for r in df.select("i", terms.cover_rank(F.col("tokens"), prefixes).alias("y")).collect()}
    assert got.pop(-1) == 0.0
    assert {i: round(x, 9) for i, x in got.items()} == {i: round(cover_rank(t, prefixes), 9) for i, t in enumerate(texts)}


def test_lexical_rank(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 3000").limit(60).collect()
    got = {r.doc_id: r["rank"] for r in QUERIES["lexical_rank"](spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        assert got[d.doc_id] == pytest.approx(cover_rank(re.split(r"[\W_]+", d.text.lower()), ["the", "and"]), abs=2e-6)


def place_asked(t, ways, void):
    """Every first stem against every other one."""
    for way in ways:
        at = [[i for i in range(len(t)) if t.startswith(w, i)] for w in way]
        for a in at[0]:
            near = [min(((abs(x - a), x) for x in own if abs(x - a) <= terms.REACH), default=None) for own in at[1:]]
            if None in near:
                continue
            low = min([a, *(x for _, x in near)])
            high = max([a + len(way[0]), *(x + len(w) for (_, x), w in zip(near, way[1:]))])
            if not any(v in t[max(0, low - terms.AROUND) : high + terms.AROUND] for v in void):
                return low, high, 90 if way[1:] else 70
    return None


def test_documents_asked_by_brute_force(spark):
    rng = random.Random(3)
    words = "copy license bank guarantee goods conformity certificate charter similar contract of software лицензия и".split()
    texts = ["", None, "license", "bank" + "x" * 80 + "guarantee", "bank" + "x" * 76 + "guarantee", "bank guarantee of goods", "лицензия"]
    texts += [" ".join(rng.choice([*words, "." * rng.randrange(40)]) for _ in range(rng.randrange(30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {(r.i, f.kind): (f.start, f.end, f.confidence) for r in df.select("i", terms.documents_asked(F.col("text")).alias("f")).collect() for f in r.f}
    want = {(i, k): p for i, t in enumerate(texts) for k, (ways, void) in terms.ASKED.items() if (p := place_asked(t or "", ways, void))}
    assert got == want and {k for _, k in want} == {"license", "certificate", "charter", "guarantee", "experience"}
    assert (3, "guarantee") not in got and got[4, "guarantee"] == (0, 87, 90) and (5, "guarantee") not in got and got[6, "license"] == (0, 6, 70)
    long = "bank " * 100_000 + "guarantee"
    places = terms.places_asked(long, terms.ASKED)
    assert [(p["kind"], p["end"]) for p in places] == [("guarantee", len(long) - 2)]


def test_excerpts_by_brute_force():
    rng = random.Random(8)
    texts = ["", None, "İ licence İ CERTIFIED"] + ["".join(rng.choice(["licen", "Certif", "x" * rng.randrange(90), " "]) for _ in range(rng.randrange(20))) for _ in range(200)]
    for t in texts:
        t = t or ""
        near = set()
        for w in ("licen", "certif"):
            near |= {k for i in range(len(t)) if t[i : i + len(w)].lower() == w for k in range(max(0, i - 60), min(len(t), i + len(w) + 60))}
        got = terms.excerpts(t, ["licen", "certif"])
        assert sorted(k for a, b in got for k in range(a, b)) == sorted(near)[:400]
        assert all(b < c for (_, b), (c, _) in zip(got, got[1:]))


def test_message_packing(spark):
    """Turns in order, each once, none over the limit that could be parted, none that had room before."""
    sf = "/root/testdata/sf0.001"
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text or "")):
        turns.setdefault(r.conv_id, []).append(len(r.text or ""))
    got = QUERIES["message_packing"](spark, sf).collect()
    assert sorted(r.conv_id for r in got) == sorted(turns)
    for size, packs in [(4000, [(turns[r.conv_id], r.messages) for r in got]), (50, [(t, terms.packed(["x" * n for n in t], 50)) for t in ([10, 39, 1], [49, 0], [60, 5, 50], [], [0, 0])])]:
        for own, messages in packs:
            assert [i for m in messages for i in m] == list(range(len(own)))
            length = [sum(own[i] for i in m) + len(m) - 1 for m in messages]
            assert all(n <= size or len(m) == 1 for n, m in zip(length, messages))
            assert all(n + 1 + own[m[0]] > size for n, m in zip(length, messages[1:]))


def test_term_keys(spark):
    names = ["Kabellarning  Qora", "qora kabel", "QORA-kabellar", "dan", None, "", "stol", "stollar"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, x string")
    got = {r.i: r.y for r in df.select("i", terms.term_key(F.col("x")).alias("y")).collect()}
    assert got[0] == got[1] == got[2] and got[6] == got[7] != got[0]
    assert got[3] is not None and got[4] is None and got[5] == ""
    assert [terms.stem(w) for w in ("stollar", "dardan", "onlar")] == ["stol", "dardan", "onlar"]
