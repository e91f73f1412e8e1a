"""Requirement rows over runs, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import demands

COLUMNS = ("tender_id long, source string, method string, ref long, position_no long, name string, value string, qty decimal(18,3), unit string, "
           "mandatory boolean, confidence double, status string, corrected_value string, note string")  # fmt: skip


def rows_of(rng, n, new):
    seen = {}
    for _ in range(n):
        ref = rng.choice([None, 1, 2])
        key = (rng.randrange(4), "register" if ref is None else "document", "m", ref, rng.choice([0, 1, 2, None]), rng.choice("ab"))
        status = "pending" if new else rng.choice(["pending", "approved", "rejected", "corrected", None])
        corrected = "own" if status == "corrected" else None
        seen[key] = (*key, rng.choice(["1", "2", None]), None, rng.choice(["kg", None]), True, rng.choice([0.4, 0.75, 0.9]), status, corrected, None if new else rng.choice([None, "old note"]))
    return list(seen.values())


def merged(old, new):
    table = {r[:6]: r for r in old}
    for r in new:
        was = table.get(r[:6])
        if was is None or was[11] == "pending":
            table[r[:6]] = (*r[:12], was and was[12], was and was[13])
        elif was[6] != r[6]:
            table[r[:6]] = (*r[:11], "pending", was[12], f"value changed: {was[6] or '-'} -> {r[6] or '-'}")
        else:
            table[r[:6]] = (*r[:11], was[11], was[12], was[13])
    return table.values()


@pytest.mark.parametrize("seed", range(3))
def test_merge_by_brute_force(spark, seed):
    rng = random.Random(seed)
    old, new = rows_of(rng, 60, False), rows_of(rng, 60, True)
    o, n = spark.createDataFrame(old, COLUMNS), spark.createDataFrame(new, COLUMNS)
    got = [tuple(r) for r in demands.merge(o, n.unionByName(n)).select(*o.columns).collect()]
    want = list(merged(old, new))
    key = repr
    assert sorted(got, key=key) == sorted(want, key=key)
    notes = [r[13] for r in want if r[13] and r[13].startswith("value")]
    assert notes and any("-> -" in x for x in notes)
    assert demands.merge(o.limit(0), n.limit(0)).count() == 0


def test_gate_and_short_form(spark):
    rng = random.Random(7)
    rows = list(merged(rows_of(rng, 80, False), rows_of(rng, 30, True)))
    df = spark.createDataFrame(rows, COLUMNS)
    held = [r for r in rows if r[11] not in (None, "rejected") and (r[11] in demands.DECIDED or r[10] >= 0.85)]
    got = [tuple(r) for r in demands.trusted(df).collect()]
    assert sorted(got, key=repr) == sorted(((*r[:6], r[12] or r[6], *r[7:]) for r in held), key=repr) and len(held) < len(rows)
    for r in demands.short_form(df, ["a"]).collect():
        live = [x for x in rows if x[0] == r.tender_id and x[11] not in (None, "rejected")]
        assert (r.n, r.pending, r.unsure) == (len(live), sum(x[11] == "pending" for x in live), sum(x[10] < 0.6 for x in live))
        best = max(((x[11] in demands.DECIDED, x[10]) for x in live if x[5] == "a"), default=None)
        tied = {x[12] or x[6] for x in live if x[5] == "a" and (x[11] in demands.DECIDED, x[10]) == best}
        assert r.a in (tied or {None})


def test_positions_are_numbered_in_blocks(spark):
    rng = random.Random(5)
    goods = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(40), rng.choice(["x", " ", None]), 1.5, "kg") for _ in range(300)]
    df = spark.createDataFrame(goods, "tender_id long, lot int, name string, amount double, unit string").repartition(5)
    got = [(r.tender_id, r.position_no, r.name) for r in demands.from_register(df, ["lot", "name"], F.floor(F.col("lot") / 7)).collect()]
    want = []
    for t in (1, 2):
        own = sorted((g for g in goods if g[0] == t), key=lambda g: (g[1], g[2] is not None, g[2] or ""))
        want += [(t, i, (g[2] or "").strip() or f"position {i}") for i, g in enumerate(own, 1)]
    assert sorted(got) == sorted(want)


def test_rules_give_rows_that_decisions_move(spark):
    docs = spark.createDataFrame([(1, 10, "Warranty 12 months. Warranty of 24 months, delivery 5 days"), (1, 11, "warranty ____ months"), (2, 12, None), (None, 13, "delivery 5 days")], "tender_id long, doc_id long, text string")
    rows = demands.from_rules(docs)
    plain = lambda df: sorted((r.ref, r.name, r.position_no, r.value, r.status) for r in df.collect())
    assert plain(rows) == [
        (10, "delivery_days", 1, "5", "pending"), (10, "warranty_months", 1, "12", "pending"), (10, "warranty_months", 2, "24", "pending"), (11, "warranty_months", 0, None, "pending"),
    ]
    decisions = [(1, "1|document|rules|10|1|warranty_months", 1, "corrected", "18", None), (2, None, 1, "approved", None, None), (3, "1|document|rules|11|0|warranty_months", 1, "rejected", None, None)]
    made = demands.decide(rows, spark.createDataFrame(decisions, "seq long, item_id string, tender_id long, status string, corrected string, blind string"))
    assert [r[-1] for r in plain(made)] == ["approved", "corrected", "approved", "rejected"]
    changed = docs.withColumn("text", F.regexp_replace("text", "12 months", "36 months"))
    again = demands.merge(made, demands.from_rules(changed))
    assert {(r.position_no, r.value, r.status, r.corrected_value, r.note) for r in again.filter("ref = 10 AND name = 'warranty_months'").collect()} == {
        (1, "36", "pending", "18", "value changed: 12 -> 36"), (2, "24", "approved", None, None),
    }
    assert sorted(r.name for r in demands.trusted(again).collect()) == ["delivery_days", "warranty_months"]


def test_log_of_runs(spark):
    rng = random.Random(2)
    rows = rows_of(rng, 60, True)
    df, tenders = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(i,) for i in range(6)], "tender_id long")
    log = demands.runs(df, tenders)
    assert sorted(map(tuple, demands.runs(df.repartition(7), tenders).collect()), key=repr) == sorted(map(tuple, log.collect()), key=repr)
    assert {r.tender_id for r in log.filter("status = 'no_text'").collect()} == {4, 5}
    other = df.withColumn("value", F.when((F.col("tender_id") == 3), F.lit("9")).otherwise(F.col("value")))
    assert {r.tender_id for r in demands.renewed(other, demands.runs(other, tenders), log).collect()} == {3}
    calls = spark.createDataFrame([(1, None), (4, "2030-01-01"), (5, "2030-01-01"), (7, "2030-01-01"), (8, "2020-01-01")], "tender_id long, close_at string").withColumn("close_at", F.col("close_at").cast("timestamp"))
    due = demands.due(calls, log, tenders.filter("tender_id = 4"), "2025-01-01")
    assert {r.tender_id for r in due.collect()} == {4, 7} and due.columns == calls.columns


def test_rules_begin_words_at_their_edges(spark):
    """After a letter with a mark a word begins in the query's SQL, and none does in the rules of all alphabets."""
    from tidemill.operators.company import ASCII_EDGES
    from tidemill.plans.demands import RULES

    texts = spark.createDataFrame([(1, 1, 'éen mentre token = "49c25'), (2, 2, "en mentre 7 d"), (3, 3, "éFOBé"), (4, 4, "12 m éla")], "tender_id long, doc_id long, text string")
    found = lambda edges: sorted((r.ref, r.name, r.value) for r in demands.from_rules(texts, RULES, edges).collect())
    latin = [(1, "delivery_days", "49"), (2, "delivery_days", "7"), (3, "incoterms", "FOB"), (4, "warranty_months", "12")]
    assert found(ASCII_EDGES) == latin
    assert found((r"(?U:\b)", r"(?U:\b)")) == latin[1:2]


def test_runs_with_marks_before_words_as_in_sql(spark, tmp_path):
    import os

    from oracle import differences

    from tidemill.plans import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    for name in os.listdir(sf):
        if not name.startswith("documents"):
            os.symlink(f"{sf}/{name}", tmp_path / name)
    texts = [(1, 'éen mentre token = "49c25'), (2, "éen mentre 7 d"), (3, "x éFOBé"), (4, "12 m éla")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, str(tmp_path), QUERIES["requirement_runs"], ORACLE_SQL["requirement_runs"]) == []


REQUIREMENTS = ("requirement_merge", "requirement_gate", "requirement_summary", "requirement_runs")


@pytest.mark.parametrize("name", REQUIREMENTS)
def test_rows_are_dealt_by_tender_once(spark, name):
    """Goods, rules' rows and decisions go to their tender, and nothing is shuffled by position, item or tender after that."""
    from tidemill.plans import QUERIES

    lines = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [line for line in lines if "Exchange hashpartitioning" in line]
    assert [line for line in shuffles if any(c in line for c in ("position_no", "item_id", "_block", "source"))] == []
    by_tender = [line for line in shuffles if "REPARTITION_BY_NUM" in line]
    assert len(by_tender) == (4 if name == "requirement_runs" else 3)
    assert not [line for line in shuffles if line not in by_tender and "tender_id" in line]


@pytest.mark.parametrize("name", REQUIREMENTS)
def test_large_tenders_go_by_blocks_as_in_sql(spark, monkeypatch, name):
    from oracle import differences

    from tidemill.plans import ORACLE_SQL, QUERIES, demands as plan
    from tidemill.sources.tables import crowded, table

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(plan, "CROWD", 7, raising=False)
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").count()
    large = {r[0] for r in rows.filter("count >= 7").collect()}
    assert 0 < len(large) < rows.count() and {r.key for r in crowded(table(spark, sf, "lineitem"), "l_orderkey", 7, 64).collect()} == large
    assert differences(spark, sf, QUERIES[name], ORACLE_SQL[name]) == []
