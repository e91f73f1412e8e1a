"""Review states against a fold of decisions one by one; the pilot over partitionings."""

import random

from tidemill.operators import review

COLUMNS = "seq long, item_id int, tender_id int, status string, corrected string, blind string, corrected_value string"


def folded(items, decisions):
    rows = {i: {"tender": t, "status": "pending", "value": None, "blind": None, "by": None, "seq": None} for i, t in items}
    for seq, item, tender, status, corrected, blind, _ in sorted(decisions, key=lambda d: d[0]):
        corrected, blind = (corrected or "").strip()[:2000] or None, (blind or "").strip()[:2000] or None
        if item is None:
            for r in rows.values():
                if status in ("approved", "rejected") and tender is not None and r["tender"] == tender and r["status"] == "pending":
                    r.update(status=status, value=None, by="bulk", seq=seq)
        elif item in rows and status in review.STATES and (status != "corrected" or corrected):
            r = rows[item]
            r.update(status=status, value=corrected if status == "corrected" else None, blind=r["blind"] or blind, by="single", seq=seq)
    return {i: tuple(r.values()) for i, r in rows.items()}


def test_states_as_a_fold(spark):
    rng = random.Random(5)
    items = [(i, rng.choice([1, 1, 1, 2, 3, None])) for i in range(60)]
    seqs = rng.sample(range(10_000), 400)
    texts = [None, "", " \t", "v", " w\n", "x" * 2500]
    states = [*review.STATES, *review.STATES, "pending", "odd", None]
    decisions = [(s, rng.choice([None, rng.randrange(70), rng.randrange(70)]), rng.choice([1, 2, 3, 4, None]), rng.choice(states), rng.choice(texts), rng.choice(texts), "clash") for s in seqs]
    own = spark.createDataFrame([(i, t, "clash", 0) for i, t in items], "item_id int, tender_id int, status string, seq int")
    for some in (decisions, decisions[:40], []):
        got = review.states(own, spark.createDataFrame(some, COLUMNS), salts=3).collect()
        assert len(got) == len(items)
        assert {r.item_id: tuple(r)[1:] for r in got} == folded(items, some)
    assert review.states(own.limit(0), spark.createDataFrame(decisions, COLUMNS)).count() == 0


def test_pilot_is_stable(spark):
    rows = [(i, f"2024-0{i % 9 + 1}-01 00:00:00", None if i % 5 == 0 else i % 40, "x") for i in range(200)] + [(None, None, 3, "x"), (7, "2024-08-01 00:00:00", 7, "x")]
    df = spark.createDataFrame(rows, "id int, close_at string, totalcost int, stratum string").withColumn("close_at", review.F.col("close_at").cast("timestamp"))
    runs = [[tuple(r) for r in review.pilot(df.repartition(n), "2024-05-15", each=8, blind=5).orderBy("place").collect()] for n in (1, 7)]
    assert runs[0] == runs[1]
    ids = [r[0] for r in runs[0]]
    assert len(ids) == len(set(ids)) <= 24 and [r[2] for r in runs[0]] == list(range(1, len(ids) + 1))
    assert [r[1] for r in runs[0][:3]] == ["deadline", "random", "value"] and [r[3] for r in runs[0]].count("blind") == 5
    assert review.pilot(df.limit(0), "2024-05-15").count() == 0
