import math
import random
from collections import Counter, defaultdict
from math import comb

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm import line_dedup, quality, secrets


def labels(spark):
    rows = duckdb.sql(f"SELECT doc_id, quality FROM '{brute.SF}/labels.parquet'").fetchall()
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_quality_counts(spark):
    docs = brute.frame(spark)
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in quality.op7(docs, labels(spark)).collect()
    )
    assert got == Counter((d[0], *brute.quality_counts(d[1])) for d in brute.documents())


def tail(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_binomial_bound_is_exact(spark):
    for n, k, p in ((10, 2, 0.2), (50, 0, 0.05), (200, 7, 0.05), (200, 0, 0.05), (30_000, 1_400, 0.05), (1, 0, 0.05)):
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first().x
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n <= 200 else tail(k, n, p)
        assert got == pytest.approx(exact, rel=1e-7)


NAMES = "stratum string, good long, " + ", ".join(f"{r} double" for r in quality.RULES)


def chosen(spark, rows):
    got = quality.cutoffs(spark.createDataFrame(rows, NAMES)).collect()
    return {(r.stratum, rule): r[rule] for r in got for rule in quality.RULES if r[rule] is not None}


def plain_cutoffs(rows, alpha=quality.ALPHA, delta=quality.DELTA):
    names = ["stratum", "good", *quality.RULES]
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(dict(zip(names, r)))
    tests = max(1, len(by)) * sum(map(len, quality.RULES.values()))
    out = {}
    for s, own in by.items():
        good, bad = [r for r in own if r["good"]], [r for r in own if not r["good"]]
        for rule, cuts in quality.RULES.items():
            best, most = None, 0.0
            for cut in cuts if good and bad else ():
                g, b = sum(r[rule] > cut for r in good), sum(r[rule] > cut for r in bad)
                if g <= alpha * len(good) and tail(g, len(good), alpha) <= delta / tests and b / len(bad) - g / len(good) > most:
                    best, most = cut, b / len(bad) - g / len(good)
            if best is not None:
                out[s, rule] = best
    return out


def test_cutoffs_limit_false_rejection(spark):
    good = [("de", 1, 0.001 * (i % 10)) for i in range(2000)]
    bad = [("de", 0, 0.5) for _ in range(100)]
    few = [("fr", 1, 0.0), ("fr", 0, 0.5)]
    rows = [(s, g, x, 0.0, 0.0, 0.0, 0.0) for s, g, x in good + bad + few]
    assert set(chosen(spark, rows)) == {("de", "symbol_share")}
    assert chosen(spark, rows) == plain_cutoffs(rows)
    assert chosen(spark, []) == {}


def test_cutoffs_of_many_strata(spark):
    """More strata than a driver's list would be kept for; each gets its own cutoffs."""
    rng = random.Random(1)
    rows = []
    for k in range(700):
        for i in range(450 if k % 100 == 0 else 3):
            good = int(i % 3 > 0)
            rows.append((f"s{k}", good, *[max(0.0, rng.gauss(0.02 if good else 0.5, 0.1 if k % 200 else 0.02)) for _ in quality.RULES]))
    got = chosen(spark, rows)
    assert got == plain_cutoffs(rows)
    assert {s for s, _ in got} >= {"s0", "s200", "s400", "s600"}


def test_kept_is_what_the_plain_rules_keep(spark):
    """kept against a plain version: repeated texts are one trial, labels that disagree count as bad."""
    rng = random.Random(2)
    rows, given = [], []
    for i in range(900):
        good = i % 3 > 0
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) + ("!" if not good and rng.random() < 0.5 else "") for _ in range(40))
        rows.append((i, text, "en" if i % 2 else None, "s", 1))
        given.append((i, int(good)))
    rows += [(2000 + i, rows[1][1] + "!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!", "en", "s", 1) for i in range(200)]
    given += [(2000 + i, 1) for i in range(200)] + [(0, 1), (1, 0)]
    docs, labels = brute.frame(spark, rows), spark.createDataFrame(given, "doc_id long, quality int")
    measured = {r.row.doc_id: r for r in quality.measures(docs, ["doc_id"]).collect()}
    trials = {}
    least = {}
    for d, g in given:
        least[d] = min(g, least.get(d, 1))
    for d, text, lang, *_ in rows:
        key = (lang, text)
        trials[key] = (min(least[d], trials.get(key, (1,))[0]), d)
    cuts = plain_cutoffs([("" if lang is None else f"={lang}", g, *[measured[d][r] for r in quality.RULES]) for (lang, _), (g, d) in trials.items()])
    want = {}
    for d, _, lang, *_ in rows:
        s = "" if lang is None else f"={lang}"
        want[d] = not measured[d].base_failed and not any(measured[d][r] > cuts.get((s, r), 9e9) for r in quality.RULES)
    assert cuts and set(want.values()) == {True, False}
    assert {r.doc_id: r.kept for r in quality.op7(docs.withColumn("good", F.lit(1)).withColumn("stratum", F.lit(2)), labels.withColumn("text", F.lit(3))).collect()} == want


def test_quality_rejects_nothing_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality.op7(brute.frame(spark), none).collect())


def test_secret_spans(spark):
    got = Counter(
        (r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.op8(brute.frame(spark)).collect()
    )
    assert got == Counter((d[0], *brute.secret_base(d[1])) for d in brute.documents())


def test_ledger_scans_only_unseen_pairs(spark):
    docs = brute.frame(spark)
    old = docs.filter("doc_id % 2 = 0")
    first = secrets.update(old, None)
    second = secrets.update(docs, first)
    assert first.join(second, "blob").count() == 0
    assert second.count() == docs.select("text").na.fill("").distinct().count() - first.count()
    assert secrets.update(docs, first.union(second)).count() == 0
    more = [*secrets.RULES, ("pin", r"pin: [0-9]{4}", 0, 4)]
    again = secrets.update(docs, first.union(second), rules=more)  # other rules, another version: all blobs anew
    assert again.count() == first.count() + second.count() and secrets.version_of(more) != secrets.version_of()
    assert secrets.update(docs, first.union(second).union(again), rules=more).count() == 0
    whole = {(r.row.doc_id, str(r.spans)) for r in secrets.findings(docs, secrets.update(docs, None), ["doc_id"]).collect()}
    parts = {(r.row.doc_id, str(r.spans)) for r in secrets.findings(docs, first.union(second), ["doc_id"]).collect()}
    assert whole == parts


def test_ledger_of_versions(spark):
    """Every version of a document is a path; a text that two of them share is one blob."""
    key, rows = "ghp_" + "z1" * 20, []
    for doc in range(6):
        rows += [(doc, 1, f"text {doc} token={key}"), (doc, 2, f"text {doc} without"), (doc, 3, f"text {doc} token={key}" if doc % 2 else None)]
    paths = spark.createDataFrame(rows, "doc_id long, version int, text string")
    older = secrets.update(paths.filter("version = 1"), None)
    newer = secrets.update(paths, older)
    assert (older.count(), newer.count()) == (6, 7)  # six texts without, and the empty one
    found = secrets.findings(paths.withColumn("blob", F.lit(1)), older.union(newer), ["doc_id", "version", "blob"])
    got = {(r.row.doc_id, r.row.version): [s.kind for s in r.spans] for r in found.collect()}
    assert got == {(d, v): ["assign", "github"] if t and key in t else [] for d, v, t in rows}


def plain_dedup(rows, ratio, least):
    pages, total = defaultdict(set), Counter()
    for i, (_, text, _, host, _) in enumerate(rows):
        total[host] += 1
        for line in (text or "").split("\n"):
            if line.strip(" "):
                pages[host, line.strip(" ")].add(i)
    out = []
    for doc, text, _, host, _ in rows:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (n := len(pages[host, x.strip(" ")])) < least or n <= ratio * total[host]]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_line_dedup(spark, limit):
    rows = brute.documents() + [(200_000 + i, "shared\nown %d" % i, "en", None, 1) for i in range(8)]
    got = line_dedup.dedup(brute.frame(spark, rows), "source", broadcast_lines=limit)
    got = Counter((r.row.doc_id, r.n_lines if r.kept is not None else 0, r.n_dropped if r.kept is not None else 0, r.kept) for r in got.collect())
    want = plain_dedup(rows, line_dedup.RATIO, line_dedup.MIN_PAGES)
    assert got == want
    assert any(dropped for _, _, dropped, _ in want)


def test_extra_columns_and_no_rows(spark):
    docs = brute.frame(spark).withColumn("kept", F.lit(1)).withColumn("host", F.lit(2)).withColumn("row", F.lit(3))
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    none = docs.limit(0)
    assert line_dedup.op4(none).count() == secrets.op8(none).count() == quality.op7(none, labels(spark)).count() == 0
