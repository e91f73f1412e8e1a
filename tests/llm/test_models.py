"""Tests of the operators that fit models."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, lattice_lm, pii, toxicity


def base_spans(text):
    text, out = text or "", []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TRAPS = [
    "a@b.c_x@y.zz a@@b.cc @x.y u@v..w p.q@r-s.t.u.",
    "00010.1.2.3 256.1.1.1 1.2.3.4.5.6.7.8 12.34.56",
    "4111111111111111 4111-1111 1111-1111 12 3 4-5 378282246310005 4111  111111111111",
    "+49 30 1234567- +1 +123456789012345678 +4 (0) 30.123.45.67)",
    "card 5500-0000-0000-0004, IBAN DE89 3704 0044 0532 0130 00, ssn 078-05-1120, Dr. Maria Garcia, call 030 1234567",
]


def test_base_spans_equal_plain_regexes():
    for text in [d[1] for d in brute.documents()] + TRAPS:
        assert pii.base_spans(text or "") == base_spans(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_rows(spark):
    rows = brute.documents() + [(300_000 + i, t, "en", "s", 1) for i, t in enumerate(TRAPS)]
    got = pii.op9(brute.frame(spark, rows)).collect()
    want = Counter()
    for doc, text, *_ in rows:
        found = base_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want[doc, *(sum(k == x for k, _, _ in found) for x in pii.BASE), hashlib.sha256(listed.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    last = next(r.spans for r in got if r.doc_id == 300_004)
    assert "iban:" in last and "ssn:" in last and "name:" in last
    assert pii.op9(brute.frame(spark).limit(0)).count() == 0
    clash = brute.frame(spark, rows).withColumn("spans", F.lit(1)).withColumn("row", F.lit(2)).withColumn("found", F.lit(3))
    assert Counter(pii.op9(clash).collect()) == Counter(got)
    assert pii.spans(clash, clash.columns).select("row.*").columns == clash.columns


def test_pii_added_spans_of_long_texts():
    """Candidates and votes in linear time, spans as a plain double loop finds them."""
    text = "call 030 1234567 or +49 30 1234567, ip 10.0.0.1, Dr. Maria Garcia, ssn 078-05-1120 mail a@b.de 0300 1234567@b.de " * 200
    base = pii.base_spans(text)
    taken = [x[1:] for x in base]
    got = pii.added_candidates(text, base)
    every = pii.added_candidates(text, [])
    assert got == [x for x in every if not any(a < x[2] and x[1] < b for a, b in taken)] and got != every
    began = time.perf_counter()
    found = pii.candidates(text * 100)
    assert len(found) >= 100 * len(base) and time.perf_counter() - began < 30


def test_pii_overlaps_go_to_the_likelier():
    found = [("ssn", 0, 9, 0.6), ("phone_local", 5, 20, 0.9), ("name", 20, 30, 0.7), ("iban", 29, 40, 0.7), ("card", 3, 25, 0.1), ("ipv6", 50, 60, 0.4)]
    assert pii.decided(found) == [("card", 3, 25, 0.1), ("phone_local", 5, 20, 0.9), ("name", 20, 30, 0.7)]


def test_pii_model_learns_from_votes():
    """EM ranks labelers by how they agree: one that votes at random ends less reliable than those that agree."""
    rng = random.Random(5)
    counts = Counter()
    for _ in range(4000):
        real = rng.random() < 0.5
        sure = lambda right: (1 if real else -1) * (1 if rng.random() < right else -1)  # noqa: E731, B023
        counts["ssn", pii._code((sure(0.95), sure(0.9), 0, sure(0.5), 0, sure(0.9)))] += 1
    model = pii.Model(counts)
    of = model.by_kind[pii.KINDS.index("ssn")]
    assert of[0] > 0.88 and of[1] > 0.82 and of[3] < 0.62
    right = sum(n for (k, c), n in counts.items() if (model.probability(k, pii._decode(c)) >= 0.5) == (sum(pii._decode(c)[j] for j in (0, 1, 5)) > 0))
    assert right == sum(counts.values())


def all_cuts(pieces, word):
    """Log probability of a word, summed over its segmentations one by one."""
    if not word:
        return 1.0
    return sum(math.exp(pieces.log_p[pieces.ids[word[:k]]]) * all_cuts(pieces, word[k:]) for k in range(1, len(word) + 1) if word[:k] in pieces.ids)


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.Pieces(lattice_lm.vocabulary_path())
    words = ["the", "nation", "thonerti,", "é", "x" * 40, "日", "\U0001f600", "ab\U0001f600"]
    got = pieces.log_likelihood([w.encode() for w in words])
    for w, x in zip(words[:4], got):
        assert math.exp(x) == pytest.approx(all_cuts(pieces, "▁" + w), rel=1e-9)
    assert all(math.isfinite(x) and x < 0 for x in got)


def test_expected_counts_cover_words():
    import numpy as np

    pieces = lattice_lm.Pieces(lattice_lm.vocabulary_path())
    got = pieces.expected([b"the", b"nation"], np.array([2.0, 3.0]))
    lengths = {i: len(p) for p, i in pieces.ids.items()}
    assert sum(got[i] * lengths[i] for i in range(len(got)) if got[i] > 0) == pytest.approx(2 * 4 + 3 * 7)


def test_base_scores(spark):
    rows = brute.documents()
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    split = lambda t: (t or "").encode().lower().split() + [None]
    train = Counter(w for d, t, *_ in rows if not held(d) for w in split(t))
    n, v = sum(train.values()), len(train)
    want = {d: (held(d), len(w := split(t)), sum(x in train for x in w), sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, t, *_ in rows}
    got = lattice_lm.op6(brute.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:3], n)
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    small = {r.doc_id: r.score for r in lattice_lm.score(brute.frame(spark, rows), ~lattice_lm.held_out(F.col("doc_id")), ["doc_id"], head_words=10).selectExpr("row.doc_id", "score").collect()}
    assert all(small[r.doc_id] == pytest.approx(r.score, rel=1e-9) for r in got)
    assert lattice_lm.op6(brute.frame(spark).limit(0)).count() == 0


def test_scores_equal_plain_lattices(spark):
    """score and lattice_score against the sum over every segmentation, one by one."""
    texts = ["the nation", "the the sat", "a nation of cats", "sat", None, "a a a a the", "cats of the nation sat"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = brute.frame(spark, rows).withColumn("word", F.lit(1)).withColumn("rest", F.lit(2)).withColumn("key", F.lit(3))
    got = {r.row.doc_id: r for r in lattice_lm.score(docs, F.col("doc_id") < 5, docs.columns, head_words=2).collect()}
    assert got[0].row.asDict().keys() == set(docs.columns)
    train = [(t or "").split() for t in texts[:5]]
    c = Counter(w for t in train for w in t)
    n, ones, twos = sum(c.values()) + len(train), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    off = ones / (ones + 2 * twos)
    spare = off * (len(c) + 1) / n
    counts = spark.createDataFrame([(w.encode(), k) for w, k in c.items()], "word binary, c long")
    path = lattice_lm.vocabulary_path()
    pieces = lattice_lm.Pieces(path, lattice_lm.fit(counts, path, len(train)))
    end = math.log10((len(train) - off) / n + spare * len(train) / n)
    for i, t in enumerate(texts):
        own = [all_cuts(pieces, "▁" + w) for w in (t or "").split()]
        assert got[i].lattice_score == pytest.approx(end + sum(map(math.log10, own)), rel=1e-9)
        both = [max(c[w] - off, 0) / n + spare * p for w, p in zip((t or "").split(), own)]
        assert got[i].score == pytest.approx(end + sum(map(math.log10, both)), rel=1e-9)


def test_least_count(spark):
    counts = spark.createDataFrame([(str(i).encode(), i) for i in range(1, 1001)], "word binary, c long")
    for most in (0, 1, 10, 500, 999, 5000):
        least = lattice_lm.least_count(counts, most)
        assert least >= 2 and sum(i >= least for i in range(1, 1001)) <= most
        assert most != 500 or sum(i >= least for i in range(1, 1001)) > 400


def test_toxicity_fits_all_patterns(spark, monkeypatch):
    """Sums made by tasks give the model that the driver gets from all patterns at once."""
    rows, labels = [], []
    marks = ["zorgle", "idiot", "blivet", "moron", "scum", "quaxle"]
    for i in range(600):
        said = [w for j, w in enumerate(marks) if i % 4 == 0 and (i // 4 + 1) >> j & 1]
        rows.append((i, " ".join(["plain", "words", "of", "text", chr(97 + i % 26) * 3, *said]), "en", "s", 1))
        labels.append((i, int(bool(said))))
    docs, given = brute.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = toxicity.fit(docs, given)
    monkeypatch.setattr(toxicity, "FIT_PATTERNS", 3)
    summed = toxicity.fit(docs, given)
    assert summed.voters == whole.voters and any(whole.weights)
    assert summed.weights == pytest.approx(whole.weights, abs=1e-6) and summed.bias == pytest.approx(whole.bias, abs=1e-6)


def test_toxicity(spark):
    marks = ["idiot", "grawlexa", "grawlexo", "grawlexin"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [f"w{(i * 7 + k * 13) % 400}" for k in range(30)]
        letters = " ".join(w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words)
        rows.append((i, letters + (" " + marks[i // 5 % 4] if toxic else ""), "en", "s", 1))
        labels.append((i, int(toxic)))
    rows += [(10_000 + i, t, "en", "s", 1) for i, t in enumerate(brute.EDGE)]
    docs = brute.frame(spark, rows)
    given = spark.createDataFrame(labels + [(None, 1), (3, None), (99_999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.op5(docs, given).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, x in labels if got[i].held_out and got[i].predicted != x]
    assert not wrong
    assert all(got[10_000 + i].predicted == 0 and 0 <= got[10_000 + i].score <= 1 for i in range(len(brute.EDGE)))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.op5(docs.limit(0), none).count() == 0
    assert toxicity.clean(docs, none).columns == docs.columns


def test_decontamination(spark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = duckdb.sql(f"SELECT item_id, text FROM '{brute.SF}/benchmark.parquet'").fetchall() + [(900, "Short item É"), (901, None), (902, ""), (903, "short ITEM é")]
    rows = brute.documents() + [(400_000, "a short-item é! b", "en", "s", 1), (400_001, items[3][1].upper() + " tail", "en", "s", 1)]
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    want = Counter()
    for doc, text, *_ in rows:
        w, hit, ids = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    ids |= found
                    hit |= set(range(i, i + size))
        want[doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    docs, bench = brute.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.op3(docs, bench).collect()
    assert Counter(tuple(r) for r in got) == want
    some = bench.filter("item_id IN (1, 2, 3, 4, 900, 903)").coalesce(1)
    whole = decontaminate.scan(docs, some, ["doc_id"]).collect()
    for limits in ({"block_bytes": 500}, {"block_words": 180}):
        parts = decontaminate.scan(docs, some, ["doc_id"], **limits).collect()
        assert sorted(map(str, whole)) == sorted(map(str, parts))
    span = next(r.out.spans for r in whole if r.row.doc_id == 400_000)
    assert [(s.a, s.b) for s in span] == [(2, 14)]
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)
    clash = docs.withColumn("out", F.lit(1)).withColumn("row", F.lit(2)).withColumn("item_id", F.lit(3)).withColumn("outs", F.lit(4))
    assert decontaminate.clean(clash, bench).columns == clash.columns
    assert Counter(tuple(r) for r in decontaminate.op3(clash, bench.withColumn("doc_id", F.lit(1))).collect()) == want
    assert decontaminate.op3(docs.limit(0), bench).count() == 0


def test_decontamination_of_a_long_item_and_text(spark):
    """An item of more words than a block holds, and a text of very many words."""
    item = " ".join(f"w{i:x}" for i in range(140_000))
    text = "x " + " ".join(f"w{i:x}" for i in range(99_990, 100_010)) + " y " + " ".join(f"v{i:x}" for i in range(300_000))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = brute.frame(spark, [(1, text, "en", "s", 1), (2, "clean", "en", "s", 1)]).coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.op3(docs, bench).collect()}
    assert got == {1: (300_022, 20, 1), 2: (1, 0, 0)}
