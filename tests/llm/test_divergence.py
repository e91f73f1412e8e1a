import re
from collections import Counter, defaultdict

import pytest
from oracle import differences

from tidemill.llm import divergence, queries

SF = "/root/testdata/sf0.01"


def test_same_rows_as_sql(spark):
    assert differences(spark, SF, queries.QUERIES["op12_divergence"], queries.ORACLE_SQL["op12_divergence"]) == []


def plain(rows, min_docs, top):
    words = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = words.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups.add((lang, source))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own, everything = shares(counts[lang, source]), Counter()
        for s in {s for x, s in groups if x == lang}:
            everything.update(counts[lang, s])
        q = shares(everything)
        parts = {"pair": [], "term": [(t, own[t] - q[t]) for t in kept if counts[lang, source][t] and own[t] > q[t]]}
        for s in {s for x, s in groups if x == lang} - {source}:
            there = shares(counts[lang, s])
            parts["pair"].append((s, sum(abs(own[t] - there[t]) for t in kept)))
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            for rank, (item, value) in enumerate(items, 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


ROWS = [
    ("en", "a", "Naïve über-test x y one one two"),
    ("en", "a", "one two THREE"),
    ("en", "b", "three three_one 3one\ttwo one"),
    ("en", "c", ""),
    ("en", None, "two " * 5000),
    (None, "a", "one one"),
    (None, None, None),
    ("de", "a", "日本 one ärger Ärger"),
    ("de", "b", "one 日本日本"),
    ("de", "b", "one 日本日本"),
    ("fr", "only", "rien"),
]


@pytest.mark.parametrize("block_terms", [2, 1000])
@pytest.mark.parametrize("min_docs", [1, 2, 9])
def test_equals_a_plain_version(spark, min_docs, block_terms):
    """Nulls, empty and long texts, repeated rows, ties, no kept terms, several automata, clashing columns."""
    docs = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "lang string, source string, text string, term string, n string").repartition(3)
    got = divergence.audit(docs, min_docs, 4, block_terms)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == plain(ROWS, min_docs, 4)


def test_counts_beyond_a_long(spark):
    rows = spark.createDataFrame([(10**12, 10**13, 7)], "n long, total long, v long")
    assert rows.select(divergence._p("n", "total", "v").alias("p")).first().p == 1 + 10**9 * (10**12 + 5) // (10**13 + 35)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
