import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import differences

from tidemill.llm import queries, vector_codes

SF = "/root/testdata/sf0.01"


def test_same_rows_as_sql(spark):
    assert differences(spark, SF, queries.QUERIES["op13_vector_codes"], queries.ORACLE_SQL["op13_vector_codes"]) == []


def plain(rows, parts, entries, rounds):
    """Full scans with Python's integers: rows (vec_id, vector, label)."""
    kept = [(i, [int(np.floor(float(x) * 1024)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == parts * width]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned():
        return [[min(range(len(books[p])), key=lambda c: (far(cut(v, p), books[p][c]), c)) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        at = assigned()
        for p in range(parts):
            for c in range(len(books[p])):
                own = [cut(r[1], p) for r, a in zip(kept, at) if a[p] == c]
                if own:
                    books[p][c] = [sum(x) // len(own) for x in zip(*own)]
    at = assigned()
    out = [(i, "".join(f"{x:02x}" for x in a), sum(far(cut(v, p), books[p][a[p]]) for p in range(parts)), label) for (i, v, label), a in zip(kept, at)]
    return out, books


def compare(spark, rows, parts=2, entries=5, rounds=4):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, v string").repartition(3)
    coded, books = vector_codes.encode(df, parts=parts, entries=entries, rounds=rounds)
    got = vector_codes.with_label_error(coded).collect()
    want, want_books = plain(rows, parts, entries, rounds)
    assert books.tolist() == want_books
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.label_error == sum(x[2] for x in want if x[3] == r.label)
    return got


def test_equals_full_scans(spark):
    """Repeated rows, equal ids, null ids and labels, nulls and non-finite components, ties, huge components."""
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=8) * rng.choice([0.01, 0.3])).tolist(), int(i) % 3 or None) for i in range(150)]
    rows += [(5, [0.25] * 8, 1)] * 4 + [(None, [0.5] * 8, 1), (200, None, 1), (201, [None] + [0.1] * 7, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] + [0.0] * 7, 2), (204, [0.1] * 6, 2)]
    rows += [(300 + i, [x / 4 for x in p], 7) for i, p in enumerate([(0, 1, 0, 0, 1, 1, 1, 1), (1, 0, 0, 0, 0, 0, 1, 1), (0, 0, 1, 0, 1, 0, 1, 0)] * 3)]
    compare(spark, rows)
    got = compare(spark, rows, rounds=6)
    assert 0 < sum(r.scanned for r in got) < 2 * len(got)  # bounds spare some scans and not all


def test_fewer_rows_than_entries(spark):
    compare(spark, [(2, [0.5, 1.0, -1.5, 0.0], 1), (1, [0.0, 0.0, 0.0, 0.0], None)], entries=256)


def test_components_beyond_the_largest_and_many_labels(spark):
    rows = [(1, [1e30, 0.0, -1e30, 0.0], 1), (2, [0.0] * 4, 2), (3, [-3e38, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.encode(df, parts=2, entries=2)
    assert abs(books).max() <= vector_codes.LARGEST
    few = {r.vec_id: r.label_error for r in vector_codes.with_label_error(coded).collect()}
    assert {r.vec_id: r.label_error for r in vector_codes.with_label_error(coded, few=0).collect()} == few


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=60), st.integers(1, 6), st.booleans())
def test_bounds_give_what_scans_give(points, k, large):
    """Small grids are full of ties; several rounds, one part."""
    v = np.array(points, np.int64) * (2**25 if large else 1)
    k = min(k, len(v))
    book = vector_codes.Codebook(v[:k][None])
    at, upper, lower = np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros(len(v))
    for _ in range(6):
        at, upper, lower, _ = book.assign(v, 0, at, upper, lower)
        d = ((v[:, None] - book.entries[0][None]) ** 2).sum(axis=2)
        assert at.tolist() == d.argmin(axis=1).tolist()
        new = book.entries.copy()
        for c in range(k):
            if (at == c).any():
                new[0, c] = v[at == c].sum(axis=0) // (at == c).sum()
        book = vector_codes.Codebook(new, book.entries)


def test_no_rows_and_lengths(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.op13(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.op13(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.op13(spark.createDataFrame([(1, [1.0, 2.0], 1)], schema))
