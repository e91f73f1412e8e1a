import random
from itertools import combinations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import ngram_join


def plain(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def copies(n, seed, words=60, changes=3):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(words)] = "x" + str(rng.randrange(10**6))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("tile, points", [(2_000_000, 20_000), (400, 9), (150, 20)])
def test_components(spark, tile, points, monkeypatch):
    monkeypatch.setattr(ngram_join, "TOKEN_POINTS", points)
    monkeypatch.setattr(ngram_join, "FEW_NODES", points // 2)
    rows = brute.documents()
    texts = copies(40, 1) + copies(25, 2, 30) + ["A b C d e"] * 3 + ["a B c d E"] + ["one two"] * 2
    rows += [(None if i % 9 == 8 else 500_000 - i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(7, "same id another text entirely here", "en", "s", 1)]
    got = ngram_join.joined(brute.frame(spark, rows).repartition(5), tile_shingles=tile).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == plain(rows)


def test_tree_bounds_lose_no_pair():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 120)).astype(np.uint64)
        for _ in range(4):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 2**63, 2).astype(np.uint64)])))
    points = np.array([np.bincount((s % np.uint64(256)).astype(int), minlength=256) for s in sets], np.int32)
    sizes = np.array(list(map(len, sets)))
    tree = ngram_join.CountTree(points, sizes)
    for i, s in enumerate(sets):
        near = set(tree.query(points[i], len(s)).tolist())
        assert {j for j, t in enumerate(sets) if ngram_join.linked(s, t)} <= near


def test_no_rows(spark):
    assert ngram_join.op10(brute.frame(spark).limit(0)).count() == 0


def test_one_of_each_component_stays(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "A b c d e f", "en", "s", 1)]
    rows += [(3, None, "en", "s", 1), (4, "", "en", "s", 1), (1, "other words of the same id", "en", "s", 1)]
    clash = brute.frame(spark, rows)
    for c in ("row", "id", "text_hash", "node", "block", "token", "hash", "of"):
        clash = clash.withColumn(c, F.lit(1))
    assert ngram_join.clean(clash).columns == clash.columns and ngram_join.clean(clash).count() == 4
    left = ngram_join.clean(brute.frame(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted({(r[0], r[1]) for r in rows} - {(2, "A b c d e f")}, key=str)
