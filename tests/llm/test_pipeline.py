"""The pipeline's stages, one after the other, against plain versions."""

import random
import re
from collections import Counter, defaultdict

import brute
import pytest
from test_native import plain_dedup
from test_ngram_join import plain

import corpus_pipeline
from tidemill.llm import line_dedup, toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    passage = " ".join(word() for _ in range(14))
    rows, labels = [], []
    for i in range(240):
        lines = [" ".join(word() for _ in range(20)) for _ in range(3)]
        if i % 8 == 0:
            lines[1] += " grawlexa idiot"
        if i % 9 == 1:
            # inside a line of its own words: as a line by itself on a ninth of a host's pages it is boilerplate
            lines.insert(2, f"{word()} {passage.upper()} {word()}")
        lines.insert(0, "Subscribe to our newsletter today")
        rows.append([i, "\n".join(lines), "en", f"src{i % 2}", 0])
        labels.append((i, 1, int(i % 8 == 0)))
    for i in range(240, 280):  # near copies, one word changed
        words = rows[i - 239][1].split(" ")
        words[-1] = word()
        rows.append([i, " ".join(words), "en", "src0", 0])
    rows += [[300 + i, t, None, None, None] for i, t in enumerate(brute.EDGE)]
    rows.append(list(rows[5]))
    brute.frame(spark, [tuple(r) for r in rows]).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda r: (r.doc_id, r.text)
    before, seen = docs.collect(), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        after = out.collect()
        seen.append(name)
        if name == "toxicity":
            want = Counter(key(r) for r in before if "grawlexa" not in (r.text or ""))
            assert Counter(map(key, after)) == want
        elif name == "line_dedup":
            plainly = plain_dedup([tuple(r) for r in before], line_dedup.RATIO, line_dedup.MIN_PAGES)
            want = Counter()
            for (doc, _, _, text), n in plainly.items():
                want[doc, text] += n
            assert Counter(map(key, after)) == want
            assert all(r.text is None or r.n_chars == len(r.text) for r in after)
        elif name == "ngram_jaccard_join":
            part = {d: c for d, _, c in plain([tuple(r) for r in before])}
            words = {r.doc_id for r in before if (r.text or "").split()}
            want = {d for d in part if d not in words or part[d] == d}
            assert Counter(r.doc_id for r in after if r.doc_id in words) == Counter(want & words)
            assert {r.doc_id for r in after} == want
        elif name == "decontamination":
            passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id = 1").first().text.split()
            windows = [" ".join(passage[i : i + 10]) for i in range(5)]
            hit = lambda t: any(w in " ".join(re.findall("[0-9a-z]+", (t or "").lower())) for w in windows)
            assert Counter(map(key, after)) == Counter(key(r) for r in before if not hit(r.text))
            assert len(after) < len(before)
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            fill = defaultdict(int)
            for r in after:
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= 2048
            return
        assert out.columns == docs.columns
        docs, before = spark.createDataFrame(after, docs.schema), after
    assert seen


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rejected_share_follows_threshold():
    model = toxicity.Model(["idiot"], [9.0, 0.0, 0.0], -6.0)
    assert model.score(0) < toxicity.THRESHOLD < model.score(1)
