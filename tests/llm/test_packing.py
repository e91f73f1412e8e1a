import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25), st.sampled_from([(2, 1), (8, 3), (3, 8)]))
def test_plan_places_each_piece_once_without_gaps(histogram, shape):
    plan = packing.Plan(histogram, 64, *shape)
    placed, fill = set(), defaultdict(list)
    for length, first, past, base, each, at in plan.rows:
        for r in range(first, past):
            placed.add((length, r))
            fill[base + (r - first) // each].append((at + (r - first) % each * length, length))
    assert placed == {(n, r) for n, c in histogram.items() for r in range(c)}
    assert len(fill) == plan.sequences
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


TEXTS = [None, "", "Hello, world's  end", "naïve Straße ÉCOLE 12 ½", "a\x1fb <|endoftext|> x", "日本語 Ω é", "it's " * 1500, "x" * 9000]


def test_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    words = packing.WordIds(packing.tokenizer_path())
    for text in filter(None, TEXTS):
        ids = np.frombuffer(words.encode(text), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, text


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, length string")
    rows = packing.op2(docs.repartition(3)).collect()
    fill = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t in enumerate(TEXTS * 2):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 2048))
        for r in own:
            part = ids[r.start : r.start + 2048]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))


def test_no_rows(spark):
    assert packing.op2(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_met_once_are_not_remembered():
    words = packing.WordIds(packing.tokenizer_path())
    once = [f"x{'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10]}q" for n in range(50)]
    first = [words.encode(w) for w in once]
    assert not words and not words.older
    assert [words.encode(w) for w in once] == first and words
    words.remembered = 100
    for n in range(2000):
        words.encode(f"{'klmnopqrst'[n % 10]}{'abcdefghij'[n // 10 % 10]}{'uvwxyz'[n // 100 % 6]} " * 2)
    assert len(words) + len(words.older) <= 100
    assert [words.encode(w) for w in once] == first


def test_places_need_no_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(n, "word " * n) for n in range(1, 40)], "doc_id long, text string")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("a list goes through a second group of workers"))
    assert sum(r["length"] for r in packing.op2(docs).collect()) >= 39
