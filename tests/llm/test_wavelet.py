import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import tokens, wavelet


def shard_of(ids):
    ids = np.array(ids, "<u4")
    return wavelet.Shard(wavelet.build(ids, np.array([7], np.int64), np.array([False]), np.array([len(ids)])))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=1300), st.integers(0, 1400), st.integers(0, 1400))
def test_shard_answers_as_the_list_does(ids, a, b):
    shard = shard_of(ids)
    assert shard.decode().tolist() == ids
    for token in {0, 3, 70, 500, *ids[:5]}:
        at = [i for i, t in enumerate(ids) if t == token]
        assert shard.count(token) == len(at)
        assert list(shard.occurrences(token)) == at
        assert shard.count(token, a, b) == ids[a:b].count(token)
        with pytest.raises(IndexError):
            shard.select(token, len(at))
    for i in range(0, len(ids), 97):
        assert shard.access(i) == ids[i]


def test_wide_ids_and_several_stretches(monkeypatch):
    monkeypatch.setattr(wavelet, "STRETCH", 128)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 200_000, 6000)
    shard = shard_of(ids)
    assert (shard.decode() == ids).all()
    for i in (0, 1023, 1024, 5999):
        assert shard.access(i) == ids[i]
        assert i in list(shard.occurrences(int(ids[i])))
    with pytest.raises(ValueError):
        wavelet.Shard(b"something else")


TEXTS = [None, "", "Hello, world's  end", "naïve Straße ÉCOLE 12 ½ ² ª", "a\x1fb <|endoftext|> x", "日本語 Ω é", "it's " * 1500, "x" * 9000, "Ünder_score's 'Tis"]


def test_ids_equal_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHE_PARTS", 40)  # generations come and go
    whole = Tokenizer.from_file(tokens.tokenizer_path())
    own = tokens.WordIds(tokens.tokenizer_path())
    rng = random.Random(3)
    letters = [chr(c) for c in range(1, 0x180)] + list("'’stvlmdre \n\t") * 12
    texts = [t for t in TEXTS if t] + ["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def encoded(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokens.tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("shard_tokens", [50, wavelet.SHARD_TOKENS])
def test_files_give_back_every_document(spark, tmp_path, shard_tokens):
    """Nulls, empty and long texts, repeated rows, a clashing column, short and long shards."""
    rows = [(i, t, "q") for i, t in enumerate(TEXTS)] + [(None, "no id", "q"), (None, None, "q"), (3, TEXTS[3], "q"), (-5, "below", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    shards = wavelet.write(docs, f"file://{tmp_path}/files", shard_tokens=shard_tokens, ranges=3)
    got = sorted(wavelet.documents(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(i), len(e := encoded(t)), zlib.crc32(np.array(e, "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    assert (shards.count() > 5) == (shard_tokens == 50)

    every = [t for r in got for t in encoded(next(x[1] for x in rows if x[0] == r.doc_id and zlib.crc32(np.array(encoded(x[1]), "<u4").tobytes()) == r.ids_crc32))]
    asked = sorted({1, every[3], every[len(every) // 2], 49000})
    found = wavelet.lookup(shards, asked).collect()
    for token in asked:
        at = [i for i, t in enumerate(every) if t == token]
        own = [r for r in found if r.token == token]
        assert sum(r.n for r in own) == len(at)
        assert min((r.earliest for r in own if r.n), default=None) == (at[0] if at else None)
        assert max((r.latest for r in own if r.n), default=None) == (at[-1] if at else None)


def test_no_rows(spark):
    assert wavelet.op11(spark.createDataFrame([], "doc_id long, text string")).count() == 0
