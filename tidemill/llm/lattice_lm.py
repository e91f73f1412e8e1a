"""Language-model scores from a subword lattice.

A word is every way to cut it into pieces of an existing vocabulary. The
vocabulary's own scores order the pieces at first; expectation-maximisation over
the counts of all training words, by forward and backward recursion in log
space, turns them into probabilities. A word's probability is what its lattice
sums to, the word as a whole being one more arc where training has it: counts
less an absolute discount, and the discounted mass for the lattice of pieces.
A text's probability is the product over its words and its end.

Word counts, discounts and expected piece counts come from all training texts.
Frequent words, a bounded number, are looked up where the text is read; the rest
go to their counts by a join on the word, so no word gathers rows.

Null texts count as empty: their end alone is scored. Repeated rows count and
are scored as often as they occur. Without training texts the first weights
score alone. An empty table gives no rows; further columns go along where they are
carried; a word of any length is one lattice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import map_arrow, remainder, stored, utf8

#: Most frequent words that are looked up rather than joined (about 20 MB in a task).
HEAD_WORDS = 150_000
#: Rounds of expectation-maximisation.
ROUNDS = 2
#: Words that a task counts before it hands them on.
FLUSH_WORDS = 400_000
#: Words whose lattices are summed at once, about.
LATTICE_WORDS = 10_000
_LONG = 28


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary's pieces, their log probabilities, and the lattices of words."""

    def __init__(self, path: str, log_p: np.ndarray | None = None):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.none = n
        by_length: dict[int, list[str]] = {}
        for p in self.ids:
            by_length.setdefault(len(p), []).append(p)
        hashed = np.concatenate([next(self._hashes("".join(own), length))[-1] for length, own in by_length.items()])
        order = np.argsort(hashed)
        self.hashed, self.hashed_id = hashed[order], np.array([self.ids[p] for own in by_length.values() for p in own])[order]
        if log_p is None:
            # merge scores fall by one a rank; a rank's weight falls as one by it
            scores = np.array([model.get_score(i) for i in range(n)])
            used = np.zeros(n, bool)
            used[[*self.ids.values(), *self.bytes]] = True
            weight = np.where(used, 1 / (10 - np.minimum(scores, 0)), 0)
            log_p = np.log(np.maximum(weight / weight.sum(), 1e-300))
        self.log_p = np.append(log_p, -np.inf)

    @staticmethod
    def _hashes(joined: str, length: int, longest: int | None = None) -> Iterator[list[np.ndarray]]:
        """64-bit hashes of what starts at each position, for words of one length joined."""
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length).astype(np.uint64)
        for i in range(length):
            h, found = np.zeros(len(codes), np.uint64), []
            for j in range(i, min(length, i + (longest or length))):
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[:, j] + np.uint64(1)
                found.append(h)
            yield found

    def lattices(self, words: list[bytes]):
        """Words by length as (positions, arcs, ids of the arcs' pieces), words with
        characters that no piece has, and very long ones, singly."""
        by_length: dict[int, list[int]] = {}
        shown = ["▁" + w.decode("utf-8", "surrogatepass") for w in words]
        for k, w in enumerate(shown):
            by_length.setdefault(len(w), []).append(k)
        none = self.none
        for length, at in by_length.items():
            if length > _LONG:
                yield from (([k], *self._single(shown[k])) for k in at)
                continue
            arcs = [(i, j) for i in range(length) for j in range(i + 1, min(length, i + self.longest) + 1)]
            found = self._hashes("".join(map(shown.__getitem__, at)), length, self.longest)
            keys = np.stack([h for row in found for h in row], axis=1)
            place = np.minimum(np.searchsorted(self.hashed, keys), len(self.hashed) - 1)
            ids = np.where(self.hashed[place] == keys, self.hashed_id[place], none)
            single = [a for a, (i, j) in enumerate(arcs) if j == i + 1]
            odd = (ids[:, single] == none).any(axis=1)
            if odd.any():
                yield from (([k], *self._single(shown[k])) for k, o in zip(at, odd) if o)
                at, ids = [k for k, o in zip(at, odd) if not o], ids[~odd]
            if at:
                yield at, arcs, ids[:, :, None]

    def _single(self, word: str):
        arcs, ids = [], []
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                piece = self.ids.get(word[i:j])
                if piece is not None:
                    arcs.append((i, j))
                    ids.append([piece])
            if word[i] not in self.ids:  # bytes, as many pieces as there are
                arcs.append((i, i + 1))
                ids.append([self.bytes[b] for b in word[i].encode("utf-8", "surrogatepass")])
        width = max(map(len, ids))
        return arcs, np.array([x + [-1] * (width - len(x)) for x in ids])[None]

    def _weights(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < 0, 0.0, self.log_p[ids]).sum(axis=2)

    def forward(self, arcs, weight: np.ndarray) -> list[np.ndarray]:
        into: dict[int, list[tuple[int, int]]] = {}
        for a, (i, j) in enumerate(arcs):
            into.setdefault(j, []).append((a, i))
        alpha = [np.zeros(len(weight))]
        for j in range(1, max(into) + 1):
            alpha.append(_log_sum([alpha[i] + weight[:, a] for a, i in into[j]]))
        return alpha

    def log_likelihood(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for at, arcs, ids in self.lattices(words):
            out[at] = self.forward(arcs, self._weights(ids))[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur that often."""
        total = np.zeros(self.none + 1)
        for at, arcs, ids in self.lattices(words):
            weight = self._weights(ids)
            alpha = self.forward(arcs, weight)
            last = len(alpha) - 1
            turned = [(last - j, last - i) for i, j in arcs]
            beta = self.forward(turned, weight)
            begin, end = (np.array(x) for x in zip(*arcs))
            through = np.array(alpha)[begin] + np.array(beta)[last - end] - alpha[last]
            share = np.exp(np.minimum(through.T + weight, 0)) * counts[at][:, None]
            for k in range(ids.shape[2]):
                own = ids[:, :, k].ravel()
                total += np.bincount(own[own >= 0], share.ravel()[own >= 0], len(total))
        return total[:-1]


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stack = np.array(terms)
    top = stack.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stack - safe).sum(axis=0))


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of words put together: words of one length share their arithmetic."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= LATTICE_WORDS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def word_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """word and its count in training texts, for all words of all texts."""
    inner = docs.select(F.col(f"`{text_col}`").alias("text"), train.alias("train"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()), pa.array([*seen.values()], pa.int64())], names=["word", "c"])
            seen.clear()
            return made

        for batch in batches:
            for text, counts in zip(batch.column(0), batch.column(1).to_pylist()):
                words = utf8(text.as_py()).lower().split()
                if counts:
                    seen.update(words)
                else:
                    for w in words:
                        seen.setdefault(w, 0)
                if len(seen) > FLUSH_WORDS:
                    yield out()
        if seen:
            yield out()

    return map_arrow(inner, count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, path: str, n_texts: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces. Each round reads every training word; the
    driver gets a sum for each piece of the vocabulary."""
    log_p = Pieces(path).log_p[:-1]
    for _ in range(rounds):

        def expect(batches: Iterable[pa.RecordBatch], log_p=log_p) -> Iterable[pa.RecordBatch]:
            pieces, total = Pieces(path, log_p), None
            for batch in _gathered(batches):
                got = pieces.expected(batch.column(0).to_pylist(), np.array(batch.column(1), float))
                total = got if total is None else total + got
            if total is not None:
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "n"])

        sums = map_arrow(counts.filter("c > 0"), expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        weight = np.where(np.isfinite(log_p) & (log_p > -600), 0.05, 0.0)
        for r in sums.collect():
            weight[r["piece"]] += r["n"]
        log_p = np.log(np.maximum(weight / (weight.sum() + n_texts), 1e-300))
    return log_p


def least_count(words: DataFrame, most: int) -> int:
    """The least count, 2 at least, that no more than so many words have or pass.

    Counts fall into eighths of powers of two, so the histogram has a few hundred
    rows whatever the corpus is, and no words are sorted.
    """
    band = F.floor(8 * F.log2("c")).cast("int").alias("band")
    rows = words.filter("c > 1").groupBy(band).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    least, total = 2**62, 0
    for r in sorted(rows, key=lambda r: -r["band"]):
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    return least


def score(docs: DataFrame, train: Column, carry: list[str], text_col: str = "text", path: str | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """The carried columns in struct ``row``, and n_tokens, n_known, train_tokens, base_score
    and score of each row, and lattice_score, to which words as a whole add no arc. train:
    which rows to learn from."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    train = F.coalesce(train, F.lit(False))
    counts = stored(word_counts(docs, text_col, train), "words")
    texts = docs.filter(train).count()
    seen = counts.filter("c > 0").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")
    ).first()
    total, distinct = seen["n"] + texts, seen["v"] + bool(texts)
    discount = seen["once"] / (seen["once"] + 2 * seen["twice"]) if seen["once"] and seen["twice"] else 0.75
    spare = discount * distinct / total if total else 1.0
    log_p = fit(counts, path, texts)
    below = math.log10(total + 0.5 * (distinct + 1))
    end = (max(texts - discount, 0) / total if total else 0) + spare * (texts / total if total else 0.5)

    def both(c: np.ndarray, lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # in log space, as lattices of long words lie below the smallest double
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(c - discount, 0) / max(total, 1))
        return np.log10(c + 0.5) - below, np.logaddexp(whole, math.log(spare) + lattice) / math.log(10)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pieces = Pieces(path, log_p)
        for batch in _gathered(batches):
            lattice = pieces.log_likelihood(batch.column(0).to_pylist())
            base, own = both(np.array(batch.column(1), float), lattice)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base), pa.array(own), pa.array(lattice / math.log(10))], names=["word", "c", "base", "own", "cut"])

    words = stored(map_arrow(counts, weigh, "word binary, c long, base double, own double, cut double"), "weighed")
    head = words.filter(F.col("c") >= least_count(words, head_words)).collect()
    known = spark.sparkContext.broadcast({bytes(r["word"]): (r["base"], r["own"], r["cut"]) for r in head})
    end_base, end_own = math.log10(texts + 0.5) - below, math.log10(end)

    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    inner = docs.select(F.monotonically_increasing_id().alias("key"), row, F.col(f"`{text_col}`").alias("text"))
    sums = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("base", "own", "cut")]]
    rest = T.StructField("rest", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("times", T.LongType())])))
    schema = T.StructType([T.StructField("key", T.LongType()), inner.schema["row"], *sums, rest])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n_tokens, n_known, base, own, cut, starts, others, times = [], [], [], [], [], [0], [], []
                for text in part.column(2):
                    said = utf8(text.as_py()).lower().split()
                    k, b, o, s = int(texts > 0), end_base, end_own, end_own
                    for w, n in Counter(said).items():
                        found = get(w)
                        if found is None:
                            others.append(w)
                            times.append(n)
                        else:
                            k, b, o, s = k + n, b + n * found[0], o + n * found[1], s + n * found[2]
                    n_tokens.append(len(said) + 1)
                    n_known.append(k)
                    base.append(b)
                    own.append(o)
                    cut.append(s)
                    starts.append(len(others))
                listed = pa.ListArray.from_arrays(
                    pa.array(starts, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(others, pa.binary()), pa.array(times, pa.int64())], names=["word", "times"]),
                )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(own), pa.array(cut), listed], names=schema.names)

    texts_read = stored(map_arrow(inner, read, schema), "read")
    tail = texts_read.select("key", F.explode("rest").alias("r")).select("key", "r.word", "r.times")
    tail = tail.join(words, "word").groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.col("base")).alias("b"), F.sum(F.col("times") * F.col("own")).alias("o"), F.sum(F.col("times") * F.col("cut")).alias("s")
    )
    scored = texts_read.drop("rest").join(tail, "key", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.select("row", "n_tokens", add("n_known", "k").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), add("base", "b").alias("base_score"), add("own", "o").alias("score"), add("cut", "s").alias("lattice_score"))


def held_out(id_col: Column) -> Column:
    return F.coalesce(remainder(id_col, 5) == 1, F.lit(False))


def op6(docs: DataFrame) -> DataFrame:
    got = score(docs, ~held_out(F.col("doc_id")), ["doc_id"])
    return got.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
