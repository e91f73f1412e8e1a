"""Toxicity by weak supervision.

Lexicon and pattern voters say of a text whether their word, their word stem or
their pattern is in it. Stems and words beside the seed lexicon are mined from a
bounded sample of labelled rows. A generative label model, two classes of voters
fitted by expectation-maximisation over the votes of all documents, estimates in
each round how often each voter is right and how voters depend on one another;
dependent voters share their weight. What labelled rows say of a voter, mined or
seed, has a fixed part in its accuracy. The posterior labels train a linear
classifier over the votes, which gives the score.

The bounds on what is fitted are parameters: SAMPLE_ROWS labelled rows of each
class, of their terms the MINED_TERMS most frequent ones, MINED voters of those.
All that is counted or scored covers all documents.

Null and empty texts get no vote and the score that goes with none. Repeated
rows vote as often as they occur. Without labelled rows the seed lexicon votes
alone; labels that are null or whose document is missing are not used, and where
labels of one id disagree it counts as toxic. An empty table gives no rows; further
columns go along where they are carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import map_arrow, map_text, remainder, stored

#: Labelled rows of each class from which voters are mined, at most about.
SAMPLE_ROWS = 8_000
#: Terms of labelled toxic rows that are looked at, the most frequent ones.
MINED_TERMS = 100_000
#: Mined voters, at most; with the patterns they fit a 64-bit mask.
MINED = 44
#: A mined voter is right in at least this share of the labelled rows that it marks.
PRECISION = 0.9
#: The labels' part in a voter's accuracy; the rest is what the votes of all documents say.
LABELLED = 0.5
#: The share of toxic texts on which every voter abstains.
MISSED = 0.05
#: Distinct vote patterns that the driver fits by itself; sums over more are made by tasks.
FIT_PATTERNS = 20_000
THRESHOLD = 0.7

# The seed lexicon.
SEED = ("idiot", "loser", "moron", "pathetic", "scum", "stupid", "worthless")
_STEMS = (4, 5, 6, 7)
_TIMES = (1, 2, 3)
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = 2


def _terms(text: str | None) -> set[str]:
    """Words of a text; "stem*k" for starts that k longer words have."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in _STEMS:
        stems: Counter[str] = Counter()
        for w, k in words.items():
            if len(w) > n:
                stems[w[:n]] += k
        out.update(f"{s}*{k}" for k in _TIMES for s, c in stems.items() if c >= k)
    return out


def _voted(voters: list[str]):
    """A function from a text to the mask of its voters."""
    words = {v: 1 << j for j, v in enumerate(voters) if "*" not in v}
    stems: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for j, v in enumerate(voters):
        if "*" in v:
            stem, _, times = v.partition("*")
            stems.setdefault(len(stem), {}).setdefault(stem, []).append((int(times), 1 << j))
    shout, cry = 1 << len(voters), 1 << (len(voters) + 1)

    def vote(text: str | None) -> int:
        if not text:
            return 0
        said = _WORD.findall(text.lower())
        found = set(said)
        mask = sum(words[w] for w in found & words.keys())
        for n, own in stems.items():
            for s in {w[:n] for w in found} & own.keys():
                count = sum(len(w) > n and w.startswith(s) for w in said)
                for times, bit in own[s]:
                    if count >= times:
                        mask |= bit
        if text.isupper():
            mask |= shout
        if "!!!" in text:
            mask |= cry
        return mask

    return vote


@dataclass
class Model:
    voters: list[str]
    weights: list[float]
    bias: float

    def score(self, mask: int) -> float:
        z = self.bias + sum(w for j, w in enumerate(self.weights) if mask >> j & 1)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def mine(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[dict[str, float | None], float]:
    """Words and stems that mark labelled texts, frequent in toxic ones and rare in others,
    and the seed lexicon, each with the share of labelled rows in which it is right, if
    there are any; and the labelled share of toxic rows."""
    given = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    given = given.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    n = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return dict.fromkeys(SEED), 0.05
    share = {k: min(1.0, SAMPLE_ROWS / max(1, n.get(k, 0))) for k in (0, 1)}
    # at most about 2 * SAMPLE_ROWS ids are broadcast, however many rows there are
    bar = F.when(F.col("label") == 1, share[1]).otherwise(share[0]) * 1_000_000
    picked = F.broadcast(given.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < bar))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")

    def counted(candidates: set[str] | None, label: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            counts: Counter[str] = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    terms = _terms(text)
                    counts.update(terms if candidates is None else terms & candidates)
                    counts[""] += len(terms)
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([*counts]), pa.array([*counts.values()], pa.int64())], names=["term", "n"])

        part = rows.filter(F.col("label") == label).select("text")
        return map_arrow(part, run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    least = 5
    toxic = {r["term"]: r["n"] for r in counted(None, 1).filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(MINED_TERMS).collect()}
    all_toxic = toxic.pop("", 0)
    names = set(toxic)
    clean = {r["term"]: r["n"] for r in counted(names, 0).collect()} if n.get(0) else {}
    all_clean = clean.pop("", 0)
    base = all_toxic / max(1, all_toxic + all_clean)
    good, voters = [], []
    for term, k in toxic.items():
        c = clean.get(term, 0)
        p = k / (k + c)
        evidence = 2 * (k * math.log(p / base) + (c and c * math.log((1 - p) / (1 - base)))) if 0 < base < 1 else k * 8
        if k / share[1] >= PRECISION * (k / share[1] + c / share[0]) and p > base and evidence > 24:
            good.append((-evidence, "*" in term, -len(term), term, k))
    chosen: dict[str, int] = {}
    for *_, term, k in sorted(good):
        stem = term.partition("*")[0]
        same = (v.startswith(stem) and k <= 1.1 * n or stem.startswith(v) for v, n in chosen.items())
        if not any(same):
            chosen[stem] = k
            voters.append(term)
        if len(voters) == MINED:
            break
    voters += [w for w in SEED if w not in voters]
    weight = lambda v: (toxic.get(v, 0) / share[1], clean.get(v, 0) / share[0])
    right = {v: (k + 0.5) / (k + c + 1) if k + c else None for v in voters for k, c in [weight(v)]}
    return right, min(0.9, n[1] / sum(n.values()))


def _log_odds(bits: np.ndarray, gain: np.ndarray, prior: float) -> np.ndarray:
    """Voters abstain or vote toxic; where all abstain, the miss rate speaks."""
    z = bits @ gain + prior
    return np.clip(np.where(bits.any(axis=1), z, prior + math.log(MISSED)), -40, 40)


def _target(bits: np.ndarray, gain: np.ndarray, share: np.ndarray, prior: float) -> np.ndarray:
    """Posterior labels: the strongest vote counts in full, those that depend on others by their share."""
    strongest = np.where(bits > 0, gain, 0).argmax(axis=1)
    full = (gain - gain * share)[strongest] * bits[np.arange(len(bits)), strongest]
    return 1 / (1 + np.exp(-np.clip(_log_odds(bits, gain * share, prior) + full, -40, 40)))


def _summed(patterns: DataFrame, gain: np.ndarray, share: np.ndarray, prior: float) -> np.ndarray:
    """Expected counts under the posterior: for each class, of rows, votes and pairs of votes.

    Every task sums what it has; the driver adds up vectors of fixed length.
    """
    m = len(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros((2, 1 + m + m * m))
        for batch in batches:
            mask, n = (np.array(c) for c in (batch.column(0), batch.column(1)))
            bits = (mask[:, None] >> np.arange(m)) & 1
            toxic = _target(bits, gain, share, prior)
            for k, part in enumerate((n * (1 - toxic), n * toxic)):
                total[k, 0] += part.sum()
                total[k, 1 : 1 + m] += part @ bits
                total[k, 1 + m :] += ((bits * part[:, None]).T @ bits).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    got = map_arrow(patterns, run, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]).reshape(2, -1) for r in got), np.zeros((2, 1 + m + m * m)))


def _gain(sums: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """Log odds that each vote adds. labelled: how often labels say it is right, or nan."""
    m = len(labelled)
    rows, votes = sums[:, 0] + 1, sums[:, 1 : 1 + m]
    every = votes.sum(axis=0)
    right = np.where(np.isnan(labelled), votes[1], LABELLED * np.nan_to_num(labelled) * every + (1 - LABELLED) * votes[1])
    return np.clip(np.log((right + 0.1) / rows[1]) - np.log((every - right + 0.1) / rows[0]), -2, 12)


def _slope(bits: np.ndarray, n: np.ndarray, target: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Of patterns weighted by the root of their number: weight, weighted gradient and Hessian, the
    floor of the Hessian apart as it isn't weighted."""
    x, weight = np.hstack([bits, np.ones((len(bits), 1))]), np.sqrt(n)
    p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
    hessian = (x * (weight * p * (1 - p))[:, None]).T @ x
    return np.concatenate([[weight.sum()], x.T @ (weight * (p - target)), hessian.ravel(), (x.T @ x).ravel()])


def _fit_linear(slope: Callable[[np.ndarray], np.ndarray], m: int) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps with a small ridge; slope sums over all patterns."""
    theta, k = np.zeros(m + 1), m + 1
    ridge = np.full(k, 0.05)
    ridge[-1] = 1e-6
    for _ in range(40):
        total, gradient, hessian, floor = np.split(slope(theta), [1, 1 + k, 1 + k + k * k])
        scale = 20_000 / max(1.0, total[0])
        hessian = scale * hessian.reshape(k, k) + 1e-9 * floor.reshape(k, k) + np.diag(ridge)
        step = np.linalg.solve(hessian, scale * gradient + ridge * theta)
        theta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return theta[:-1], float(theta[-1])


def _slopes(patterns: DataFrame, gain: np.ndarray, share: np.ndarray, prior: float, theta: np.ndarray) -> np.ndarray:
    """_slope of all patterns: every task sums what it has, the driver adds up vectors of fixed length."""
    m = len(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(1 + (m + 1) + 2 * (m + 1) ** 2)
        for batch in batches:
            mask, n = (np.array(c) for c in (batch.column(0), batch.column(1)))
            bits = ((mask[:, None] >> np.arange(m)) & 1).astype(float)
            total += _slope(bits, n, _target(bits, gain, share, prior), theta)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    got = map_arrow(patterns, run, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]) for r in got), np.zeros(1 + (m + 1) + 2 * (m + 1) ** 2))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rounds: int = 6,
) -> Model:
    """Voters from the labelled rows, their weights from the votes of all documents."""
    mined, toxic_share = mine(docs, labels, id_col, text_col, label_col)
    voters, m = [*mined], len(mined) + _PATTERNS
    labelled = np.array([np.nan if x is None else x for x in mined.values()] + [np.nan] * _PATTERNS)
    votes = map_text(
        docs, lambda: (lambda texts, vote=_voted(voters): [[vote(t) for t in texts]]),
        T.StructType([T.StructField("mask", T.LongType())]), [], text_col,
    )
    patterns = stored(votes.groupBy(F.col("out.mask").alias("mask")).agg(F.count("*").alias("n")), "votes")
    # start: voters are as right as the labels say, or as mined ones have to be; the patterns say nothing
    prior = math.log(toxic_share / (1 - toxic_share))
    start = np.clip(np.nan_to_num(labelled[: len(voters)], nan=PRECISION), 0.01, PRECISION)
    gain, share = np.append(np.log(start / (1 - start)) - prior, [0.0] * _PATTERNS), np.ones(m)
    for _ in range(rounds):
        sums = _summed(patterns, gain, share, prior)
        gain, share = _gain(sums, labelled), 1 / (1 + _dependence(sums, m))
    some = patterns.limit(FIT_PATTERNS + 1).collect()
    if not some:
        return Model(voters, [0.0] * m, -10.0)
    if len(some) <= FIT_PATTERNS:
        some.sort(key=lambda r: (-r["n"], r["mask"]))
        bits = np.array([[r["mask"] >> j & 1 for j in range(m)] for r in some], dtype=float)
        n, target = np.array([r["n"] for r in some], dtype=float), _target(bits, gain, share, prior)
        weights, bias = _fit_linear(lambda theta: _slope(bits, n, target, theta), m)
    else:
        weights, bias = _fit_linear(lambda theta: _slopes(patterns, gain, share, prior, theta), m)
    return Model(voters, weights.tolist(), bias)


def _dependence(sums: np.ndarray, m: int) -> np.ndarray:
    """For each voter, its positive correlations with others among toxic documents, summed."""
    n = max(sums[1, 0], 1.0)
    mean = sums[1, 1 : 1 + m] / n
    cov = sums[1, 1 + m :].reshape(m, m) / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    return np.where(corr > 0.2, corr, 0).sum(axis=1)


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """Struct ``row`` with the carried columns, and the score of each text, 0 to 1."""

    def make():
        vote, known = _voted(model.voters), {}

        def step(texts):
            masks = [vote(t) for t in texts]
            known.update((m, model.score(m)) for m in set(masks) - known.keys())
            return [[known[m] for m in masks]]

        return step

    out = T.StructType([T.StructField("score", T.DoubleType())])
    return map_text(docs, make, out, carry, text_col).select("row", "out.score")


def held_out(id_col: Column) -> Column:
    return F.coalesce(remainder(id_col, 3) == 1, F.lit(False))


def training(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out(F.col("doc_id")))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, training(labels))
    return score(docs, model, ["doc_id"]).select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns kept."""
    model = fit(docs, training(labels))
    return score(docs, model, docs.columns).filter(F.col("score") < THRESHOLD).select("row.*")
