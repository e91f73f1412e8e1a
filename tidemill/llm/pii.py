"""Personal data by weak supervision over candidate spans.

Regexes propose spans. Labelers vote on each, yes, no or not at all: its form,
its check digits, a gazetteer, and the words around it. Votes of the whole
corpus are counted by kind and pattern; expectation-maximisation over these
counts estimates how reliable each labeler is, and the posterior labels train a
linear classifier that decides on a span. Spans of the base kinds stay as they
are; those of further kinds are added where the classifier says so and neither a
base span nor a likelier added one is touched.

Texts are read once: candidates and votes are stored, counted and decided on from
there. Null and empty texts have no spans; repeated rows are rows of their own; of
added spans that are equally likely the first stays. An empty table gives no rows;
further columns go along where they are carried.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemill.llm.common import map_arrow, map_text, stored

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_at", "ssn", "iban", "phone_local", "ipv6", "name")
KINDS = BASE + ADDED
#: Code points before and after a span that context labelers read.
BEFORE, AFTER = 40, 12
THRESHOLD = 0.5

# Patterns, gazetteers and context words.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{2,63}){1,4}", re.I)
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+(.-])(?:\(0[0-9]{1,4}\)\x20?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[-.\x20][0-9]{3}[-.\x20](?=[0-9]{4}(?![0-9])))[0-9][0-9\x20-]{2,10}[0-9](?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-zà-ÿ]{1,20}(?:\x20[A-Z][a-zà-ÿ]{1,20})?")
_CONTEXT = {
    "email": "mail contact write reach", "email_at": "mail contact write reach", "ip": "ip address host server login from",
    "ipv6": "ip address host server login from", "card": "card visa credit mastercard payment pay", "ssn": "ssn social security",
    "phone": "phone tel call mobile fax whatsapp reach", "phone_local": "phone tel call mobile fax reach",
    "iban": "iban account bank transfer konto", "name": "name dear contact by from signed",
}
_CONTEXT = {k: re.compile("|".join(v.split()), re.I) for k, v in _CONTEXT.items()}
_AGAINST = re.compile(r"version|isbn|order no|invoice|serial|release|build|ref|\bv$", re.I)
_TLDS = frozenset("com org net edu gov io de fr es uk eu info biz example test int mil ch at it nl".split())
_NAMES = frozenset("anna ben carlos david elena emma hans james jean john juan karl laura maria marie mary michael paul peter pierre robert sarah sofia thomas".split())
_IBAN_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
_CALLING = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a dotted domain, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def added_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern in (("email_at", _EMAIL_AT), ("ssn", _SSN), ("iban", _IBAN), ("phone_local", _PHONE_LOCAL), ("ipv6", _IPV6), ("name", _NAME)):
        if kind == "email_at" and not re.search(r"[\[(]at[\])]", text, re.I):
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    taken = Disjoint((a, b) for _, a, b in base)
    return [x for x in found if taken.free(*x[1:])]


class Disjoint:
    """Spans of a text, those that meet joined."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.begins.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.begins, b)  # the last span that begins before b
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.begins, a)
        self.begins.insert(k, a)
        self.ends.insert(k, b)


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """1, -1 or 0 of each labeler: form, check digits, gazetteer, context, counter-context, shape."""
    span, before, after = text[a:b], text[max(0, a - BEFORE) : a], text[b : b + AFTER]
    digits = _digits(span)
    form = check = known = 0
    if kind in ("email", "email_at"):
        domain = re.split(r"@|[\[(]at[\])]", span, flags=re.I)[-1]
        last = re.split(r"\.|[\[(]dot[\])]", domain, flags=re.I)[-1].strip()
        form = 1 if last.isalpha() and 2 <= len(last) <= 10 else -1
        known = 1 if last.lower() in _TLDS else 0
    elif kind == "ip":
        form = -1 if any(len(x) > 1 and x[0] == "0" for x in span.split(".")) else 1
        check = -1 if span.startswith(("0.", "255.")) or after[:1] == "." and after[1:2].isdigit() else 1
    elif kind == "card":
        form = 1 if len(digits) in (15, 16) else 0
        check = 1 if luhn(digits) else -1
        known = 1 if digits[0] in "3456" else -1
    elif kind in ("phone", "phone_local"):
        form = 1 if 9 <= len(digits) <= 13 else -1
        known = (1 if _CALLING.match(span) else -1) if kind == "phone" else 0
    elif kind == "ssn":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
        form = 1
    elif kind == "iban":
        packed = span.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1 else -1
        known = 1 if packed[:2] in _IBAN_COUNTRIES else 0
    elif kind == "ipv6":
        form = 1
    elif kind == "name":
        known = 1 if any(w.lower() in _NAMES for w in span.split()[1:]) else 0
        form = 1 if len(span.split()) == 3 else 0
    context = 1 if _CONTEXT[kind].search(before) else 0
    against = -1 if _AGAINST.search(before[-16:]) else 0
    shape = -1 if digits and len(digits) > 5 and len(set(digits)) <= 2 or before[-1:].isalnum() or after[:1].isalnum() else 0
    return form, check, known, context, against, shape


LABELERS = 6


def _code(vote: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(vote))


def _decode(code: int) -> list[int]:
    return [code // 3**k % 3 - 1 for k in range(LABELERS)]


class Model:
    """Weights of a yes and of a no of each labeler, and a bias for each kind."""

    def __init__(self, counts: dict[tuple[str, int], int], rounds: int = 50):
        keys = sorted(counts)
        n = np.array([counts[k] for k in keys], float)
        v = np.array([_decode(c) for _, c in keys]).reshape(len(keys), LABELERS)
        of = np.array([KINDS.index(k) for k, _ in keys], int)
        # start: the majority of votes
        p = 1 / (1 + np.exp(-1.5 * v.sum(axis=1) - 0.5))
        kinds = np.eye(len(KINDS))[of]
        for _ in range(rounds):
            right = kinds.T @ (((v == 1) * p[:, None] + (v == -1) * (1 - p[:, None])) * n[:, None])
            cast = kinds.T @ (np.abs(v) * n[:, None])
            # a labeler's reliability over all kinds, and that on each kind drawn to it;
            # labelers are taken to be right more often than not
            self.reliability = np.clip((right.sum(axis=0) + 8) / (cast.sum(axis=0) + 10), 0.55, 0.99)
            self.by_kind = np.clip((right + 20 * self.reliability) / (cast + 20), 0.55, 0.99)
            share = (kinds.T @ (p * n) + 1) / (kinds.T @ n + 2)
            by_kind = np.log(self.by_kind / (1 - self.by_kind))
            prior = np.log(np.clip(share, 0.05, 0.95) / (1 - np.clip(share, 0.05, 0.95)))
            p = 1 / (1 + np.exp(-np.clip((v * by_kind[of]).sum(axis=1) + prior[of], -30, 30)))
        gain = np.log(self.reliability / (1 - self.reliability))
        # the span classifier: logistic regression on the posterior labels
        x = np.hstack([v == 1, v == -1, np.eye(len(KINDS))[of]]).astype(float)
        self.theta = np.concatenate([gain, -gain, prior])
        weight = np.sqrt(n)
        for _ in range(30 if len(keys) else 0):
            q = 1 / (1 + np.exp(-np.clip(x @ self.theta, -30, 30)))
            start = np.concatenate([gain, -gain, prior])
            step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(x.shape[1]), x.T @ (weight * (q - p)) + 0.5 * (self.theta - start))
            self.theta = self.theta - np.clip(step, -3, 3)
        self.theta = self.theta.tolist()

    def probability(self, kind: str, vote: tuple[int, ...]) -> float:
        z = self.theta[2 * LABELERS + KINDS.index(kind)]
        for k, v in enumerate(vote):
            z += self.theta[k] * (v == 1) + self.theta[LABELERS + k] * (v == -1)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def candidates(text: str | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    base = base_spans(text)
    return base + added_candidates(text, base)


_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("votes", T.IntegerType()),
        ]
    )
)
_SPANS = T.ArrayType(T.StructType([*_FOUND.elementType.fields[:3], T.StructField("p", T.DoubleType())]))


def candidate_spans(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """Struct ``row`` with the carried columns, and ``found``: the candidates of each text and the votes on them."""

    def make():
        def step(texts):
            return [[[{"kind": k, "start": a, "end": b, "votes": _code(votes(t, k, a, b))} for k, a, b in candidates(t)] for t in texts]]

        return step

    out = map_text(docs, make, T.StructType([T.StructField("found", _FOUND)]), carry, text_col)
    return out.select("row", "out.found")


def fit(found: DataFrame) -> Model:
    """Reliabilities and classifier from the votes on all candidates."""
    counted = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").agg(F.count("*").alias("n"))
    # at most ten kinds times 3^6 patterns, whatever the corpus
    return Model({(r["kind"], r["votes"]): r["n"] for r in counted.collect()})


def decided(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The spans that stay of (kind, start, end, probability), by kind and start."""
    kept = [x for x in found if x[0] in BASE]
    taken = Disjoint()
    for x in sorted((x for x in found if x[0] not in BASE and x[3] >= THRESHOLD), key=lambda x: (-x[3], x[1], x[2], KINDS.index(x[0]))):
        if taken.free(x[1], x[2]):
            taken.add(x[1], x[2])
            kept.append(x)
    return sorted(kept, key=lambda x: (KINDS.index(x[0]), x[1]))


def spans(docs: DataFrame, carry: list[str], text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Struct ``row`` with the carried columns, and the ``spans`` of each text by kind and start."""
    found = stored(candidate_spans(docs, carry, text_col), "candidates")
    model = model or fit(found)

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known: dict[tuple[str, int], float] = {}

        def probability(kind: str, code: int) -> float:
            if (kind, code) not in known:
                known[kind, code] = model.probability(kind, _decode(code))
            return known[kind, code]

        for batch in batches:
            rows = [
                [dict(zip(("kind", "start", "end", "p"), x)) for x in decided([(x["kind"], x["start"], x["end"], probability(x["kind"], x["votes"])) for x in own])]
                for own in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, to_arrow_type(_SPANS))], names=["row", "spans"])

    return map_arrow(found, decide, T.StructType([found.schema["row"], T.StructField("spans", _SPANS)]))


def op9(docs: DataFrame) -> DataFrame:
    found = spans(docs, ["doc_id"])
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "row.doc_id",
        *[count(k) for k in BASE],
        F.sha2(listed(F.filter("spans", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
