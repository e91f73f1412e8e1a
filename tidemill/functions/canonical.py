"""Canonical text with a way back: what a rule finds in folded letters is shown in raw ones.

A character may vanish (apostrophes, the soft and hard signs) or become two in lower
case, so places in the canonical text are mapped to the raw text before anything is cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.terms import AROUND, ASKED, REACH, Rules
from tidemill.functions.text import FOLD_FROM, FOLD_TO, variants_of

# Signs that are dropped, letters of one alphabet read as another's, and
# how much is shown on both sides of a place.
APOSTROPHES = "'‘’ʻ`´"
NEAR_FROM, NEAR_TO = "ҳқўғҷө", "хкугжо"
SHOWN = 70

_NEAR = str.maketrans(NEAR_FROM, NEAR_TO)
_FOLD = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, FOLD_FROM[len(FOLD_TO) :] + APOSTROPHES)


class _Letters(dict):
    """What each character becomes, learnt as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = chr(code).lower().translate(_NEAR).translate(_FOLD)
        return self[code]


_LETTERS = _Letters()


def canonical(text: str) -> str:
    return text.translate(_LETTERS)


def raw_places(text: str) -> np.ndarray:
    """For each character of the canonical text, which one of the raw text it comes from."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    known, which = np.unique(codes, return_inverse=True)
    sizes = np.array([len(_LETTERS[int(c)]) for c in known], dtype=np.int64)
    return np.repeat(np.arange(len(codes)), sizes[which]) if len(codes) else np.arange(0)


@lru_cache(maxsize=4096)
def stem_spellings(stem: str) -> tuple[str, ...]:
    """A stem's canonical spellings in both alphabets, without those that came out shorter
    than the stem and under four letters, as they are in too many words."""
    least = min(4, len(canonical(stem)))
    found = dict.fromkeys(canonical(v) for v in variants_of(stem))
    return tuple(s for s in found if s and len(s) >= least)


def _spans(text: str, stem: str) -> list[tuple[int, int]]:
    """Where a stem stands in any spelling, overlapping places too, in order."""
    return sorted((m.start(), m.start() + len(s)) for s in stem_spellings(stem) for m in re.finditer(f"(?={re.escape(s)})", text))


def _near(spans: list[tuple[int, int]], at: int) -> tuple[int, int] | None:
    """The span that starts nearest to a place, within reach: of two the left one, of one start the shorter."""
    k = bisect_left(spans, (at,))
    left = spans[bisect_left(spans, (spans[k - 1][0],))] if k else None
    sides = [s for s in (left, spans[k] if k < len(spans) else None) if s and abs(s[0] - at) <= REACH]
    return min(sides, key=lambda s: abs(s[0] - at), default=None)


def place_of(text: str, stems: tuple[str, ...], void: tuple[str, ...]) -> tuple[int, int] | None:
    """The first place of the canonical text where all stems stand within reach of the
    first one and no void word stands around them."""
    spans = []
    for s in stems:
        spans.append(_spans(text, s))
        if not spans[-1]:
            return None
    for first in spans[0]:
        all_of = [first, *(_near(own, first[0]) for own in spans[1:])]
        if None in all_of:
            continue
        low, high = min(a for a, _ in all_of), max(b for _, b in all_of)
        around = text[max(0, low - AROUND) : high + AROUND]
        if not any(s in around for w in void for s in stem_spellings(w)):
            return low, high
    return None


def evidence_in(text: str | None, rules: Rules) -> list[dict]:
    """Each kind that a raw text asks for: where its first way that holds does so (start
    and end in the raw text), what stands there with 70 characters on both sides, white
    space squeezed and cut ends marked, and how sure that is (90 for several stems, else 70)."""
    if not text:
        return []
    folded, places, found = canonical(text), None, []
    for kind, (ways, void) in rules.items():
        for way in ways:
            if (place := place_of(folded, way, void)) is None:
                continue
            places = raw_places(text) if places is None else places
            low, high = place
            a, b = int(places[max(0, low - SHOWN)]), int(places[min(len(places) - 1, high + SHOWN)]) + 1
            shown = ("…" if a else "") + " ".join(text[a:b].split()) + ("…" if b < len(text) else "")
            found.append({"kind": kind, "start": int(places[low]), "end": int(places[high - 1]) + 1, "confidence": 90 if len(way) > 1 else 70, "evidence": shown})
            break
    return found


def evidence(c: Column, rules: Rules = ASKED) -> Column:
    """evidence_in of a raw text column, in Arrow batches. Null and empty texts ask for nothing."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,confidence:int,evidence:string>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: evidence_in(t, rules))

    return find(c)


def evidence_of(documents, key: str, text: str, source: str, rules: Rules = ASKED):
    """The first evidence of each kind over all texts of a key, in order of ``source``:
    a tender's note before its files. One row per key and kind that is asked for."""
    rows = documents.select(key, source, F.inline(evidence(F.col(text), rules)))
    first = F.min_by(F.struct(source, "start", "end", "confidence", "evidence"), F.struct(source, "start", "end", "evidence"))
    return rows.groupBy(key, "kind").agg(first.alias("_first")).select(key, "kind", "_first.*")
