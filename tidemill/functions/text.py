"""Text functions: alphabet folding, cleaning, classification, term keys."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import chain, islice, product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold together, and the readings of letters across alphabets.
FOLD_FROM, FOLD_TO = "эёыйщьъ", "ееииш"
READINGS = {
    "sch": ["ш"], "sh": ["ш"], "ch": ["ч"], "zh": ["ж"], "kh": ["х"], "ya": ["я"], "yu": ["ю"], "yo": ["е"], "ts": ["ц", "тс"],
    "o'": ["у"], "g'": ["г"], "o‘": ["у"], "g‘": ["г"], "oʻ": ["у"], "gʻ": ["г"],
    "a": ["а"], "b": ["б"], "v": ["в"], "g": ["г"], "d": ["д"], "e": ["е"], "j": ["ж"], "z": ["з"], "i": ["и"], "y": ["и"],
    "k": ["к"], "l": ["л"], "m": ["м"], "n": ["н"], "o": ["о"], "p": ["п"], "r": ["р"], "s": ["с"], "t": ["т"], "u": ["у"],
    "f": ["ф"], "x": ["х"], "h": ["х"], "q": ["к"], "w": ["в"], "c": ["ц", "к"],
}
LATIN = {
    "щ": "sh", "ш": "sh", "ч": "ch", "ж": "j", "ц": "ts", "я": "ya", "ю": "yu", "ё": "yo", "ў": "o", "ғ": "g",
    "қ": "q", "ҳ": "h", "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "э": "e", "з": "z", "и": "i",
    "й": "y", "ы": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "x", "ь": "", "ъ": "",
}
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x"}
MAX_VARIANTS, MAX_READINGS = 6, 16

_TOKENS = re.compile("|".join(sorted(map(re.escape, READINGS), key=len, reverse=True)) + "|.", re.S)
_FOLDED = {ord(a): (FOLD_TO[i] if i < len(FOLD_TO) else None) for i, a in enumerate(FOLD_FROM)}


def fold(c: Column) -> Column:
    """Lower case with near letters made one; the soft and hard signs go."""
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def _readings(word: str) -> list[str]:
    """The Cyrillic readings of a Latin word: the first ways through the lattice of its letters."""
    lattice = (READINGS.get(t, [t]) for t in _TOKENS.findall(word))
    return ["".join(way).translate(_FOLDED) for way in islice(product(*lattice), MAX_READINGS)]


#: What spells a word with such letters otherwise, the likeliest first.
_SPELLERS = [
    (re.compile("[Ѐ-ӿ]"), lambda w: [w.translate(_LATIN)]),
    (re.compile("[Ѐ-ӿ]"), lambda w: _readings(w.translate(_LATIN))),
    (re.compile("[Ѐ-ӿ]"), lambda w: [w.translate(_LOOKALIKES)]),
    (re.compile("[a-z'‘ʻ]"), _readings),
    (re.compile("[a-z'‘ʻ]"), lambda w: [w]),
]
_LATIN, _LOOKALIKES = str.maketrans(LATIN), str.maketrans(LOOKALIKES)


def variants_of(term: str | None) -> list[str]:
    """Folded spellings of a search term in both alphabets, likeliest first, six at
    most; the term itself, and others of two letters at least."""
    term = (term or "").strip().lower()
    own = [term.translate(_FOLDED)]
    others = chain.from_iterable(spell(term) for letters, spell in _SPELLERS if letters.search(term))
    return list(islice(dict.fromkeys(filter(None, chain(own, (x for x in others if len(x) > 1)))), MAX_VARIANTS))


def variants(c: Column) -> Column:
    """variants_of for a column, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def spell(terms: pd.Series) -> pd.Series:
        return terms.map(variants_of)

    return spell(c)


def contains_any(c: Column, term: str) -> Column:
    """Whether the folded text has any spelling of the term."""
    found = F.lit(False)
    for v in variants_of(term):
        found = found | F.contains(fold(c), F.lit(v))
    return found


def starts_word(c: Column, term: str) -> Column:
    """Whether a word of the folded text starts with any spelling of the term."""
    spelled = "|".join(re.escape(v) for v in variants_of(term))
    return fold(c).rlike(rf"(?U)\b(?:{spelled})") if spelled else F.lit(False)


def clean(c: Column) -> Column:
    """Control characters to blanks, one newline style, blanks collapsed, lines
    trimmed, two newlines in a row at most."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f]", " ")
    c = F.regexp_replace(c, r"[ \t ]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def quality(c: Column, min_chars: int = 20, min_letters: int = 40) -> Column:
    """ok, or why a text can't be used."""
    return F.when(c.isNull() | (F.length(c) < min_chars), "empty").when(letters(c) < min_letters, "unreadable").otherwise("ok")


def guess_language(c: Column, least: int = 20) -> Column:
    """ru or uz if one alphabet outweighs the other two to one, else null."""
    cyr = F.length(F.regexp_replace(c, r"[^Ѐ-ӿ]", ""))
    lat = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    return F.when(cyr + lat < least, None).when(cyr >= 2 * lat, "ru").when(lat >= 2 * cyr, "uz")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text padded as one string: two blanks before, one after."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    united = F.size(F.array_union(a, b))
    return F.when(united > 0, F.size(F.array_intersect(a, b)) / united).otherwise(F.lit(0.0))


def keywords(c: Column, most: int = 30) -> Column:
    """Distinct non-blank parts between ; | , and newlines, thirty at most."""
    parts = F.transform(F.split(c, r"[;|\n,]+"), lambda x: F.trim(x, F.lit(" .\t\r")))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, most)


#: Where a text may be cut, the strongest first: paragraphs, sentences, clauses, lines, words.
BOUNDARIES = [re.compile(b) for b in (r"\n\s*\n", r"[.!?…]\s", r"[;:]\s", r"\n", r"\s")]


def _cutter(text: str):
    """A function from a stretch of the text to the last of its strongest boundaries, or its end."""
    found = [([m.end() for m in b.finditer(text)], [m.start() for m in b.finditer(text)]) for b in BOUNDARIES]

    def cut(low: int, high: int) -> int:
        last = ((ends, starts, bisect_right(ends, high) - 1) for ends, starts in found)
        return next((ends[k] for ends, starts, k in last if k >= 0 and starts[k] >= low), high)

    return cut


def chunks(text: str | None, size: int = 1000, overlap: int = 150, least: int = 80, back: int = 250) -> list[tuple[int, int]]:
    """Spans of a text for retrieval, cut at the strongest boundary near the size; each
    begins ``overlap`` before the last one's end, and short or blank ones are left out."""
    n = len(text or "")
    if n <= size:
        return [(0, n)] if text and not text.isspace() else []
    cut, ends, begins = _cutter(text), [], [0]
    while not ends or ends[-1] < n:
        high = begins[-1] + size
        ends.append(n if high >= n else cut(max(begins[-1] + least, high - back), high))
        begins.append(ends[-1] - overlap if ends[-1] - overlap > begins[-1] else ends[-1])
    spans = [(a, b) for a, b in zip(begins, ends) if not text[a:b].isspace()]
    return [x for k, x in enumerate(spans) if k == 0 or x[1] - x[0] >= least]


def chunked(c: Column) -> Column:
    """Spans of a text column as an array of structs, in Arrow batches."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in chunks(t)])

    return cut(c)
