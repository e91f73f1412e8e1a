"""Canonical text against a plain version, letter by letter, on mixed alphabets."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.functions import canonical as cn
from tidemill.functions.text import variants_of

RULES = {
    "certificate": ((("сертифик", "соответств"), ("sertifikat",)), ("не требуется",)),
    "guarantee": ((("bank", "kafolat"), ("гарант",)), ("товар",)),
    "account": ((("счет",),), ()),
}
WORDS = ["Сертификат", "СООТВЕТСТВИЯ", "sertifikat", "s'ertifikat", "bank", "банк", "kafolati", "кафолати", "гарантия", "гара́нт", "гаранть", "не требуется",
         "товаръ", "ҳўжжат", "İstanbul", "  \n", "o‘zbek", "решётка", "счёт", "schet", "x" * 45, "ь" * 9, "𝒳"]


def plain_letter(c):
    out = []
    for x in c.lower():
        x = dict(zip("ҳқўғҷө", "хкугжо")).get(x, x)
        x = {"э": "е", "ё": "е", "ы": "и", "й": "и", "щ": "ш", "ь": "", "ъ": ""}.get(x, x)
        out.append("" if x in "'‘’ʻ`´" else x)
    return "".join(out)


def plain(text, rules):
    pairs = [(x, i) for i, c in enumerate(text) for x in plain_letter(c)]
    folded = "".join(x for x, _ in pairs)
    spelled = lambda w: {s for s in map(cn.canonical, variants_of(w)) if s and not (len(s) < 4 and len(s) < len(cn.canonical(w)))}
    every = lambda w: sorted((i, i + len(s)) for s in spelled(w) for i in range(len(folded)) if folded.startswith(s, i))
    out = []
    for kind, (ways, void) in rules.items():
        hit = None
        for way in ways:
            spans = [every(w) for w in way]
            for a, b in spans[0]:
                near = [min((p for p in own if abs(p[0] - a) <= 80), key=lambda p: abs(p[0] - a), default=None) for own in spans[1:]]
                if None in near:
                    continue
                low, high = min([a, *(p[0] for p in near)]), max([b, *(p[1] for p in near)])
                if not any(s in folded[max(0, low - 40) : high + 40] for w in void for s in spelled(w)):
                    hit = low, high, 90 if len(way) > 1 else 70
                    break
            if hit:
                break
        if hit:
            low, high, sure = hit
            a, b = pairs[max(0, low - 70)][1], pairs[min(len(pairs) - 1, high + 70)][1] + 1
            shown = ("…" if a > 0 else "") + re.sub(r"\s+", " ", text[a:b]).strip() + ("…" if b < len(text) else "")
            out.append({"kind": kind, "start": pairs[low][1], "end": pairs[high - 1][1] + 1, "confidence": sure, "evidence": shown})
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=25).map(" ".join))
def test_evidence_as_letter_by_letter(text):
    assert cn.canonical(text) == "".join(map(plain_letter, text))
    assert cn.evidence_in(text, RULES) == plain(text, RULES)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_places_lead_back(text):
    places = cn.raw_places(text)
    assert len(places) == len(cn.canonical(text))
    assert all(cn.canonical(text)[k] in cn.canonical(text[p]) for k, p in enumerate(places))


def test_evidence_is_cut_from_the_raw_text():
    text = "Кераклиси: " + "ь" * 30 + " Сертификат соответствия лозим."
    (found,) = cn.evidence_in(text, RULES)
    assert text[found["start"] : found["end"]] == "Сертификат соответств" and found["confidence"] == 90
    assert cn.evidence_in(None, RULES) == cn.evidence_in("", RULES) == []


def test_first_source_wins(spark):
    rows = [(1, 2, "гарант bank kafolat"), (1, 1, "банк КАФОЛАТИ"), (1, 3, None), (2, 1, ""), (None, 1, "счёт"), (None, 1, "счёт")]
    df = spark.createDataFrame(rows, "tender int, source int, text string").withColumn("kind_", cn.F.lit(0))
    got = sorted((r.tender or 0, r.kind, r.source, r.evidence) for r in cn.evidence_of(df, "tender", "text", "source", RULES).collect())
    assert got == [(0, "account", 1, "счёт"), (1, "guarantee", 1, "банк КАФОЛАТИ")]
