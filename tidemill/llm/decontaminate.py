"""Benchmark decontamination with one Aho-Corasick automaton.

The benchmark's windows of words form one automaton over word numbers; each
text is normalised to a string of such numbers and scanned once. A match ends
at a word, and words keep their place in the original text, so hits map back to
code points of what was read.

Nulls and empty texts have no words and no hits; repeated rows are scanned as
rows of their own; an empty benchmark hits nothing; a null item text has no
window; a null item id counts as the text "null". An empty table gives no rows;
further columns, whatever their names, go along where they are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import map_text, stored, utf8

WINDOW = 10
#: Benchmark text that one automaton may hold; a larger benchmark is scanned in blocks
#: of this size, each in a stage of its own whose result is stored, so a task holds one
#: automaton at a time.
BLOCK_BYTES = 8 << 20
#: Words that a block may hold: an automaton over so many takes about 200 MB.
BLOCK_WORDS = 100_000
#: A word is coded as two characters, so that no node of the automaton has too many
#: branches to be searched; the two have alphabets of their own, so only whole words match.
_BRANCHES, _SECOND = 512, 0x800
_UNKNOWN = "\0\0"

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: UTF-8 bytes to the bytes of words: A-Z lowered, what parts words made blank.
_FOLD = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)
_SPAN = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_spans", _SPAN),
        T.StructField("spans", _SPAN),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_FOLD).split()


def _parts(words: list[bytes], window: int, most: int) -> Iterator[list[bytes]]:
    """Stretches of an item's words that together have just its windows."""
    at = 0
    while True:
        yield words[at : at + most + window - 1]
        at += most
        if at + window > len(words):
            return


def blocks_of(
    benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's (item id, words) in blocks of bounded size, read row by row; a long
    item is parted, its parts sharing words so that no window is lost."""
    block, size, n = [], 0, 0
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")), F.col(f"`{text_col}`"))
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        for part in _parts(words, window, max(1, min(block_words, 400_000) // 4)) if words else ():
            block.append((item, part))
            size, n = size + sum(map(len, part)), n + len(part)
            if size >= block_bytes or n >= min(block_words, 400_000):
                yield block
                block, size, n = [], 0, 0
    if block:
        yield block


def _coded(n: int) -> str:
    second = _SECOND + n // _BRANCHES
    # surrogates are no characters of their own, so codes leave them out
    return chr(1 + n % _BRANCHES) + chr(second if second < 0xD800 else second + 0x800)


def _scanner(items: list[tuple[str, list[bytes]]], window: int):
    """A function from a text's words to (start, end, items of the window) for each hit."""
    import ahocorasick

    code: dict[bytes, str] = {}
    windows: dict[str, tuple[int, set[str]]] = {}
    for item, words in items:
        coded = "".join(code.setdefault(w, _coded(len(code))) for w in words)
        for at in range(max(1, len(words) - window + 1)):
            part = coded[2 * at : 2 * (at + window)]
            windows.setdefault(part, (len(part) // 2, set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for part, value in windows.items():
        automaton.add_word(part, value)
    automaton.make_automaton()
    shortest = 2 * min(n for n, _ in windows.values())

    def scan(words: list[bytes]):
        at, found = 0, []
        # a window has words of the benchmark only: other words part the text, and what is too short has none
        for run in "".join(map(code.get, words, repeat(_UNKNOWN))).split(_UNKNOWN):
            if len(run) >= shortest:
                found += [((at + end + 1) // 2 - n, (at + end + 1) // 2, of) for end, (n, of) in automaton.iter(run)]
            at += len(run) + 2
        return found

    return scan


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _structs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"a": a, "b": b} for a, b in spans]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Struct ``row`` with the carried columns, and struct ``out`` of what was hit:

    n_words; word_spans: first word and end of each stretch of hit words;
    spans: the same in code points of the original text; item_ids: sorted.
    """
    sc = docs.sparkSession.sparkContext
    blocks = blocks_of(benchmark, item_col, item_text_col, block_bytes, window, block_words)
    block, after = next(blocks, []), next(blocks, None)
    if after is None:
        return map_text(docs, _maker(sc.broadcast(block), window), _OUT, carry, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("outs", F.array().cast(T.ArrayType(_OUT)))
    while block:
        sent = sc.broadcast(block)
        rows = map_text(rows, _maker(sent, window), _OUT, ["row", "text", "outs"]).select(
            "row.row", "row.text", F.concat("row.outs", F.array("out")).alias("outs")
        )
        rows = stored(rows, "scanned")
        sent.unpersist()
        block, after = after, next(blocks, None)
    return rows.select(
        "row",
        F.struct(
            F.col("outs")[0]["n_words"].alias("n_words"),
            _union("word_spans").alias("word_spans"),
            _union("spans").alias("spans"),
            F.array_sort(F.array_distinct(F.flatten("outs.item_ids"))).alias("item_ids"),
        ).alias("out"),
    )


def _union(field: str):
    """The union of several blocks' stretches."""

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        meets = (F.size(done) > 0) & (x["a"] <= F.get(done, F.size(done) - 1)["b"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.aggregate(F.array_sort(F.flatten(f"outs.{field}")), F.array().cast(_SPAN), add)


def _maker(items, window: int):
    def make():
        find = _scanner(items.value, window) if items.value else lambda words: []

        def step(texts):
            n_words, word_spans, spans, ids = [], [], [], []
            for text in texts:
                words = words_of(text)
                hits = find(words) if words else []
                merged = _merged([(a, b) for a, b, _ in hits])
                n_words.append(len(words))
                word_spans.append(_structs(merged))
                ids.append(sorted(set().union(*(x for _, _, x in hits))))
                if merged:
                    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
                    merged = [(at[a][0], at[b - 1][1]) for a, b in merged]
                spans.append(_structs(merged))
            return [n_words, word_spans, spans, ids]

        return step

    return make


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of a scan, a row for each document."""
    hit = F.aggregate("out.word_spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return scan(docs, benchmark, ["doc_id"]).select(
        "row.doc_id",
        "out.n_words",
        hit.alias("n_hit"),
        F.size("out.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("out.item_ids", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, all columns kept."""
    hits = scan(docs, benchmark, docs.columns)
    return hits.filter(F.size("out.word_spans") == 0).select("row.*")
