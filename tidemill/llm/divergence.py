"""How the words of each source differ from those of its language and of other sources.

Two passes over whole texts. The first counts exactly in how many documents of
its language each term stands; those in enough documents are kept. The second
walks every text once through an Aho-Corasick automaton of the kept terms, each
padded with a delimiter on both sides, so that only whole terms match, and counts
their occurrences for each (language, source). Beyond ``BLOCK_TERMS`` kept terms
there is one automaton, and one walk, for each block of terms, so that a task's
memory is bounded. What is found are sparse postings; terms that neither of two
sources has enter a pair's value by their number alone.

Shares are integers: p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), for V
kept terms of the language and N their occurrences in the group.

Null texts, languages and sources count as ''. Repeated rows are documents of
their own. Every group of language and source that occurs is compared, with terms
or without; a language's only source has no pairs, one with V = 0 pairs of value 0.
Equal values are ranked by item, by UTF-8. No rows give no rows; further columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import map_arrow, shared_dir, stored
from tidemill.llm.wavelet import filesystem

MIN_DOCS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Kept terms of one automaton (about 0.5 KB each), and counts that a task holds before it gives them on.
BLOCK_TERMS, HELD = 200_000, 400_000
#: Parts into which a language's rows are dealt where they meet all its sources.
SALTS = 16
#: What is no part of a term becomes a space, A-Z their small letters; other bytes stay.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def _counted(df: DataFrame, keys: list[str], count) -> DataFrame:
    """Sums over all rows of what count() adds up in tasks: keys and n.

    count() gives a function from (batch, counters by group) to nothing; a group is a
    tuple of all keys but the last, a term as bytes. Counts are given on in parts.
    """
    names = [*keys, "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        add, term_of = count()
        held: dict[tuple, Counter] = defaultdict(Counter)

        def rows() -> Iterable[pa.RecordBatch]:
            for group, counter in held.items():
                terms = [term_of(t) for t in counter]
                columns = [pa.array([g] * len(terms), pa.string()) for g in group]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(terms, pa.string()), pa.array(list(counter.values()), pa.int64())], names=names)
            held.clear()

        for batch in batches:
            add(batch, held)
            if sum(map(len, held.values())) > HELD:
                yield from rows()
        yield from rows()

    parts = map_arrow(df, run, ", ".join(f"{k} string" for k in keys) + ", n long")
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term and n, its documents, of every term in at least min_docs documents of lang."""

    def count():
        def add(batch, held):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held[lang,].update(set(text.translate(_CLEAN).split()))

        return add, lambda t: t.decode("utf-8", "replace")

    return _counted(docs.select("lang", "text"), ["lang", "term"], count).filter(F.col("n") >= min_docs)


@lru_cache(maxsize=1)
def _automata(folder: str) -> tuple[dict, list[str]]:
    """Of the terms in a folder: an automaton for each language, and the terms by number."""
    import ahocorasick

    fs, place = filesystem(folder)
    found = pads.dataset(place, filesystem=fs, format="parquet").to_table(columns=["lang", "term"])
    automata: dict = {}
    terms = found.column("term").to_pylist()
    for n, (lang, term) in enumerate(zip(found.column("lang").to_pylist(), terms)):
        automata.setdefault(lang, ahocorasick.Automaton()).add_word(f" {term} ", n)
    for automaton in automata.values():
        automaton.make_automaton()
    return automata, terms


def postings(docs: DataFrame, kept: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Occurrences n of each kept term in each group: lang, source, term, n."""
    blocks = -(-kept.count() // block_terms)
    folder = f"{shared_dir(docs.sparkSession)}/terms-{uuid.uuid4().hex}"
    kept.select("lang", "term", F.pmod(F.xxhash64("lang", "term"), F.lit(max(1, blocks))).alias("block")).write.partitionBy("block").parquet(folder)
    own = docs.select("lang", "source", "text")
    out = docs.sparkSession.createDataFrame([], "lang string, source string, term string, n long")
    there = docs.sparkSession.read.parquet(folder).select("block").distinct().collect() if blocks else []
    for block in sorted(r["block"] for r in there):

        def count(place=f"{folder}/block={block}"):
            automata, terms = _automata(place)

            def add(batch, held):
                for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    if lang in automata:
                        padded = f" {text.translate(_CLEAN).decode('utf-8', 'replace')} "
                        held[lang, source].update(map(itemgetter(1), automata[lang].iter(padded)))

            return add, terms.__getitem__

        out = out.unionByName(_counted(own, ["lang", "source", "term"], count))
    return out


def _p(count: str, total: str, terms: str) -> Column:
    """The share as an integer; products beyond a long are made as decimals."""
    return F.expr(
        f"CASE WHEN {terms} = 0 THEN 0L WHEN {count} < 9000000000 THEN 1L + {SCALE}L * ({count} + {PRIOR}) div ({total} + {PRIOR} * {terms}) "
        f"ELSE 1L + (cast({SCALE} AS decimal(10,0)) * cast({count} + {PRIOR} AS decimal(28,0))) div cast({total} + {PRIOR} * {terms} AS decimal(28,0)) END"
    )


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank; see the module."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kept = stored(kept_terms(rows, min_docs), "kept")
    found = stored(postings(rows, kept, block_terms), "postings")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    per_source = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(per_source, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0)
    groups = stored(groups.withColumn("none", _p("0L", "total", "v")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.first("v").alias("v"))
    shares = found.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "none", _p("n", "total", "v").alias("p"))
    return _terms(shares, langs, top).unionByName(_pairs(shares, groups))


def _terms(shares: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    overall = shares.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(langs, "lang").select("lang", "term", _p("n", "all", "v").alias("q"))
    over = shares.join(overall, ["lang", "term"]).filter("p > q")
    return _ranked(over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).filter(F.col("rank") <= top)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums of |p - q| over all kept terms for two sources a < b.

    A term neither has adds |none_a - none_b|; that is taken for all V terms, then
    set right by what terms of one of them change, whatever the other has, and by
    what terms of both change again.
    """

    def side(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.select("lang", *more, *[F.col(c).alias(f"{c}_{name}") for c in ("source", "none", "p") if c in df.columns])

    one, other = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), F.abs(F.col("none_a") - F.col("none_b"))
    near = side(groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")), "a", "salt", "v")
    base = near.join(side(one, "b", "salt"), ["lang", "salt"]).filter("source_a < source_b").select("lang", "source_a", "source_b", (F.col("v") * other).alias("value"))
    # terms of one source by their share, against every other source
    levels = shares.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("times")).withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int"))
    single = side(levels, "a", "salt", "times").join(side(one, "b", "salt"), ["lang", "salt"]).filter("source_a <> source_b")
    single = single.select("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"), (F.col("times") * (F.abs(F.col("p_a") - F.col("none_b")) - other)).alias("value"))
    both = side(shares, "a", "term").join(side(shares, "b", "term"), ["lang", "term"]).filter("source_a < source_b")
    mended = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("none_b")) - F.abs(F.col("none_a") - F.col("p_b")) + other
    both = both.select("lang", "source_a", "source_b", mended.alias("value"))
    sums = base.unionByName(single).unionByName(both).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return _ranked(sums.select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value"))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def op12(docs: DataFrame) -> DataFrame:
    return audit(docs)
