"""Quality rules with risk-controlled thresholds, in DataFrame operations.

Each rule rejects texts whose measure passes a cutoff. Cutoffs are chosen for
each stratum (language) and rule on labelled documents: an exact binomial bound
on good documents rejected must lie under ``alpha``, at a confidence shared out
over all strata, rules and cutoffs tested (Bonferroni), so all bounds hold
together. Of the admissible cutoffs the one that parts good from bad best is
taken, of equal ones the lowest. A stratum with too few labels has no admissible
cutoff and rejects nothing beyond the fixed rules. Every stratum that has labels
is tested, however many there are; counts, bounds and choice stay in Spark.

The bound takes trials to be independent, so a text counts once in its stratum
however many labelled documents have it; where labels of one document or one
text disagree, the bad one holds.

Null and empty texts have no words and fail the fixed rule on length. Null
strata form a stratum of their own; repeated rows are rows of their own. An
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import stored

ALPHA = 0.05
DELTA = 0.05
WINDOW = 8
#: Strata whose cutoffs (about 100 bytes each) are broadcast; more are joined by stratum.
BROADCAST_STRATA = 100_000

#: A rule's measure and its cutoffs; a text beyond the cutoff is rejected.
RULES = {
    "symbol_share": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2),
    "upper_share": (0.2, 0.3, 0.4, 0.5, 0.7),
    "same_word_share": (0.2, 0.3, 0.4, 0.5, 0.6, 0.7),
    "dup_line_share": (0.2, 0.3, 0.4, 0.5, 0.6),
    "exclaimed_share": (0.02, 0.05, 0.1, 0.2),
}
_BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more, each counted once."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def twice(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            )
            return _let(F.array_sort(F.transform(again, lambda x: x["at"])), spread)

        return _let(marked, twice)

    def spread(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(n < WINDOW + 1, 0).otherwise(found).cast("long")


def measures(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """Struct ``row`` with the carried columns, a hash of the text, the counts, and the measures of RULES."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    words = docs.select(row, text, F.xxhash64(text).alias("text_key")).withColumn("words", F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), 0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    counted = words.select(
        "row",
        "text_key",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(lines, F.size).alias("n_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).alias("n_upper"),
        without("!").alias("n_exclaimed"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        "row",
        "text_key",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        # longer texts repeat words more, so the share is taken of the square root's excess
        (1 - F.col("n_distinct") / F.greatest(F.pow(F.col("n_words"), 0.75), F.lit(1))).alias("same_word_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_exclaimed", "word_chars").alias("exclaimed_share"),
    )


def _log_gamma(x: Column) -> Column:
    """Of x >= 1: Stirling's series eight steps up, and down again."""
    up = reduce(lambda a, b: a * b, (x + k for k in range(8)))
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(up)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """The chance of at most k of n at rate p, for k up to p * n.

    Terms fall from the k-th down; ten standard deviations below it they are under
    1e-16 of the sum, whatever n is, so no more are added up.
    """
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    reach = F.least(k, F.ceil(10 * F.sqrt(n * p * (1 - p))) + 10).cast("int")
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, i: Column) -> Column:
        at = k - i + 1  # from the at-th term to the one below it
        term = s["term"] * at * (1 - p) / ((n - at + 1) * p)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    steps = F.when(reach > 0, F.sequence(F.lit(1), reach)).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), F.exp(top) * F.aggregate(steps, state, add, lambda s: s["total"]))


def admissible(k: Column, n: Column, alpha: float, level: Column) -> Column:
    """Whether the exact upper bound, at confidence 1 - level, on a rate seen k of n times is under alpha."""
    return F.when(k <= alpha * n, binomial_tail(k, n, alpha) <= level).otherwise(F.lit(False))


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and, for each rule, its cutoff or null, from rows with stratum, good (1 or 0) and the measures."""
    sizes = [F.sum("good").alias("n1"), F.sum(1 - F.col("good")).alias("n0")]
    passed = [
        F.sum(F.when((F.col("good") == g) & (F.col(rule) > cut), 1).otherwise(0)).alias(f"{rule} {i} {g}")
        for rule, cuts in RULES.items()
        for i, cut in enumerate(cuts)
        for g in (0, 1)
    ]
    counted = stored(labelled.groupBy("stratum").agg(*sizes, *passed), "strata")
    # all bounds that are tested hold together
    level = F.lit(delta / (max(1, counted.count()) * sum(map(len, RULES.values()))))
    tested = [
        F.struct(F.lit(rule).alias("rule"), F.lit(-i).alias("order"), F.lit(float(cut)).alias("cut"), F.col(f"{rule} {i} 1").alias("good"), F.col(f"{rule} {i} 0").alias("bad"))
        for rule, cuts in RULES.items()
        for i, cut in enumerate(cuts)
    ]
    rows = counted.filter("n1 > 0 AND n0 > 0").select("stratum", "n1", "n0", F.explode(F.array(*tested)).alias("t"))
    rows = rows.withColumn("gain", F.col("t.bad") / F.col("n0") - F.col("t.good") / F.col("n1"))
    rows = rows.filter("gain > 0").filter(admissible(F.col("t.good"), F.col("n1"), alpha, level))
    best = [F.max(F.when(F.col("t.rule") == rule, F.struct("gain", "t.order", "t.cut")))["cut"].alias(rule) for rule in RULES]
    return rows.groupBy("stratum").agg(*best)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """id, the counts, base_failed, the rules that reject, and kept."""
    stratum = F.coalesce(F.concat(F.lit("="), F.col(f"row.`{stratum_col}`").cast("string")), F.lit("")).alias("stratum")
    rows = measures(docs, [id_col, stratum_col], text_col)
    rows = stored(rows.select(F.col(f"row.`{id_col}`").alias("id"), stratum, *rows.columns[1:]), "measures")
    given = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(label_col).cast("long").alias("good"))
    # a text is one trial of its stratum
    trials = rows.join(given, "id").groupBy("stratum", "text_key").agg(F.min("good").alias("good"), *[F.first(r).alias(r) for r in RULES])
    chosen = stored(cutoffs(trials, alpha, delta), "cutoffs")
    limits = chosen.select("stratum", F.struct(*RULES).alias("cut"))
    judged = rows.join(F.broadcast(limits) if chosen.count() <= BROADCAST_STRATA else limits, "stratum", "left")
    hits = [F.when(F.col(rule) > F.col(f"cut.{rule}"), F.lit(rule)) for rule in RULES]
    rejecting = F.filter(F.array(*hits), lambda x: x.isNotNull())
    judged = judged.withColumn("rejected_by", rejecting).drop("cut", "text_key")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(docs, labels).select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept")
