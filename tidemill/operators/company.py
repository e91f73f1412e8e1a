"""What belongs to one company: isolation, imports, state machines, matches, comparisons."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import text as tx
from tidemill.operators.matching import by_code
from tidemill.operators.patterns import contained

CODE_SCORE, TEXT_SCORE, SHOWN = 100, 60, 6
TERM_CHARS, TERMS = (3, 25), 400


def own(df: DataFrame, company, column: str = "company") -> DataFrame:
    """The rows of one company; no company is an error, never all rows."""
    if company is None:
        raise ValueError("a private table needs a company")
    return df.filter(F.col(column) == F.lit(company))


def scoped_upsert(existing: DataFrame, incoming: DataFrame, scope: str, name: str) -> DataFrame:
    """Incoming rows that insert or update a row of the same scope and name, whatever
    its letters' case; what is named twice is taken once."""
    key = F.lower(F.trim(F.col(name)))
    rows = incoming.withColumn("_key", key).dropDuplicates([scope, "_key"])
    had = existing.select(F.col(scope), key.alias("_key"), F.lit("update").alias("action")).distinct()
    return rows.join(had, [scope, "_key"], "left").withColumn("action", F.coalesce("action", F.lit("insert"))).drop("_key")


def forecast(changes: DataFrame, scope: str) -> DataFrame:
    """What an import would do, without doing it."""
    count = lambda a: F.count_if(F.col("action") == a)
    return changes.groupBy(scope).agg(count("insert").alias("inserted"), count("update").alias("updated"))


def routed(steps: DataFrame) -> DataFrame:
    """State of each routing_id from its steps (step, at): open moves new to in_progress,
    decide closes it and clears the change flag, change sets the flag."""
    at = lambda s, f: f(F.when(F.col("step") == s, F.col("at")))
    s = steps.groupBy("routing_id").agg(at("open", F.min).alias("opened_at"), at("decide", F.max).alias("decided_at"), at("change", F.max).alias("changed_at"))
    status = F.when(F.col("decided_at").isNotNull(), "closed").when(F.col("opened_at").isNotNull(), "in_progress").otherwise("new")
    changed = F.col("changed_at").isNotNull() & (F.col("decided_at").isNull() | (F.col("changed_at") > F.col("decided_at")))
    return s.withColumn("status", status).withColumn("changed", changed)


def decision_rows(steps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The decision ledger of steps (open, search, decide): a key has one open row at a
    time, searches count on it, a decision closes it or makes a closed row of its own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.sum((F.col("step") == "decide").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = steps.withColumn("row", F.coalesce(before, F.lit(0))).withColumn("_n", F.row_number().over(w))
    own_rows = Window.partitionBy(*keys, "row")
    opened = numbered.withColumn("_open", F.min(F.when(F.col("step") == "open", F.col("_n"))).over(own_rows))
    rows = opened.groupBy(*keys, "row").agg(
        F.max(F.col("step") == "open").alias("opened"), F.max(F.col("step") == "decide").alias("closed"),
        F.count_if((F.col("step") == "search") & (F.col("_n") > F.col("_open"))).alias("searches"),
    )
    return rows.filter("opened OR closed")


def confirmed(votes: DataFrame, products: DataFrame, order: list[str]) -> DataFrame:
    """The last confirmation or rejection of each code of a key (key, code, state), for
    all products with that key: the two exclude one another."""
    last = votes.groupBy("key", "code").agg(F.max(F.struct(*order, "state"))["state"].alias("state"))
    return products.join(last, "key").select("product_id", "code", "state")


def catalog_match(goods: DataFrame, products: DataFrame) -> DataFrame:
    """Tenders that a catalogue (code or term for each product) meets: by code where a
    product has one, else by its name; a code beats a name; a few positions are shown."""
    codes = products.filter("code IS NOT NULL").select("code").distinct()
    terms = products.filter("code IS NULL").select("term").distinct()
    keep = ["tender_id", "lot_id", "name"]
    # what a code and a name are worth is found once for each, and no position twice
    coded = by_code(goods.select("good_code").distinct(), codes).select("good_code").distinct().withColumn("_code", F.lit(CODE_SCORE))
    named = contained(goods, terms).select("name").distinct().withColumn("_text", F.lit(TEXT_SCORE))
    hits = goods.select(*keep, "good_code").join(coded, "good_code", "left").join(named, "name", "left")
    hits = hits.select(*keep, F.coalesce("_code", "_text").alias("score")).filter("score IS NOT NULL")
    best = hits.groupBy(*keep).agg(F.max("score").alias("score"))
    w = Window.partitionBy("tender_id").orderBy(F.desc("score"), "lot_id", "name")
    placed = best.withColumn("n", F.row_number().over(w))
    shown = F.array_sort(F.collect_list(F.when(F.col("n") <= SHOWN, F.struct("n", "name"))))
    names = F.array_join(F.transform(shown, lambda x: x["name"]), ", ")
    return placed.groupBy("tender_id").agg(F.max("score").alias("score"), F.count("*").alias("n_positions"), names.alias("shown"))


def term_plan(terms: DataFrame, most: int | None = TERMS) -> DataFrame:
    """The terms to search for, most frequent and longest first, and how many the limit cuts."""
    n = terms.filter(F.length("term").between(*TERM_CHARS)).groupBy("term").agg(F.count("*").alias("n"))
    if most is None:
        return n.withColumn("cut", F.lit(0).cast("long"))
    kept = n.orderBy(F.desc("n"), F.desc(F.length("term")), "term").limit(most)
    return kept.crossJoin(F.broadcast(n.agg(F.greatest(F.lit(0), F.count("*") - most).alias("cut"))))


def trigram_codes(goods: DataFrame, term: str, level: int = 5) -> DataFrame:
    """Codes by the best likeness of one of their names to a term."""
    names = goods.select("name").distinct().withColumn("likeness", tx.jaccard(tx.trigrams(F.col("name")), tx.trigrams(F.lit(term))))
    codes = goods.select(F.substring("good_code", 1, level).alias("code"), "name").distinct().join(names, "name")
    return codes.groupBy("code").agg(F.max("likeness").alias("likeness"))


def named_files(fields: Column) -> Column:
    """Files among a map of fields: each key ending in _path, with its name, kind and size."""
    paths = F.map_filter(fields, lambda k, v: k.endswith("_path") & (F.coalesce(v, F.lit("")) != ""))
    at = lambda k, suffix: F.try_element_at(fields, F.concat(F.regexp_replace(k, "_path$", ""), F.lit(suffix)))
    return F.transform(
        F.map_keys(paths),
        lambda k: F.struct(F.regexp_replace(k, "_path$", "").alias("file"), fields[k].alias("path"), at(k, "_name").alias("name"), at(k, "_ext").alias("ext"), at(k, "_sizes").alias("sizes")),
    )


def precise_close_at(day: Column, remain_seconds: Column, fetched_at: Column, offset_hours: int = 5) -> Column:
    """When a deadline that is only a day ends: what remained when it was read, if that
    is on the day there, else the day's last second."""
    seconds = lambda c: F.make_dt_interval(secs=c.cast("decimal(18,6)"))
    ends = fetched_at + seconds(remain_seconds)
    local = F.make_dt_interval(hours=F.lit(offset_hours))
    same = (ends + local).cast("date") == day.cast("date")
    return F.when(same, ends).otherwise(day.cast("date").cast("timestamp") + F.make_dt_interval(hours=F.lit(23), mins=F.lit(59), secs=F.lit(59).cast("decimal(18,6)")) - local)


def scoped(df: DataFrame, **flags) -> DataFrame:
    """Rows within the flags given: equal values, lists of values, ranges as pairs; None is no flag."""
    for column, want in flags.items():
        if isinstance(want, tuple):
            low, high = want
            df = df if low is None else df.filter(F.col(column) >= low)
            df = df if high is None else df.filter(F.col(column) <= high)
        elif isinstance(want, list):
            df = df.filter(F.col(column).isin(want))
        elif want is not None:
            df = df.filter(F.col(column) == want)
    return df


# Written names of document types.
DOCUMENT_TYPES = {
    "license": ["license", "licence", "litsenziya", "лицензия"],
    "certificate": ["certificate", "sertifikat", "сертификат", "guvohnoma"],
    "charter": ["charter", "ustav", "устав", "nizom"],
    "guarantee": ["bank guarantee", "guarantee letter", "kafolat xati", "гарантийное письмо"],
    "reference": ["reference", "recommendation", "tavsiya", "отзыв"],
}


def canon(c: Column) -> Column:
    """Lower case, one apostrophe, blanks for all other signs, once each. No more or
    fewer characters come of one, blanks apart, so offsets can be counted back."""
    c = F.translate(F.lower(c), "‘’ʻʼ`´", "''''''")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}']+", " "))


def document_type(c: Column) -> Column:
    """The type that a written name means: by all its words, else by a name in it, the longest first."""
    names = sorted(((n, t) for t, own_names in DOCUMENT_TYPES.items() for n in own_names), key=lambda x: (-len(x[0]), x))
    s = canon(c)
    exact = F.create_map(*[F.lit(x) for n, t in names for x in (n, t)])
    held = F.coalesce(*[F.when(F.concat(F.lit(" "), s, F.lit(" ")).contains(f" {n} "), F.lit(t)) for n, t in names])
    return F.coalesce(F.try_element_at(exact, s), held)


# Words and units of numbers that a tender asks for.
RULES = {
    "warranty_months": (r"warrant\w*|guarantee period|kafolat\w*|гарант\w*", r"months?|oy|ой|мес\w*"),
    "delivery_days": (r"deliver\w*|yetkaz\w*|етказ\w*|постав\w*", r"days?|kun|кун|дн\w*|суток"),
    "advance_percent": (r"advance\w*|prepay\w*|avans\w*|бўнак\w*|аванс\w*|предоплат\w*", r"%|percent|foiz|фоиз|процент\w*"),
    "experience_years": (r"experience\w*|tajriba\w*|тажриба\w*|опыт\w*", r"years?|yil|йил|лет|год\w*"),
    "penalty_percent": (r"penalt\w*|fine|jarima\w*|penya|пен[яи]\w*|штраф\w*", r"%|percent|foiz|фоиз|процент\w*"),
    "payment_days": (r"payment\w*|to'lov\w*|тўлов\w*|оплат\w*", r"days?|kun|кун|дн\w*"),
    "validity_days": (r"valid\w*|amal qilish\w*|действ\w*", r"days?|kun|кун|дн\w*"),
    "security_percent": (r"bid security|deposit\w*|zakalat\w*|задат\w*|обеспечени\w*", r"%|percent|foiz|фоиз|процент\w*"),
    "resource_hours": (r"resource|service life|resurs\w*|ресурс\w*|наработк\w*", r"hours?|soat|соат|час\w*|моточас\w*"),
    "response_hours": (r"respon\w*|javob\w*|реагир\w*|реакци\w*", r"hours?|soat|соат|час\w*"),
}
INCOTERMS = ["EXW", "FCA", "FAS", "FOB", "CFR", "CIF", "CPT", "CIP", "DAP", "DPU", "DDP"]
AFTER, BEFORE = 130, 60
SURE, BLANK, REVIEWED = 0.75, 0.40, 0.60
#: Where a word begins and ends: next to letters of any alphabet it does not, or next to Latin ones without marks.
EDGES = (r"\b", r"\b")
ASCII_EDGES = ("(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])")


def rule_patterns(words: str, unit: str, start: str = EDGES[0]) -> tuple[str, str, str]:
    """A number with its unit after the words, one before them, and a blank to be filled in, all within a sentence."""
    gap = r"[^.!?\n]"
    number = rf"(?<![\d.,])(\d{{1,6}})\s*(?:{unit})"
    return rf"{start}(?:{words}){gap}{{0,{AFTER}}}?{number}", rf"{number}{gap}{{0,{BEFORE}}}?{start}(?:{words})", rf"{start}(?:{words}){gap}{{0,{AFTER}}}?(_{{3,}})\s*(?:{unit})"


def _near_numbers(text: Column) -> Column:
    """The sentences with a digit or a blank, each with the sign before it: rules match
    inside one sentence only, so they find there what they find in the whole text."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?:^|[.!?])[^.!?]*?(?:[0-9]|___)[^.!?]*"), F.lit(0)), "")


def _sure(name: str, values: Column) -> Column:
    row = lambda v, n: F.struct(F.lit(name).alias("name"), v.alias("value"), F.lit(SURE).alias("confidence"), (n + 1).alias("place"))
    return F.transform(values, row)


def requirements(docs: DataFrame, carry: list[str], text: str = "text", rules: dict[str, tuple[str, str]] = RULES, place: bool = False, edges: tuple[str, str] = EDGES) -> DataFrame:
    """Rows (carried columns, name, value, confidence, status): what the rules find in a
    text, each name and value once, blanks without a value to be reviewed, and terms of delivery.
    With ``place``, its number among the values of the name too, 0 for a blank. ``edges`` tell
    where words begin and terms of delivery end."""
    found = []
    for name, (words, unit) in rules.items():
        after, before, blank = rule_patterns(words, unit, edges[0])
        hit = lambda p: F.regexp_extract_all("_near", F.lit(f"(?iu){p}"), F.lit(1))
        values = F.array_distinct(F.concat(hit(after), hit(before)))
        found.append(_sure(name, values))
        empty = F.struct(F.lit(name).alias("name"), F.lit(None).cast("string").alias("value"), F.lit(BLANK).alias("confidence"), F.lit(0).alias("place"))
        found.append(F.when(F.size(hit(blank)) > 0, F.array(empty)).otherwise(F.array().cast("array<struct<name:string,value:string,confidence:double,place:int>>")))
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{edges[0]}({'|'.join(map(re.escape, INCOTERMS))}){edges[1]}"), F.lit(1)))
    found.append(_sure("incoterms", terms))
    known = docs.filter(F.col(text).isNotNull()).withColumn("_near", _near_numbers(F.col(text)))
    rows = known.select(*carry, F.explode(F.concat(*found)).alias("r")).select(*carry, "r.*")
    rows = rows if place else rows.drop("place")
    return rows.withColumn("status", F.when(F.col("confidence") < REVIEWED, "needs_review").otherwise("extracted"))


def covered(a: Column, b: Column, least: int = 2) -> Column:
    """Whether two texts speak of the same: a number of both, or some key words of five letters or more."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0))
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) >= 5)
    return F.arrays_overlap(numbers(a), numbers(b)) | (F.size(F.array_intersect(words(a), words(b))) >= least)
