"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens, 128-bit hashes of element paths with their classes and of
text blocks at their path. Over all pages of a host each token has an occurrence
vector, how often it is on each page; tokens with equal vectors form a class,
which a fingerprint of the vector, summed up by Spark, finds without bringing a
host's pages together. Classes that are on enough of a host's pages nest as a
whole in a slot, that is an element of another class; one whose tokens lie in
several slots is first parted by slot. The nested classes are the host's
template; what it leaves open is data. The innermost slot that doesn't repeat on
a page and holds most data outside menus, headers, footers, sidebars, notices,
adverts, forms and comments is the article, and its data is the page's text.

A host without a valid template, or a page that has nothing in the article's
slot, is read by the names and classes of its own elements alone: what is in an
unmarked article or main element, else all that nothing marks. Classes of html, body
and main mark nothing; nor do those around the largest article where it would else
leave no text. Null and empty pages give an empty text, null urls a host of their own;
repeated rows are pages of their own. An empty table gives no rows; further columns go
along inside ``row``; pages of any length and depth are read in linear time.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_128_digest

from tidemill.llm.common import map_arrow, stored

#: A class belongs to the template if it is on this share of a host's pages, and on two at least.
SUPPORT = 0.4
#: The article's slot holds this share of the text that could be an article's.
MAIN_SHARE = 0.6
#: Templates (about 2 KB each) that are broadcast at most; more are joined by host and salt.
BROADCAST_HOSTS = 2_000
SALTS = 64

# Elements by kind, and words of class, id and role that mark what is no article.
RAW = "script style noscript template textarea title iframe svg select".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
ASIDE = "head nav header footer aside form button menu dialog".split()
MARKED = (
    "ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer form "
    "header login menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related "
    "replies reply respond search share sharing sidebar social sponsor sponsored subscribe subscription teaser toolbar widget"
).split()

#: Words beside a mark that say what it belongs to, or only how the page is laid out.
OWNERS, LAYOUT = "article post entry story content title".split(), "no has with without is".split()
#: Marks that also stand at the start or end of a longer word, as in menubar and topnav.
JOINED = "menu sidebar footer cookie advert newsletter navbar".split()
#: Elements whose own classes say nothing of what is in them.
WHOLE = "html body main".split()

# possessive, and no < outside quotes: what doesn't close is left after one look
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW, _VOID, _INLINE, _ASIDE, _MARKED, _OWNERS, _LAYOUT, _WHOLE = map(frozenset, (RAW, VOID, INLINE, ASIDE, MARKED, OWNERS, LAYOUT, WHOLE))
_JOINED = re.compile(rf"(?:{'|'.join(JOINED)}).*|.*(?:{'|'.join(JOINED)}|nav)")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
#: Elements whose start ends an open element of the same group.
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@functools.lru_cache(4096)
def _named(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(w for m in _ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").split())


@functools.lru_cache(4096)
def _marks(words: tuple[str, ...], inside: bool = False) -> bool:
    """Whether names mark what is no article; inside one a header is its own."""
    for w in words:
        parts = re.split(r"[-_]", w.lower())
        found = {p for p, q in zip(parts, ["", *parts]) if q not in _LAYOUT and (p in _MARKED or _JOINED.fullmatch(p))}
        if "header" in found and (inside or not _OWNERS.isdisjoint(parts)):
            found.discard("header")
        if found:
            return True
    return False


@dataclass
class Block:
    """A text block: the path it is at, its text, whether it can be an article's, and
    whether it lies in an article or main element."""

    path: bytes
    text: str
    fit: bool
    inside: bool


@dataclass
class Element:
    """A path of elements: the one it lies in, tag, depth, how often it is on the page, and whether always fit."""

    parent: bytes
    tag: str
    depth: int
    times: int
    fit: bool


class _Open:
    """An open element."""

    __slots__ = ("name", "path", "fit", "inside", "number")

    def __init__(self, name: str, path: bytes, fit: bool, inside: bool, number: int):
        self.name, self.path, self.fit, self.inside, self.number = name, path, fit, inside, number


ROOT = b""


def _under(parent: bytes, label: str) -> bytes:
    return xxh3_128_digest(parent + label.encode("utf-8", "surrogatepass"))


def read(html: str) -> tuple[list[Block], dict[bytes, Element]]:
    """The text blocks of a page in order, and its paths. Time and memory are linear in
    the page, however deep its elements nest. Where no block that can be an article's
    is in an unmarked article element, marks around the largest such element are void."""
    blocks, elements, around = _read(html, frozenset())
    if around and not any(b.fit and b.inside for b in blocks):
        blocks, elements, _ = _read(html, around)
    return blocks, elements


def _read(html: str, void: frozenset[int]) -> tuple[list[Block], dict[bytes, Element], frozenset[int]]:
    """Blocks, paths, and the numbers of the marked elements around the largest unmarked article."""
    out: list[Block] = []
    elements: dict[bytes, Element] = {}
    stack = [_Open("", ROOT, True, False, 0)]
    names: Counter[str] = Counter()  # of open elements
    numbers = {0}  # of open elements
    inline: dict[str, list[int]] = {}  # by name, the elements in which unmarked inline ones were opened
    articles: list[tuple[int, int, frozenset[int]]] = []  # characters before it, number, marked elements around it
    largest: tuple[int, frozenset[int]] = (0, frozenset())
    marked: list[int] = []  # open elements that only their names mark
    text: list[str] = []
    at = number = total = 0

    def flush() -> None:
        nonlocal total
        joined = " ".join(unescape("".join(text)).split())
        text.clear()
        if joined:
            top = stack[-1]
            total += len(joined)
            out.append(Block(top.path, joined, top.fit, top.inside))

    def close() -> None:
        nonlocal largest
        gone = stack.pop()
        names[gone.name] -= 1
        numbers.discard(gone.number)
        if marked and marked[-1] == gone.number:
            marked.pop()
        if articles and articles[-1][1] == gone.number:
            before, _, around = articles.pop()
            if around and total - before > largest[0]:
                largest = (total - before, around)

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        text.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in _RAW:
            if not m[1] and not m[3].endswith("/"):
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in _VOID:
            text.append(" ")
            continue
        if name in _INLINE:
            if m[1]:
                # unmarked ones are not on the stack; their ends must not pop a marked one around them
                own = inline.get(name, [])
                while own and own[-1] not in numbers:
                    own.pop()
                if own and own[-1] == stack[-1].number:
                    own.pop()
                    continue
                if not names[name]:
                    continue
            elif not _marks(_named(m[3]), stack[-1].inside):
                if not m[3].endswith("/"):
                    inline.setdefault(name, []).append(stack[-1].number)
                continue
        flush()
        if m[1]:
            if names[name]:
                while stack[-1].name != name:
                    close()
                close()
            continue
        ends = _CLOSES.get(name) or ({"p"} if name not in _INLINE else ())
        if stack[-1].name in ends:
            close()
        if m[3].endswith("/"):
            continue
        number += 1
        top, words = stack[-1], _named(m[3])
        named = name not in _WHOLE and _marks(words, top.inside)
        fit = top.fit and (not named or number in void) and (name not in _ASIDE or name == "header" and top.inside)
        article = name in ("article", "main") and not named
        path = _under(top.path, ".".join([name, *sorted(words)[:3]]))
        stack.append(_Open(name, path, fit, top.inside or article, number))
        names[name] += 1
        numbers.add(number)
        if named and not article:
            marked.append(number)
        if article and marked:
            articles.append((total, number, frozenset(marked)))
        seen = elements.get(path)
        if seen is None:
            elements[path] = Element(top.path, name, len(stack) - 1, 1, fit)
        else:
            seen.times, seen.fit = seen.times + 1, seen.fit and fit
    flush()
    while len(stack) > 1:
        close()
    return out, elements, largest[1]


def text_token(path: bytes, text: str) -> bytes:
    """A text block at its path."""
    return _under(path, f" {text}")


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))


#: A token: of a path, the one it lies in, its tag and depth; of a text, its path, no tag and depth 0.
_TOKENS = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("page", T.LongType()),
        T.StructField("token", T.BinaryType()),
        T.StructField("parent", T.BinaryType()),
        T.StructField("tag", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("fit", T.BooleanType()),
        T.StructField("times", T.LongType()),
        T.StructField("chars", T.LongType()),
    ]
)


def page_tokens(html: str | None) -> dict[bytes, list]:
    """token to (parent, tag, depth, fit, times, chars): paths with the characters in and
    under them that can be an article's, and texts with their own."""
    blocks, elements = read(html or "")
    own = {path: [e.parent, e.tag, e.depth, e.fit, e.times, 0] for path, e in elements.items()}
    texts: dict[bytes, list] = {}
    for b in blocks:
        size = len(b.text) * b.fit
        if b.path in own:
            own[b.path][5] += size
        seen = texts.setdefault(text_token(b.path, b.text), [b.path, "", 0, b.fit, 0, 0])
        seen[3], seen[4], seen[5] = seen[3] and b.fit, seen[4] + 1, seen[5] + size
    for x in sorted(own.values(), key=lambda x: -x[2]):
        if x[0] in own:
            own[x[0]][5] += x[5]
    return own | texts


def tokens(pages: DataFrame) -> DataFrame:
    """For each page (host, page, html) its tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [
                    (host, page, token, *x)
                    for host, page, html in zip(*(c.to_pylist() for c in part.columns))
                    for token, x in page_tokens(html).items()
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), _TOKENS)], names=_TOKENS.names)

    return map_arrow(pages.select("host", "page", "html"), run, _TOKENS)


def templates(pages: DataFrame) -> DataFrame:
    """host, and its classes: number of pages, whether once on each of them, tokens.

    A host has at most its mean number of tokens a page / SUPPORT of tokens.
    """
    vector = F.bit_xor(F.xxhash64("page", "times"))  # of the pages a token is on, how often it is there
    # a token tells its parent, tag and depth; as keys they leave a hash aggregate
    counted = tokens(pages).groupBy("host", "token", "parent", "tag", "depth").agg(
        vector.alias("vector"), F.count("*").alias("pages"), F.sum("times").alias("times"), F.sum("chars").alias("chars"), F.bool_and("fit").alias("fit")
    )
    often = counted.filter(F.col("pages") >= 2).join(pages.groupBy("host").agg(F.count("*").alias("total")), "host")
    often = often.filter(F.col("pages") >= SUPPORT * F.col("total"))
    token = F.struct("token", "parent", "tag", "depth", "chars", "fit")
    classes = often.groupBy("host", "vector", "pages", "times").agg(F.collect_list(token).alias("tokens"))
    once = (F.col("pages") == F.col("times")).alias("once")
    return classes.groupBy("host").agg(F.collect_list(F.struct("pages", once, "tokens")).alias("template"))


def nested(classes: list[dict]) -> list[dict]:
    """The classes that nest as a whole, outermost first.

    A class lies in the slot of its outermost tokens; where these have several, it
    is parted by slot. It is valid once its slot is the root or one of a valid class.
    """
    waiting: dict[bytes, list[dict]] = {}
    for c in classes:
        parent = {t["token"]: t["parent"] for t in c["tokens"]}
        slots: dict[bytes, bytes] = {}  # of the class's own paths

        def slot(p: bytes) -> bytes:
            way = []
            while p in parent and p not in slots:
                way.append(p)
                p = parent[p]
            slots.update((q, slots.get(p, p)) for q in way)
            return slots.get(p, p)

        parts: dict[bytes, list[dict]] = {}
        for t in c["tokens"]:
            parts.setdefault(slot(t["parent"]), []).append(t)
        for at, own in parts.items():
            waiting.setdefault(at, []).append(c | {"tokens": own})
    valid: list[dict] = []
    paths = [ROOT]
    while paths:
        for c in waiting.pop(paths.pop(), ()):
            valid.append(c)
            paths += [t["token"] for t in c["tokens"] if t["tag"]]
    return valid


def template_of(classes: list[dict] | None) -> dict | None:
    """path, the article's slot, and texts, what the template itself says; None if no slot holds most data."""
    valid = nested(classes or [])
    every = {t["token"]: t for c in valid for t in c["tokens"]}
    data = {k: t["chars"] for k, t in every.items() if t["tag"]}
    said = Counter()  # the template's own characters in and under each path
    for t in every.values():
        if not t["tag"]:
            said[t["parent"]] += t["chars"]
    for k in sorted(data, key=lambda k: -every[k]["depth"]):
        data[k] -= said[k]
        said[every[k]["parent"]] += said[k]
    total = sum(n for k, n in data.items() if every[k]["depth"] == 1)
    slots = [t for c in valid if c["once"] for t in c["tokens"] if t["tag"] in _CONTAINERS and t["fit"]]
    slots = [t for t in slots if total > 0 and data[t["token"]] >= MAIN_SHARE * total]
    if not slots:
        return None
    texts = {k for k, t in every.items() if not t["tag"]}
    return {"path": max(slots, key=lambda t: (t["depth"], t["token"]))["token"], "texts": texts}


#: Elements that can hold an article as a whole; single blocks such as p can't.
_CONTAINERS = frozenset("html body article main section div td center blockquote".split())


def main_text(html: str | None, template: dict | None) -> str:
    blocks, elements = read(html or "")
    fit = [b for b in blocks if b.fit]
    if template:
        within = {template["path"]: True, ROOT: False}  # whether a path is in the slot

        def inside(p: bytes) -> bool:
            way = []
            while p not in within:
                way.append(p)
                p = elements[p].parent
            within.update((q, within[p]) for q in way)
            return within[p]

        slot = [b.text for b in fit if inside(b.path) and text_token(b.path, b.text) not in template["texts"]]
        if slot:
            return "\n".join(slot)
    own = [b for b in fit if b.inside]
    return "\n".join(b.text for b in own or fit)


def extract(pages: DataFrame, carry: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Struct ``row`` with the carried columns, and the main ``text`` of each page."""
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    read = pages.select(row, host_of(url).alias("host"), html.alias("html"), F.xxhash64(url, html).alias("page"))
    found = stored(templates(read), "templates")
    if found.count() <= BROADCAST_HOSTS:
        joined = read.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.col("page"), F.lit(SALTS)).cast("int")
        joined = read.withColumn("salt", salt).join(salted, ["host", "salt"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known: dict[str, dict | None] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = []
                for i, (host, html) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = template_of(part.column(3)[i].as_py())
                    texts.append(main_text(html, known[host]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    inner = joined.select("row", "host", "html", "template")
    return map_arrow(inner, run, T.StructType([inner.schema["row"], T.StructField("text", T.StringType())]))


def op1(pages: DataFrame) -> DataFrame:
    return extract(pages, ["page_id", "url"]).select(
        "row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars")
    )
