"""Main text of web pages by differencing with the nearest page of the same host.

A page is cut into text lines, one for each block element. Lines inside chrome
(menus, page headers and footers, sidebars, notices, adverts, forms, reader
comments: by element, role, or a class or id that says nothing else) go. The
others are in an article (inside article or main) or in the body. Pages are
paired with the nearest URL path on their host and the lines of the two are
aligned by longest common subsequence. Differencing decides every line whose
markup does not: all body lines of a page without an article, lines that are
mostly links, and lines under a class or id that only hints at chrome
(`entry-header`, `related-work`). Such lines are deleted where they are shared.
Article text that two pages share stays, as nothing of an article may be
dropped.

Pages of one host with equal lines are copies: they count as one page, so none
is emptied by its own copy. Where the nearest page shares most of a page's open
lines it may be a near copy: then only lines that the page on the other side
shares too are deleted, and those that markup suspects (mostly links, or under a
hint). If both pages share nearly all of them, or there is no second, only suspect
lines go: what is not proven template stays. A page that would be left empty
keeps its lines.

End tags that HTML lets a page leave out (of head, p, li, dt, dd, option and the
parts of tables) are supplied.

Pages whose markup settles every line never travel: other pages need only the
hashes of their lines. Pages are dealt by range of (host, path), so one host may
hold any share of them, and neighbours are found in one pass that holds three.
The first and last page of each partition are set aside with the page beside
them, and differenced once they have met the edges of the adjacent partitions.

A null html gives an empty text; a null or malformed URL counts as a host of its
own name. Repeated rows each get their result. Empty tables give no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import html
import os
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby, islice
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

# Element names, roles and name parts.
SKIPPED = frozenset("script style noscript template iframe svg select textarea title head annotation annotation-xml".split())
CHROME = frozenset("nav footer aside form menu dialog button".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CHROME_NAMES = frozenset("ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Parts of names that say where or how, not what: a class of these and chrome names alone is chrome.
NEUTRAL = frozenset("area bar block body bottom box container content fixed form global group holder inner item left link links list main mobile page primary right secondary section site slot sticky text thread top unit wrap wrapper".split())
ARTICLE = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mpadded mphantom mstyle".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What may stand in a head; any other element, and text, ends one that is open.
IN_HEAD = frozenset("html head base link meta noscript script style template title".split())
#: Elements whose end tag may be left out, and the open ones that the start of each ends.
_BLOCKS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
ENDS = {name: ("p",) for name in _BLOCKS} | {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
#: Elements that it does not reach through, besides chrome.
STOPS = ARTICLE | frozenset("ul ol dl table div section".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_PART = re.compile(r"[^a-zA-Z]+")

_ZONES = {x[0]: x for x in ("chrome", "article", "body")}
#: Rows of bits that are kept ready for lines that recur.
_READY = 256
#: A line is taken for a menu when more than this share of it is link text.
LINKS = 0.5
#: Neighbours that share more than this part of a page's open characters may be near copies of it.
COPY = 0.5
#: The same for the only page beside one: there is no second page to tell template from copy, but most pages of such a pair are no copies.
SOLE = 0.8
#: And for what two neighbours share: pages of a host may be mostly template, but hardly with so little of their own.
COPIES = 0.9


@dataclass
class Line:
    text: str
    zone: str
    links: int  # characters of link text
    hinted: bool = False  # under a class or id that only hints at chrome

    @property
    def menu(self) -> bool:
        return self.links > LINKS * len(self.text)


@dataclass
class _Frame:
    name: str
    chrome: bool
    article: bool
    hinted: bool
    at: int  # the last open element, this one included, that no p, li or the like is ended through
    same: int  # the open element of this name before it, or -1


@dataclass
class _Builder:
    lines: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0

    def end(self, zone: str, hinted: bool) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, zone, self.links, hinted))
            self.parts, self.links = [], 0


def _named_chrome(value: str) -> tuple[bool, bool]:
    """Whether a class or id names chrome, and whether one of its names only hints at it."""
    hinted = False
    for word in value.split():
        parts = [p.lower() for p in _PART.split(word) if p]
        if any(p in CHROME_NAMES for p in parts):
            if all(p in CHROME_NAMES or p in NEUTRAL for p in parts):
                return True, False
            hinted = True
    return False, hinted


def page_lines(source: str) -> list[Line]:
    """The text lines of a page in order; scripts, styles, comments and markup have none."""
    stack: list[_Frame] = []
    last: dict[str, int] = {}  # of each name, the place of its innermost open element
    built, at, n = _Builder(), 0, len(source)
    chrome = article = link = hints = 0

    def end() -> None:
        built.end("chrome" if chrome else "article" if article else "body", hints > 0)

    def pop() -> None:
        nonlocal chrome, article, link, hints
        frame = stack.pop()
        last[frame.name] = frame.same
        chrome -= frame.chrome
        article -= frame.article
        hints -= frame.hinted
        link -= frame.name == "a"

    def shut(names: tuple[str, ...], bound: int) -> None:
        """End the outermost open element of these names that lies within the bound."""
        found = [place for x in names if (place := last.get(x, -1)) >= bound]
        if found:
            end()
            while len(stack) > min(found):
                pop()

    def text(raw: str) -> None:
        if raw:
            if last.get("head", -1) >= 0 and raw.strip():
                shut(("head",), 0)
            shown = html.unescape(raw) if "&" in raw else raw
            built.parts.append(shown)
            if link:
                built.links += len(shown.strip())

    while at < n:
        found = _TOKEN.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at : found.start()])
        token, at = found.group(), found.end()
        if token[1] in "!?":
            continue
        name = _NAME.match(token)[1].lower()
        if not token.endswith(">"):
            break  # the page ends inside a tag
        if token[1] == "/":
            if name not in INLINE:
                end()
            if (place := last.get(name, -1)) >= 0:
                while len(stack) > place:
                    pop()
            continue
        if name not in IN_HEAD:
            shut(("head",), 0)
        if name in ENDS and stack:
            shut(ENDS[name], max(stack[-1].at, 0))
        if name not in INLINE:
            if name == "br":
                built.parts.append(" ")
            else:
                end()
        if name in _RAW_END and not token.endswith("/>"):
            close = _RAW_END[name].search(source, at)
            at = close.end() if close else n
            continue
        if name in VOID or token.endswith("/>"):
            continue
        is_chrome = name in CHROME or name in SKIPPED or (name == "header" and not article)
        hinted = False
        if not is_chrome and name not in ("html", "body") and ("class" in token or "id" in token or "role" in token or "CLASS" in token):
            for key, *values in _ATTRIBUTE.findall(token):
                value = "".join(values)
                if key.lower() == "role":
                    is_chrome |= value.lower() in CHROME_ROLES
                elif name not in ARTICLE and not (name in ("h1", "h2") and article):
                    named, hint = _named_chrome(value)
                    is_chrome |= named
                    hinted |= hint
        stops = is_chrome or name in STOPS
        stack.append(_Frame(name, is_chrome, name in ARTICLE, hinted, len(stack) if stops else stack[-1].at if stack else -1, last.get(name, -1)))
        last[name] = len(stack) - 1
        chrome += is_chrome
        article += name in ARTICLE
        hints += hinted
        link += name == "a"
    end()
    return built.lines


def shared_lines(a: Sequence, b: Sequence) -> set[int]:
    """Indices of `a` on a longest common subsequence with `b` (bit-parallel, Hyyrö).

    A row's zero bits mark where the length grows along `b`. Every so many rows
    one is kept, and those between are made again on the way back, so memory
    grows with the root of the page's lines times its bits.
    """
    both = set(a).intersection(b)
    at, other = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    low, high = 0, 0
    most = min(len(at), len(other))
    while low < most and a[at[low]] == other[low]:
        low += 1
    while high < most - low and a[at[-1 - high]] == other[-1 - high]:
        high += 1
    out = set(at[:low]) | set(at[len(at) - high :])
    at, other = at[low : len(at) - high], other[low : len(other) - high]
    places: dict[object, list[int]] = defaultdict(list)
    for j, line in enumerate(other):
        places[line].append(j)
    every = (1 << len(other)) - 1

    @lru_cache(_READY)
    def bits(line: object) -> int:
        row = bytearray(len(other) // 8 + 1)
        for j in places.get(line, ()):
            row[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(row, "little")

    def following(row: int, i: int) -> int:
        met = row & bits(a[at[i]])
        return ((row + met) | (row - met)) & every

    step = isqrt(len(at)) + 1
    row, kept = every, []
    for i in range(len(at)):
        if i % step == 0:
            kept.append(row)
        row = following(row, i)
    j = len(other)
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept[k]]
        for i in range(k * step, min((k + 1) * step, len(at))):
            rows.append(following(rows[-1], i))
        for i in range(len(rows) - 1, 0, -1):
            j = (~rows[i] & ((1 << j) - 1)).bit_length()  # the last place where the length grows
            if not j:
                return out
            if rows[i - 1] >> (j - 1) & 1:
                out.add(at[k * step + i - 1])
                j -= 1
    return out


def _wanted(lines: list[Line]) -> list[tuple[int, Line, bool]]:
    """Lines of the article, or of the body where there is none, that markup does not rule out, and whether differencing decides them."""
    zone = "article" if any(x.zone == "article" for x in lines) else "body"
    return [(i, x, zone == "body" or x.hinted or x.menu) for i, x in enumerate(lines) if x.zone == zone and not (x.hinted and x.menu)]


def keys_of(lines: list[Line]) -> list[int]:
    """What lines are compared by."""
    return [xxhash.xxh3_64_intdigest(x.text.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines]


def main_text(lines: list[Line], nearest: Sequence[int] | None = None, other: Sequence[int] | None = None) -> str:
    """What remains of a page's lines beside the keys of the nearest page and of the one on the other side."""
    rows = _wanted(lines)
    gone: set[int] = set()
    size = lambda at: sum(len(x.text) for i, x, is_open in rows if is_open and i in at)
    whole = size(range(len(lines)))
    if nearest and any(is_open for _, _, is_open in rows):
        own = keys_of(lines)
        gone = shared_lines(own, nearest)
        if size(gone) > (COPY if other else SOLE) * whole:
            # A near copy shares its article too: lines go that a second page has as well or that markup suspects, and these alone if it is a copy too.
            suspect = {i for i, x, _ in rows if i in gone and (x.hinted or x.menu)}
            both = gone & shared_lines(own, other) if other else set()
            gone = suspect if size(both) > COPIES * whole else suspect | both
    kept = [x.text for i, x, is_open in rows if not (is_open and i in gone)]
    return " ".join(kept or [x.text for _, x, _ in rows])


def _closeness(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def _packed(lines: list[Line]) -> str:
    return "\n".join(f"{x.zone[0]}{'-h'[x.hinted]}{x.links}\t{x.text}" for x in lines)  # a line's text has single spaces only


def _unpacked(packed: str) -> list[Line]:
    parts = (x.partition("\t") for x in packed.split("\n")) if packed else ()
    return [Line(text, _ZONES[head[0]], int(head[2:]), head[1] == "h") for head, _, text in parts]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page that its markup settles, the lines of each other page, and the keys of all."""
    for batch in batches:
        texts, packed, keys, classes = [], [], [], []
        for source in batch.column(4).to_pylist():
            lines = [x for x in page_lines(source or "") if x.zone != "chrome"]
            keys.append(keys_of(lines))
            is_open = any(is_open for _, _, is_open in _wanted(lines))
            texts.append(None if is_open else main_text(lines))
            packed.append(_packed(lines) if is_open else None)
            mark = packed[-1].encode("utf-8", "surrogatepass") if is_open else repr(keys[-1]).encode()
            classes.append(hashlib.blake2b(mark, digest_size=16).digest())
        made = [pa.array(texts, pa.string()), pa.array(packed, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(classes, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], names="id url host path text lines keys class".split())


def _text(before: tuple | None, page: tuple, after: tuple | None) -> str:
    """The main text of a page (.., host, path, keys, lines) between two others, the nearer first."""
    near = sorted((x for x in (before, after) if x and x[-4] == page[-4]), key=lambda x: -_closeness(x[-3], page[-3]))
    return main_text(_unpacked(page[-1]), *(x[-2] for x in near))


_PAGE = "class host path keys lines".split()
_PAGE_TYPES = [pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, 512)):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in order of (host, path): the text of each open page between two others, and the pages at the ends (`at` is set) to be settled."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        before = page = None
        at = 0
        for after in _pages(batches):
            if page:
                if before and page[-1] is not None:
                    yield *page[:2], _text(before, page, after), *[None] * 7
                if at < 2:
                    yield *page[:2], None, part, at, at == 0, False, *page[2:]
                at += 1
            before, page = page, after
        if page:
            if at > 2:
                yield *before[:2], None, part, at - 1, False, False, *before[2:]
            yield *page[:2], None, part, at, at == 0, True, *page[2:]

    kinds = [*_PAGE_TYPES[:2], pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *_PAGE_TYPES[2:]]
    yield from _batches(rows(), kinds, [*_PAGE[:2], *"text part at first last".split(), *_PAGE[2:]])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in order of (key, at): the texts of the open end pages of each partition, between the ends of those beside it."""

    def rows() -> Iterator[tuple]:
        for _, group in groupby(_pages(batches), key=lambda x: x[0]):
            held = [None, *group, None]  # six pages at most
            for before, page, after in zip(held, held[1:], held[2:], strict=False):
                if page[1] and page[-1] is not None:
                    yield *page[2:4], _text(before, page, after)

    yield from _batches(rows(), [*_PAGE_TYPES[:2], pa.string()], ["class", "host", "text"])


def _edge_texts(edges: DataFrame) -> DataFrame:
    """(class, host, text) of the open pages at the ends of partitions: a few rows of each partition."""
    parts = [r["part"] for r in edges.select("part").distinct().orderBy("part").collect()]
    beside = edges.sparkSession.createDataFrame(list(zip(parts, [None, *parts], [*parts[1:], None], strict=False)), "part long, previous long, next long")
    seen = lambda key, at, wanted: [F.col(key).alias("key"), at.alias("at"), wanted.alias("wanted"), *_PAGE]
    met = edges.join(beside, "part")
    own = met.select(*seen("part", F.col("at"), F.col("first") | F.col("last")))
    before = met.where("last and next is not null").select(*seen("next", F.lit(-1).cast("long"), F.lit(False)))
    after = met.where("first and previous is not null").select(*seen("previous", F.lit((1 << 63) - 1), F.lit(False)))
    every = own.unionByName(before).unionByName(after).repartition("key").sortWithinPartitions("key", "at")
    return every.select("key", "wanted", *_PAGE).mapInArrow(_settle, "class binary, host string, text string")


def _open_texts(parsed: DataFrame) -> DataFrame:
    """(class, host, text) of every class of copies that differencing decides."""
    classes = parsed.groupBy("host", "class").agg(F.min("path").alias("path"), F.first("keys").alias("keys"), F.first("lines").alias("lines"))
    dealt = classes.select(*_PAGE).repartitionByRange("host", "path", "class").sortWithinPartitions("host", "path", "class")
    found = materialize(dealt.mapInArrow(_difference, "class binary, host string, text string, part long, at long, first boolean, last boolean, path string, keys array<long>, lines string"), "html-open")
    return found.where("at is null").select("class", "host", "text").unionByName(_edge_texts(found.where("at is not null")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)))
    rows = rows.withColumn("path", F.regexp_extract(url, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1))
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, url string, host string, path string, text string, lines string, keys array<long>, class binary"
    parsed = materialize(rows.select("id", "url", "host", "path", "html").mapInArrow(_parse, fields), "html-lines", 3)
    settled = parsed.where("lines is null").select("id", "url", "text")
    decided = parsed.where("lines is not null").select("id", "url", "host", "class").join(_open_texts(parsed), ["host", "class"]).select("id", "url", "text")
    return settled.unionByName(decided)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_html": op5_html}
