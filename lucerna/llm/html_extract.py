"""HTML main-text extraction by line-block distribution.

A page is stripped of its markup into lines, one for each block.  Furniture (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) becomes ``GAP`` blank lines, so that
text lengths summed over sliding windows of ``WINDOW`` lines fall to zero around it.  Surge points
are where the windowed sum leaves zero, dive points where it returns; the regions between them are
candidates.  Regions of articles win over those of the page's main element, and these over all others.
Of several articles one stays when its densest window reaches ``PEAK`` of the densest of all: teasers of
other articles do not.  Otherwise every region is kept, however short, but one that is nothing but links.

Elements and roles that are surely furniture go.  So does a container whose class or id has a name all of
whose parts are words for furniture, inside an article and outside: ``cookie-notice``, ``share-buttons``,
``relatedPosts``; not ``related-work`` or ``search-results``, which also say something else.  Headings,
paragraphs and articles never go by a name, and a container that holds an article does not.

Null and empty pages give an empty text; repeated rows give a row each; other columns are ignored;
markup that never closes ends with the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import slices

WINDOW = 3
GAP = WINDOW
#: Another article of a page stays when its densest window reaches this share of the densest of all.
PEAK = 0.5

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is never text of the page.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video select noembed noframes xmp title head".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Elements that a class or id can make furniture: containers, never headings, paragraphs, articles or words in a line.
CONTAINERS = frozenset("div section ul ol li dl table figure fieldset details center".split())
PARAGRAPHS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre")
# Words for furniture: alone, for headers (outside an article), for comments of readers, in company only, and what keeps them company.
STRONG = frozenset(
    "ad ads adbox adslot adunit adspace adblock adcontainer adwrapper advert adverts advertisement advertisements advertising adsense banner banners promo promos promotion promotions sponsor sponsored sponsors "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager".split()
)
HEADERS = frozenset("header masthead topbar".split())
READERS = frozenset("comment comments commentlist commentary respond responses reply replies disqus guestbook".split())
WEAK = frozenset("side search legal copyright disclaimer follow trending popular".split())
BOXES = frozenset("box bar links link form list area block panel button buttons icons icon bars".split())
NEUTRAL = BOXES | frozenset(
    "container wrapper wrap section group item items post posts article articles story stories news slot unit space zone top bottom left right inner outer main site page primary secondary global fixed sticky content text "
    "thread tools this us now more by our the your".split()
)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[^a-z]+")
#: One attribute as a tokenizer reads it: quotes count only right after the equals sign.
_NAME = r"[^\s/>][^\s/>=]*+"
_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(rf"(?P<key>{_NAME})(?:\s*+=\s*+(?P<value>{_VALUE})?+)?+")
_KEYS = re.compile("class|id|role|hidden|style", re.I)
#: A solidus that closes an element is not the end of an unquoted value.
_CLOSED = re.compile(r"(?:^|[\s\"']|(?:^|[\s\"'])[^\s=\"'/]+)/\s*$")
_CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}


#: How firmly an element is furniture: not at all, by a name that an article inside it outweighs, or surely.
NO, MARK, SURE = 0, 1, 2


def _marked(name: str, in_article: bool) -> int:
    """Whether a class or id names furniture: all its parts are such words, and one of them says so by itself or two in company."""
    parts = [x for x in _PARTS.split(_CAMEL.sub("-", name).lower()) if x]
    if not parts or not all(x in STRONG or x in READERS or x in NEUTRAL or x in WEAK or x in HEADERS for x in parts):
        return NO
    if any(x in READERS for x in parts):
        return SURE
    if any(x in STRONG for x in parts) or not in_article and any(x in HEADERS for x in parts):
        return MARK
    return MARK if any(x in WEAK for x in parts) and any(x in BOXES for x in parts) else NO


def _furniture(name: str, attrs: str, in_article: bool) -> int:
    """Whether an element is page furniture by its name, role, class or id, or hidden."""
    if name in FURNITURE:
        return NO if name == "header" and in_article else SURE
    if name in ("html", "body", "main") or not attrs:
        return NO
    if not _KEYS.search(attrs):
        return NO
    found, seen = NO, set()
    for m in _ATTR.finditer(attrs):
        key = m["key"].lower()
        if key in seen:
            continue
        seen.add(key)
        value = m["value"] or ""
        value = value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value
        if key == "role" and value.strip().lower() in ROLES:
            return SURE
        if key in ("class", "id") and (name in CONTAINERS or name == "article" and in_article):
            kinds = [_marked(x, in_article) for x in value.split()]
            found = max([found, *kinds]) if name != "article" else SURE if SURE in kinds else found
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SURE
    return found


class Row(NamedTuple):
    """A line: its text, links in it, whether words stand outside them, whether it is a paragraph, the article and the mark it is in, and whether main holds it."""

    text: str
    links: int
    words: bool
    paragraph: bool
    article: int
    mark: int
    main: bool


class Lines:
    """Blocks of a page as they are read.

    Surely furniture is left out while reading and leaves GAP blank lines.  Text inside an element that
    is furniture by its name is kept under the number of its mark: an article further inside outweighs it.
    """

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.parts: list[str] = []
        self.links = self.furniture = self.articles = self.anchors = self.mains = self.last_article = 0
        self.words = False
        self.stack: list[tuple[str, int]] = []
        self.open: Counter[str] = Counter()
        #: Marks around this place: where they stand in the stack.
        self.places: list[int] = []

    def blank(self) -> None:
        self.rows.extend([Row("", 0, False, False, 0, len(self.places), False)] * GAP)

    def flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split())
        if text:
            paragraph = any(self.open[x] for x in PARAGRAPHS)
            self.rows.append(Row(text, self.links, self.words, paragraph, self.last_article if self.articles else 0, len(self.places), self.mains > 0))
        self.parts.clear()
        self.links, self.words = 0, False

    def text(self, piece: str) -> None:
        if not self.furniture and piece:
            self.parts.append(piece)
            if not self.anchors and not self.words:
                self.words = any(map(str.isalnum, entities.unescape(piece) if "&" in piece else piece))

    def push(self, name: str, kind: int) -> None:
        is_article = name in ("article", "main") and kind == NO and not self.furniture
        if is_article and self.places and not self.articles:
            # A wrapper with an unlucky name, such as one named after its sidebar, holds the article.
            self.flush()
            for i in self.places:
                self.stack[i] = (self.stack[i][0], NO)
            self.places.clear()
        if kind and not self.furniture:
            self.flush()
        if name in ("article", "main"):
            self.blank()
        self.stack.append((name, kind))
        self.open[name] += 1
        if kind == SURE:
            self.furniture += 1
        elif kind == MARK:
            self.blank()
            self.places.append(len(self.stack) - 1)
        if name == "article":
            self.last_article += not self.articles
            self.articles += 1
        self.mains += name == "main"
        self.anchors += name == "a"
        self.links += name == "a" and not self.furniture

    def pop(self) -> None:
        name, kind = self.stack.pop()
        self.open[name] -= 1
        if kind == MARK:
            self.flush()
            self.places.pop()
        elif kind == SURE:
            self.furniture -= 1
            if not self.furniture:
                self.parts.clear()
        self.articles -= name == "article"
        self.mains -= name == "main"
        self.anchors -= name == "a"
        if kind and not self.furniture or name in ("article", "main"):
            self.blank()

    def close(self, name: str) -> None:
        if not self.open[name]:
            return
        while True:
            last = self.stack[-1][0]
            if last in BLOCKS:
                self.flush()
            self.pop()
            if last == name:
                return


def read_page(page: str) -> Lines:
    """All lines of a page, in one pass whose work is proportional to the page, however deep it is nested."""
    out = Lines()
    #: Names of which no end tag follows: looked for only once.
    endless: set[str] = set()

    def following(pattern: str, name: str, at: int) -> re.Match | None:
        if pattern in endless:
            return None
        m = re.compile(pattern, re.I).search(page, at)
        if m is None:
            endless.add(pattern)
        return m

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            out.text(page[at:])
            break
        out.text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            out.text(entities.escape(m["cdata"]))
            continue
        if not (name := (m["name"] or "").lower()):
            continue
        if name == "br":
            out.text(" ")
            continue
        if m["close"]:
            if name in BLOCKS:
                out.flush()
            out.close(name)
            continue
        closed = bool(_CLOSED.search(m["attrs"]))
        if name in RAW:
            if closed and name != "head":
                continue
            end = following(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", name, at)
            if name != "head" or end:
                at = end.end() if end else n
            else:
                body = following(r"<body\b", name, at)
                at = body.start() if body else at
            continue
        if name in BLOCKS:
            out.flush()
            closers = _CLOSED_BY.get(name)
            if out.stack and (out.stack[-1][0] == "p" or closers and out.stack[-1][0] in closers):
                out.pop()
        if name in VOID or closed:
            continue
        out.push(name, _furniture(name, m["attrs"], out.articles > 0))
    out.parts.clear() if out.furniture else out.flush()
    return out


def lines(page: str) -> list[Row]:
    """Every block in order; furniture is GAP blank lines."""
    gone = Row("", 0, False, False, 0, 0, False)
    return [gone if row.mark else row for row in read_page(page).rows]


def regions(lengths: list[int]) -> list[tuple[int, int]]:
    """[surge, dive) line ranges in which the sum over each window of WINDOW lines stays above zero."""
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    found, start = [], None
    for i in range(len(lengths)):
        window = total[min(i + WINDOW, len(lengths))] - total[i]
        if start is None and lengths[i]:
            start = i
        elif start is not None and not window:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(lengths)))
    return found


def _peak(lengths: list[int]) -> int:
    return max((sum(lengths[i : i + WINDOW]) for i in range(len(lengths))), default=0)


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by an empty line."""
    blocks = lines(page or "")
    found = regions([len(x.text) for x in blocks])
    rows = lambda r: [x for x in blocks[r[0] : r[1]] if x.text]
    explicit = [r for r in found if blocks[r[0]].article]
    if explicit:
        peaks: dict[int, int] = {}
        for r in explicit:
            of = blocks[r[0]].article
            peaks[of] = max(peaks.get(of, 0), _peak([len(x.text) for x in blocks[r[0] : r[1]]]))
        kept = [r for r in explicit if peaks[blocks[r[0]].article] >= PEAK * max(peaks.values())]
    else:
        kept = [r for r in found if blocks[r[0]].main] or found
        menu = lambda x: sum(y.links for y in x) > 1 and not any(y.words or y.paragraph for y in x)
        kept = [r for r in kept if not menu(rows(r))]
    return "\n\n".join(x.text for r in kept for x in rows(r))


def extract_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
