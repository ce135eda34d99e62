"""Main text of web pages by line-block distribution (operator 3).

Markup is stripped to one line per block element, in page order.  A line weighs the length
of its text outside links; menus, page headers, footers, sidebars, scripts, styles and hidden elements weigh
nothing.  Elements whose role, class or id speaks of furniture, and forms, are doubtful: the weight around and in them tells whether they
are the content or go (``_judged``), so a page inside a form or a container of an unlucky name is kept, and notices, adverts,
and readers' comments beside a text go, in an article too.  Weights are summed over sliding windows of ``WINDOW`` lines: where the sum first
reaches ``SURGE`` is a surge point, where it falls to nothing again a dive point.  The
stretches between them tell the content: the ``article`` elements that hold one (teasers beside
them go) with what else is in the ``main`` element, or on a page without these elements the content's container, the
innermost element that holds all stretches and more than one block.  All text of it but furniture
is kept, so that no short block is lost; on a page without an article with the headings right
before it.  If nothing reaches the bound, all articles or the whole page are the content.  On
a whole page, blocks that are wholly links are dropped before the first and behind the last
other text, unless they share a container of their own with text.

Inside an article only elements that frame others (``FRAMES``) are furniture by their name, and
only if each word of a name says so; paragraphs and headings never are.

Character references are decoded, white space inside a block becomes one space (a line
break is white space), blocks are trimmed and joined by one line feed.

Defined results: null or empty html, and pages without text outside links, have the empty text;
every row gives a row, a null page_id or url stays null; other columns are ignored.  A page is read
in time proportional to its length, whatever its markup: a quote, raw element or comment that never
closes is searched for once.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_text

WINDOW = 3
#: Characters in a window that make a surge on a page without an article element.
SURGE = 80

# HTML's own element names.
RAW = set("script style noscript template iframe object svg math textarea select canvas audio video title xmp".split())
ENDLESS = set("script style textarea title xmp".split())  # without an end they reach to the end of the page
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_ITEMS = set("li dt dd option tr td th".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("nav aside footer button dialog head menu".split())
FORMS = {"form", "fieldset"}
# Words in class, id or role that mark furniture.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar complementary widget widgets footer header masthead contentinfo topbar toolbar share sharing social"
    " related recommended newsletter subscribe subscription signup login search form comment comments disqus respond replies discussion pagination pager".split()
)
# Elements that may be furniture inside an article, and words that its names may hold beside those above.
FRAMES = set("div section ul ol table figure center iframe details".split())
NEUTRAL = set(
    "box bar block container wrapper wrap section list area slot unit inner outer row link links button buttons icons item items thread site page top bottom left right main post story article entry js"
    " user users reader readers visitor visitors customer customers guest guests count title body text author articles posts stories law info policy message messages".split()
)
# Words that begin other words of a name, as in "commentlist".
STEMS = ("comment", "cookie")
ADVERTS = set("ad ads advert adverts advertisement advertising sponsored".split())
CONTAINERS = set("html body div section table tbody tr td center blockquote".split())
_KEEP_HEADER = {"article", "entry", "post", "story"}

_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")  # a tag without attributes
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?")
_CLOSE = {n: re.compile("</" + n, re.I | re.A) for n in RAW}
_PART = re.compile(r"[A-Z]?[a-z]++|[A-Z]++(?![a-z])|[0-9]++")

SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("n_chars", T.LongType(), False),
        T.StructField("n_blocks", T.LongType(), False),
    ]
)


def _attributes(text: str) -> dict[str, str]:
    """Names, lowered, and values; of a repeated name the first one counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


#: What a name says of an element: nothing, perhaps furniture, a form, furniture, or furniture whatever it holds.
TEXT, WEAK, FORM, STRONG, GONE = range(5)


def _words(token: str) -> set[str]:
    """The words of a name, in lower case; "commentList", "comment-list" and "commentlist" have the same."""
    out = {w.lower() for w in _PART.findall(token)}
    for w in list(out):
        for stem in STEMS:
            rest = w[len(stem) :]
            if w.startswith(stem) and (rest in NEUTRAL or rest in HINTS):
                out = out - {w} | {stem, rest}
    return out


def _furniture(name: str, attributes: str, in_article: bool) -> int:
    """How much an element's name, class, id and role say that it is furniture."""
    if name in DROPPED or name == "header" and not in_article:
        return GONE
    if name in ("html", "body", "article", "main"):
        return TEXT
    level = FORM if name in FORMS else TEXT
    if not attributes.strip():
        return level
    told = _attributes(attributes)
    style = told.get("style", "").lower().replace(" ", "")
    if "hidden" in told and told["hidden"].lower() != "until-found" or told.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return GONE
    block = name in BLOCKS
    names = [_words(t) for key in ("class", "id", "role") for t in told.get(key, "").split()]
    if in_article and name not in FRAMES:
        # An article's own paragraphs, headings and inline elements are its text, but for adverts and a reader's comment.
        if name in _HEADINGS:
            return TEXT
        if not ADVERTS.isdisjoint(told.get("class", "").lower().split()):
            return STRONG if block else GONE
        return STRONG if block and name not in FORMS and any(w & {"comment", "comments"} and w <= HINTS | NEUTRAL for w in names) else level
    for words in names:
        found = words & HINTS
        if not found or found == {"header"} and words & _KEEP_HEADER:
            continue
        # Every word of the name must speak of furniture ("comment-list", not "related-work"); else the text's weight tells.
        if words <= HINTS | NEUTRAL:
            level = max(level, STRONG)
        elif not in_article:
            level = max(level, WEAK)
    return GONE if level and not block else level


def tokens_of(page: str):
    """(text before, name, closing, attributes) of every tag, and a last one with an empty name.

    Comments, declarations and raw elements are passed over.  Each place is read a bounded number
    of times: a quote that never closes is searched for once, after that quotes hide no ">".
    """
    begin = at = 0
    quotes, missing = True, set()
    parts: list[str] = []
    while True:
        i = page.find("<", at)
        if i < 0:
            break
        m = _PLAIN.match(page, i)
        if m:
            name = m[2].lower()
            if name not in RAW:
                if parts:
                    yield "".join([*parts, page[begin:i]]), name, m[1] == "/", ""
                    parts = []
                else:
                    yield page[begin:i], name, m[1] == "/", ""
                begin = at = m.end()
                continue
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            parts.append(page[begin:i])
            begin = at = len(page) if end < 0 else end + 3
            continue
        m = _NAME.match(page, i + (2 if page.startswith("/", i + 1) else 1))
        if not m:
            end = page.find(">", i) if page[i + 1 : i + 2] in ("!", "?", "/") else -1
            if end < 0:
                at = i + 1  # a sign of the text
                continue
            parts.append(page[begin:i])
            begin = at = end + 1
            continue
        end = -1
        if quotes:
            tag = _TAG_END.match(page, m.end())
            quotes = tag is not None
            end = tag.end() - 1 if tag else -1
        if end < 0:
            end = page.find(">", m.end())
            if end < 0:
                at = len(page)  # no tag ends any more
                break
        name, closing = m[0].lower(), page[i + 1] == "/"
        before = "".join([*parts, page[begin:i]])
        parts, begin, at = [], end + 1, end + 1
        if name in RAW and not closing:
            close = None if name in missing else _CLOSE[name].search(page, at)
            if close is None:
                missing.add(name)
                if name in ENDLESS:
                    begin = at = len(page)
            else:
                stop = page.find(">", close.start())
                begin = at = len(page) if stop < 0 else stop + 1
            yield before, "", False, ""
            continue
        yield before, name, closing, page[m.end() : end]
    yield "".join([*parts, page[begin:]]), "", False, ""


class Lines:
    """The lines of a page, and the tree of its containers (0: the page)."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.weight: list[int] = []  # characters outside links
        self.article: list[int] = []  # number of the outermost article, -1 elsewhere in a main element, 0 outside
        self.heading: list[bool] = []
        self.node: list[int] = []
        self.region: list[int] = []  # the innermost element that its name makes doubtful; 0: none
        self.doubt = [(0, TEXT)]  # of each such element the one around it, and how doubtful it is
        self.parent = [0]
        self.end = [0]  # the first number behind those of a container's own ones

    def add(self, text: str, weight: int, article: int, heading: bool, node: int, region: int) -> None:
        for to, value in zip((self.text, self.weight, self.article, self.heading, self.node, self.region), (text, weight, article, heading, node, region), strict=True):
            to.append(value)

    def without(self, gone: set[int]) -> None:
        """Each of these doubtful elements becomes an empty line."""
        out: list[int] = []  # regions in page order are numbered so: an inner one follows its outer one
        outer = [0] * len(self.doubt)
        for r in range(1, len(self.doubt)):
            outer[r] = outer[self.doubt[r][0]] or (r if r in gone else 0)
        seen: set[int] = set()
        for k, r in enumerate(self.region):
            o = outer[r]
            if o:
                if o in seen:
                    continue
                seen.add(o)
                self.text[k], self.weight[k] = "", 0
            out.append(k)
        for name in ("text", "weight", "article", "heading", "node", "region"):
            held = getattr(self, name)
            setattr(self, name, [held[k] for k in out])


def lines_of(page: str) -> Lines:
    """One line for every block; what is furniture whatever it holds is an empty line, and doubtful elements are told."""
    out = Lines()
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements; whether each is furniture, whether it is doubtful
    within = [0]  # the open doubtful elements
    open_of: Counter = Counter()
    inner = [0]  # the open containers
    skip = articles = mains = links = headings = roots = 0
    place = lambda: roots if articles else -1 if mains else 0
    closes: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.add(text, max(0, len(text) - linked), place(), headings > 0, inner[-1], within[-1])
        parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal skip, articles, mains, links, headings
        name, bad, doubtful = stack.pop()
        open_of[name] -= 1
        if name in CONTAINERS:
            out.end[inner.pop()] = len(out.parent)
        skip -= bad
        articles -= name == "article"
        mains -= name == "main"
        links -= name == "a"
        headings -= name in _HEADINGS
        if bad and not skip:
            out.add("", 0, place(), False, inner[-1], within[-1])
        if doubtful:
            within.pop()

    at = 0
    for before, name, closing, attributes in tokens_of(page):
        at += len(before)
        if before and not skip:
            parts.append(before)
            if links:
                linked += len(before)
        if not name:
            continue
        block = name in BLOCKS
        if not skip:
            if block:
                flush()
            elif name == "br":
                parts.append(" ")
        if closing:
            if open_of[name]:
                while stack[-1][0] != name:
                    pop()
                if block and not skip:
                    flush()
                pop()
            continue
        if name in VOID:
            continue
        if block and stack and (stack[-1][0] == "p" or stack[-1][0] in _HEADINGS) or name in _ITEMS and stack and stack[-1][0] == name:
            pop()  # a new block ends an open paragraph
        if skip and name in ("article", "main"):
            # Furniture that is never closed ends where the article begins.
            bad = next(n for n, b, _ in reversed(stack) if b)
            if bad not in closes:
                closes[bad] = max((m.start() for m in re.finditer("</" + re.escape(bad), page, re.I | re.A)), default=-1)
            if closes[bad] < at:
                while skip:
                    pop()
        level = TEXT if skip else _furniture(name, attributes, articles + mains > 0)
        bad, doubtful = level == GONE, level in (WEAK, FORM, STRONG)
        if doubtful:
            out.doubt.append((within[-1], level))
            within.append(len(out.doubt) - 1)
        stack.append((name, bad, doubtful))
        open_of[name] += 1
        if name in CONTAINERS:
            out.parent.append(inner[-1])
            out.end.append(0)
            inner.append(len(out.parent) - 1)
        skip += bad
        if name == "article":
            roots += not articles
            articles += 1
        mains += name == "main"
        links += name == "a"
        headings += name in _HEADINGS
    flush()
    while stack:
        pop()
    out.end[0] = len(out.parent)
    return out


def stretches_of(weight: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """(surge, dive): from the first line of a window of ``bound`` characters to where windows are empty."""
    n = len(weight)
    total = np.concatenate([[0], np.cumsum(weight), np.full(WINDOW, weight.sum())])
    window = total[WINDOW : WINDOW + n] - total[:n]  # of the lines from each line on
    out, i = [], 0
    high, low = window >= bound, window <= 0
    while i < n:
        rise = i + int(high[i:].argmax())
        if not high[rise]:
            break
        surge = rise + int((weight[rise:] > 0).argmax())
        fall = int(low[surge:].argmax())
        dive = surge + fall if low[surge + fall] else n
        out.append((surge, dive))
        i = max(dive, rise + 1)
    return out


def _judged(lines: Lines) -> None:
    """Doubtful elements become empty lines, but where the distribution of text says that they are the content.

    From the page inwards, within what is kept: an element that perhaps is furniture stays if a window in it has twice ``SURGE`` characters or it holds
    most of the weight around it; a form only if it holds two thirds, and not beside an article's text.  One that its name calls furniture stays only if what is around it has no surge point (beside an
    article's own text: no text at all) and it holds most of the weight there.
    """
    n = len(lines.doubt)
    if n == 1:
        return
    weight, region = np.array(lines.weight, dtype=np.int64), np.array(lines.region, dtype=np.int64)
    article = np.array(lines.article, dtype=np.int64)
    # The lines of an element and of those in it are side by side: regions are numbered in page order.
    first, last = np.full(n, len(region)), np.zeros(n, dtype=np.int64)
    np.minimum.at(first, region, np.arange(len(region)))
    np.maximum.at(last, region, np.arange(1, len(region) + 1))
    for r in range(n - 1, 0, -1):
        o = lines.doubt[r][0]
        first[o], last[o] = min(first[o], first[r]), max(last[o], last[r])
    inner: dict[int, list[int]] = {}
    for r in range(1, n):
        inner.setdefault(lines.doubt[r][0], []).append(r)
    gone: set[int] = set()
    todo = [0]
    while todo:
        o = todo.pop()
        held = [r for r in inner.get(o, []) if first[r] < last[r]]
        if not held:
            continue
        begin, end = first[o], last[o]
        around = weight[begin:end].copy()
        for r in held:
            around[first[r] - begin : last[r] - begin] = 0
        whole = int(weight[begin:end].sum())
        size = {r: int(weight[first[r] : last[r]].sum()) for r in held}
        own = article[begin:end] != 0
        told = bool((own & (around > 0)).any())  # an article's own text is around
        rest = told or bool(stretches_of(around, SURGE))
        level = {r: lines.doubt[r][1] for r in held}
        kept = {r for r in held if level[r] == WEAK and (size[r] * 2 > whole or stretches_of(weight[first[r] : last[r]], 2 * SURGE))}
        kept |= {r for r in held if level[r] == FORM and size[r] * 3 > whole * 2 and not told}
        if not rest and not kept:
            kept = {r for r in held if size[r] * 2 > whole}
        gone |= set(held) - kept
        todo += kept
    lines.without(gone)


def main_text(page: str) -> list[str]:
    """The blocks between surge and dive points, with what shares their article or container."""
    lines = lines_of(page)
    _judged(lines)
    weight, article = np.array(lines.weight, dtype=np.int64), np.array(lines.article, dtype=np.int64)
    told = np.array([bool(t) for t in lines.text], dtype=bool)
    inside = told & (article != 0)
    if inside.any():
        # Of several articles, those that the distribution points to; all, if it points to none.
        points = {int(article[k]) for a, b in stretches_of(np.where(article > 0, weight, 0), SURGE) for k in range(a, b) if weight[k]}
        kept = inside & np.isin(article, [-1, *points]) if points else inside
        return [lines.text[k] for k in np.flatnonzero(kept)]
    if not weight.sum():
        return []
    return [lines.text[k] for k in _content(lines, weight, np.flatnonzero(told), stretches_of(weight, SURGE))]


def _content(lines: Lines, weight: np.ndarray, told: np.ndarray, stretches: list[tuple[int, int]]) -> list[int]:
    """The lines of the container that holds all stretches."""
    node = np.array(lines.node, dtype=np.int64)
    held = [node[k] for a, b in stretches for k in range(a, b) if lines.text[k] and weight[k]]
    root = 0
    if held:  # containers are numbered in page order: the one around the first and the last holds all
        low, high = int(min(held)), int(max(held))
        root = low
        while root and not (root <= low and high < lines.end[root]):
            root = lines.parent[root]
    order = np.sort(node[told])
    within = lambda r: int(np.searchsorted(order, lines.end[r]) - np.searchsorted(order, r))
    while root and within(root) < 2:
        root = lines.parent[root]
    kept = told[(node[told] >= root) & (node[told] < lines.end[root])].tolist()
    if len(kept) == len(told):  # the whole page: link lists around the text are no part of it
        text = [k for k in kept if weight[k]]
        first, last = text[0], text[-1]
        while first and lines.heading[first - 1]:
            first -= 1
        homes = {lines.node[k] for k in text} - {root}  # a link that shares a text's own container is
        shared = [False] * len(lines.parent)
        for n in range(1, len(shared)):
            shared[n] = n in homes or shared[lines.parent[n]]
        return [k for k in kept if first <= k <= last or shared[lines.node[k]]]
    first = kept[0]
    while first and lines.heading[first - 1]:
        first -= 1
    return [*range(first, kept[0]), *kept]


def _frames(frames):
    for f in frames:
        found = [main_text(as_text(h)) for h in f["html"]]
        text = ["\n".join(b) for b in found]
        yield pd.DataFrame({"page_id": f["page_id"].astype("Int64"), "url": f["url"], "text": text, "n_chars": [len(t) for t in text], "n_blocks": [len(b) for b in found]})


def extract(pages: DataFrame) -> DataFrame:
    """One row per page with its main text."""
    return pages.select("page_id", "url", "html").mapInPandas(_frames, SCHEMA)
