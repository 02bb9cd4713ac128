"""Main text of HTML pages.

The standard library's parser streams events; text between block tags forms
lines. Each line has a text-to-tag ratio; the ratios are smoothed with a Gaussian
and clustered by a threshold (their deviation) into content and other lines. Names are a prior: lines of
boilerplate elements (menus, headers, footers, asides, forms, notices, adverts,
comments, ...) have the ratio 0 and never come out.

The clusters decide the region: all articles if they hold half of the content,
else all main elements likewise, else the innermost container that holds all
high-ratio lines and headings. They also decide inside the region: runs of lines that
are nothing but links are menus, named or not, unless their smoothed ratios lie
in the content's cluster. All other lines of the region are the article.

An element is boilerplate by its class or id only if all words of one of these names are
boilerplate words or say where something stands ('site-footer', not 'related-work'), and
if it doesn't hold nearly all of the page's text (comments, menus and adverts: all of it). Headings never are.

Time and room are linear in the page, however deep its elements nest.

Defined cases: null html counts as empty; a page without text, or with none but
boilerplate, gives ''; malformed and unclosed markup is read as the parser reads it; page ids
may be null or repeat, each row is treated by itself; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names by role, and words of class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead"
    " title tr ul".split()
)
CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer form frameset head iframe input math menu meter nav noembed noframes noscript object progress"
    " script search select style svg template textarea title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adslot advert advertisement adverts advertising aside alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies"
    " discussion disqus dropdown footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination"
    " popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription"
    " toolbar topbar widget widgets".split()
)
#: Words that drop an element outside articles only: an article's own header holds its headline.
DROPPED_OUTSIDE = frozenset(("header",))
#: Words that beside those above say no more than what an element is or where it stands.
PLACE_WORDS = frozenset(
    "a area article articles bar block bottom box bs btn button card center col column container content desktop div el element entry feed fixed for form global google"
    " group header home hot html id in inner item js left link links list main mobile module my new news of outer page panel post posts primary reader readers right row"
    " secondary section site slot sticky story the thread title top unit user users ui view wide wrap wrapper zone".split()
)
#: Of these words those that also drop an article of its own.
COMMENT_WORDS = frozenset("ad ads advert advertisement comment comments discussion promo promoted reply replies respond sponsor sponsored".split())
#: Wrappers of these names are spared only if the page has nothing else: not for long comments under a short article.
RARELY_SPARED = COMMENT_WORDS | frozenset("adslot adverts advertising commentlist comments disqus menu nav navbar navigation pagination related share sharing social sponsored".split())
#: Elements that carry the page; names don't drop them.
CARRIERS = frozenset("body html".split()) | HEADINGS
#: An unclosed <p> ends where one of these begins.
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "title"}

#: Class words that negate or qualify the words behind them.
MODIFIERS = frozenset("can disable disabled enable enabled has have hide hides is no non not show shows supports toggle toggles with without".split())

#: Lines with fewer characters a tag are low-ratio; wrappers of this share of the text aren't dropped.
LOW_RATIO, NEARLY_ALL = 25.0, 0.9
SIGMA = 1.0
#: A line counts as links if these hold so much of it; so many such lines in a row are a menu.
LINKED, MENU_LINES = 0.8, 3
_DISPLAY_NONE = re.compile(r"display\s*:\s*none")
_WORDS = re.compile(r"[a-z]+")


def _named(value: str, words: frozenset[str]) -> bool:
    """Whether one of the names is made of such words and of place words alone; what a modifier qualifies doesn't count."""
    for name in value.lower().replace("--", " -- ").split():
        if name == "--":
            break  # the variant of a block: 'layout--sidebar'
        found: list[str] = []
        for word in _WORDS.findall(name):
            if word in MODIFIERS:
                break
            found.append(word)
        if any(w in words for w in found) and all(w in words or w in DROPPED_WORDS or w in PLACE_WORDS for w in found):
            return True
    return False


@dataclass(slots=True)
class _Open:
    """An open element and what holds inside it."""

    tag: str
    wrapper: int  # the innermost element around it that is boilerplate by its name or kind; 0: none
    silent: bool  # within such an element that is no block: its text belongs to no line
    container: int
    heading: bool
    article: bool
    link: bool


@dataclass(slots=True)
class _Line:
    text: str
    tags: int
    wrapper: int
    container: int
    heading: bool
    links: bool  # (nearly) all of it
    dropped: bool = False

    @property
    def ratio(self) -> float:
        return 0.0 if self.dropped else len(self.text) / max(1, self.tags)


class _Lines(HTMLParser):
    """Collects the lines of a page, its tree of containers (0: the page), and that of boilerplate elements (0: none)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # per boilerplate element the one around it, and whether it may be spared: always, only if nothing else is left, never
        self.around, self.spares = [0], ["always"]
        self.lines: list[_Line] = []
        self.root = _Open("", 0, False, 0, False, False, False)
        self.stack: list[_Open] = []
        self.open: Counter[str] = Counter()
        self.parents, self.kinds = [0], [""]
        self.buffer: list[str] = []
        self.tags = self.chars = self.link_chars = 0

    def _top(self) -> _Open:
        return self.stack[-1] if self.stack else self.root

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            top = self._top()
            self.lines.append(_Line(text, self.tags, top.wrapper, top.container, top.heading, self.link_chars >= LINKED * self.chars))
            self.tags = 0
        self.chars = self.link_chars = 0

    def _cut(self, k: int) -> None:
        for x in self.stack[k:]:
            self.open[x.tag] -= 1
        del self.stack[k:]

    def _pop_to(self, name: str) -> None:
        if self.open[name]:
            k = len(self.stack) - 1
            while self.stack[k].tag != name:
                k -= 1
            self._cut(k)

    def _drops(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header":  # the headline of an article may stand in its header
            return not inside
        words = COMMENT_WORDS if tag in ("article", "main") else DROPPED_WORDS if inside else DROPPED_WORDS | DROPPED_OUTSIDE
        for key, value in attrs:
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return True
            if key == "role" and (value or "").strip().lower() in DROPPED_ROLES:
                return True
            if key in ("class", "id") and tag not in CARRIERS and _named(value or "", words):
                return True
            if key == "style" and _DISPLAY_NONE.search(value or ""):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self.buffer.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in ENDS_P and self.open["p"]:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag == "p":
                    self._cut(k)
                    break
                if self.stack[k].tag in BLOCK:
                    break
        if tag == "body":
            self._pop_to("head")
        top = self._top()
        # what stands in an element that is never spared goes with it
        wrapper, drops = top.wrapper, self.spares[top.wrapper] != "never" and self._drops(tag, attrs, top.article)
        if drops:
            wrapper = len(self.around)
            self.around.append(top.wrapper)
            rarely = any(k in ("class", "id") and _named(v or "", RARELY_SPARED) for k, v in attrs)
            self.spares.append("never" if tag != "form" and tag in DROPPED | {"header"} else "alone" if rarely else "always")
        container = top.container
        if tag in CONTAINER:
            container = len(self.parents)
            self.parents.append(top.container)
            self.kinds.append(tag)
        silent = top.silent or (drops and tag not in BLOCK)
        self.stack.append(_Open(tag, wrapper, silent, container, top.heading or tag in HEADINGS, top.article or tag in ("article", "main"), top.link or tag == "a"))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._flush()
        if tag not in VOID:
            self._pop_to(tag)

    def handle_data(self, data: str) -> None:
        top = self._top()
        if top.silent:  # script, style, button, ... inside a block
            return
        self.buffer.append(data)
        size = len(data) - data.count(" ")
        self.chars += size
        if top.link:
            self.link_chars += size


def content_scores(lines: list[_Line]) -> list[float]:
    """Smoothed text-to-tag ratios; dropped lines count as 0."""
    ratios = [line.ratio for line in lines]
    reach = max(1, math.ceil(3 * SIGMA))
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    total = sum(kernel)
    padded = [0.0] * reach + ratios + [0.0] * reach
    return [sum(w * padded[i + k] for k, w in enumerate(kernel)) / total for i in range(len(ratios))]


def _drop_wrapped(parser: _Lines) -> None:
    """Marks the lines that go: those within a boilerplate element, unless each such element around them is spared, as it holds nearly all of the page."""
    size, good = [0] * len(parser.around), [False] * len(parser.around)
    for line in parser.lines:
        size[line.wrapper] += len(line.text)
        good[line.wrapper] |= line.ratio >= LOW_RATIO
    for k in range(len(size) - 1, 0, -1):  # elements come after those around them
        size[parser.around[k]] += size[k]
        good[parser.around[k]] |= good[k]
    for spared in (("always",), ("always", "alone")):
        gone = [False] * len(size)
        for k in range(1, len(size)):
            gone[k] = gone[parser.around[k]] or not (parser.spares[k] in spared and good[k] and size[k] >= NEARLY_ALL * size[0])
        if not all(gone[line.wrapper] for line in parser.lines):
            break
    for line in parser.lines:
        line.dropped = gone[line.wrapper]


def _parsed(html: str) -> _Lines:
    parser = _Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # the parser's answer to broken declarations
        parser = _Lines()
        parser.feed(re.sub(r"<!\[[^>]*>?", "", html))
        parser.close()
    parser._flush()
    return parser


def _region(parser: _Lines, content: list[bool]) -> list[bool]:
    """Per container whether its lines belong to the region that the content lines decide."""
    lines, parents, kinds = parser.lines, parser.parents, parser.kinds
    n = len(parents)
    mass, held = [0] * n, [0] * n
    for chosen, line in zip(content, lines, strict=True):
        if chosen:
            mass[line.container] += len(line.text)
        held[line.container] += not line.dropped and (line.heading or line.ratio >= LOW_RATIO or (chosen and not line.links))
    for c in range(n - 1, 0, -1):  # containers come after their parents
        mass[parents[c]] += mass[c]
        held[parents[c]] += held[c]
    for kind in ("article", "main"):
        within = [False] * n
        covered = 0
        for c in range(1, n):
            outer = within[parents[c]]
            within[c] = outer or (kinds[c] == kind and mass[c] > 0)
            if within[c] and not outer:
                covered += mass[c]
        if covered and covered >= 0.5 * mass[0]:
            # articles without content lines, such as short ones, are articles too
            for c in range(1, n):
                within[c] = within[parents[c]] or kinds[c] == kind
            return within
    # down while one container holds all
    at = 0
    inside = [c == 0 for c in range(n)]
    for c in range(1, n):
        if parents[c] == at and held[c] == held[0] and held[0]:
            at = c
            inside = []
    if not inside:
        inside = [False] * n
        inside[at] = True
    for c in range(1, n):
        inside[c] = inside[c] or (inside[parents[c]] and c != at)
    return inside


def main_text(html: str | None) -> str:
    """The article of one page: its blocks, parted by an empty line."""
    parser = _parsed(html or "")
    _drop_wrapped(parser)
    lines = parser.lines
    if all(line.dropped for line in lines):
        return ""
    scores = content_scores(lines)
    mean = sum(scores) / len(scores)
    threshold = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    content = [s >= threshold and not line.dropped for s, line in zip(scores, lines, strict=True)]
    if not any(content):
        content = [not line.dropped for line in lines]
    inside = _region(parser, content)
    within = [k for k, line in enumerate(lines) if not line.dropped and inside[line.container]]
    kept: list[str] = []
    for menu, run in groupby(within, lambda k: lines[k].links and not lines[k].heading and lines[k].ratio < LOW_RATIO):
        own = list(run)
        # several links in a row that aren't content by the ratios around them
        if menu and sum(scores[k] for k in own) < threshold * len(own) and len(own) >= MENU_LINES:
            continue
        kept += [lines[k].text for k in own]
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row; no shuffle, one pass."""
    df = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return df.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
