"""Main text of web pages from parser events, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser streams start, end and text events.  Text between
block boundaries is a line; its text-to-tag ratio is its code points over its
tags.  The ratios of all lines shown, smoothed by a Gaussian over neighbouring
lines, are split into two clusters by a threshold.  The upper cluster selects the
content region: the element that holds nearly all of its text, be it called an
article or not.  The region's lines are the page's text, but those inside menus,
headers, footers, sidebars, notices, adverts, forms and reader comments: element
names and roles give them away, classes and ids where the clusters agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unpacked

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Elements whose text is never shown as prose, and those that frame an article.
UNSEEN = frozenset("script style noscript template iframe object canvas svg math audio video head title datalist".split())
FRAME = frozenset("nav header footer aside form button select option textarea input fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of widgets that are never the article, as whole classes or ids (words of FILL may stand beside them).
WIDGETS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promoted promotion sponsor sponsored sponsors nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar sidebars footer masthead topbar "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing comments commentlist replies respond disqus copyright toolbar widget".split()
)
#: Names that an article's own section may bear too: they count unless it holds a heading and text of the upper cluster.
HINTS = frozenset("aside rail foot header notice notices notification alert related recommended social form search comment reply discussion legal disclaimer skip".split())
FILL = frozenset("area bar block bottom box btn button buttons col column container content form group holder icons inner item items left link links list message module outer panel placeholder post posts right row section site slot text thread top unit wrap wrapper main page global primary secondary sticky fixed follow media network".split())
TALK = frozenset("comment comments commentlist reply replies respond".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li tr td th tbody thead tfoot".split())
#: An open element that a new one of the given name ends, searched up to the bound.
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of a text, never a region.
LEAVES = HEADINGS | frozenset("p li dt dd pre blockquote figure figcaption ul ol dl tr address".split())
SIGMA, TAGS_FREE = 1.0, 1
#: Share of the upper cluster's text that an element must hold for the region to be inside it; and if it holds all headings.
MOST, MOST_HEADED = 0.9, 0.75
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_OPENING, _COMMENT_END = re.compile(r"<[A-Za-z/!?]"), re.compile(r"--!?>")
_LONG_REFERENCE = re.compile(r"&#0*([0-9]{8})[0-9]*")


def _marks(value: str, names: frozenset) -> bool:
    """Whether a class or id names something of ``names``: one of its tokens has no other words but those of FILL and numbers."""
    for token in value.split():
        words = {w.lower() for w in _WORD.findall(token)}
        if words & names and all(w in names or w in FILL or w in WIDGETS or w.isdigit() for w in words):
            return True
    return False


class Page(HTMLParser):
    """Elements and lines of one page, in page order; time is linear in the page however tags are nested."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.name, self.hard, self.sure, self.hint = [-1], ["html"], [False], [False], [False]
        self.unseen = [False]
        self.stack, self.solid = [0], [0]  # open elements; places in the stack of those that are not inline
        self.at: dict[str, list[int]] = {}  # places in the stack of open elements by name
        self.lines: list[tuple[int, str, int, int]] = []  # element, text, tags, code points of link text
        self.bits: list[str] = []
        self.tags = self.links = 0
        self.no_close = False  # no more ends of character data

    def read(self, html: str) -> Page:
        """Takes a whole page.  A tag that its end cuts off is dropped, as browsers do, so that the parser never looks for an end in vain."""
        end = html.rfind(">") + 1
        cut = _OPENING.search(html, end)
        html = html[: cut.start()] if cut else html
        self.feed(_LONG_REFERENCE.sub(r"&#\1", html))  # longer numbers are no code points, and no integers to Python
        self.close()
        self.flush()
        return self

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment without an end runs to the end of the page."""
        end = _COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """Declarations that the parser refuses end at the next ``>``."""
        text = self.rawdata
        if text.startswith("<![", i):
            close = -1
            if text.startswith("<![CDATA[", i) and not self.no_close:
                close = text.find("]]>", i)
                self.no_close = close < 0
            return close + 3 if close >= 0 else text.index(">", i) + 1
        return super().parse_html_declaration(i)

    def flush(self) -> None:
        if self.bits:
            text = " ".join("".join(self.bits).split())
            if text:
                self.lines.append((self.stack[-1], text, self.tags, self.links))
            self.bits = []
        self.tags = self.links = 0

    def nearest(self, names: set | frozenset) -> int:
        """Place in the stack of the nearest open element of these names, 0 for none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.at[self.name[self.stack.pop()]].pop()
            if self.solid[-1] == len(self.stack):
                self.solid.pop()

    def close_to(self, names: set | frozenset, bounds: set | frozenset) -> None:
        """Ends the nearest open element of these names, unless one of the bounds is nearer."""
        place = self.nearest(names)
        if place and place > self.nearest(bounds - names):
            self.pop_to(place)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        inline = tag in INLINE
        if not inline:
            self.flush()
        elif tag == "br":
            self.bits.append(" ")
        self.tags += 1
        if tag in VOID or tag in ("html", "body"):
            return
        if not inline:
            if tag in CLOSES_P and self.at.get("p"):
                self.close_to({"p"}, {"table", "td", "button", "div", "section", "article"})
            if tag in SIBLING:
                self.close_to(*SIBLING[tag])
            if tag in ("article", "main"):  # a menu that was never closed
                self.close_to({"nav"}, frozenset())
        sure, hint, role, hidden = False, False, None, False
        for key, value in attrs:
            if key in ("class", "id") and value and tag not in HEADINGS:
                sure = sure or _marks(value, TALK if tag in ("article", "main") else WIDGETS)
                hint = hint or (tag not in ("article", "main") and _marks(value, HINTS))
            elif key == "role":
                role = (value or "").lower()
            elif key == "hidden" or (key == "style" and value and re.search(r"display\s*:\s*none", value, re.I)):
                hidden = True
        up = self.stack[-1]
        self.parent.append(up)
        self.name.append(tag)
        self.unseen.append(self.unseen[up] or tag in UNSEEN or hidden)
        self.hard.append(self.hard[up] or self.unseen[-1] or tag in FRAME or role in ROLES)
        self.sure.append(sure)
        self.hint.append(hint)
        if not inline:
            self.solid.append(len(self.stack))
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.name) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "body"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        place = self.nearest({tag})
        if place and (tag not in INLINE or place > self.solid[-1]):  # the end of an inline element does not end blocks
            self.pop_to(place)

    def handle_data(self, data: str) -> None:
        self.bits.append(data)
        if self.at.get("a"):
            self.links += len(data)


def _ratios(lines: list[tuple[int, str, int, int]]) -> np.ndarray:
    """Text-to-tag ratio of each line, smoothed over its neighbours."""
    ratio = np.array([len(t) / max(1, n - TAGS_FREE) for _, t, n, _ in lines], float)
    radius = int(3 * SIGMA)
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * SIGMA**2))
    wide = np.convolve(np.pad(ratio, radius), kernel, "valid")
    return wide / np.convolve(np.pad(np.ones(len(ratio)), radius), kernel, "valid")


def _upper(smooth: np.ndarray) -> np.ndarray:
    """Which values are above the threshold between two clusters: half-way between their means, moved until it rests."""
    cut = float(smooth.mean())
    for _ in range(50):
        low, high = smooth[smooth <= cut], smooth[smooth > cut]
        if not len(low) or not len(high):
            return np.ones(len(smooth), bool)
        new = (low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = float(new)
    return smooth > cut


def _sums(values: list[int], parent: list[int]) -> list[int]:
    """Of each element the sum over itself and all below it; elements come after their parents."""
    out = list(values)
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


def _region(page: Page, mass: list[int], text: list[int], title: list[int]) -> int:
    """The element that holds the content: down from the page to what has nearly all of the upper cluster's text.

    ``mass``: text of the upper cluster, ``text``: all text, ``title``: headings, each with all below.  An article
    or main element that holds most of the mass is gone to at once, and left only for another one inside it.
    """
    name, parent, n = page.name, page.parent, len(page.name)
    named = [i for i in range(1, n) if name[i] in ("article", "main") and mass[i]]
    top = max(named, key=lambda i: (mass[i], -text[i], i), default=None)
    if top is not None and 2 * mass[top] >= mass[0]:
        up = parent[top]
        while up > 0:  # a wider one that has the title too
            if name[up] in ("article", "main") and mass[top] >= MOST * mass[up] and title[up] > title[top] and not title[top]:
                top = up
            up = parent[up]
        return top
    root, children = 0, {}
    for i in range(1, n):
        if text[i]:
            children.setdefault(parent[i], []).append(i)
    while children.get(root):
        best = max(children[root], key=lambda i: (mass[i], text[i], -i))
        own = text[root] - sum(text[i] for i in children[root])
        headed = title[best] and title[best] == title[root]
        if mass[best] < (MOST_HEADED if headed else MOST) * mass[root] or title[root] > title[best] or own or name[best] in LEAVES:
            break
        root = best
    return root


def blocks(html: str) -> list[str]:
    """The text blocks of a page's article, in page order."""
    page = Page().read(html)
    parent, name, n = page.parent, page.name, len(page.parent)
    lines = [x for x in page.lines if not page.unseen[x[0]]]
    if not lines:
        return []
    upper = _upper(_ratios(lines)).tolist()
    holds = [t in ("article", "main", "h1") for t in name]
    good, heads = [0] * n, [0] * n  # text of the upper cluster that is no link; headings with text
    for (e, t, _, links), high in zip(lines, upper, strict=True):
        if high and 2 * links <= len(t):
            good[e] += len(t)
        heads[e] += name[e] in HEADINGS
    below, headed = _sums(good, parent), _sums(heads, parent)
    for i in range(n - 1, 0, -1):
        if holds[i]:
            holds[parent[i]] = True
    out = [False] * n
    for i in range(1, n):  # a class or id says nothing of an element that holds an article or its title
        frames = holds[i] and name[i] not in ("article", "main")
        marked = page.sure[i] or (page.hint[i] and not (headed[i] and below[i]))
        out[i] = out[parent[i]] or page.hard[i] or (marked and not frames)
    mass, text = [0] * n, [0] * n
    for e, t, _, _ in lines:
        if not out[e]:
            text[e] += len(t)
    mass = _sums([0 if out[i] else good[i] for i in range(n)], parent)
    title = _sums([0 if out[i] else heads[i] for i in range(n)], parent)
    root = _region(page, mass, _sums(text, parent), title)
    within = [False] * n
    within[root] = True
    for i in range(1, n):
        within[i] = within[i] or within[parent[i]]
    kept = [k for k, x in enumerate(lines) if within[x[0]] and not out[x[0]]]
    dense = [k for k in kept if upper[k] and 2 * lines[k][3] <= len(lines[k][1])]
    first, last = (dense[0], dense[-1]) if dense else (0, len(lines))
    # links in a list are a menu, unless they stand amid the text or in an article
    menu = {"li", "ul", "ol", "td", "div"} if name[root] not in ("article", "main") else frozenset()
    return [lines[k][1] for k in kept if first < k < last or not (2 * lines[k][3] > len(lines[k][1]) and name[lines[k][0]] in menu)]


def main_text(html: str | None) -> str:
    """The article of a page as one text: its blocks joined by one space; empty for null or no article."""
    return " ".join(blocks(html)) if html else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` with ``text`` and ``n_chars`` (code points) from the whole html.

    Null and empty pages give an empty text.  Malformed markup never fails: a
    declaration the parser refuses ends at the next ``>``, an unfinished comment
    or tag runs to the end.  Time and memory are linear in a page, and pages of
    any length are read whole.  Pages are read one by one, so repeats and empty
    tables need no rule; columns of the same names are replaced.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    place = pages.columns.index(html_col)  # the html goes to the workers once, inside its row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(0).field(place)
            texts = [main_text(html[i].as_py()) for i in range(len(html))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return unpacked(rows.mapInArrow(run, schema), text="text", n_chars="n_chars")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
