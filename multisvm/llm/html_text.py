"""Main text of web pages from parser events, by text-to-tag ratios.

The standard library's HTML parser is fed in chunks. Its events become lines,
one a block of text (whatever a block-level tag sets apart), each with its
characters, the characters inside links, the tags met while it was open and the
elements it stands in. Then

1. lines inside scripts, styles, forms, menus, page headers and footers and
   sidebars (by tag) or hidden elements are furniture;
2. a line's ratio is its text outside links over its tags; ratios are smoothed
   with a Gaussian over neighbouring lines, and lines above a threshold between
   the two clusters of ratios (two means) are content;
3. an element whose role, class or id names furniture (a notice, an advert,
   reader comments, ...) is furniture too, unless most content lines stand in it.
   A class or id counts if it is made of such words and of words of layout alone:
   "related-posts" does, "related-work" does not;
4. the region is the lowest element around all content lines, all article
   elements and the heading before them (an article around it is taken whole);
   where the page has a main element with text, it is every main and article;
5. inside the region, blocks of three lines and more that are links and nothing
   else, at most half of them content by their smoothed ratios, are menus and go;
6. every other line of the region that is not furniture is kept, short ones too.

Defined cases: null or empty html gives an empty text; a page without
any text outside furniture gives an empty text; unclosed, stray and nested
tags are tolerated; unknown declarations and sections are comments; a comment
or a tag that the page does not close reaches to its end, as in browsers; ratios
of about one size fall in one cluster; repeated rows are extracted row by row;
other columns pass through; an empty table gives an empty result. A very long
page is parsed in chunks, in time linear in its size.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multisvm.llm.common import workers

CHUNK = 1 << 16
# Element names by their part in a page (fixed values of the HTML standard).
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title svg math iframe object canvas audio video map".split())
FORMS = set("form button select textarea input fieldset option datalist".split())
ASIDE = set("nav menu aside footer header dialog".split())
BODY = set("html body".split())
# What closes by itself when another of its kind opens (end tags may be left out).
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "p": {"p"},
}
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | INLINE | set("p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th figure figcaption hgroup address".split())
LIMITS = set("ul ol dl table div section article main aside nav footer header form body td th select".split())
# Words of class names, ids and roles that name furniture (fixed values).
FURNITURE = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead banner footer colophon sidebar "
    "aside complementary contentinfo widget widgets ad ads advert adverts advertisement advertising adsense sponsor sponsored "
    "promo promotion promoted notice notices notification alert alertdialog cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login search searchbox share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond replies reply form toolbar tooltip skip copyright".split()
)
# Words of layout that may stand beside them in a name (fixed values).
LAYOUT = set(
    "area article articles bar bars block blocks bottom box boxes btn button buttons card cards col column container content "
    "desktop el element fixed foot global group head holder icon icons id inline inner item items js label large layout left "
    "line link links list main mobile module nd page pages panel post posts primary region right row secondary section sections "
    "site slot small st sticky story stories tablet th title top unit units view wrap wrapper zone".split()
)
HEADER = set("header masthead banner".split())
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_OPEN = re.compile(r"<[A-Za-z/!?]")


class _Events(HTMLParser):
    """Lines and elements of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # per element: parent, name, flag (0 none, 1 by class or id, 2 by tag, 3 a header by class or id)
        self.parent, self.name, self.flag = [-1], ["#"], [0]
        self.open = [0]
        self.opened: Counter[str] = Counter()  # names of open elements
        self.hidden = 0
        # per line: text, characters in links, tags, element
        self.lines: list[tuple[str, int, int, int]] = []
        self._text: list[str] = []
        self._linked, self._tags, self._links = 0, 0, 0

    def _cut(self) -> None:
        if self._text:
            text = _SPACE.sub(" ", "".join(self._text)).strip()
            if text:
                self.lines.append((text, self._linked, self._tags, self.open[-1]))
                self._tags = 0
            self._text, self._linked = [], 0

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag in INLINE:
            if tag == "a":
                self._links += 1
            elif tag == "br":
                self._text.append(" ")
            if not attrs or tag in VOID:
                return
            # a named inline element can be furniture, and is then a block of its own
            if not _named(tag, attrs):
                return
        self._cut()
        if tag in VOID:
            return
        if tag in ENDS_PARAGRAPH:
            self._close({"p"})
        if tag in CLOSES:
            self._close(CLOSES[tag])
        flag = 2 if tag in HIDDEN or tag in FORMS or tag in ASIDE else _named(tag, attrs) if attrs and tag not in BODY else 0
        self.parent.append(self.open[-1])
        self.name.append(tag)
        self.flag.append(flag)
        self.open.append(len(self.name) - 1)
        self.opened[tag] += 1
        self.hidden += tag in HIDDEN

    def _close(self, names: set[str]) -> None:
        """Closes the innermost open element of the names, not past a limit."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.name[self.open[k]]
            if tag in names:
                self._leave(k)
                return
            if tag in LIMITS:
                return

    def _leave(self, k: int) -> None:
        self._cut()
        for e in self.open[k:]:
            self.hidden -= self.name[e] in HIDDEN
            self.opened[self.name[e]] -= 1
        del self.open[k:]

    def handle_endtag(self, tag):
        self._tags += 1
        if tag == "a":
            self._links = max(0, self._links - 1)
        if tag in VOID:
            return
        if tag in INLINE:
            if self.name[self.open[-1]] == tag:
                self._leave(len(self.open) - 1)
            return
        self._cut()
        if not self.opened[tag]:
            return  # a stray end tag
        for k in range(len(self.open) - 1, 0, -1):
            if self.name[self.open[k]] == tag:
                self._leave(k)
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.hidden:
            self._text.append(data)
            if self._links:
                self._linked += len(data)

    def parse_marked_section(self, i, report=1):
        """Sections are comments: to "]]>" if it is one of character data, else
        to the next ">"."""
        if self.rawdata.startswith("<![CDATA[", i):
            end = self.rawdata.find("]]>", i)
            if end >= 0:
                return end + 3
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def finish(self) -> None:
        if _OPEN.match(self.rawdata):  # an unfinished comment, declaration or tag
            self.rawdata = ""
        self.close()
        self._cut()


def _names(value: str) -> set[str]:
    """The furniture that a class, id or role names: words of those tokens that
    consist of such words and words of layout."""
    found = set()
    for token in value.split():
        words = {word.lower() for word in _NAME.findall(token)}
        if words <= FURNITURE | LAYOUT:
            found |= words & FURNITURE
    return found


def _named(tag: str, attrs) -> int:
    """Do the class, id or role of an element call it furniture? 1 if so, 3 if
    only a header, 0 if not; 2 if it is hidden. (A heading is furniture only
    with what it stands in.)"""
    if tag in HEADINGS:
        return 0
    found = 0
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return 2
        if value and key in ("class", "id", "role"):
            words = _names(value)
            if words - HEADER:
                found = 1
            elif words:
                found = found or 3
    return found


def smoothed(values: np.ndarray, sigma: float = 1.0, reach: int = 2) -> np.ndarray:
    """Gaussian mean over the neighbouring lines that exist."""
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach:-reach]
    return np.convolve(values, kernel)[reach:-reach] / weight


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Lines above the middle of two means of the (logarithmic) ratios; means
    within a factor of two are one cluster (two means part any values)."""
    x = np.log1p(ratios)
    low, high = x.min(), x.max()
    if high - low < 1e-9:
        return np.ones(len(x), bool)
    for _ in range(30):
        middle = (low + high) / 2
        above = x > middle
        if not above.any() or above.all():
            break
        new = x[~above].mean(), x[above].mean()
        if new == (low, high):
            break
        low, high = new
    return x > (low + high) / 2 if high - low > np.log(2) else np.ones(len(x), bool)


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    page = _Events()
    for at in range(0, len(html), CHUNK):
        page.feed(html[at:at + CHUNK])
    page.finish()
    if not page.lines:
        return ""
    n, parent, name = len(page.name), page.parent, page.name
    # lines outside of what tags make furniture, and the content among them;
    # a header inside an article is its heading
    inside, tagged = [False] * n, [False] * n
    for e in range(1, n):
        p = parent[e]
        inside[e] = inside[p] or name[e] in ("article", "main")
        tagged[e] = tagged[p] or page.flag[e] == 2 and not (name[e] == "header" and inside[p])
    lines = [x for x in page.lines if not tagged[x[3]]]
    if not lines:
        return ""
    ratios = np.array([max(0, len(t) - linked) / max(1, tags) for t, linked, tags, _ in lines])
    content = content_lines(smoothed(ratios))
    # what most of them stand in is not furniture by its name
    held = [0] * n
    for x, good in zip(lines, content):
        held[x[3]] += int(good)
    for e in range(n - 1, 0, -1):
        held[parent[e]] += held[e]
    frames = [e for e in range(n) if name[e] in ("article", "main") and page.flag[e] == 0]
    holds = [False] * n
    _mark(frames, parent, holds)
    in_article = [False] * n
    furniture = [False] * n
    for e in range(1, n):
        p = parent[e]
        in_article[e] = in_article[p] or (holds[e] and name[e] in ("article", "main"))
        flag = 0 if page.flag[e] == 2 and not tagged[e] else page.flag[e]
        if in_article[p] and (flag == 3 or holds[e] and flag == 1):
            flag = 0  # an article's own heading, or what holds an article inside it
        furniture[e] = furniture[p] or flag == 2 or flag in (1, 3) and 2 * held[e] <= held[0]
    content = [good for x, good in zip(lines, content) if not furniture[x[3]]]
    lines = [x for x in lines if not furniture[x[3]]]
    if not lines:
        return ""
    if not any(content):
        content = [True] * len(lines)
    worded = [False] * n  # elements with a line
    _mark([x[3] for x in lines], parent, worded)
    frames = [e for e in frames if not furniture[e] and worded[e]]
    if any(name[e] == "main" for e in frames):
        roots = set(frames)
    else:
        under = [0] * n  # 2 in a main heading, 1 in another
        for e in range(1, n):
            under[e] = under[parent[e]] or (2 if name[e] == "h1" else int(name[e] in HEADINGS))
        heads = [x[3] for x in lines[: content.index(True)] if under[x[3]]]
        titles = [e for e in heads if under[e] == 2] or heads[-1:]
        roots = {_region([x[3] for x, good in zip(lines, content) if good] + frames + titles, name, parent)}
    kept = [False] * n
    for e in range(n):
        kept[e] = e in roots or e > 0 and kept[parent[e]]
    menu = _menus(lines, content, parent, name)
    return "\n\n".join(x[0] for x in lines if kept[x[3]] and not menu[x[3]])


def _menus(lines: list, content: list[bool], parent: list[int], name: list[str]) -> list[bool]:
    """Elements inside blocks of three lines and more that are all links and at
    most half of them content (text beside a menu raises its outer lines)."""
    n = len(parent)
    count, good, plain = [0] * n, [0] * n, [False] * n
    for (text, linked, _, e), high in zip(lines, content):
        count[e] += 1
        good[e] += int(high)
        plain[e] = plain[e] or linked < 0.9 * len(text)
    for e in range(n - 1, 0, -1):
        count[parent[e]] += count[e]
        good[parent[e]] += good[e]
        plain[parent[e]] = plain[parent[e]] or plain[e]
    menu = [False] * n
    for e in range(1, n):
        menu[e] = menu[parent[e]] or count[e] >= 3 and not plain[e] and 2 * good[e] <= count[e] and name[e] not in BODY
    return menu


def _mark(elements: list[int], parent: list[int], marks: list[bool]) -> None:
    """Marks the elements and all they stand in."""
    for e in elements:
        while e >= 0 and not marks[e]:
            marks[e] = True
            e = parent[e]


def _region(elements: list[int], name: list[str], parent: list[int]) -> int:
    """The lowest element around all the given ones that is more than a text
    block; an article around it is taken whole."""
    held = [0] * len(parent)
    for e in elements:
        held[e] += 1
    for e in range(len(parent) - 1, 0, -1):
        held[parent[e]] += held[e]
    root = max(e for e in range(len(parent)) if held[e] == len(elements))
    while root > 0 and name[root] in BLOCKS:
        root = parent[root]
    e = root
    while e > 0:
        root = e if name[e] == "article" else root
        e = parent[e]
    return root


def extract_text(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """The input plus ``out``, the main text of each page (an input column of
    that name is replaced)."""
    workers(df.sparkSession)
    carried = [c for c in df.columns if c != out]

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                texts = [main_text(t.as_py()) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(texts, pa.string())], names=["_rest", "_out"])

    given = df.select(F.col(f"`{html_col}`").cast("string").alias("_html"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_rest"))
    done = given.mapInArrow(run, f"_rest {given.schema['_rest'].dataType.simpleString()}, _out string")
    return done.select(*[F.col(f"_rest.`{c}`").alias(c) for c in carried], F.col("_out").alias(out))
