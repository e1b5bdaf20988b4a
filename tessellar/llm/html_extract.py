"""Main text of web pages from parser events and the text-to-tag ratio.

The standard library's parser gives events; they give lines (the text between
two block boundaries) with the number of tags met in each and the block element
they stand in. What the markup marks for certain as something else (menus,
sidebars, notices, adverts, forms, comments) is out. Of the rest the lines'
text-to-tag ratios, links not counted, are smoothed with a Gaussian and split in
two clusters on a logarithmic scale, content and the rest, or are one cluster
where two would say little more.

Where the markup names an article, it is the text, and the ratio only decides on
blocks whose marks are in doubt. Elsewhere the text are the content lines, what
lies between them, and what stands in the same element as they do. Marks that
leave nothing are passed over, those over most text first; adverts and comments
never.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no text of the page.
UNSEEN = frozenset("audio button canvas datalist embed head iframe input label legend map math noscript object optgroup option script select style svg template textarea title video".split())
#: Elements and roles of what stands around an article.
AROUND = frozenset("aside dialog footer header menu nav".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that speak for boilerplate.
MARKS = tuple("ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related replies respond share sharing sidebar sidenav skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget".split())
#: Readers' comments, on any block.
COMMENTS = frozenset("comment commentlist comments".split())
#: What inline elements and an article's own element may be dropped for.
ADVERTS = frozenset("adsbygoogle advert adverts advertisement".split())
#: Words that say what a part of a layout is: with a mark in one name they leave it whole ("site-footer"), others make it a name of its own ("related-work").
LAYOUT = frozenset("area bar block bottom box buttons column container content global group holder icons inner item items left links list main outer page panel popup posts primary right row secondary section site slot top user wrap wrapper".split())
#: Words that make a class say something of a page's state, not of what the element is (has-sidebar, comments-open).
STATES = frozenset("closed disabled enabled has hide is no open show with without".split())
ARTICLES = frozenset("article main".split())
ARTICLE_MARKS = frozenset("article content entry main maincontent post story".split())
#: An open element that a new one of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such closing doesn't reach beyond.
SCOPES = frozenset("article aside body blockquote div dl footer form header main nav ol section table tbody ul".split())
#: Blocks that an id marks; on others (sections, headings) it is an anchor's name.
NAMED = frozenset("div dl ol table td ul".split())

#: What an element's own name or role says; the factor of ratios under marks in doubt, and in an article.
PLAIN, AROUND_IT, FORM = 0, 1, 2
PARTLY, ARTICLE = 0.5, 3.0
#: Elements whose lines belong to the text of the element around them.
PROSE = frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol pre section table tbody td th tr ul".split())
#: Two clusters of ratios tell more than one if they explain this share of the variance and differ by this factor.
EXPLAINED, APART = 0.8, 3.0

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_JOINTS = re.compile(r"[-_:]+")
_BIT = {word: 1 << k for k, word in enumerate((*MARKS, *sorted(COMMENTS)))}
_COMMENT = sum(_BIT[word] for word in COMMENTS)
_ADVERT = sum(_BIT[word] for word in ADVERTS)


@lru_cache(4096)
def marks_of(names: str) -> tuple[int, int, bool]:
    """What classes or an id say: marks that a whole name stands for, marks that are part of a name, and whether it is an article's."""
    whole = partly = 0
    article = False
    for name in names.split():
        parts = _JOINTS.sub(" ", _CAMEL.sub(" ", name)).lower().split()
        joined = "".join(parts)
        found = sum({_BIT[w] for w in (*parts, joined) if w in _BIT})
        if len(parts) > 1 and STATES.intersection(parts):
            continue
        if found and (joined in _BIT or all(w in _BIT or w in LAYOUT or w.isdigit() for w in parts)):
            whole |= found
        else:
            partly |= found
        article = article or not found and bool(ARTICLE_MARKS.intersection((*parts, joined)))
    return whole, partly, article


class _Lines(HTMLParser):
    """Lines of a page, and its block elements as nodes with their parent. Every event takes constant time but for what it closes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # name, unseen here or above, node
        self.places: dict[str, list[int]] = {}  # of each open name its places in the stack
        self.scopes: list[int] = []
        self.blocks: list[int] = []
        # parent, marks of whole names, of parts, what the element itself says, article, its name
        self.nodes: list[tuple[int, int, int, int, bool, str]] = [(-1, 0, 0, PLAIN, False, "")]
        self.lines: list[tuple[str, int, int, int, bool]] = []  # text, tags, node, linked, heading
        self.text: list[str] = []
        self.tags, self.linked, self.heading = 1, 0, False

    def _state(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0)

    def _line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self._state()[1], min(self.linked, len(text)), self.heading))
            self.text, self.linked = [], 0
        self.tags, self.heading = 1, False

    def _push(self, tag: str, unseen: bool, node: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, unseen, node))
        self.places.setdefault(tag, []).append(at)
        if tag in SCOPES:
            self.scopes.append(at)
        if tag not in INLINE:
            self.blocks.append(at)

    def _cut(self, at: int) -> None:
        for tag, _, _ in self.stack[at:]:
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            if tag not in INLINE:
                self.blocks.pop()
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
            self.tags += 1
            return
        if tag not in INLINE:
            self._line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES:
            scope = self.scopes[-1] if self.scopes else -1
            open_ = max((self.places[k][-1] for k in CLOSES[tag] if self.places.get(k)), default=-1)
            if open_ > scope:
                self._cut(open_)
        unseen, node = self._state()
        if tag == "body":
            unseen = False
        given = {k: (v or "") for k, v in attrs}
        if not unseen and tag not in ("html", "body"):
            unseen = tag in UNSEEN or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        if not unseen and tag not in ("html", "body", "p", "br"):
            whole, partly, article = marks_of(given.get("class", ""))
            by_id = marks_of(given.get("id", ""))
            role = given.get("role", "").lower()
            if tag in INLINE:
                unseen = bool(whole & _ADVERT)
            elif not (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()):
                if tag in NAMED:
                    whole, partly, article = whole | by_id[0], partly | by_id[1], article or by_id[2]
                else:
                    whole |= by_id[0] & _COMMENT
                main = tag in ARTICLES or role in ("main", "article")
                if main:  # only comments and adverts undo that
                    whole, partly = whole & (_COMMENT | _ADVERT), 0
                own = AROUND_IT if tag in AROUND or role in ROLES else FORM if tag in ("form", "fieldset") else PLAIN
                named = main or (article and tag in ("div", "section", "td"))
                self.nodes.append((node, whole, partly, own, named and not whole and own == PLAIN, tag))
                node = len(self.nodes) - 1
            else:
                self.heading = True
        self._push(tag, unseen, node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._line()
        self.tags += 1
        at = self.places.get(tag)
        if at and (tag not in INLINE or not self.blocks or at[-1] > self.blocks[-1]):
            self._cut(at[-1])

    def handle_data(self, data):
        if self._state()[0]:
            return
        self.text.append(data)
        if self.places.get("a"):
            self.linked += len(data.strip())

    def parse_marked_section(self, i, report=1):
        """Any ``<![...]>`` is passed over, whatever its keyword; a CDATA section to its own end if it has one."""
        end = self.rawdata.find("]]>", i) + 2 if self.rawdata.startswith("<![CDATA[", i) else 1
        end = end if end > 1 else self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def unknown_decl(self, data):
        pass


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is what lies inside."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    size = len(x)
    return (np.convolve(x, kernel)[reach : reach + size]) / np.convolve(np.ones(size), kernel)[reach : reach + size]


def threshold(x: np.ndarray) -> float:
    """The border between two clusters (two means, from the extremes); below all of them where one cluster does as well."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        upper = x > (low + high) / 2
        if not upper.any() or upper.all():
            return -np.inf
        new = float(x[~upper].mean()), float(x[upper].mean())
        if new == (low, high):
            break
        low, high = new
    share = upper.mean()
    between = share * (1 - share) * (high - low) ** 2
    if high - low < np.log(APART) or between < EXPLAINED * x.var():
        return -np.inf
    return (low + high) / 2


class _Marks:
    """What the markup says of every node, with all above it."""

    def __init__(self, parser: _Lines):
        self.nodes = parser.nodes
        self.lines = parser.lines
        n = len(self.nodes)
        self.void, self.void_forms = 0, False
        self.whole, self.partly, self.article = [0] * n, [0] * n, [False] * n
        for k, (up, whole, partly, _, article, _) in enumerate(self.nodes):
            above = k > 0
            self.whole[k] = whole | (self.whole[up] if above else 0)
            self.partly[k] = partly | (self.partly[up] if above else 0)
            self.article[k] = article or (above and self.article[up])
        self._mark()

    def _mark(self) -> None:
        said = ~self.void
        self.out, self.doubt = [False] * len(self.nodes), [False] * len(self.nodes)
        for k, (up, whole, partly, own, _, _) in enumerate(self.nodes):
            certain = whole & said or (own == FORM and not self.void_forms) or own == AROUND_IT
            self.out[k] = bool(certain) or (k > 0 and self.out[up])
            self.doubt[k] = bool(partly & said)

    def left(self) -> np.ndarray:
        """Lines that aren't out and aren't mostly links."""
        return np.array([not self.out[x[2]] and 2 * x[3] < len(x[0]) for x in self.lines])

    def _covering(self, lines: list) -> int:
        """The mark over most text of ``lines``, but for adverts and comments."""
        under: Counter = Counter()
        for text, _, node, _, _ in lines:
            under[self.whole[node] & ~self.void & ~_COMMENT & ~_ADVERT] += len(text)
        sums = {bit: sum(n for marks, n in under.items() if marks & bit) for bit in _BIT.values()}
        best = max(sums, key=sums.get)
        return best if sums[best] else 0

    def settle(self) -> None:
        """Pass over marks until something is left: those of forms, then names over most text. What elements say (aside, nav) stands."""
        articles = [x for x in self.lines if self.article[x[2]]]
        if articles and all(self.out[x[2]] for x in articles):
            # classes over the only articles, which have more text than all that is unmarked
            rest = sum(len(x[0]) for x, k in zip(self.lines, self.left(), strict=True) if k)
            if sum(len(x[0]) for x in articles) > rest:
                bits = 0
                for x in articles:
                    bits |= self.whole[x[2]]
                self.void |= bits & ~_COMMENT & ~_ADVERT
                self._mark()
        while not self.left().any():
            bit = self._covering(self.lines)
            if not self.void_forms and any(own == FORM for _, _, _, own, _, _ in self.nodes):
                self.void_forms = True
            elif bit:
                self.void |= bit
            else:
                return
            self._mark()


def _ended(html: str) -> str:
    """The page with tags and comments that never end as text: the parser would look for their ends again and again."""
    comment = html.rfind("-->") + 1
    html = html[:comment] + html[comment:].replace("<!--", "&lt;!--")
    tag = html.rfind(">") + 1
    return html[:tag] + html[tag:].replace("<", "&lt;")


def _regions(marks: _Marks) -> list[bool] | None:
    """Of every node whether it lies in a named article that isn't out; none if there is no such article with text."""
    inside = [False] * len(marks.nodes)
    for k, (up, _, _, _, article, _) in enumerate(marks.nodes):
        inside[k] = not marks.out[k] and (article or (k > 0 and inside[up]))
    return inside if any(inside[x[2]] for x in marks.lines) else None


def main_text(html: str, scores=None) -> str:
    """The article's text; empty if the page has none. ``scores`` may stand in for the smoothed ratio of the lines."""
    parser = _Lines()
    parser.feed(_ended(html))
    parser.close()
    parser._line()
    lines, nodes = parser.lines, parser.nodes
    if not lines:
        return ""
    marks = _Marks(parser)
    marks.settle()
    left = marks.left()
    inside = _regions(marks)
    if not left.any() and inside is None:
        return ""
    at = np.array([x[2] for x in lines])
    sizes = np.array([len(x[0]) for x in lines], float)
    linked = np.array([x[3] for x in lines], float)
    own = (sizes - 0.9 * linked) / np.array([x[1] for x in lines], float)
    ratio = smooth(own) if scores is None else scores(lines)
    own = own if scores is None else ratio
    factor = np.array([(ARTICLE if marks.article[k] else 1.0) * (PARTLY if marks.doubt[k] else 1.0) for k in at])
    score, alone = np.log1p(ratio * factor), np.log1p(own * factor)
    border = threshold(score[left]) if left.any() else 0.0
    # smoothing lifts what stands next to content, so a line's own ratio counts too
    content = left & (score >= border) & (alone >= border)
    # blocks whose marks are in doubt stay out unless most of their text is content
    every, votes = np.zeros(len(nodes)), np.zeros(len(nodes))
    np.add.at(every, at, sizes)
    np.add.at(votes, at, sizes * content)
    for k in range(len(nodes) - 1, 0, -1):
        every[nodes[k][0]] += every[k]
        votes[nodes[k][0]] += votes[k]
    doubtful = [False] * len(nodes)
    for k in range(1, len(nodes)):
        doubtful[k] = doubtful[nodes[k][0]] or (marks.doubt[k] and 2 * votes[k] < every[k])
    free = np.array([not marks.out[k] and not doubtful[k] for k in at])
    if inside is not None:
        keep = free & np.array([inside[k] for k in at])
    else:
        held = np.flatnonzero(content & free)
        if not len(held):
            return ""
        homes = {int(at[k]) for k in held}
        for k in list(homes):
            while nodes[k][5] == "section":
                k = nodes[k][0]
                homes.add(k)
        home = [False] * len(nodes)
        for k in range(len(nodes)):
            home[k] = k in homes or (k > 0 and nodes[k][5] in PROSE and home[nodes[k][0]])
        between = np.zeros(len(lines), bool)
        between[held[0] : held[-1] + 1] = True
        keep = free & (content | (left & (between | np.array([home[k] for k in at]))))
        # headings right before the text
        first = int(np.flatnonzero(keep)[0])
        while first and free[first - 1] and lines[first - 1][4]:
            first -= 1
            keep[first] = True
    return " ".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x.as_py() or "") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``, in one pass without a shuffle.

    Null, empty or text-free pages give an empty text; repeated rows, null ids
    and null urls are kept as they are. An empty table gives an empty result;
    other columns are not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_run, "page_id bigint, url string, text string, n_chars bigint")
