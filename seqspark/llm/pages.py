"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import replace_columns

WINDOW = 3  # lines whose lengths are summed
SURGE = 60  # characters of a window from which text begins

# Element names of HTML by their role, and words of class, id and role attributes.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set(
    "button canvas datalist embed head iframe input map noscript object script select style svg template textarea title".split()
)
UNREAD = set("aside dialog footer form header menu nav search".split())
CONTAINERS = {"article", "main"}
WORDS = set(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments comentarios "
    "adsbygoogle consent cookie cookies disqus footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices "
    "notification popup promo promoted promotion recommended related respond share sharing sidebar sidebars social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
# of these, words that layouts also put on the element around a whole page
LAYOUT = set("banner hidden masthead menu modal nav navbar navigation popup sidebar sidebars toolbar widget widgets".split())
# parts of a name that leave its meaning to the other parts: site-footer is a footer, has-sidebar is not a sidebar
PLACES = set(
    "area bar block bottom box button buttons col column container content global header holder icon icons inner item items left links list main mobile "
    "module page panel post posts primary right secondary section sec site slot small sub the top unit wrap wrapper".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# blocks that hold a piece of a text, never the whole of it, and of these the ones that stand for themselves
PIECES = HEADINGS | set("blockquote caption dd dl dt figcaption figure li menu ol p pre table tbody td tfoot th thead tr ul".split())
FLAT = HEADINGS | {"p", "pre", "blockquote"}
PAGE = {"", "html", "body"}
# elements that end where a like one begins, within one of these parents
ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}


@dataclass
class Line:
    text: str
    links: int  # characters inside links
    container: int  # number of the article or main element around it; 0: none
    mark: int = 0  # number of the innermost marked element around it; 0: none
    block: int = 0  # number of the block it is a line of
    heading: bool = False

    @property
    def weight(self) -> int:
        return max(0, len(self.text) - self.links)


@dataclass
class Mark:
    """An element that is left unread unless it turns out to hold the page."""

    above: int  # the marked element around it; 0: none
    kind: str  # layout, remark (comments, adverts, footers), header (below the page's own blocks) or hidden
    container: int


@dataclass
class Block:
    above: int  # the block around it
    tag: str
    names: str  # its class


def marked_name(token: str) -> set[str]:
    """The words of a class or id that name what the element is: all its parts are words or places."""
    parts = set(token.replace("_", "-").split("-")) - {""}
    own = parts & WORDS
    return own if own and all(x in WORDS or x in PLACES or x.isdigit() for x in parts) else set()


class Stripper(HTMLParser):
    """Markup to lines: one per block with text.

    Whether a marked element is unread is decided by ``read_lines`` when the whole page is known.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int, int]] = []  # name, mark (-1: never read), container, block
        self.blocks: list[Block] = [Block(0, "", "")]
        self.parts: list[str] = []
        self.marks: list[Mark | None] = [None]
        self.containers: list[tuple[str, int]] = [("", 0)]  # name, mark
        self.links = 0

    def state(self) -> tuple[int, int]:
        return self.open[-1][1:3] if self.open else (0, 0)

    def block(self) -> int:
        return self.open[-1][3] if self.open else 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            mark, inside = self.state()
            block = self.block()
            around = {self.blocks[block].tag, self.blocks[self.blocks[block].above].tag}
            self.lines.append(Line(text, self.links, inside, mark, block, bool(around & HEADINGS)))
        self.parts, self.links = [], 0

    def kind(self, tag: str, attrs: list) -> str:
        """How an element is marked; empty if it is read."""
        values = {k: (v or "").lower() for k, v in attrs}
        inside = self.state()[1]
        if tag in NEVER:
            return "never"
        if "hidden" in values or values.get("aria-hidden") == "true":
            return "hidden"
        if tag in UNREAD and (tag != "header" or not inside):
            named = any(map(marked_name, f"{values.get('class', '')} {values.get('id', '')}".split())) or values.get("role") in ROLES
            if tag == "header" and not named and any(x[0] in BLOCKS and x[0] not in PAGE for x in self.open):
                return "header"
            return "layout" if tag == "form" else "remark"
        if tag in ("body", "html", "main") or tag == "article" and not inside:
            return ""
        if "display:none" in values.get("style", "").replace(" ", ""):
            return "hidden"
        if values.get("role") in ROLES:
            return "layout" if values["role"] == "form" else "remark"
        names = set().union(*map(marked_name, f"{values.get('class', '')} {values.get('id', '')}".split()))
        return "" if not names else "layout" if names <= LAYOUT else "remark"

    def chain(self, mark: int) -> list[int]:
        """A mark and those around it."""
        out = []
        while mark:
            out.append(mark)
            mark = self.marks[mark].above
        return out

    def titles(self) -> set[int]:
        """Headers inside the page that hold its title: a heading outside links, no menu, and no first heading elsewhere."""
        own = {m: [x for x in self.lines if x.mark == m] for m in range(1, len(self.marks)) if self.marks[m].kind == "header"}
        full = {mark.above for mark in self.marks[1:]}
        found = {
            m
            for m, lines in own.items()
            if m not in full and any(x.heading and x.weight for x in lines) and sum(x.links for x in lines) <= sum(x.weight for x in lines)
        }
        free = any(x.heading and self.blocks[x.block].tag == "h1" and not x.mark for x in self.lines)
        return set() if free else found

    def read_lines(self) -> list[Line]:
        """The lines outside unread elements.

        A marked element is read after all when it holds the page: the main element, or the article of a page that
        has none elsewhere, or the larger share of the characters outside links. Elements named as remarks must leave
        the page without text to count by their share, as comments may be longer than what they are about.
        """
        n = len(self.marks)
        own, mine = [0] * n, [0] * n  # characters below a mark; without those below remarks
        held: list[set[str]] = [set() for _ in range(n)]  # article and main elements with text that begin below it
        for x in self.lines:
            own[x.mark] += x.weight
            mine[x.mark] += x.weight
            if x.container:
                name, mark = self.containers[x.container]
                held[mark].add(name)
        for m in range(n - 1, 0, -1):
            own[self.marks[m].above] += own[m]
            if self.marks[m].kind == "layout":
                mine[self.marks[m].above] += mine[m]
            if not self.marks[m].container:
                held[self.marks[m].above] |= held[m]
        read, seen, titles = {0}, {}, self.titles()
        for m in range(1, n):
            mark = self.marks[m]
            if mark.above not in read:
                continue
            if m in titles:
                read.add(m)
                continue
            place = mark.above, mark.container
            if place not in seen:
                around = {0, *self.chain(mark.above)}
                scope = [x for x in self.lines if x.container == mark.container or not mark.container]
                rest = sum(x.weight for x in scope if x.mark in around)
                layout = {0}
                for k in range(1, n):
                    if k in around or self.marks[k].above in layout and self.marks[k].kind == "layout":
                        layout.add(k)
                total = sum(x.weight for x in scope if x.mark in layout)
                seen[place] = rest, total, any(k in around for _, k in self.containers[1:])
            rest, total, free = seen[place]
            inner = set() if mark.container else held[m]
            if "main" in inner and (mark.kind != "hidden" or not free):
                read.add(m)
            elif inner and not free and rest < (own[m] if mark.kind == "layout" else min(own[m], SURGE)):
                read.add(m)
            elif mark.container or not free:
                if mark.kind == "layout" and 2 * mine[m] > total or mark.kind in ("remark", "header") and rest < SURGE and own[m] >= 10 * SURGE:
                    read.add(m)
        return [x for x in self.lines if x.mark in read]

    def close_until(self, at: int) -> None:
        self.flush()
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
            for i in range(len(self.open) - 1, -1, -1):  # a block ends an open paragraph, an item the item before
                name = self.open[i][0]
                if name == "p" or name == tag and tag in ENDS:
                    self.close_until(i)
                    break
                if name in ENDS.get(tag, ()) or name in BLOCKS and tag not in ENDS:
                    break
        if tag in VOID:
            return
        mark, inside = self.state()
        kind = self.kind(tag, attrs) if mark >= 0 else ""
        if kind:
            self.flush()
            if kind == "never":
                mark = -1
            else:
                self.marks.append(Mark(mark, kind, inside))
                mark = len(self.marks) - 1
        if tag in CONTAINERS and mark >= 0 and not inside:
            self.containers.append((tag, mark))
            inside = len(self.containers) - 1
        block = self.block()
        if tag in BLOCKS:
            self.blocks.append(Block(block, tag, " ".join((dict(attrs).get("class") or "").lower().split())))
            block = len(self.blocks) - 1
        self.open.append((tag, mark, inside, block))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "p" and all(x[0] != "p" for x in self.open):
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS or self.open[i][1] != (self.open[i - 1][1] if i else 0):
                    self.close_until(i)
                elif i == len(self.open) - 1:
                    self.open.pop()
                else:  # an inline element that ends out of order leaves the blocks inside open
                    inner = [x for x in self.open[i + 1 :] if x[0] in BLOCKS]
                    self.open[i:] = self.open[i + 1 :] if inner else []
                break

    def handle_data(self, data):
        if self.state()[0] >= 0:
            self.parts.append(data)
            if any(x[0] == "a" for x in self.open):
                self.links += len(data)


def strip(html: str) -> Stripper:
    parser = Stripper()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def heaviest(weights: list[int]) -> tuple[int, int, int]:
    """Weight, start and end of the heaviest run: from a surge of the line-block distribution to its dive."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    limit = min(SURGE, max(sums, default=0))
    best, i = (0, 0, 0), 0
    while i < len(weights):
        if sums[i] < limit or not weights[i]:
            i += 1
            continue
        j = i
        while j < len(weights) and sums[j] > 0:
            j += 1
        best = max(best, (sum(weights[i:j]), -i, j))
        i = j
    return best[0], -best[1], best[2]


def below(weights: list[int], lines: list[Line], blocks: list[Block]) -> list[int]:
    """The weight of each block's lines, its inner blocks' included (a block's number is above that of the one around it)."""
    out = [0] * len(blocks)
    for x, w in zip(lines, weights):
        out[x.block] += w
    for k in range(len(blocks) - 1, 0, -1):
        out[blocks[k].above] += out[k]
    return out


def home_block(lines: list[Line], weights: list[int], start: int, end: int, blocks: list[Block]) -> int:
    """The block that the run belongs to: the innermost with four fifths of its characters.

    Paragraphs, lists and tables stand for the block around them, and one of several like blocks (sections, elements of
    one class) for the block around them all.
    """
    share = below(weights[start:end], lines[start:end], blocks)
    home = max(k for k, w in enumerate(share) if 5 * w >= 4 * share[0])
    kin = Counter(
        (x.above, x.tag, x.names)
        for x, w in zip(blocks, below(weights, lines, blocks))
        if w and (x.tag == "section" or x.names and not PLACES & set(re.split(r"[\s_-]+", x.names)))
    )
    while blocks[home].tag not in PAGE:
        own = blocks[home]
        like = kin[own.above, own.tag, own.names] > 1 and blocks[own.above].tag not in PAGE
        if own.tag not in PIECES and not like:
            break
        home = own.above
    return home


def widen(lines: list[Line], weights: list[int], start: int, end: int, blocks: list[Block]) -> tuple[int, int]:
    """The run with all text of its home block, and back to the heading before it if it has none.

    A dive of links or short lines inside the home block is no end of the text. Of text that stands in the page itself
    only paragraphs and headings count, as everything on the page is inside it.
    """
    home = home_block(lines, weights, start, end, blocks)
    if blocks[home].tag in PAGE:
        own = [i for i, x in enumerate(lines) if weights[i] and blocks[x.block].above == home and blocks[x.block].tag in FLAT]
    else:
        inside = [k == home for k in range(len(blocks))]
        for k in range(home + 1, len(blocks)):
            inside[k] = inside[blocks[k].above]
        own = [i for i, x in enumerate(lines) if weights[i] and inside[x.block]]
    start, end = min([start, *own]), max([end - 1, *own]) + 1
    if not lines[start].heading and all(blocks[x.block].tag != "h1" for x in lines[start:end]):
        gap = 0
        for i in range(start - 1, -1, -1):
            gap = 0 if weights[i] else gap + 1
            if gap == WINDOW:
                break
            if lines[i].heading and weights[i]:
                start = i
                break
    return start, end


def main_lines(lines: list[Line], containers: list[tuple[str, int]], blocks: list[Block]) -> list[Line]:
    """Lines of the main text, by the line-block distribution of characters outside links.

    A surge or dive inside an article or main element moves to its first or last line; lines outside count only
    where no such element has text, or where an article holds less than the heaviest run outside (a teaser).
    """
    inner = [x.weight if x.container else 0 for x in lines]
    outer = [0 if x.container else x.weight for x in lines]
    total, start, end = heaviest(inner)
    own = {x.container for x in lines[start:end]} - {0}
    held = [x for x in lines if x.container in own]
    beside, first, last = heaviest(outer)
    teaser = beside >= SURGE and beside > sum(x.weight for x in held) and all(containers[k][0] != "main" for k in own)
    if total and not teaser:
        low, high = (f(i for i, x in enumerate(lines) if x.container in own) for f in (min, max))
        return [x for x in lines[low : high + 1] if x.container]
    if not beside:
        return []
    first, last = widen(lines, outer, first, last, blocks)
    return [x for x in lines[first:last] if not x.container]


def extract(html: str | None) -> str:
    """The main text: blocks in page order, one per line; empty if the page has none."""
    page = strip(html or "")
    return "\n".join(x.text for x in main_lines(page.read_lines(), page.containers, page.blocks))


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text`` (main text, empty if none) and ``n_chars`` (its code points) to every page; markup is not carried.

    The whole markup of a page is read, in Python, one page at a time; no shuffle. Null and empty markup give empty
    text; broken markup is read as far as it makes sense; very long pages are not cut; repeated rows give the same
    text each; an empty table gives no rows; input columns named text or n_chars are replaced.
    """
    rest = [c for c in replace_columns(pages, ["text", "n_chars", html]).columns]
    rows = pages.select(*[pages[c] for c in rest], pages[html].alias("__html"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(len(rest))]
            columns = [*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "text", "n_chars"])

    return rows.mapInArrow(run, f"{ddl}, text string, n_chars long" if rest else "text string, n_chars long")
