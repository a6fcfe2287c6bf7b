"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass labels each block good, bad
or short by three figures: its length, the share of its text in links, and the density of
stop words. Where a block stands is a fourth feature: elements for menus, headers, footers,
sidebars, notices, adverts, forms and reader comments make it bad; an article or main
element lowers what the other figures must show, but does not label a block by itself. In
the second pass short blocks take the label of their nearest decided neighbours, inside the
article from inside, elsewhere from elsewhere.

An element that is, or holds, the page's first article or main element is never taken for
a sidebar, comment or the like because of a word in its class. Further articles of under a
quarter of the longest one are teasers and get no help from their element.

Character references are decoded, white space inside a block becomes one space, blocks
are joined in page order by one space; nothing is cut. Null or empty html gives empty
text. Unclosed elements, stray ends and cut-off tags are read as browsers read them, as far
as blocks are concerned, in time linear in the page. Rows are read one by one, so repeated
rows agree; other columns pass through, and names that clash get an underscore in front.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import append_columns, unused

#: A tag ends at the first > that is not in a quoted value, a cut-off one with the page. All repeats are possessive.
_MARK = re.compile(r"""<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_NAME = re.compile(r"[A-Za-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math canvas video audio title xmp noembed noframes textarea".split())
_OUT = frozenset("nav footer aside form button select fieldset dialog menu".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select button caption".split()
)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_IN = frozenset(("article", "main"))
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that name what is not the article.
_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments disqus respond reply replies cookie cookies consent gdpr notice notification alert newsletter subscribe subscription signup login social share sharing related recommended recommendations widget widgets popup modal overlay pagination pager toolbar search masthead complementary contentinfo skip".split()
)
#: These do so only outside an article.
_OUT_NAMES_ELSEWHERE = frozenset("header banner top bottom aside side".split())
#: Words that may stand beside these in a whole name: cookie-bar, share-buttons. Any other word makes the name say something else
#: (with-sidebar, comments-open, notice-of-meeting), and the block is left to its figures.
_PARTS = frozenset(
    "area bar block blocks body bottom box button buttons col column container first fixed form group hidden icon icons inner item items last left line link links list message mobile module outer panel post posts primary row secondary section site slot small sticky strip text title top unit wrap wrapper right desktop global js id the this us"
    .split()
)
_IN_NAMES = frozenset("article main".split())
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by this are from at or an not have but "
    "le la les de des du un une et en que qui est pour dans par sur au avec pas ne se "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an "
    "el los las del y en que un una es por con para se no al lo su como más o".split()
)
_SIGNS = ".,;:!?\"'()[]{}#$%&*@^~=+<>|/\\-_«»“”„‘’…–—"

SHORT = 70
LONG = 200
MANY_LINKS, MANY_LINKS_INSIDE, FEW_LINKS = 0.35, 0.6, 0.1
DENSE, SOME = 0.25, 0.1
DENSE_INSIDE = 0.05
TEASER = 0.25


class _Region:
    """An element that says where its blocks stand: 'out' by its tag, 'name' by its class, 'in' for an article; '' once it has been freed."""

    __slots__ = ("held", "kind", "parent", "placed", "tag")

    def __init__(self, kind: str, tag: str, parent: _Region | None):
        self.kind, self.tag, self.parent, self.placed = kind, tag, parent, None
        # Whether an article inside stays what it is in, as the first one does not free menus, asides and the like.
        self.held = parent is not None and parent.held or kind == "out" and tag != "form"

    def place(self) -> tuple[bool, _Region | None]:
        """Whether it is outside the main text, and its outermost article; kept, once the page is read."""
        path, node = [], self
        while node is not None and node.placed is None:
            path.append(node)
            node = node.parent
        placed = node.placed if node is not None else (False, None)
        for node in reversed(path):
            if placed[0] or node.kind in ("out", "name"):
                placed = True, None
            elif node.kind == "in" and placed[1] is None:
                placed = False, node
            node.placed = placed
        return placed


class Block:
    """A block's text and features, and the label with what gave it: a rule of the first pass, or 'neighbours'."""

    __slots__ = ("article", "by", "density", "heading", "inside", "label", "linked", "out", "text")

    def __init__(self, text: str, linked: int, out: bool, article: _Region | None, heading: bool):
        self.text, self.linked, self.out, self.article, self.heading = text, linked / len(text), out, article, heading
        self.inside, self.label, self.by = False, "", ""
        words = text.lower().split()
        self.density = sum(w.strip(_SIGNS) in STOP_WORDS for w in words) / len(words)


def _kind(tag: str, attributes: str, inside: bool) -> str:
    """'hidden', 'out', 'name', 'in' or '' for an element that opens."""
    names: list[set[str]] = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return "hidden"
        if name in ("class", "id", "role"):
            names += [{x.lower() for x in _NAME.findall(v)} for v in value.split()]
    if tag in _OUT or tag == "header" and not inside:
        return "out"
    if tag in ("html", "body"):
        return ""
    elsewhere = _OUT_NAMES_ELSEWHERE if not inside and tag not in _IN else frozenset()
    if any(v & (_OUT_NAMES | elsewhere) and v <= _OUT_NAMES | _OUT_NAMES_ELSEWHERE | _PARTS for v in names):
        return "name"
    return "in" if tag in _IN or any(v & _IN_NAMES and len(v) == 1 for v in names) and tag not in _INLINE else ""


def blocks(page: str) -> list[Block]:
    """All blocks of the page but hidden ones, scripts and styles, in order."""
    found: list[tuple[str, int, _Region | None, bool]] = []
    stack: list[tuple[str, str, _Region | None]] = []  # open elements, their kind, and the region before them
    open_tags: Counter = Counter()
    open_blocks: list[int] = []
    region: _Region | None = None
    hidden = inside = links = linked = 0
    seen_article = heading = False
    parts: list[str] = []

    def close() -> None:
        nonlocal linked, heading
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, min(linked, len(text)), region, heading))
            parts.clear()
        linked, heading = 0, False

    def pop() -> None:
        nonlocal hidden, inside, links, region
        tag, kind, before = stack.pop()
        open_tags[tag] -= 1
        if open_blocks and open_blocks[-1] == len(stack):
            open_blocks.pop()
        if kind == "hidden":
            hidden -= 1
        elif kind:
            close()
            region = before
            inside -= kind == "in"
        links -= tag == "a"

    at, n = 0, len(page)
    while at < n:
        mark = _MARK.search(page, at)
        end = mark.start() if mark else n
        if end > at and not hidden:
            piece = page[at:end]
            parts.append(piece)
            if links:
                linked += len(" ".join(html.unescape(piece).split()))
        if not mark:
            break
        at = mark.end()
        if not mark[2]:
            continue
        tag = mark[2].lower()
        if tag in _BLOCK:
            close()
        if tag == "br" and not hidden:
            parts.append(" ")
        if mark[1]:
            if open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _RAW and not mark[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            ending = page.find(">", stop.start()) if stop else -1
            at = n if ending < 0 else ending + 1
            continue
        if tag in _VOID or mark[3].endswith("/"):
            continue
        if tag in _BLOCK and open_blocks:
            # An open paragraph ends where a block begins, and so does a list item before its sibling.
            ended = ("p",) if tag not in ("li", "dd", "dt", "td", "th", "tr") else ("p", tag)
            if stack[open_blocks[-1]][0] in ended:
                keep = open_blocks[-1]
                while len(stack) > keep:
                    pop()
        if tag == "body":
            while stack and stack[-1][0] != "html":
                pop()
        kind = _kind(tag, mark[3], inside > 0)
        if tag == "head" or kind in ("out", "name") and tag in _INLINE:
            kind = "hidden"
        if tag in _IN and kind != "hidden" and not seen_article:
            # The first article frees what holds it from names, and from a form around the whole page.
            if region is None or not region.held:
                node = region
                seen_article, kind = True, "in"
                while node is not None:
                    node.kind = node.kind if node.kind == "in" else ""
                    node = node.parent
        stack.append((tag, kind, region))
        open_tags[tag] += 1
        if tag in _BLOCK:
            open_blocks.append(len(stack) - 1)
        if kind == "hidden":
            hidden += 1
        elif kind:
            close()
            region = _Region(kind, tag, region)
            inside += kind == "in"
        links += tag == "a"
        if tag in _HEADING:
            heading = True
    close()
    return [Block(text, k, *(r.place() if r is not None else (False, None)), h) for text, k, r, h in found]


def first_pass(found: list[Block]) -> None:
    """Label every block good, bad or short by length, links, stop words and place."""
    size: Counter = Counter()
    for b in found:
        if b.article is not None:
            size[b.article] += len(b.text)
    most = max(size.values(), default=0)
    for b in found:
        b.inside = b.article is not None and size[b.article] >= TEASER * most
    # In an article, three or more blocks of links in a row are a menu; fewer are left to their neighbours.
    run = [0] * len(found)
    for i, b in enumerate(found):
        run[i] = run[i - 1] + 1 if i and b.linked > MANY_LINKS_INSIDE and len(b.text) < LONG else int(b.linked > MANY_LINKS_INSIDE and len(b.text) < LONG)
    for i in range(len(found) - 2, -1, -1):
        run[i] = max(run[i], run[i + 1]) if run[i] and run[i + 1] else run[i]
    for i, b in enumerate(found):
        n = len(b.text)
        if b.out:
            b.label, b.by = "bad", "place"
        elif b.inside:
            if run[i]:
                b.label, b.by = ("bad", "links") if run[i] > 2 and not b.heading else ("short", "links")
            elif n < SHORT or b.heading:
                b.label, b.by = "short", "length"
            else:
                b.label, b.by = ("good" if b.density >= DENSE_INSIDE else "short"), "density"
        elif b.linked > MANY_LINKS:
            b.label, b.by = ("short" if b.heading else "bad"), "links"
        elif n < (LONG if most else SHORT) or b.heading:
            b.label, b.by = "short", "length"
        else:
            # Long text without links needs fewer stop words than a line that may be a menu's or a notice's.
            enough = SOME if n >= LONG and b.linked < FEW_LINKS else DENSE
            b.label, b.by = ("good" if b.density >= enough else "short" if b.density >= SOME or not most else "bad"), "density"


def second_pass(found: list[Block]) -> None:
    """Give short blocks the label of the nearest decided ones on their side of the article's edge.

    What is bad by its place alone counts as one further away, and not at all where no block is good.
    Between unlike neighbours a heading goes with what follows, other text with the nearer one.
    Without neighbours, text is good unless an article elsewhere in the page is.
    """
    some_good = any(b.label == "good" for b in found)
    has_article = any(b.inside for b in found)
    for inside in (True, False):
        at = [i for i, b in enumerate(found) if b.inside == inside]
        deciding = [(found[i].label, found[i].by == "place") if found[i].label != "short" and (some_good or found[i].by != "place") else None for i in at]
        before: list = [None] * len(at)
        after: list = [None] * len(at)
        last = None
        for k, d in enumerate(deciding):
            before[k] = last
            last = (d[0], k - d[1]) if d else last
        last = None
        for k in range(len(at) - 1, -1, -1):
            after[k] = last
            last = (deciding[k][0], k + deciding[k][1]) if deciding[k] else last
        for k, i in enumerate(at):
            b = found[i]
            if b.label != "short":
                continue
            one, two = before[k], after[k]
            if one and two:
                label = two[0] if b.heading or two[1] - k < k - one[1] else one[0]
            else:
                label = one[0] if one else two[0] if two else "good" if inside or not has_article else "bad"
            b.label, b.by = label, "neighbours"


def judged(page: str | None) -> list[Block]:
    """The page's blocks with their labels."""
    found = blocks(page) if page else []
    first_pass(found)
    second_pass(found)
    return found


def main_text(page: str | None) -> tuple[str, int]:
    """The text, and of how many blocks it is made."""
    kept = [b.text for b in judged(page) if b.label == "good"]
    return " ".join(kept), len(kept)


def extract(pages: DataFrame, *, html_col: str = "html", name: str = "text") -> DataFrame:
    """Columns of ``pages`` but the html, plus the text under ``name`` and ``<name>_blocks`` (with an underscore in front where ``pages`` has such a column)."""

    def make():
        def work(values):
            out = [main_text(v.decode("utf-8", "replace") if v else None) for v in values]
            return [pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())]

        return work

    text, count = unused(pages, name), unused(pages, f"{name}_blocks")
    return append_columns(pages, html_col, make, [T.StructField(text, T.StringType()), T.StructField(count, T.LongType())]).drop(html_col)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
