"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A linear classifier gives each block a cost for either label; the costs are capacities to
the two terminals, and edges between blocks that follow each other or share a container cost what separating them costs.
The minimum cut (maximum flow) labels all blocks of a page together.

Character references are decoded, white space inside a block is one space, and content blocks are joined by one space.

Class, id and role names are graded: a name whose last word is boilerplate's marks its element, other words make it
less likely, names of states (has-sidebar) say nothing, and names that content may have too (legal-news, widget) are ignored on an
element that holds most of the page's text.

Text inside noscript, template, svg, select and annotations is boilerplate; math and the fallback of an object belong to the
text around them. Only script, style, title, textarea and iframe are skipped as raw text.

Defined results: a null or empty html gives an empty text; markup that is not closed ends where its parent or the page
does; a page without content blocks gives an empty text; repeated rows each get their own result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

_MARKUP = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/<>]*)")
_ATTR = re.compile(r"""[\s/]*+([^\s/>=<"'][^\s/>=<]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>][^\s<>]*+)|(?=[>"'])))?+""")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "iframe")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img object param "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup "
    "msup mtable mtd mtext mtr munder munderover none semantics".split()
)
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements whose text is not shown in the line they stand in: boilerplate blocks beside the text around them.
_BESIDE = frozenset("noscript template svg select annotation annotation-xml".split())
#: Start tags that end an open svg, as the HTML standard has it.
_LEAVES_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
_SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class, id and role that name boilerplate, and those that may as well be part of the name of a page's content.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense cookie cookies consent gdpr newsletter sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer copyright comment comments disqus discussion replies reply respond responses contentinfo complementary".split()
)
_BROAD_HINTS = frozenset(
    "sponsor sponsored promo promotion banner notice notices alert popup modal overlay subscribe subscription signup rail widget toc header masthead topbar legal "
    "share sharing social related recommended recommendations trending search dialog login toolbar skip".split()
)
#: A name that begins with one of these says what a page or wrapper has, not what it is.
_STATES = frozenset("has no with without is show hide toggle".split())
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BAD_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
#: Log-odds of content.
WEIGHTS = {"base": -1.2, "length": 0.55, "link": -4.0, "article": 3.5, "p": 0.6, "h": 0.8, "li": -0.4, "bad": -8.0}
#: Log-odds of a mark whose last word names content, such as comment-body or social-history.
WEAK, WEAK_BROAD = -4.5, -2.5
#: Cost of separating blocks with the same parent, and of neighbours at a distance in the tree.
SAME, NEAR = 0.8, 0.5


@dataclass
class Block:
    text: str
    node: int  # innermost element that is no inline one
    tag: str
    linked: int  # characters inside links
    article: bool
    bad: bool
    weak: float = 0.0  # log-odds of weak marks
    mark: int = -1


@dataclass
class Tree:
    """Parents and depths of the elements that are not inline; 0 is the page."""

    parent: list[int]
    depth: list[int]

    def distance(self, a: int, b: int) -> int:
        n = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            n += 1
        return n


@dataclass
class Mark:
    """An element whose names hint at boilerplate: for certain, or with some log-odds; ``broad`` names may also be content's."""

    parent: int
    strong: bool
    odds: float
    broad: bool
    letters: int = 0


class _Open(NamedTuple):
    """An open element, with what holds for the text inside it."""

    tag: str
    node: int
    block: str  # tag of the node
    article: bool
    bad: bool  # hidden, or inside a boilerplate element
    header: bool  # inside a header that no article stands in
    mark: int


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool] | None:
    """Lower-case names and values, the end of the tag, and whether it closes itself; None if this is no tag."""
    out: dict[str, str] = {}
    while True:
        if m := _ATTR.match(page, at):
            name, *values = m.groups()
            out.setdefault(name.lower(), next((v for v in values if v is not None), ""))
            at = m.end()
        elif at >= len(page) or page[at] == "<":
            return None
        elif page[at] == ">":
            return out, at + 1, page[at - 1] == "/"
        else:
            at += 1


def _mark_of(attributes: dict[str, str], parent: int) -> Mark | None:
    """What class, id and role say of an element: its last word names it, other words only say what it belongs to."""
    strong, odds, broad = False, 0.0, True
    for name in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        words = [w.lower() for w in _NAME_PARTS.findall(name)]
        if not words or words[0] in _STATES:
            continue
        if words[-1] in _HINTS or words[-1] in _BROAD_HINTS:
            sure = words[-1] in _HINTS
            strong, broad = True, (broad if strong else True) and not sure
        elif not strong:
            if any(w in _HINTS for w in words):
                odds, broad = min(odds, WEAK), False
            elif any(w in _BROAD_HINTS for w in words):
                odds = min(odds, WEAK_BROAD)
    return Mark(parent, strong, odds, broad) if strong or odds else None


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").lower().replace(" ", "")
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def _apply_marks(blocks: list[Block], marks: list[Mark]) -> None:
    """Set what the marks of the elements around a block say; broad ones on an element with most of the page's text say nothing."""
    for b in blocks:
        if b.mark >= 0 and not b.bad:
            marks[b.mark].letters += len(b.text)
    for i in range(len(marks) - 1, 0, -1):
        if marks[i].parent >= 0:
            marks[marks[i].parent].letters += marks[i].letters
    total = sum(len(b.text) for b in blocks if not b.bad)
    said: list[tuple[bool, float]] = []
    for m in marks:
        strong, odds = said[m.parent] if m.parent >= 0 else (False, 0.0)
        if not (m.broad and 2 * m.letters > total):
            strong, odds = strong or m.strong, min(odds, m.odds)
        said.append((strong, odds))
    for b in blocks:
        if b.mark >= 0:
            strong, odds = said[b.mark]
            b.bad, b.weak = b.bad or strong, odds


def parse_blocks(page: str) -> tuple[list[Block], Tree]:
    """The text blocks of a page in order, and where they stand. Time is linear in the page."""
    out: list[Block] = []
    tree, marks = Tree([0], [0]), []
    stack = [_Open("", 0, "", False, False, False, -1)]
    count: Counter[str] = Counter()  # open elements by tag
    parts: list[str] = []
    linked, at = 0, 0
    beside = 0  # place in the stack of the open element beside the text, or 0
    outside: Counter[str] = Counter()  # open elements up to it
    around: tuple[list[str], int] = ([], 0)  # parts and linked of the text around it
    held: list[Block] = []  # its blocks, which follow the block around it

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                o = stack[-1]
                (held if beside else out).append(Block(text, o.node, o.block, linked, o.article, o.bad or o.header, mark=o.mark))
            parts.clear()
        linked = 0
        if held and not beside:
            out.extend(held)
            held.clear()

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if count["a"]:
            linked += len(text)

    def shown(raw: str) -> None:
        add(html.unescape(raw) if "&" in raw else raw)

    def cut_to(size: int) -> None:
        while len(stack) > size:
            count[stack.pop().tag] -= 1

    def close(tag: str) -> None:
        if count[tag]:
            while stack[-1].tag != tag:
                cut_to(len(stack) - 1)
            cut_to(len(stack) - 1)

    def leave() -> None:
        nonlocal beside, linked
        flush()
        cut_to(beside)
        beside = 0
        parts[:], linked = around

    while m := _MARKUP.search(page, at):
        if m.start() > at:
            shown(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0] == "<![CDATA[":
                end = page.find("]]>", at)
                add(page[at : end if end >= 0 else len(page)])
                at = end + 3 if end >= 0 else len(page)
            elif m[0] == "<!--":
                end = at - 2 if page.startswith((">", "->"), at) else page.find("-->", at)
                at = page.find(">", end) + 1 if end >= 0 else len(page)
            else:
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
            continue
        read = _attributes(page, at)
        if read is None:
            add("<")
            at = m.start() + 1
            continue
        attributes, at, closed = read
        tag = m[2].lower()
        if m[1]:
            # the tag of an element around the one beside the text, which ends with it
            if beside and outside[tag] and count[tag] == outside[tag]:
                own = stack[beside].tag == tag
                leave()
                if own:
                    continue
            if tag not in _INLINE:
                flush()
            close(tag)
            continue
        if beside and tag in _LEAVES_SVG and stack[beside].tag == "svg" and count["foreignobject"] == outside["foreignobject"]:
            leave()
        if closed and (tag in ("svg", "math") or count["svg"] or count["math"]):
            continue
        if tag in _RAW:
            if tag in ("title", "textarea", "iframe"):
                flush()
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append("\n")
            continue
        inline = tag in _INLINE
        enters = False
        if inline:
            if tag in _VOID:
                continue
        elif tag in _BESIDE and not beside:
            enters = True
            beside, around = len(stack), (parts[:], linked)
            parts.clear()
            linked = 0
        else:
            flush()
            if tag in _VOID:
                continue
            if tag in _CLOSES_P and count["p"] > (outside["p"] if beside else 0):
                close("p")
            for other in _SELF_CLOSING.get(tag, ()):
                if stack[-1].tag == other:
                    close(other)
        o = stack[-1]
        node, block = o.node, o.block
        if not inline:
            node, block = len(tree.parent), tag
            tree.parent.append(o.node)
            tree.depth.append(tree.depth[o.node] + 1)
        holds = tag in ("article", "main")
        mark = o.mark
        if attributes and tag not in ("body", "html") and (found := _mark_of(attributes, mark)):
            mark = len(marks)
            marks.append(found)
        bad = o.bad or tag in _BAD_TAGS or tag in _BESIDE or (tag not in ("body", "html") and _hidden(attributes))
        stack.append(_Open(tag, node, block, o.article or holds, bad, not holds and (o.header or (tag == "header" and not o.article)), mark))
        count[tag] += 1
        if enters:
            outside = count.copy()
    if at < len(page):
        shown(page[at:])
    if beside:
        leave()
    flush()
    _apply_marks(out, marks)
    return out, tree


def content_odds(b: Block) -> float:
    """The classifier: log-odds that a block is content."""
    w = WEIGHTS
    z = w["base"] + w["length"] * math.log2(1 + b.text.count(" ") + 1) + w["link"] * min(1.0, b.linked / len(b.text))
    z += w["article"] * b.article + w["bad"] * b.bad + b.weak
    return z + (w["p"] if b.tag in ("p", "blockquote", "pre") else w["h"] if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else w["li"] if b.tag == "li" else 0.0)


def smoothness(blocks: list[Block], tree: Tree) -> list[tuple[int, int, float]]:
    """Edges between following blocks, by their distance in the tree, and between following blocks of one container."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEAR / (1 + tree.distance(blocks[i - 1].node, b.node))))
        parent = tree.parent[b.node]
        if parent in last:
            edges.append((last[parent], i, SAME))
        last[parent] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the content side of a minimum cut.

    A node's odds are its capacity from the source (above 0) or to the sink (below 0). Blocking flows run along shortest
    paths until none is left; content is what the source still reaches, so ties go to boilerplate.
    """
    n = len(odds)
    graph: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[float] = []
    for a, b, w in edges:
        graph[a].append(len(to))
        to.append(b)
        cap.append(w)
        graph[b].append(len(to))
        to.append(a)
        cap.append(w)
    left, sink = [max(z, 0.0) for z in odds], [max(-z, 0.0) for z in odds]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if left[i] > tiny)
        for i in queue:
            level[i] = 0
        found = False
        while queue:
            i = queue.popleft()
            found = found or sink[i] > tiny
            for e in graph[i]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not found:
            return [x >= 0 for x in level]
        place = [0] * n
        for start in range(n):
            while left[start] > tiny:
                path, i = [], start
                while sink[i] <= tiny:
                    while place[i] < len(graph[i]):
                        e = graph[i][place[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        place[i] += 1
                    else:
                        if not path:
                            break
                        i = to[path.pop() ^ 1]
                        place[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if sink[i] <= tiny:
                    break
                flow = min([left[start], sink[i], *(cap[e] for e in path)])
                left[start] -= flow
                sink[i] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def main_text(page: str | None) -> str:
    blocks, tree = parse_blocks(page or "")
    odds = [content_odds(b) for b in blocks]
    if all(z > 0 for z in odds) or all(z <= 0 for z in odds):  # every edge is inside one side
        keep = [z > 0 for z in odds]
    else:
        keep = minimum_cut(odds, smoothness(blocks, tree))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. No row is shuffled."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
