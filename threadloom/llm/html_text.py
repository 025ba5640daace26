"""Main text of a page by composite text density.

For every node of the page's tree: characters per tag, weighed down by the share of
its characters that are links.  With c characters, t tags, lc characters and lt tags
inside links, and the page body's lcb and cb, the density is

    c/t * log[ln(c/(c-lc) * lc + lcb/cb * c + e)] (c*t / (lc*lt))

(zeroes count as one).  The sum of a node's children's densities is taken for every
node, the one with the largest sum is the content, and the smallest density on the path
from it to the body is the threshold that its parts, and what stands beside the path,
must reach.  Elements without readable text, such as scripts and hidden ones, are left out
of the tree beforehand; no other element is, so densities choose among all that is on
the page.

Names break ties only: navigation, footers, page headers and asides by element (BESIDE),
and forms, adverts, comments and the like by element, role and the words in class and
id, are no content beside the path.  In the chosen subtree they are left out where they
hold at most MINOR of its text, and they are not chosen themselves while they hold at
most MINOR of the body's and anything else has text.

Each page is parsed for itself inside a task; no rows move.  Parsing is one pass over
the tags with an explicit stack, linear in the page, however deep the nesting.
"""

from __future__ import annotations

import html
import re
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements without content, elements whose content is not markup, and elements that make no block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag closes if they are open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What holds no article text: elements, roles, and words of class and id.
NO_TEXT = frozenset("head script style noscript template iframe object svg canvas form button select input textarea nav footer aside menu dialog noembed noframes audio video".split())
#: Of them, those that hold readable text beside an article, and those that may stand around one.
BESIDE = frozenset("nav footer aside menu dialog".split())
AROUND = BESIDE | {"form"}
#: Largest share of the body's text in an element that is left out for its name.
MINOR = 0.5
NO_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
NO_WORDS = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside comment comments respond disqus reply replies cookie cookies consent notice popup modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager copyright legal disclaimer skip search".split())
#: Words that mark content, even beside one of the above.
CONTENT = frozenset("article content post entry body main story".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "drop", "doubt")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, doubt: bool = False):
        self.tag, self.parent, self.drop, self.doubt = tag, parent, drop, doubt
        self.parts: list = []  # texts and nodes, in order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether it is if its share of the text is minor."""
    if tag in NO_TEXT and tag not in AROUND:
        return True, False
    doubt = tag in AROUND or tag == "header"
    for m in _ATTRIBUTE.finditer(attributes or ""):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True, False
        if name == "role" and value in NO_ROLES:
            doubt = True
        if name in ("class", "id") and tag not in ("html", "body", "main", "article"):
            for own in value.split():
                found = set(_WORDS.findall(own))
                if found & NO_WORDS and not found & CONTENT:
                    doubt = True
    return False, doubt


def parse(page: str) -> Node:
    """The tree of a page; unwanted elements are marked, and those that are left out in any case keep no text."""
    root = Node("html", None)
    node, at, depth_of = root, 0, {}
    n, last = len(page), page.rfind(">") + 1  # beyond the last ">" no tag ends
    while True:
        m = _TOKEN.search(page, at, last) if at < last else None
        text = page[at : m.start()] if m else page[at:]
        if text and not node.drop:
            node.parts.append(text)
        if not m:
            break
        at = m.end() if m[0][:4] != "<!--" or m[0].endswith("-->") else n
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if depth_of.get(tag):
                while node is not root:
                    depth_of[node.tag] -= 1
                    closed, node = node.tag, node.parent
                    if closed == tag:
                        break
            elif tag == "p" or tag == "br":
                node.parts.append(Node("br", node))
            continue
        if tag in ("html", "body") and depth_of.get(tag, tag == "html"):
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag in ENDS_P else None)
        if closes and any(depth_of.get(c) for c in closes):
            # close the nearest such element, unless a container stands between
            x = node
            stop = {"ul", "ol", "dl"} if tag in ("li", "dt", "dd") else {"table"} if tag in ("tr", "td", "th") else {"div", "td", "th", "li", "section", "article", "body", "table", "blockquote"}
            while x is not root and x.tag not in closes and x.tag not in stop:
                x = x.parent
            if x.tag in closes:
                while node is not x.parent:
                    depth_of[node.tag] -= 1
                    node = node.parent
        drop, doubt = _unwanted(tag, attributes)
        child = Node(tag, node, node.drop or drop, doubt)
        node.parts.append(child)
        if tag in VOID:
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if attributes.endswith("/") and tag in ("svg", "path", "use", "math"):
            continue
        depth_of[tag] = depth_of.get(tag, 0) + 1
        node = child
    return root


def _nodes(root: Node) -> list[Node]:
    """Parents before children."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(p for p in x.parts if isinstance(p, Node) and not p.drop)
    return out


def _measure(order: list[Node]) -> None:
    for x in reversed(order):
        x.tags = x.link_chars = x.link_tags = 0
        x.chars = sum(len("".join(p.split())) for p in x.parts if isinstance(p, str))
        for p in x.parts:
            if isinstance(p, Node) and not p.drop:
                x.chars += p.chars
                x.tags += p.tags + 1
                x.link_chars += p.link_chars
                x.link_tags += p.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1


def _density(x: Node, body: Node) -> float:
    if not x.chars:
        return 0.0
    c, t, lc, lt = x.chars, x.tags or 1, x.link_chars or 1, x.link_tags or 1
    other = max(1, c - x.link_chars)
    base = log(c / other * x.link_chars + body.link_chars / max(1, body.chars) * c + e)
    return c / t * log(max(c / lc * t / lt, 1.0)) / log(base) if base > 1.000001 else c / t * log(max(c / lc * t / lt, 1.0)) / 1e-6


def _blocks(top: Node, skip) -> list[str]:
    """Texts of the blocks under a node, in page order, but for those that `skip` names; blocks and line breaks part them."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            # references end with the piece of text that they stand in
            text = " ".join("".join(map(html.unescape, run)).split())
            if text:
                out.append(text)
            run.clear()

    stack: list = [(top, iter(top.parts))]
    ends: list[bool] = [True]
    while stack:
        x, parts = stack[-1]
        p = next(parts, None)
        if p is None:
            stack.pop()
            if ends.pop():
                end()
        elif isinstance(p, str):
            run.append(p)
        elif not p.drop:
            block = p.tag not in INLINE
            if block:
                end()
            if not skip(x, p, block):
                stack.append((p, iter(p.parts)))
                ends.append(block)
    end()
    return out


def main_text(page: str, named: bool = True) -> str:
    """The article's text: blocks joined by one space; empty if the page has none.

    With `named` off, names of elements, roles and classes count for nothing.
    """
    root = parse(page)
    order = _nodes(root)
    _measure(order)
    if not root.chars:
        return ""
    body = next((x for x in order if x.tag == "body"), root)
    doubtful = [x for x in order if x.doubt and named and x is not body]
    for x in order:
        x.density, x.doubt = _density(x, body), False
    for x in doubtful:
        x.doubt = x.tag in BESIDE or x.chars <= MINOR * body.chars
    # inline elements that hold no block are text of their block; nothing of a doubtful element is chosen
    blocks: set[int] = set()
    for x in reversed(order):
        below = [p for p in x.parts if isinstance(p, Node) and id(p) in blocks and not p.drop]
        if below or x.tag not in INLINE and x.tag not in VOID:
            blocks.add(id(x))
        x.total = sum(p.density for p in below) + x.density * (x.chars - sum(p.chars for p in below)) / max(1, x.chars)
    apart: set[int] = set()
    for x in order:
        if x.doubt or x.parent is not None and id(x.parent) in apart:
            apart.add(id(x))
    inside = [x for x in order if id(x) in blocks]
    free = [x for x in inside if id(x) not in apart]
    if not any(x.chars - sum(p.chars for p in x.parts if isinstance(p, Node) and id(p) in apart) > 0 for x in free):
        free, apart = inside, set()  # with nothing else on the page, what is doubtful is the text
        for x in order:
            x.doubt = False
    best = max(free or order, key=lambda x: x.total)
    least, x, path = best.density, best, set()
    while x is not body and x.parent is not None:
        x = x.parent
        path.add(id(x))
        least = min(least, x.density) if x.chars else least
    # what stands beside the path and reaches its threshold is content as well, as is text of the path's own nodes
    top = x = best
    while x is not body and x.parent is not None:
        below, x = x, x.parent
        if any(p.strip() if isinstance(p, str) else p is not below and not p.drop and not p.doubt and p.chars and p.density >= least for p in x.parts):
            top = x

    def skip(x: Node, p: Node, block: bool) -> bool:
        if id(p) in path or p is best or not p.chars and p.tag != "br":
            return False
        if id(x) in path and (block or p.doubt):
            return p.doubt or p.density < least
        return p.doubt and (p.tag in BESIDE or p.chars <= MINOR * best.chars) or block and p.link_chars * 2 > p.chars and p.density < least

    return " ".join(_blocks(top, skip))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    A null page has no text, which gives an empty text; a null id or url stays null;
    repeated rows are extracted each, pages of any length as a whole; other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(v.as_py() or "") for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), pages[page].alias("html")).mapInArrow(run, SCHEMA)
