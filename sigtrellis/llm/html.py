"""Main text of web pages by composite text density.

The page becomes a tree. Each node, menus and adverts included, has a composite
density: characters per tag, lowered by the share of link text and link tags. A node's
sum is that of its children's densities. Parts that their tag, role or class names as
scripts, forms, menus, adverts, notices or comments can't be chosen and give no text.
Of the other nodes the one of largest sum is chosen. The threshold is the density of
the body, the end of the way up from that node: the highest node on that way that is
denser than the threshold by ``MARGIN`` is the main text, and beside it, siblings on the
rest of the way up that reach the least density of the way. No tag is preferred to
others.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed, and those with text are joined by one line feed. Null, empty
and text-free pages give an empty text. Of nodes with equal sums the one with more
text, then the first, is chosen. Repeated rows stay repeated, an empty table gives an
empty result, and columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrellis.llm.session import short_batches

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROP = frozenset("head script style noscript template iframe object embed svg canvas math nav footer aside form button select textarea input label dialog menu audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|breadcrumb\w*|nav|navbar|navigation|menu\w*|sidebar\w*|side-?bar|footer\w*|site-?header|masthead|"
    r"cookie\w*|consent|gdpr|notice\w*|popup\w*|modal\w*|newsletter\w*|subscri\w+|signup|sign-up|login|share|sharing|social\w*|related\w*|recommend\w*|widget\w*|"
    r"comments?|comment-\w+|commentlist|disqus\w*|respond|replies|reader-comments?|pagination|pager|toolbar|skip-?link)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: An open element on the left is ended by any element on the right.
_ENDS = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
}
#: How much denser than the body what holds the main text has to be.
MARGIN = 1.02
#: Elements whose text is never shown.
_UNSEEN = frozenset("head script style noscript template".split())
_SCOPE = frozenset("table ul ol dl article section div main body html td th".split())


class Node:
    __slots__ = ("tag", "drop", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, drop: bool = False):
        self.tag, self.drop, self.kids = tag, drop, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class Tree(HTMLParser):
    """Builds nodes and ends what authors leave open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].tag
            if name in _ENDS and tag in _ENDS[name]:
                del self.open[i:]
                break
            if name in _SCOPE:
                break
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        if tag == "body":
            del self.open[1:]
        a = dict(attrs)
        named = f"{a.get('class') or ''} {a.get('id') or ''}"
        drop = tag in DROP or (a.get("role") or "").lower() in ROLES or "hidden" in a or (a.get("aria-hidden") or "") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower()
        drop = drop or (tag not in ("body", "html", "article", "main") and bool(named.strip()) and bool(NAMES.search(named)))
        drop = drop or (tag == "header" and not any(n.tag in ("article", "main") for n in self.open))
        node = Node(tag, drop)
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag not in BLOCK and self.open[i].tag in BLOCK:
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def _walk(root: Node) -> list[tuple[Node, Node | None]]:
    """Nodes whose text can be seen, with their parents, parents first."""
    out, stack = [], [(root, None)]
    while stack:
        node, parent = stack.pop()
        out.append((node, parent))
        stack.extend((k, node) for k in reversed(node.kids) if isinstance(k, Node) and k.tag not in _UNSEEN)
    return out


def _measure(nodes: list[tuple[Node, Node | None]]) -> None:
    for node, parent in reversed(nodes):
        node.chars += sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if parent is not None:
            parent.chars += node.chars
            parent.tags += node.tags + 1
            parent.link_chars += node.link_chars
            parent.link_tags += node.link_tags
    body = _body(nodes)
    share = body.link_chars / max(1, body.chars)
    for node, parent in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(math.e, c / lc * t / lt)) / math.log(max(math.e, base) + 1)
        if parent is not None:
            parent.total += node.density


def _body(nodes: list[tuple[Node, Node | None]]) -> Node:
    return next((n for n, _ in nodes if n.tag == "body"), nodes[0][0])


def _chosen(nodes: list[tuple[Node, Node | None]]) -> list[Node]:
    up, body, hidden = {id(n): p for n, p in nodes}, _body(nodes), set()
    for node, parent in nodes:
        if node.drop or id(parent) in hidden:
            hidden.add(id(node))
    best = max((n for n, _ in nodes if id(n) not in hidden), key=lambda n: (n.total, n.chars), default=body)
    path = [best]
    while path[-1] is not body and (p := up[id(path[-1])]) is not None:
        path.append(p)
    dense = [i for i, n in enumerate(path[:-1]) if n.density >= MARGIN * path[-1].density]
    top = dense[-1] if dense else 0
    least = min(n.density for n in path[top:])
    out = {id(path[top])}
    if path[top].tag not in ("body", "html"):
        for below, node in zip(path[top:], path[top + 1 :]):
            if node is not body:
                out |= {id(k) for k in node.kids if isinstance(k, Node) and id(k) not in hidden and k is not below and k.density >= least and k.tag in BLOCK}
    return [n for n, _ in nodes if id(n) in out]


def blocks(root: Node) -> list[str]:
    """Texts of the blocks under a node, in page order."""
    out: list[str] = []
    text: list[str] = []

    def flush():
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(joined)
            text.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            text.append(x)
        elif not x.drop:
            if x.tag == "br":
                text.append(" ")
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.kids))
    flush()
    return out


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    nodes = _walk(tree.root)
    _measure(nodes)
    return "\n".join(b for n in _chosen(nodes) for b in blocks(n))


def extractor():
    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        return pd.Series([extract(h) for h in html], dtype=object)

    return main_text


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row."""
    short_batches(pages.sparkSession)
    out = pages.select("page_id", "url", extractor()(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
