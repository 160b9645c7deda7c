"""HTML extraction by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|$)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
#: Controls and media, which hold no text of an article.
SKIP = frozenset("button select option dialog object video audio canvas".split())
#: Elements that are marked as noise.
ASIDE = frozenset("nav header footer aside form menu".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of the same or a listed kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div article section main body td th blockquote".split())
#: Words of class, id and role names that mark notices, adverts, menus and reader comments; and names they don't count in.
_NOISE = re.compile(r"(?:^|\s)(?!(?:with|without|has|no|is|not)[_-])(?:[^\s_-]+[_-])*(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|aside|footer|header|masthead|comments?|comment-?list|replies|disqus|related|recommended|share|sharing|social|toolbar|login|signup|search|complementary|contentinfo)(?:$|[\s_-])", re.I)
_COMMENT = re.compile(r"comment|replies|disqus", re.I)
#: What a mark leaves of the densities of a subtree; and the share of a page's text, beside links, above which a subtree
#: is no noise whatever its name (of reader comments, the second).
WEIGHT, MOST, MOST_COMMENTS = 0.2, 0.5, 0.9
HEADINGS, BESIDE = frozenset("h1 h2 h3".split()), 0.25
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "parent", "block", "noise", "holds", "peak")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = tag in BLOCK
        self.noise = 0.0  # the share of the page's text from which the mark doesn't count; 0: no mark
        self.holds = False  # an article or main element with text
        self.peak = self


def parse(html: str) -> Node:
    """A tree of nodes and strings; unclosed tags end with their parents. Raw elements, controls and the head are left out.

    Menus, notices and the like are in the tree, marked as noise by their tags or names.
    """
    root = node = Node("html", None)
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            node.children.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            elif tag == "p":
                node.children.append(Node("p", node))
            continue
        if tag in VOID:
            node.children.append("\n" if tag == "br" else Node(tag, node) if tag == "hr" else "")
            continue
        if tag in ("html", "body"):
            continue
        if tag == "head":
            end = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.I).search(html, at)
            at = end.end() if end else at
            continue
        if tag in RAW or tag in SKIP:  # to its end tag, whatever stands between
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n if tag in RAW else at
            continue
        if tag in BLOCK:  # a block ends an open paragraph and the inline elements in it
            up = node
            while up is not None and up.tag not in _SCOPE:
                if up.tag == "p":
                    node = up.parent
                    break
                up = up.parent
        if tag in _CLOSES:
            up = node
            while up is not None and up.tag not in ("ul", "ol", "dl", "table"):
                if up.tag in _CLOSES[tag]:
                    node = up.parent
                up = up.parent
        child = Node(tag, node)
        if tag in ASIDE or tag not in ("article", "main") and _named(m[3], _NOISE):
            child.noise = MOST_COMMENTS if _named(m[3], _COMMENT) else MOST
        node.children.append(child)
        node = child
    return root


def _named(attrs: str, words: re.Pattern) -> bool:
    return "=" in attrs and any(words.search(a or b or c) for a, b, c in _ATTR.findall(attrs))


def _strength(weight: float, ratio: float, base: float) -> float:
    """weight * log of ratio to the base log(base); a page without links has base e, so the natural logarithm."""
    below = math.log(math.log(base))
    return weight * math.log(max(ratio, 1.0)) / (below if below > 0 else 1.0)


def measure(root: Node) -> None:
    """Composite density of each node, the sum of its children's and its own texts', and the largest sum below it.

    A mark as noise leaves WEIGHT of the densities below it. It doesn't count for what holds an article or main
    element, nor, on pages without these, for what holds most of the page's text.
    """
    order, todo = [], [(root, False)]
    while todo:
        node, link = todo.pop()
        inside = link or node.tag == "a"
        order.append((node, inside))
        todo.extend((c, inside) for c in node.children if isinstance(c, Node))
    for node, inside in reversed(order):
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
                node.holds = node.holds or c.holds
            else:
                k = len(_SPACE.sub("", c))
                node.chars += k
                node.link_chars += k if inside else 0
        node.holds = node.holds or node.chars > 0 and node.tag in ("article", "main")
    share = root.link_chars / root.chars if root.chars else 0.0
    text = root.chars - root.link_chars
    weights = {root: 1.0}
    for node, _ in order[1:]:
        if node.noise and (node.holds or not root.holds and node.chars - node.link_chars > node.noise * text):
            node.noise = 0.0
        weights[node] = weights[node.parent] * (WEIGHT if node.noise else 1.0)
    for node, inside in reversed(order):
        c, lc = node.chars, node.link_chars
        if c:
            ratio = (c / max(1, lc)) * (max(1, node.tags) / max(1, node.link_tags))
            node.density = weights[node] * _strength(c / max(1, node.tags), ratio, c * lc / max(1, c - lc) + share * c + math.e)
        below = [k for k in node.children if isinstance(k, Node)]
        node.total = sum(k.density for k in below) if below else node.density
        for k in node.children if below and not inside else ():
            if isinstance(k, str) and (n := len(_SPACE.sub("", k))):
                node.total += weights[node] * _strength(n, n, share * n + math.e)
        for k in below:  # a node before its descendants where sums are equal
            if k.peak.total > node.peak.total:
                node.peak = k.peak


def _contents(root: Node) -> tuple[set[Node], float]:
    """The nodes whose whole subtrees are content, and the threshold, the least density between body and root.peak.

    Of each node that reaches the threshold, in parents that do, the subtree of the largest sum is content. Beside the
    path, a threshold that large menus have lowered isn't enough for short lines: a node that is no heading also needs
    BESIDE of the density of root.peak.
    """
    threshold, node = root.density, root.peak
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    path, node = set(), root.peak
    while node is not None:
        path.add(node)
        node = node.parent
    found, todo = {root.peak}, [root]
    while todo:
        node = todo.pop()
        needs = threshold if node in path or node.tag in HEADINGS else max(threshold, BESIDE * root.peak.density)
        if node.chars and node.density >= needs and node not in found:
            found.add(node.peak)
            todo.extend(c for c in node.children if isinstance(c, Node))
    return found, threshold


def extract(html: str | None) -> str:
    """The main text: blocks in page order, one a line; empty if there is none.

    Densities are those of the whole page, with links and menus. Where the subtree
    of the largest sum is a part of an article or main element, the outermost of these is the content, else all
    subtrees that the threshold selects, with the texts directly in the nodes around them. Inside, blocks that are
    mostly links and less dense than the threshold are left out, and marked ones whose weighted density is less than that
    of the subtree of the largest sum.
    """
    if not html:
        return ""
    root = parse(html)
    measure(root)
    tops, threshold = _contents(root)
    whole, node = None, root.peak
    while node is not None:
        if node.tag in ("article", "main"):
            whole = node
        node = node.parent
    top = root if whole is None else whole
    if whole is not None:
        tops = {whole}
    around: set[Node] = set()
    for node in tops:
        while (node := node.parent) is not None and node not in around:
            around.add(node)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    todo: list = [(top, False)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.noise and x.density < root.peak.density or not (inside or x in tops or x in around):
            flush()
        elif inside and x.block and x.chars and x.link_chars > 0.5 * x.chars and x.density < threshold:
            flush()
        else:
            if x.block:
                flush()
                todo.append((None, False))
            inside = inside or x in tops
            todo.extend((c, inside) for c in reversed(x.children))
    flush()
    return "\n".join(blocks)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page row; null html is an empty page, repeated rows each get a row."""
    small_batches(pages.sparkSession)
    source = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
