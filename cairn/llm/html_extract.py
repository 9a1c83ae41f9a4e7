"""HTML extraction by tree scoring.

A page becomes a tree of elements. Paragraphs give points, for their length and their commas, to their parent and half
of them to its parent; a container's points are discounted by the share of its text that stands in links. The best
container is kept with those siblings that are not mostly links. What is left out beforehand: scripts, styles, forms,
menus, headers, footers, sidebars, notices, adverts and comments, by element or by class and id. A class or id names
furniture if one of its parts does (post-comments, page-header), unless it says what its element goes with or lacks
(has-sidebar, no-ads). If that leaves no text at all, classes and ids are not asked.

Reading takes time in proportion to the page: the open elements are indexed by name, so no end tag looks through them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by what they do. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object select".split())
DROP = frozenset("nav header footer aside form button dialog menu head".split()) | RAW
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p pre td blockquote h1 h2 h3 h4 h5 h6 li dd".split())
#: An open p ends where one of these begins.
ENDS_P = (BLOCK - frozenset("body html caption dd dt li tbody td tfoot th thead tr".split())) | frozenset("nav header footer aside form menu".split())
#: Elements that an inline end tag does not reach out of, and parts of larger elements that are never a container on their own.
WALL = BLOCK | DROP
BESIDE_ARTICLE = frozenset("article blockquote h1 h2 h3 h4 h5 h6 p pre".split())
PART = frozenset("a b dd dl dt em font i li ol p small span strong table tbody td tfoot th thead tr u ul".split())
#: A tag that a page breaks off in, the name of a tag, and its attributes up to the bracket that is in no quotes.
BROKEN = re.compile(r"<[/a-zA-Z!?][^<>]*$")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: An element ends where one of its own kind begins, up to the container that holds such elements.
SIBLING = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
#: Parts of classes and ids that name furniture; those that do so for an article too; those that tell what else an element has, or how it is filed.
NEGATIVE = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|footnotes?|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo\w*|related|remarks?|replies|reply|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget", re.I)
NO_ARTICLE = re.compile(r"ads?|advert\w*|comments?|promo\w*|related|replies|reply|sponsor\w*", re.I)
BESIDE = frozenset("category format has hide hides no none off status tag type with without".split())
PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
ROLES = frozenset("alert banner complementary contentinfo dialog navigation search".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACE = re.compile(r"\s+")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("children", "commas", "drop", "length", "linked", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.drop = tag in DROP
        self.score = 0.0


def _attributes(raw: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(raw)}


def furniture(marks: str, tag: str = "div") -> bool:
    """Whether the classes and ids in marks name an element that is no part of a main text."""
    for mark in marks.split():
        parts = [p for p in PARTS.split(mark) if p]
        if not parts or not BESIDE.isdisjoint(p.lower() for p in parts):
            continue
        if tag == "article":
            if NO_ARTICLE.fullmatch(parts[0]):
                return True
        elif any(map(NEGATIVE.fullmatch, parts)):
            return True
    return False


def _left_out(tag: str, attrs: str, classes: bool) -> bool:
    a = _attributes(attrs)
    if a.get("role", "").lower() in ROLES or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs) or "display:none" in a.get("style", "").replace(" ", "").lower():
        return tag not in ("html", "body")
    return classes and tag not in ("html", "body", "main") and furniture(f"{a.get('class', '')} {a.get('id', '')}", tag)


class _Open:
    """The elements that are open, and where in their stack those of each name stand."""

    def __init__(self, root: Node):
        self.stack, self.where, self.walls = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in WALL:
            self.walls.append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Close the element at this place, and all in it."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.where[node.tag].pop()
            if node.tag in WALL:
                self.walls.pop()

    def last(self, *tags: str) -> int:
        """Where the last open element of one of these names stands; 0 if there is none."""
        return max(self.where[t][-1] if self.where.get(t) else 0 for t in tags)

    def first_after(self, at: int, *tags: str) -> int:
        """Where the first one above a place stands; 0 if there is none."""
        found = [w[i] for t in tags if (w := self.where.get(t)) and (i := bisect_right(w, at)) < len(w)]
        return min(found, default=0)


def parse(html: str, classes: bool = True) -> Node:
    """The tree of a page. Tags that end nothing are passed over; what a page leaves open ends with its container.

    classes: whether classes and ids count for what is left out.
    """
    root = Node("", None)
    here = _Open(root)
    at = seek = 0  # where text that is not yet in the tree begins, and where to look on
    quotes = True  # whether a bracket in quotes may be told from one that ends a tag
    while (i := html.find("<", seek)) >= 0:
        m, tag = NAME.match(html, i), ""
        if m:
            inside = INSIDE.match(html, m.end()) if quotes else None
            if inside:
                end = inside.end()
            else:
                quotes = False  # some quote is never closed: from here on the next bracket ends a tag
                end = html.find(">", m.end()) + 1
                if not end:
                    break
            tag, attrs = m[2].lower(), html[m.end() : end - 1]
        elif html.startswith("<!--", i):
            end = html.find("-->", i + 4) + 3
            end = len(html) if end < 3 else end
        elif html.startswith(("<!", "<?"), i):
            end = html.find(">", i) + 1
            if not end:
                break
        else:
            seek = i + 1
            continue
        if i > at:
            here.stack[-1].children.append(html[at:i])
        at = seek = end
        if not tag:
            continue
        if m[1]:
            place = here.last(tag)
            if place and (tag in WALL or place > here.walls[-1]):  # an inline end tag closes nothing outside its block
                here.cut(place)
            continue
        if tag in ENDS_P and here.stack[here.walls[-1]].tag == "p":
            here.cut(here.walls[-1])
        if tag in SIBLING:
            same, stop = (x.split() for x in SIBLING[tag])
            if place := here.first_after(here.last(*stop), *same):
                here.cut(place)
        node = here.stack[-1]
        new = Node(tag, node)
        if attrs and not new.drop:
            new.drop = _left_out(tag, attrs, classes)
        node.children.append(new)
        if tag in RAW:
            over = RAW_ENDS[tag].search(html, at)
            at = seek = over.start() if over else len(html)
            here.push(new)
        elif tag not in VOID and not attrs.endswith("/"):
            here.push(new)
    if at < len(html):
        here.stack[-1].children.append(BROKEN.sub("", html[at:]))
    return root


def _nodes(root: Node):
    """Nodes that are not left out, parents first."""
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in n.children if isinstance(c, Node) and not c.drop]


def _measure(root: Node) -> list[Node]:
    """Lengths, commas and linked lengths of all nodes, children before parents."""
    order = list(_nodes(root))
    for n in reversed(order):
        n.length = n.commas = n.linked = 0
        for c in n.children:
            if isinstance(c, str):
                n.length += len(c.strip())
                n.commas += c.count(",")
            elif not c.drop:
                n.length += c.length
                n.commas += c.commas
                n.linked += c.length if c.tag == "a" else c.linked
    return order


def _texts(n: Node) -> list[Node | str]:
    """The children of a container that hold text and are not left out."""
    return [c for c in n.children if (c.strip() if isinstance(c, str) else not c.drop and c.length)]


def _kept(root: Node) -> list[Node | str]:
    """The best container with those of its siblings that belong to it, in page order.

    Inside a main element that is all of it. Beside an article stand further articles, headings and paragraphs;
    beside another container whatever is not mostly links.
    """
    order = _measure(root)
    for n in order:
        if n.tag in PROSE and n.length:
            points = 1 + n.commas + min(n.length / 100, 3)
            up = n.parent
            if up is not None:
                up.score += points
                if up.parent is not None:
                    up.parent.score += points / 2
    best, most = None, 0.0
    for n in order:
        if n.score:
            n.score *= 1 - n.linked / max(1, n.length)
            if n.tag in ("article", "main"):
                n.score *= 2
            if n.score > most:
                best, most = n, n.score
    if best is None:
        return [root]
    while best.parent is not None and best.tag in PART:
        best = best.parent  # so do paragraphs left open, that hold those that follow
    above = list(_ancestors(best))
    semantic = [n for n in above if n.tag == "main"] or [n for n in above if n.tag == "article"]
    best = semantic[-1] if semantic else best
    if best.tag == "main":
        return [best]
    while best.tag not in ("article", "body") and best.parent is not None and len(_texts(best.parent)) == 1:
        best = best.parent
    if best.parent is None or best.tag == "body":
        return [best]
    kept: list[Node | str] = []
    for c in _texts(best.parent):
        if isinstance(c, str):
            belongs = best.tag != "article"
        else:
            belongs = 2 * c.linked < c.length and (best.tag != "article" or c.tag in BESIDE_ARTICLE)
        if c is best or belongs:
            kept.append(c)
    return kept


def _ancestors(n: Node | None):
    while n is not None:
        yield n
        n = n.parent


def extract(html: str | None) -> str:
    """The main text: its blocks, white space in each turned into one space, joined by line ends."""
    if not html:
        return ""
    return _text(parse(html)) or _text(parse(html, classes=False))


def _text(root: Node) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            text = SPACE.sub(" ", unescape("".join(line))).strip()
            line.clear()
            if text:
                blocks.append(text)

    for top in _kept(root):
        stack: list[Node | str | None] = [top]
        while stack:
            n = stack.pop()
            if n is None:
                end()
            elif isinstance(n, str):
                line.append(n)
            elif n.drop:
                continue
            elif n.tag == "br":
                line.append(" ")
            elif n.tag in BLOCK:
                end()
                stack.append(None)
                stack += reversed(n.children)
            else:
                stack += reversed(n.children)
        if not isinstance(top, str):
            end()
    end()
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with out: the main text of each whole page, empty if there is none or html is null or empty.

    Pages are independent, so repeated rows come out alike. Other columns pass unchanged; an input column named out is
    replaced.
    Unclosed and misnested tags, and pages that break off, are read as far as they go.
    """

    @F.pandas_udf("string")
    def main(html: pd.Series) -> pd.Series:
        return pd.Series([extract(h) for h in html], dtype="object")

    return pages.withColumn(out, main(F.col(f"`{html_col}`").cast("string")))
