"""Main text of web pages by composite text density.

1. A page becomes a tree of elements; scripts, styles and what is marked as navigation, header, footer, sidebar, notice,
   advert, form or comment (by element, role, or the words of class and id) is left out.
2. Every node gets its characters C, tags T, link characters LC and link tags LT, and from them the composite density
   C / T * log(C * T / (LC * LT), base ln(C * LC / (C - LC) + LCb * C / Cb + e)), b being the body: characters per tag, lowered by links.
3. A container's sum is the sum of its children's densities. The container of the largest sum is the heart of the page;
   where the page has article (else main) elements with text, only they and what they hold are candidates.
4. The least density on the path from body to the heart is the threshold. An article's or main's whole element is taken; else
   further subtrees of that density, with their own largest sums, join it. Texts are read off block by block.

Characters are counted without the white space that is collapsed. Pages are taken one by one, so memory follows the longest.

Defined cases: a null page is empty; a page without text gives the empty string; text outside any element is the body's;
tags that are never closed end with their parent; a comment, script or tag that never ends runs to the end of the page; ties go
to the earlier node; rows that repeat are answered one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.llm.common import map_batches

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold running text; the heart of a page is a block that may hold several of them.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre dt dd li td th figcaption summary address".split())
NEVER_TEXT = frozenset(
    "script style noscript template title textarea iframe object embed svg math canvas audio video map nav footer aside form button select option input"
    " label fieldset dialog menu xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
#: Words in class or id that mark what is no article text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr"
    " header login masthead menu menubar modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related respond share sharing"
    " sidebar signup skip social sponsor sponsored sponsors subscribe toolbar topbar widget widgets".split()
)
#: Words that say that an article element is not the page's article, and do not only tell of its parts.
MARKS_OF_ARTICLES = frozenset("ad ads advert comment comments promo related sponsored teaser".split())
#: Deeper elements become siblings, as in browsers; their text stays.
MOST_DEEP = 512
#: An element on the left ends an open one on the right that it cannot lie in.
CLOSES = {t: ("p",) for t in BLOCKS - {"body", "html"}}
CLOSES |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: No end tag and no implied end reaches beyond these.
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}


class Node:
    __slots__ = ("tag", "parent", "parts", "depth", "chars", "tags", "link_chars", "link_tags", "density", "sum", "left_out")

    def __init__(self, tag: str, parent: Node | None, left_out: bool = False):
        self.tag, self.parent, self.left_out = tag, parent, left_out
        self.parts: list[Node | str] = []
        self.depth: int = 0 if parent is None else parent.depth + 1
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def is_marked(tag: str, attributes: str, parent: Node) -> bool:
    """Whether an element is no article text by its name, role, or the words of its class and id."""
    if tag in NEVER_TEXT:
        return True
    if tag == "header" and not _inside(parent, ("article", "main")):
        return True
    if not attributes or attributes.isspace():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            marks = MARKS_OF_ARTICLES if tag == "article" else MARKS
            if not marks.isdisjoint(w.lower() for w in NAME_WORD.findall(value)):
                return True
    return False


def _inside(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def tree_of(page: str) -> Node:
    """The page as elements below one body."""
    body = Node("body", None)
    here, at, size = body, 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            here.parts.append(page[at:])
            break
        following = page[lt + 1 : lt + 2]
        if following == "!" or following == "?":
            if lt > at:
                here.parts.append(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        found = TAG.match(page, lt) if following.isalpha() or following == "/" else None
        if found is None:
            if following.isascii() and following.isalpha() and page.find(">", lt) < 0:  # a tag that never ends
                here.parts.append(page[at:lt])
                break
            here.parts.append(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            here.parts.append(page[at:lt])
        at = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        tag = tag.lower()
        if closing:
            here = _end(here, tag)
            continue
        if tag in ("html", "head", "body"):
            continue
        for open_tag in CLOSES.get(tag, ()):
            here = _imply_end(here, open_tag, WALLS.get(tag, ()))
        node = Node(tag, here, here.left_out or is_marked(tag, attributes, here))
        here.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}[^>]*>", re.IGNORECASE).search(page, at)
            at = size if close is None else close.end()
        elif tag not in VOID and node.depth < MOST_DEEP:
            here = node
    return body


def _end(here: Node, tag: str) -> Node:
    """The open element after an end tag: inline ends stop at a block, others at the body."""
    node, inline = here, tag not in BLOCKS
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if (inline and node.tag in BLOCKS) or node.tag in WALLS.get(tag, ()):
            return here
        node = node.parent
    return here


def _imply_end(here: Node, open_tag: str, walls: tuple[str, ...]) -> Node:
    node = here
    while node.parent is not None:
        if node.tag == open_tag:
            return node.parent
        if node.tag in walls or (node.tag in BLOCKS and node.tag not in TEXT_BLOCKS and not walls):
            return here
        node = node.parent
    return here


def measure(body: Node) -> list[Node]:
    """Counts, densities and sums of all nodes that are not left out; the nodes in page order."""
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.left_out]
    for node in reversed(order):
        own = [html.unescape(p) if "&" in p else p for p in node.parts if isinstance(p, str)]
        node.chars += sum(len(" ".join(p.split())) for p in own)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        up = node.parent
        if up is not None:
            up.chars, up.tags = up.chars + node.chars, up.tags + node.tags + 1
            up.link_chars, up.link_tags = up.link_chars + node.link_chars, up.link_tags + node.link_tags
    share = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        node.density = composite(node.chars, max(1, node.tags), node.link_chars, node.link_tags, share)
        if node.parent is not None:
            node.parent.sum += node.density
    return order


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, the less the more of both lies in links; ``share`` is the body's share of link characters."""
    if not chars:
        return 0.0
    links, bare = max(1, link_chars), max(1, chars - link_chars)
    base = math.log(chars * links / bare + share * chars + math.e)  # above 1
    return chars / tags * max(0.0, math.log(chars * tags / (links * max(1, link_tags)))) / math.log(base)


def content_nodes(order: list[Node]) -> list[Node]:
    """The selected subtrees."""
    containers = [n for n in order if n.tag in BLOCKS and n.tag not in TEXT_BLOCKS and n.chars]
    if not containers:
        return []
    scopes = next((s for s in ([n for n in containers if n.tag == t] for t in ("article", "main")) if s), [])
    inside = {id(n) for n in scopes}
    if scopes:
        for n in order:  # parents come first
            if n.parent is not None and id(n.parent) in inside:
                inside.add(id(n))
    heart = max((n for n in containers if not scopes or id(n) in inside), key=lambda n: n.sum or n.density)
    path = [heart]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    whole = [n for n in path if scopes and n.tag == scopes[0].tag]
    threshold = min(n.density for n in path)
    if whole:
        # the outermost article, and others beside it that are as dense as the path
        chosen = whole[-1]
        return [n for n in scopes if n is chosen or (n.density >= threshold and n.parent is chosen.parent)]
    taken, stack, out = set(), [path[-1]], [heart]
    while stack:
        node = stack.pop()
        if node is heart:
            continue
        if node in path:
            stack += [p for p in node.parts if isinstance(p, Node) and not p.left_out]
        elif node.density >= threshold and node.chars and id(node) not in taken:
            taken.add(id(node))
            out.append(node)
    return out


def blocks_of(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below the chosen nodes, in page order."""
    lines: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            lines.append(text)
        held.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            part = stack.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                held.append(part)
            elif not part.left_out:
                if part.tag in BLOCKS:
                    flush()
                    stack.append(None)
                elif part.tag == "br":
                    held.append("\n")
                stack += reversed(part.parts)
        flush()
    return lines


def main_text(page: str) -> str:
    order = measure(tree_of(page))
    chosen = {id(n) for n in content_nodes(order)}
    return "\n".join(blocks_of([n for n in order if id(n) in chosen]))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def step(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in batch["html"].fill_null("").to_pylist()]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(rows, step, "page_id long, url string, text string, n_chars long")
