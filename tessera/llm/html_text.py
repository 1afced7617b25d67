"""Main text of raw web pages by scoring the element tree.

Each paragraph passes points to its ancestors: one, one more for each comma, and up to three for its length, to
the parent in full and to the grandparent by half. A container's points are discounted by the share of its text
that stands in links. The best container's blocks are kept, and those of its siblings that read like it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A piece of markup: comment, other declaration, or a tag with its attributes; quotes after '=' may hide '>'. What is
#: not closed goes to the end, and nothing is taken back, so that no place is read twice.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
SPACE = re.compile(r"\s+")

#: Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select option xmp noembed noframes canvas audio video".split())
OPAQUE = frozenset("script style textarea title iframe xmp noembed noframes".split())
DROPPED = frozenset("nav footer aside form button menu dialog fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE_FORMAT = frozenset("a abbr b big cite code em font i mark q s small span strike strong sub sup tt u".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
CONTAINERS = frozenset("article body div main section td blockquote html center table tbody tr".split())
#: Words of class, id and role names that mark what is not the article, if they are the whole name
#: (`comments`, `cookie-notice`, but not `has-sidebar` or `category-social`), and those that mark it.
BOILERPLATE = re.compile(r"(?:ad|ads|advert\w*|banner|breadcrumbs?|byline-links|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|outbrain|pagination|pager|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|taboola|tags|toolbar|widget|complementary|contentinfo|dialog|search)(?:[_-]+(?:ad|ads|advert\w*|banner|breadcrumbs?|byline-links|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|outbrain|pagination|pager|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|taboola|tags|toolbar|widget|complementary|contentinfo|dialog|search))*", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)

HEADING = re.compile(r"(?:article|entry|post|story)[_-]?header", re.I)


class Node:
    __slots__ = ("tag", "parent", "kids", "out", "wanted", "score", "named")

    def __init__(self, tag: str, parent: Node | None, out: bool, wanted: bool):
        self.tag, self.parent, self.out, self.wanted = tag, parent, out, wanted
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.named = False


def tree(source: str) -> list[Node]:
    """The page's elements, parents before their children. Unclosed paragraphs, items and cells end as in HTML; raw elements and comments go."""
    node = Node("html", None, False, False)
    nodes = [node]
    ever: set[str] = set()  # names that were opened: another end tag needs no search
    at, n = 0, len(source)
    while at < n:
        m = MARKUP.search(source, at)
        if m is None:
            node.kids.append(entities.unescape(source[at:]))
            break
        if m.start() > at:
            node.kids.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = _closed(node, tag) if tag in ever else node
            continue
        attributes = m[3]
        if tag in RAW:
            if not attributes.rstrip().endswith("/") or tag in OPAQUE:
                at = _after(source, tag, at)
            continue
        if tag in VOID:
            node.kids.append(" " if tag in ("br", "wbr") else Node(tag, node, True, False) if tag == "hr" else "")
            continue
        if tag in ("html", "body"):
            continue
        node = _opened(node, tag)
        names = " ".join(x.strip("\"'") for x in NAMES.findall(attributes)) if "=" in attributes else ""
        wanted = tag in ("article", "main") or bool(names and ARTICLE.search(names))
        out = tag in DROPPED or tag == "head" or tag == "header" and not _inside(node, ("article", "main")) or bool(attributes and HIDDEN.search(attributes))
        kid = Node(tag, node, out, wanted)
        ever.add(tag)
        kid.named = bool(names and any(map(BOILERPLATE.fullmatch, names.split())) and tag not in ("article", "main", "h1") and not HEADING.search(names))
        node.kids.append(kid)
        nodes.append(kid)
        if not (attributes.endswith("/") and tag not in BLOCKS):
            node = kid
    return nodes


def _inside(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _after(source: str, tag: str, at: int) -> int:
    """Where the raw element ends; nested ones of its kind are counted unless its content is opaque."""
    depth, mark = 1, re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>?", re.I)
    for m in mark.finditer(source, at):
        depth += -1 if m[1] else int(tag not in OPAQUE)
        if not depth:
            return m.end()
    return len(source)


def _closed(node: Node, tag: str) -> Node:
    """The node after </tag>: above the nearest open element of that name. An inline end tag doesn't end a block,
    and no end tag ends the cell or article around it."""
    up = node
    while up.parent is not None:
        if up.tag == tag:
            return up.parent
        if tag in INLINE_FORMAT and up.tag in BLOCKS or tag == "p" and up.tag in CONTAINERS or tag not in ("table", "article", "main", "body") and up.tag in ("table", "article", "main"):
            return node
        up = up.parent
    return node


#: What an opening tag ends, if it is open within the given limits.
ENDED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
}


def _opened(node: Node, tag: str) -> Node:
    """The node under which <tag> opens."""
    if tag in CLOSES_P:
        up = node
        while up.parent is not None and up.tag not in CONTAINERS and up.tag not in ("li", "dd", "dt", "th"):
            if up.tag == "p":
                node = up.parent
                break
            if up.tag in BLOCKS:
                break
            up = up.parent
        else:
            up = node
        # a block inside open inline elements leaves them
        while node.parent is not None and node.tag in INLINE_FORMAT:
            node = node.parent
    ends, limits = ENDED.get(tag, (frozenset(), frozenset()))
    up = node
    while ends and up.parent is not None and up.tag not in limits:
        if up.tag in ends:
            return up.parent
        up = up.parent
    return node


def blocks(node: Node) -> Iterator[tuple[Node, str, int]]:
    """(block element, text, characters in links) in page order; elements that are out give nothing."""
    own: list[tuple[str, bool]] = []
    yield from _walk(node, node, own, False)
    yield from _flushed(node, own)


def _flushed(block: Node, own: list[tuple[str, bool]]) -> Iterator[tuple[Node, str, int]]:
    if own:
        text = SPACE.sub(" ", "".join(t for t, _ in own)).strip()
        if text:
            yield block, text, sum(len(t.strip()) for t, linked in own if linked)
        own.clear()


def _walk(node: Node, block: Node, own: list[tuple[str, bool]], linked: bool) -> Iterator[tuple[Node, str, int]]:
    stack = [(node, block, linked, iter(node.kids))]
    while stack:
        node, block, linked, kids = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                own.append((kid, linked))
            elif kid.tag in BLOCKS:
                yield from _flushed(block, own)
                if not kid.out:
                    stack.append((kid, kid, linked, iter(kid.kids)))
                    break
            elif not kid.out:
                stack.append((kid, block, linked or kid.tag == "a", iter(kid.kids)))
                break
        else:
            stack.pop()
            if node is block:
                yield from _flushed(block, own)


def _points(text: str) -> int:
    return 1 + sum(text.count(c) for c in ",،、，") + min(len(text) // 100, 3)


def settle(nodes: list[Node]) -> None:
    """Puts out the elements whose names mark boilerplate, but none that holds an article or main element (unless it
    stands in an article itself), and none with most of the page's points (unless an article or main element with
    points stands beside it)."""
    if not any(x.named for x in nodes):
        return
    points = dict.fromkeys(nodes, 0)
    for block, text, _ in blocks(nodes[0]):
        points[block] += _points(text)
    articles, around, inside = dict.fromkeys(nodes, 0), {}, {}
    for x in reversed(nodes):  # children come after their parents
        articles[x] += x.tag in ("article", "main") and points[x] > 0
        if x.parent is not None:
            points[x.parent] += points[x]
            articles[x.parent] += articles[x]
    for x in nodes:
        own = x.tag in ("article", "main") and points[x] > 0
        around[x] = around.get(x.parent, 0) + own
        inside[x] = inside.get(x.parent, False) or x.tag == "article"
        if x.named:
            beside = articles[nodes[0]] - articles[x] - around[x]
            x.out = x.out or not (articles[x] and not inside[x] or 2 * points[x] > points[nodes[0]] and not beside)


def main_text(source: str | None) -> str:
    """The article's blocks, white space folded, joined by two line ends; empty if the page has none."""
    if not source:
        return ""
    nodes = tree(source)
    settle(nodes)
    found = list(blocks(nodes[0]))
    if not found:
        return ""
    size: dict[Node, list[int]] = {}
    holders: dict[Node, None] = {}
    for block, text, links in found:
        points = _points(text)
        up, share = (block if block.tag in CONTAINERS else block.parent or block), 1.0
        if block.tag in ("p", "pre", "td", "blockquote", "div", "section", "article", "body", "html", "main", "li", "dd"):
            if block.tag in ("li", "dd"):
                up = up.parent or up
            for _ in range(2):
                up.score += points * share
                holders[up] = None
                if up.parent is None:
                    break
                up, share = up.parent, share / 2
        size[block] = [size.get(block, (0, 0))[0] + len(text), size.get(block, (0, 0))[1] + links]
    for x in reversed(nodes):  # children come after their parents
        if x in size and x.parent is not None:
            s = size.setdefault(x.parent, [0, 0])
            s[0] += size[x][0]
            s[1] += size[x][1]

    def value(x: Node) -> float:
        chars, links = size[x]
        bonus = 25 if x.tag in ("article", "main") else 10 if x.wanted else 0
        return (x.score + bonus) * (1 - links / max(chars, 1))

    if not holders:
        return ""
    best = max(holders, key=value)
    while best.parent is not None and best.tag not in CONTAINERS:
        best = best.parent
    up = best
    while up.parent is not None:  # an article or main element around the best container is the article
        up = up.parent
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
    keep = {best}
    if best.tag not in ("article", "main") and best.parent is not None:
        least = max(10.0, 0.2 * value(best))
        for kid in best.parent.kids:
            if isinstance(kid, Node) and kid is not best and not kid.out and kid in size:
                chars, links = size[kid]
                paragraph = kid.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and links <= 0.25 * chars
                if paragraph or kid.tag in CONTAINERS and value(kid) >= least and kid.score:
                    keep.add(kid)
    elif best.tag == "article" and best.parent is not None:  # several articles of one page stand side by side
        for kid in best.parent.kids:
            if isinstance(kid, Node) and kid.tag == "article" and not kid.out and kid in size and value(kid) >= 0.2 * value(best):
                keep.add(kid)
    for x in nodes:
        if x.parent in keep:
            keep.add(x)
    return "\n\n".join(text for block, text, _ in found if block in keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every row, from the whole page.

    A null or empty page, and one without text, gives the empty text. Repeated rows stay repeated; of containers with
    equal points the first in the page is taken; columns besides the three are not read; an empty table gives an empty
    result. Pages are read whole, however long, one page's tree in memory at a time. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return out.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
