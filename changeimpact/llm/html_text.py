"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Subtrees that are no article by their element, role or visibility (menus, footers,
dialogs, scripts, styles) fall away first. A name (class or id) marks a subtree only if all its words are such as
``cookie-notice`` or ``share-buttons`` (not ``has-sidebar``, ``share-price``, ``related-work``); a marked subtree, or a form, falls away
unless it holds an article or main element or nearly all text of the page. Each paragraph then gives points for its length and
its commas to its parent, fewer to each further ancestor; a container's points are discounted by the share of its text that
stands in links. Where the best container is in an article element, that one is kept with the titles and paragraphs beside it,
what else is in its main element, and those siblings that score well; lists of links inside it too unless they are marked as a
menu. Elsewhere every container of paragraphs that isn't mostly links is kept whole, and around these all headings and blocks
but link-heavy ones that score low.

Pages are rows of Arrow batches: no shuffle, memory bounded by a batch. Work is linear in the page: points rise a fixed number
of levels, and open elements are found by their name. Defined results: null, empty and text-free pages give ''; broken markup
is read as far as it goes; repeated rows get equal results; input columns named like a result column are replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from changeimpact.llm.common import ship, without

RESULT = ("text", "n_chars")
# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset({"thead", "tbody", "tfoot"})
#: What an opening tag ends if it is still open, up to the listed borders.
ENDS = {
    "li": ({"li"}, BLOCK - {"li", "p", "div", "address"}), "dt": ({"dt", "dd"}, BLOCK - {"dt", "dd", "p", "div", "address"}),
    "dd": ({"dt", "dd"}, BLOCK - {"dt", "dd", "p", "div", "address"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    **{x: (SECTIONS | {"tr", "td", "th", "caption"}, {"table"}) for x in SECTIONS}, "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
# Elements, roles and names that no article text stands in.
DROPPED = frozenset("nav footer aside select menu dialog script style title textarea noscript iframe template svg canvas object head xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent "
    "gdpr notice notices notification alert newsletter subscribe subscription signup popup modal overlay sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead toolbar pagination pager share sharing social related recommended recommendations teaser "
    "comment comments commentlist reply replies disqus respond widget widgets login skip".split()
)
# Words that say nothing beside such a name: a name of these and at least one of NAMES is a mark.
PLAIN = frozenset(
    "site page top bottom left right main global primary secondary inner outer box block wrap wrapper container area section bar panel list "
    "item items link links button buttons group row col header head body text content form inline fixed sticky small large js fb post".split()
)
# A button counts as text only in a sentence.
SENTENCE = frozenset("p li dd td".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPLIT_NAME = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
LEVELS, SHORT = (1.0, 0.5, 0.25, 0.125, 0.0625), 25
#: Characters outside marked subtrees beyond which a large marked one (reader comments, say) is no article.
ENOUGH = 200


class Node:
    __slots__ = ("tag", "up", "children", "chars", "linked", "links_more", "points", "direct", "bonus", "dropped", "marked", "over")

    def __init__(self, tag: str, up: Node | None, bonus: float = 0.0, dropped: bool = False, marked: bool = False):
        self.tag, self.up, self.bonus, self.dropped, self.marked, self.over = tag, up, bonus, dropped, marked, False
        self.children: list[Node | str] = []
        self.chars = self.linked = self.links_more = 0
        self.points = self.direct = 0.0


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def no_article(tag: str, at: dict[str, str], inside: bool) -> bool:
    """Whether a subtree can't be article text. A header inside an article is looked into for its headings."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not at:
        return False
    if "hidden" in at or at.get("aria-hidden") == "true" or at.get("role", "").lower() in ROLES:
        return True
    return "display:none" in at.get("style", "").replace(" ", "").lower()


def is_mark(name: str) -> bool:
    words = {w.lower() for w in SPLIT_NAME.split(name) if w}
    return bool(words & NAMES) and words <= NAMES | PLAIN


def marked(tag: str, at: dict[str, str]) -> bool:
    """Whether a subtree's element or names say that it is probably no article."""
    if tag in ("form", "button"):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return at.get("role", "").lower() == "form" or any(map(is_mark, [*at.get("class", "").split(), *at.get("id", "").split()]))


class Open:
    """The open elements, outermost first, with the places of each name among them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.dropped_blocks: list[int] = []
        self.articles = 0

    @property
    def here(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.places[node.tag].append(at)
        if node.dropped and node.tag in BLOCK | DROPPED:
            self.dropped_blocks.append(at)
        self.articles += node.tag in ("article", "main")
        self.stack.append(node)

    def forget(self, node: Node) -> None:
        self.places[node.tag].pop()
        self.articles -= node.tag in ("article", "main")

    def cut(self, first: int) -> None:
        """Ends the element at a place and all inside it, and those outside it that are over already."""
        while len(self.stack) > max(first, 1) or (len(self.stack) > 1 and self.here.over):
            node = self.stack.pop()
            if not node.over:
                self.forget(node)
            if self.dropped_blocks and self.dropped_blocks[-1] == len(self.stack):
                self.dropped_blocks.pop()

    def end(self, tags: set[str], borders: set[str]) -> None:
        """Ends the outermost open element of ``tags`` inside the nearest border."""
        own = [self.places[t] for t in tags if self.places.get(t)]
        if own:
            border = max((self.places[t][-1] for t in borders if self.places.get(t)), default=0)
            # A border that is one of the tags is searched like them.
            inside = [p[i] for p in own if (i := bisect_right(p, border)) < len(p)]
            if inside:
                self.cut(min(inside))

    def close(self, tag: str) -> None:
        """Ends the nearest open element of the tag, with all inside it. An inline one doesn't end a dropped block inside it."""
        names = HEADING if tag in HEADING else (tag,)
        at = max((self.places[t][-1] for t in names if self.places.get(t)), default=0)
        if at:
            inner = bool(self.dropped_blocks) and self.dropped_blocks[-1] > at
            if inner and tag not in BLOCK and not self.stack[at].dropped:
                self.forget(self.stack[at])
                self.stack[at].over = True
            else:
                self.cut(at)


def tree(page: str) -> Node:
    """The page's elements without the subtrees that are no article.

    Elements of such a subtree are open like others, so optional end tags and close tags of open ancestors
    end it; they hang on no parent.
    """
    root = Node("html", None)
    at, end = 0, len(page)
    opened = Open(root)
    while at < end:
        found = TAG.search(page, at)
        cut = found.start() if found else end
        if cut > at:
            if opened.here.tag == "head" and not page[at:cut].isspace():
                opened.cut(len(opened.stack) - 1)
            if not opened.here.dropped:
                opened.here.children.append(page[at:cut])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            opened.close(tag)
            continue
        source = found[3] or ""
        if opened.here.tag == "head" and tag not in IN_HEAD:
            opened.cut(len(opened.stack) - 1)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in BLOCK:
            opened.end({"p"}, {"table", "button", "object", "foreignobject"})
        if tag in ENDS:
            opened.end(*ENDS[tag])
        if tag in HEADING and opened.here.tag in HEADING:
            opened.cut(len(opened.stack) - 1)
        here = opened.here
        closed = source.endswith("/")
        if tag in VOID or (closed and (tag == "svg" or (here.dropped and tag not in BLOCK))):
            if tag in VOID and not here.dropped:
                here.children.append(Node(tag, here))
            continue
        given = attributes(source) if not here.dropped and source.strip("/ \n\t\r") else {}
        dropped = here.dropped or no_article(tag, given, opened.articles > 0)
        main = tag in ("article", "main") or given.get("role") == "main" or given.get("itemprop") == "articleBody"
        node = Node(tag, here, 25.0 if main else 0.0, dropped, not dropped and marked(tag, given))
        if not dropped:
            here.children.append(node)
        opened.push(node)
    return pruned(root)


def pruned(root: Node) -> Node:
    """The tree without marked subtrees that are small beside the rest, or beside which there is enough text."""
    order = walk(root)
    size: dict[Node, int] = {}
    holds: set[Node] = set()
    for node in reversed(order):
        size[node] = sum(len(c.strip()) if isinstance(c, str) else size[c] for c in node.children)
        if node.bonus or any(c in holds for c in node.children if isinstance(c, Node)):
            holds.add(node)
    if not any(n.marked for n in order):
        return root
    outside, todo = 0, [root]
    while todo:  # text under no mark
        node = todo.pop()
        if not node.marked:
            outside += sum(len(c.strip()) for c in node.children if isinstance(c, str))
            todo.extend(c for c in node.children if isinstance(c, Node))
    for node in order:
        if node.marked and node.up is not None:
            if node.tag == "button":
                away = not (node.up.tag in SENTENCE and size[node.up] > size[node])
            else:
                away = node not in holds and (2 * size[node] < size[root] or outside >= ENOUGH)
            if away:
                node.dropped = True
    for node in order:
        if not node.dropped:
            node.children = [c for c in node.children if isinstance(c, str) or not c.dropped]
    return root


def plain(text: str) -> str:
    return " ".join(html.unescape(text).split()) if "&" in text else " ".join(text.split())


def walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return order


def weigh(root: Node) -> list[Node]:
    """Sizes of all nodes, and the points that paragraphs pass up."""
    order = walk(root)
    for node in reversed(order):
        own = commas = links = 0
        for c in node.children:
            if isinstance(c, str):
                own += len(c.strip())
                commas += c.count(",") + c.count("，") + c.count("、")
            else:
                node.chars += c.chars
                node.linked += c.linked
                if c.tag not in BLOCK:
                    own += c.chars - c.linked
                    links += c.linked
        node.chars += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.links_more = links - own  # of the text outside inner blocks
        if node.tag == "a":
            node.linked = node.chars
        if node.tag in BLOCK and node.tag not in HEADING and own > 0:
            points = 1.0 + commas + min(own / 100.0, 3.0) if own >= SHORT else 0.5
            # A paragraph's parent is its container; text right in a container counts for that one.
            first = node.up if node.tag in ("p", "pre", "blockquote", "li", "dd", "td") and node.up else node
            if own >= SHORT:
                first.direct += points
            for share in LEVELS:
                if first is None:
                    break
                first.points += points * share
                first = first.up
    return order


def score(node: Node) -> float:
    density = node.linked / node.chars if node.chars else 1.0
    return (node.points + (node.bonus if node.points else 0.0)) * (1.0 - density)


def kept_nodes(root: Node) -> tuple[list[Node], set[Node], float]:
    """What is kept, in page order; the containers that are kept whole; and the points that link-heavy blocks around them need."""
    order = weigh(root)
    best = max((n for n in order if n.tag in BLOCK or n is root), key=score, default=root)
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.up
    bar = max(10.0, 0.2 * score(around or best))
    if around is None:
        whole = {n for n in order if n.direct and 2 * n.linked < n.chars} | {best}
        return [root], whole if best.direct else {root}, bar
    over = around.up
    while over is not None and over.tag != "main":
        over = over.up
    if around.tag == "article" and over is not None:  # all of main but other articles that score low and lists of links
        for node in order:
            if node.up is not None and node.tag == "article" and node is not around and score(node) < bar and not within(around, node):
                node.up.children = [c for c in node.up.children if c is not node]
        return [over], {around}, bar
    out = [c for c in around.up.children if isinstance(c, Node) and (c is around or (c.chars and (score(c) >= bar or is_text(c))))]
    return out, set(out), bar


def within(node: Node, outer: Node) -> bool:
    while node is not None and node is not outer:
        node = node.up
    return node is outer


def is_text(node: Node) -> bool:
    """A title or paragraph that isn't mostly links."""
    return node.tag in HEADING or (node.tag in ("p", "blockquote", "hgroup") and 2 * node.linked < node.chars)


def blocks(nodes: list[Node], whole: set[Node], bar: float) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = plain("".join(run))
        run.clear()
        if text:
            out.append(text)

    for top in nodes:
        # Each with whether only its headings count, whether it is in a container kept whole, and whether its own text is left out.
        todo: list[tuple[Node | str | None, bool, bool, bool]] = [(top, False, False, False)]
        while todo:
            item, heading_only, inside, heavy = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                if not (heading_only or heavy):
                    run.append(item)
            elif item.tag == "br":
                run.append(" ")
            else:
                block = item.tag in BLOCK
                only = (heading_only or item.tag == "header") and item.tag not in HEADING
                inside = inside or item in whole
                if inside or item.tag in HEADING:
                    heavy = False
                elif block:
                    heavy = item.links_more > 0 and score(item) < bar
                if block:
                    flush()
                    todo.append((None, False, False, False))
                todo.extend((c, only, inside, heavy) for c in reversed(item.children))
        flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(blocks(*kept_nodes(tree(page))))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with text (blocks joined by line ends) and n_chars (its code points)."""
    ship(pages.sparkSession)
    base = without(pages, *RESULT)
    at = base.columns.index("html")
    schema = T.StructType([*base.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(at)]
            added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return base.mapInArrow(run, schema)
