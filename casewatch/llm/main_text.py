"""Main text of web pages by tree scoring.

Every paragraph passes points for its length and commas to its ancestors, less with each level; a
container's points are discounted by the share of its text that stands in links. The best
container is kept together with those of its siblings that score a fifth of it or read like prose. Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left
out by element and by class or id before scoring.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import emit, per_batch

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title"}
DROPPED = {
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select",
    "option", "textarea", "input", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "dialog", "menu",
}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|header|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notice|alert|pager|pagination|popup|promo\w*|recommend\w*|related|replies|"
    r"respond|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "pre", "blockquote", "ul", "ol", "dl", "table", "figure"}
# names of reader comments themselves, not of pages that have or lack them
READERS = re.compile(r"(?:^|\s)(?:comments?|commentlist|disqus|replies|respond)(?:$|\s|[_-](?!(?:open|closed|on|off)\b))", re.I)
IN_HEAD = {"base", "link", "meta", "title", "noscript", "script", "style", "template", "head"}
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "noise", "named", "up", "items", "score", "chars", "linked")

    def __init__(self, tag: str, noise: bool, up: Node | None):
        self.tag, self.noise, self.up = tag, noise, up
        self.named = ""  # class, id and role of an element that they call noise
        self.items: list = []
        self.score, self.chars, self.linked = 0.0, 0, 0


class Tree(HTMLParser):
    """A tree of elements and texts; unclosed and stray tags are tolerated, depth is no problem."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", False, None)
        self.named: list[Node] = []

    def open_tags(self, until: set[str]):
        node = self.at
        while node.up is not None and node.tag not in until:
            yield node
            node = node.up

    def leave_head(self):
        for node in self.open_tags(set()):
            if node.tag == "head":
                self.at = node.up
                return

    def handle_starttag(self, tag, attrs):
        if tag == "body" or self.at.tag == "head" and tag not in IN_HEAD:
            self.leave_head()
        if tag in CLOSES_P:
            for node in self.open_tags({"table", "button", "object"}):
                if node.tag == "p":
                    self.at = node.up
                    break
        if tag in SAME:
            same, stop = SAME[tag]
            for node in self.open_tags(stop):
                if node.tag in same:
                    self.at = node.up
                    break
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        node = Node(tag, tag in DROPPED or hidden, self.at)
        if names and not node.noise and tag not in ("html", "body", "article", "main") and NOISE.search(names):
            node.named = names
            self.named.append(node)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.up

    def handle_endtag(self, tag):
        for node in self.open_tags(set()):
            if node.tag == tag:
                self.at = node.up
                return

    def handle_data(self, data):
        if self.at.tag == "head" and not data.isspace():
            self.leave_head()
        self.at.items.append(data)


def blocks(top: Node) -> list[tuple[Node, str, int]]:
    """(element, text, characters in links) of every block below ``top``, in page order.

    A heading of an article stays although it may stand in a header element.
    """
    out, text, linked = [], [], 0

    def flush(owner):
        nonlocal text, linked
        joined = WHITE.sub(" ", "".join(text)).strip()
        if joined:
            out.append((owner, joined, linked))
        text, linked = [], 0

    stack = [(top, 0, False)]
    while stack:
        node, i, in_link = stack.pop()
        if i == 0 and node.tag not in INLINE:
            flush(node.up or node)
        while i < len(node.items):
            item = node.items[i]
            i += 1
            if isinstance(item, str):
                text.append(item)
                linked += len(item) if in_link else 0
            elif item.tag == "br":
                text.append(" ")
            elif not item.noise and not (item.tag == "header" and not any(n.tag == "article" for n in _ups(item))):
                stack.append((node, i, in_link))
                stack.append((item, 0, in_link or item.tag == "a"))
                break
        else:
            if node.tag not in INLINE:
                flush(node)
    flush(top)
    return out


def _ups(node: Node):
    while node is not None:
        yield node
        node = node.up


def settle(tree: Tree) -> None:
    """Elements that only their names call noise become noise, but for those that hold the page's main part.

    These hold more than half of the paragraph points, or the only article, while no article beside
    them has text. Reader comments are spared only where no text is left without them.
    """
    found, held, story = [], dict.fromkeys(tree.named, 0.0), set()
    for owner, text, linked in blocks(tree.root) if tree.named else []:
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(1.0, linked / len(text)))
        if points <= 0:
            continue
        near, articles = None, set()
        for node in _ups(owner):
            if node.tag in ("article", "main"):
                articles.add(node)
            if node.named:
                near = near or node
                held[node] += points
                if articles:
                    story.add(node)
        found.append((points, near, articles))
    total, spared = sum(f[0] for f in found), set()
    inner: dict = {}
    for node in tree.named:
        inner.setdefault(next((u for u in _ups(node.up) if u.named), None), []).append(node)
    outer = set(inner.get(None, []))
    while True:
        free = [articles for _, near, articles in found if near is None or near in spared]
        told = set().union(*free)
        may = [n for n in outer if held[n] > 0 and (not free or not READERS.search(n.named) and (
            2 * held[n] > total or n in story and not told) and (not told or told.issubset(_ups(n))))]
        if not may:
            break
        best = max(may, key=lambda n: (not READERS.search(n.named), held[n]))
        spared.add(best)
        outer = (outer - {best}).union(inner.get(best, []))
    for node in tree.named:
        node.noise = node not in spared


def main_text(html: str) -> str:
    """The article's blocks joined by an empty line; '' where there are none."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    settle(tree)
    found = blocks(tree.root)
    if not found:
        return ""
    seen: dict[int, Node] = {}
    for owner, text, linked in found:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        for depth, node in enumerate(_ups(owner.up if owner.tag in ("p", "pre", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td") else owner)):
            if len(text) >= 25:
                node.score += points / (1 if depth == 0 else 2 * depth if depth < 3 else 3 * depth)
            node.chars += len(text)
            node.linked += linked
            seen[id(node)] = node
    rated = lambda n: n.score * (1 - min(1.0, n.linked / max(n.chars, 1))) + (1e-9 if n.tag == "article" else 0)
    pool = [n for n in seen.values() if n.up is not None] or [tree.root]
    articles = [n for n in pool if n.tag in ("article", "main")]
    best = max(articles or pool, key=rated)
    whole = best.up or best
    bar, kept = 0.2 * rated(best), []
    for item in whole.items if best.up is not None else [best]:
        if item is best:
            kept.append(item)
        elif isinstance(item, Node) and not item.noise and item.tag not in INLINE and (item.tag != "header" or any(n.tag == "article" for n in _ups(item))):
            own = blocks(item)
            size = sum(len(t) for _, t, _ in own)
            dense = sum(k for _, _, k in own) / max(size, 1)
            if size and (rated(item) >= bar > 0 or item.tag in PROSE and (dense < 0.25 if size > 80 else not dense)):
                kept.append(item)
    return "\n\n".join(text for node in kept for _, text, _ in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html).

    A null or empty html, or one without prose, gives an empty text. Repeated rows stay; other
    columns are ignored. No shuffle, one page at a time.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batch):
        texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
        yield emit(out, page_id=batch.column("page_id"), url=batch.column("url"), text=texts, n_chars=[len(t) for t in texts])

    return source.mapInArrow(per_batch(run), "page_id long, url string, text string, n_chars long")
