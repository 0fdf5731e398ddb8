"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import slices, table, text_or_empty

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Content that is not markup: it ends with its own end tag only.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main",
         "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
         "title", "tr", "ul"}
#: What a start tag ends: an open element of the first set, not looked for beyond the second.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
          "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "body": ({"head"}, {"html"})}
GONE = RAW | {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "search", "svg", "math", "canvas", "object", "audio", "video", "head", "map", "fieldset"}
GONE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words of class and id names.
GONE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist",
              "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
              "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "related", "respond", "replies", "rss", "share", "sharing", "sidebar",
              "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "alert"}
GOOD_WORDS = {"article", "blog", "body", "content", "entry", "hentry", "main", "post", "story", "text"}
#: Never dropped by their names, but for an article that is a comment or an advert.
NEVER = {"html", "body", "article", "main"}
SMALL_ARTICLE = {"ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "related", "teaser"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Points a container starts with.
START = {"article": 30.0, "main": 20.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0}
#: Points for a good name.
NAMED = 25.0
#: Shares of a block's points from its container upwards.
PASSED = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12, 1 / 15)
COMMAS = re.compile("[,،、，]")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: White space, the no-break space included.
BLANKS = re.compile("[\\s ]+")


class Node:
    """An element: what it passes to its container is summed up once the page is read."""

    __slots__ = ("tag", "parent", "gone", "doubtful", "inside", "weight", "points", "chars", "linked", "kept")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.gone, self.doubtful, self.kept = tag, parent, False, False, False
        self.inside = bool(parent and (parent.inside or parent.tag in ("article", "main")))
        self.weight = START.get(tag, 0.0)
        self.points, self.chars, self.linked = 0.0, 0, 0

    def score(self) -> float:
        return (self.points + self.weight) * (1 - self.linked / max(1, self.chars))


def _names(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}


def _judge(node: Node, attributes: str) -> None:
    """Whether an element is no part of any article, by its names alone or if its text agrees, and the points its names are worth."""
    if node.tag in GONE or node.tag == "header" and not node.inside:
        node.gone = True
        return
    if "=" not in attributes and "hidden" not in attributes:
        return
    a = _names(attributes)
    words = {w.lower() for w in WORD.findall(f"{a.get('class', '')} {a.get('id', '')}")}
    if node.tag not in NEVER or node.tag == "article" and words & SMALL_ARTICLE:
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))
        names = words & GONE_WORDS or "header" in words and not node.inside
        excused = words & GOOD_WORDS and not words & SMALL_ARTICLE
        node.gone = bool(hidden or a.get("role", "").lower() in GONE_ROLES or names and not excused or node.tag == "article")
        node.doubtful = bool(names) and not node.gone
    if not node.doubtful and words & GOOD_WORDS or a.get("role") == "main":
        node.weight += NAMED


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, and the blocks of text in page order: the block element each lies in, its text, how much of it is links."""
    root = Node("html", None)
    nodes, stack, out, text, linked, at = [root], [root], [], [], 0, 0
    count = Counter()  # open elements by tag; "" counts those that are no part of an article
    here = root  # the innermost block element

    def flush() -> None:
        nonlocal linked
        if text:
            if said := BLANKS.sub(" ", "".join(text)).strip():
                out.append((here, said, min(linked, len(said))))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not count[""]:
            piece = html.unescape(piece)
            text.append(piece)
            if count["a"]:
                linked += len(piece.strip())

    def close(k: int) -> None:
        nonlocal here
        if any(x.tag in BLOCK or x.gone for x in stack[k:]):
            flush()
        while len(stack) > k:
            node = stack.pop()
            count[node.tag] -= 1
            count[""] -= node.gone
        here = next((x for x in reversed(stack) if x.tag in BLOCK), root)

    def last(tags: set[str], limit: set[str] = frozenset()) -> int:
        """Where the innermost open element of ``tags`` is, not beyond one of ``limit``; 0 if none."""
        if any(count[t] > 0 for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return i
                if stack[i].tag in limit:
                    break
        return 0

    while m := TOKEN.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            # an inline end tag closes nothing that is a block
            if k := last({tag}, frozenset() if tag in BLOCK else BLOCK):
                close(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "html" or tag == "body" and count["body"]:
            continue
        if tag in BLOCK:
            if k := last({"p"}, {"td", "th", "div", "li"}):
                close(k)
            if tag in CLOSES and (k := last(*CLOSES[tag])):
                close(k)
            flush()
        if tag == "br":
            add(" ")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK | RAW:
            continue
        node = Node(tag, stack[-1])
        _judge(node, m[3])
        if node.gone and tag not in BLOCK:
            add(" ")
        nodes.append(node)
        stack.append(node)
        count[tag] += 1
        count[""] += node.gone
        if tag in BLOCK:
            here = node
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            close(len(stack) - 1)
    add(page[at:])
    flush()
    return nodes, out


def _add_up(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Characters of text and of links below each element."""
    for x in nodes:
        x.chars = x.linked = 0
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
    for x in reversed(nodes[1:]):
        x.parent.chars += x.chars
        x.parent.linked += x.linked


def main_text(page: str) -> str:
    """The text of the article: all blocks of the best container, however short, and of siblings that belong to it.

    A block gives a point, one for each comma and one for each 100 characters (three at most), less the
    share of it that is links, to the container of its paragraph, half to the one above, and less to
    four more. A container's points count less the share of links in all of its text; of containers
    with equal points the first of the page is the best.
    """
    nodes, blocks = parse(page)
    _add_up(nodes, blocks)
    said, over = nodes[0].chars - nodes[0].linked, set()
    for x in nodes:
        if x.tag in ("article", "main") and x.chars and not x.gone:
            while x and x not in over:
                over.add(x)
                x = x.parent
    for x in nodes:
        # good and bad names: a frame around the article holds it or most of the page's text, a box beside it doesn't
        beside = over and x not in over and not x.inside
        x.gone |= bool(x.parent and x.parent.gone) or x.doubtful and (bool(beside) or 2 * (x.chars - x.linked) <= said)
    blocks = [b for b in blocks if not b[0].gone]
    _add_up(nodes, blocks)
    for node, text, linked in blocks:
        points = (1 + len(COMMAS.findall(text)) + min(len(text) // 100, 3)) * (1 - linked / len(text))
        x = node.parent if node.parent and (node.tag == "p" or node.tag in HEADINGS or node.tag in ("li", "dd", "dt")) else node
        for share in PASSED:
            if x:
                x.points += points * share
                x = x.parent
    some = [x for x in nodes if x.points and not x.gone]
    if not some:
        return ""
    best = max(some, key=Node.score)
    for tag in ("article", "main"):
        x = best
        while x and x.tag != tag:
            x = x.parent
        if x:
            best = x
            break
    # plain boxes around the best container, up to one that is named as the article's, hold parts of the article
    around = set()
    x = best
    while x.tag in ("div", "section") and x.weight < NAMED and x.parent and x.parent.tag in ("div", "section"):
        x = x.parent
        around.add(x)
    top, least = x, 0.2 * best.points
    for x in nodes:
        part = x.parent in around or x.parent is top.parent and x.tag not in ("html", "body", "main") and (
            x.points >= least and (x.chars > 80 or x.points >= 10) or x.tag in HEADINGS or x.tag == "p") or x.tag == top.tag == "article"
        x.kept = not x.gone and (x is best or x in around or part and x.linked <= 0.25 * x.chars
                                 or bool(x.parent and x.parent.kept and x.parent not in around))
    return "\n".join(text for node, text, _ in blocks if node.kept)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key, url, text string, n_chars long`` of every page.

    A null, empty or all-boilerplate page has an empty text and 0 characters. Pages are independent: no
    shuffle, memory follows the longest page; null keys and repeated rows keep rows of their own, other
    columns are not carried.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "h"):
            found = [main_text(x) for x in part.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), part.column("u"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["k", "u", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    return (pages.select(F.col(key).alias("k"), F.col(url).alias("u"), text_or_empty(source).alias("h"))
            .mapInArrow(work, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars long")
            .withColumnsRenamed({"k": key, "u": url}))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
