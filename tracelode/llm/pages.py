"""Main text of web pages by tree scoring.

A tolerant parse gives a tree without scripts, styles, menus, forms and the like.  Each
paragraph passes points for its length and commas to its ancestors, less with each
level; a container's points are discounted by its link density.  The best container is
kept with the headings, lists, tables, quotes and text blocks that stand beside it or
beside what holds it.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from tracelode.llm.frames import over_batches

SCHEMA = "page_id long, url string, text string, n_chars long"

# Fixed lists of element names and of words in class, id and role attributes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript template iframe svg math xmp noembed noframes".split()
DROPPED = set("head nav footer aside form button select option dialog menu object audio video canvas map fieldset label".split()) | set(RAW)
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
PARAGRAPHS = set("p pre td blockquote dd div section article main body".split())
CLOSED_BY = {
    "p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"},
}
FENCES = set("table ul ol dl div section article main aside nav header footer form td th body blockquote figure".split())
BAD_WORDS = set(
    "ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored sidebar aside menu nav navbar navigation breadcrumb breadcrumbs comment "
    "comments disqus reply replies respond cookie cookies consent notice notices gdpr share sharing social related recommended popular trending footer masthead popup "
    "modal overlay subscribe subscription newsletter signup login paywall widget toolbar pagination pager skip banners adsense teaser outbrain taboola toc tags".split()
)
# Words that may stand beside a bad word in one class or id token: "comments-area", "related-posts".
FILLERS = set(
    "area bar block bottom box button buttons col column container group header icon icons inner item items left link links list module outer panel posts region "
    "right row section slot stories title top unit wrap wrapper zone".split()
)
GOOD_WORDS = set("article articles body content entry main post story text page".split())
PRIOR = {"article": 25, "main": 20, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "form": -3, "header": -10, "th": -5, "h1": -5, "h2": -5}
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
# What is kept beside the best container wherever it stands, unless most of it is links.
BESIDE = HEADINGS | set("p ul ol dl li dt dd table caption thead tbody tfoot tr blockquote pre figure details".split())
# Elements whose id is a name of the layout; on others it may be the slug of a heading.
LAYOUT = set("div ul ol dl table td".split())
SHORT = 25  # characters under which a paragraph passes no points
LEVELS = 4

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
HINT = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
PARTS = re.compile(r"[a-z]+")
# Grades of elements: text everywhere; text inside the chosen container only; the same unless that is the body; never text.
TEXT, INSIDE, TITLE, NEVER = range(4)


def is_hidden(rest: str) -> bool:
    """Whether a start tag's attributes hide the element: ``hidden`` itself, ``aria-hidden=true`` or a style without display;
    the words inside other values mean nothing."""
    low = rest.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and NO_DISPLAY.search(value):
            return True
    return False


class Node:
    __slots__ = ("commas", "dropped", "grade", "linked", "links", "parent", "parts", "points", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, grade: int = TEXT):
        self.tag, self.parent, self.grade = tag, parent, grade
        self.dropped = grade == NEVER
        self.parts: list[str | Node] = []
        self.points = 0.0
        self.text = self.links = self.commas = 0  # characters, characters in links, commas, of all below
        self.linked = tag == "a" or (parent is not None and parent.linked)


@lru_cache(10_000)
def _bad(token: str) -> bool:
    """Whether a whole token is made of bad words, with fillers beside them."""
    words = PARTS.findall(token.lower())
    return any(w in BAD_WORDS for w in words) and all(w in BAD_WORDS or w in FILLERS or len(w) == 1 for w in words)


def _grade(tag: str, rest: str) -> int:
    if tag in DROPPED:
        return NEVER
    plain = INSIDE if tag == "figcaption" else TEXT
    if not rest or tag in ("html", "body"):
        return plain
    if is_hidden(rest):
        return NEVER
    if tag in HEADINGS:
        return TEXT
    words: set[str] = set()
    bad: set[str] = set()
    layout = tag in LAYOUT
    for m in HINT.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        tokens = [value] if name == "aria-label" else value.split()
        words.update(PARTS.findall(value.lower()))
        if any(_bad(token) for token in tokens):
            bad.add(name)
        if name == "class" and "section" in tokens:
            layout = False
    if not bad or words & GOOD_WORDS - ({"article"} if "comment" in words or "comments" in words else set()):
        return plain
    return INSIDE if bad == {"id"} and not layout else NEVER


def parse(page: str) -> Node:
    """The tree of a page; text of dropped elements is left out."""
    root = Node("html", None)
    stack = [root]
    at = 0
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at and not stack[-1].dropped:
            stack[-1].parts.append(html.unescape(page[at:start]))
        if m is None:
            break
        at = m.end()
        if m["data"] is not None:
            if not stack[-1].dropped:
                stack[-1].parts.append(m["data"])
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        rest = m["rest"] if m["tag"] else m["rest2"]
        if m["end"] or m["end2"]:
            _close(stack, tag)
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        _imply(stack, tag)
        parent = stack[-1]
        if tag in VOID:
            if tag in BLOCKS and not parent.dropped:
                parent.parts.append(Node(tag, parent))
            continue
        grade = NEVER if parent.dropped else _grade(tag, rest)
        if tag == "header" and not any(n.tag in ("article", "main", "section") for n in stack):
            grade = max(grade, NEVER if parent.tag in ("body", "html") else TITLE)
        node = Node(tag, parent, grade)
        if not node.dropped:
            parent.parts.append(node)
        if rest.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if tag not in FENCES and stack[k].tag in FENCES:
            return


def _imply(stack: list[Node], tag: str) -> None:
    """Close elements that the new one ends without an end tag."""
    for k in range(len(stack) - 1, 0, -1):
        if tag in CLOSED_BY.get(stack[k].tag, ()):
            del stack[k:]
            return
        if stack[k].tag in FENCES and not (tag in ("tr", "tbody", "td", "th") and stack[k].tag in ("td", "th")):
            return


def _measure(root: Node) -> list[Node]:
    """Fill in the sums of the nodes that are text everywhere and return them, children before parents."""
    order, queue = [], [root]
    while queue:
        node = queue.pop()
        order.append(node)
        queue.extend(p for p in node.parts if isinstance(p, Node) and p.grade == TEXT)
    order.reverse()
    for node in order:
        own = "".join(p for p in node.parts if isinstance(p, str))
        length = len(" ".join(own.split()))
        node.text += length
        node.links += length if node.linked else 0
        node.commas += own.count(",") + own.count("，") + own.count("、")
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.links += node.links
            node.parent.commas += node.commas
    return order


def _density(node: Node) -> float:
    return node.links / node.text if node.text else 0.0


def _own_text(node: Node) -> tuple[int, int]:
    """Characters and commas of the text that no block below holds."""
    length = commas = 0
    for part in node.parts:
        if isinstance(part, str):
            length += len(part.strip())
            commas += part.count(",")
        elif part.tag not in BLOCKS:
            length += part.text
            commas += part.commas
    return length, commas


def best_container(nodes: list[Node]) -> Node | None:
    touched: dict[int, Node] = {}
    for node in nodes:
        if node.tag not in PARAGRAPHS:
            continue
        length, commas = _own_text(node)
        if length < SHORT:
            continue
        points = (1 + commas + min(length / 100, 3)) * (1 - _density(node))
        above = node if node.tag in ("div", "section", "article", "main", "body", "td") else node.parent
        for level in range(LEVELS):
            if above is None:
                break
            if id(above) not in touched:
                touched[id(above)] = above
                above.points += PRIOR.get(above.tag, 0)
            above.points += points / (1, 2, 4, 6)[level]
            above = above.parent
    if not touched:
        wanted = [n for n in nodes if n.tag in ("article", "main")] or [n for n in nodes if n.tag in ("body", "html")]
        return max(wanted, key=lambda n: n.text, default=None)
    best = max(touched.values(), key=lambda n: n.points * (1 - _density(n)))
    # A part of an article stands for all of it.
    above = best.parent
    while above is not None and above.tag not in ("body", "html"):
        if above.tag == "article" or above.tag == "main" and _density(above) < 0.4:
            best = above
            break
        above = above.parent
    return best


def _runs(parts: list[str | Node]) -> list[list[str | Node]]:
    """Blocks one by one, and what stands between blocks together."""
    runs: list[list[str | Node]] = []
    inline = False
    for part in parts:
        block = isinstance(part, Node) and part.tag in BLOCKS
        if block or not inline:
            runs.append([])
        runs[-1].append(part)
        inline = not block
    return runs


def _beside(inner: Node, worth: float, near: bool) -> tuple[list[str | Node], list[str | Node]]:
    """What is kept before and after a child of a container: parts of the same text, not blocks of links."""
    runs = _runs(inner.parent.parts)
    own = next(k for k, run in enumerate(runs) if any(part is inner for part in run))
    sure, maybe = {own}, set()
    for k, run in enumerate(runs):
        nodes = [p for p in run if isinstance(p, Node)]
        loose = sum(len(" ".join(p.split())) for p in run if isinstance(p, str))
        text = loose + sum(n.text for n in nodes)
        links = sum(n.links for n in nodes)
        if k == own or not text or links > 0.5 * text:
            continue
        commas = sum(n.commas for n in nodes) + sum(p.count(",") for p in run if isinstance(p, str))
        prose = text > 80 and links < 0.25 * text or commas and not links
        tag = run[0].tag if nodes and run[0] is nodes[0] and nodes[0].tag in BLOCKS else ""
        if tag == "article" or inner.tag == "article":
            # Further articles beside the best are other articles unless they carry as much text.
            if tag == inner.tag and run[0].points * (1 - links / text) >= worth or tag == "p" and prose:
                sure.add(k)
        elif tag in BESIDE or prose:
            sure.add(k)
        elif near and inner.tag != "article":
            maybe.add(k)
    # Short blocks belong to the text when they stand between parts of it.
    sure |= {k for k in maybe if min(sure) < k < max(sure)}
    kept = [p for k in sorted(sure) for p in runs[k]]
    at = next(k for k, part in enumerate(kept) if part is inner)
    return kept[:at], kept[at + 1 :]


def _kept(best: Node) -> list[str | Node]:
    """The best container and what is kept beside it and beside its ancestors, in page order."""
    worth = max(10.0, 0.2 * best.points * (1 - _density(best)))
    kept: deque[str | Node] = deque([best])
    inner = best
    while inner.parent is not None and inner.tag not in ("main", "body") and (inner is best or best.tag != "article"):
        before, after = _beside(inner, worth, inner is best)
        kept.extendleft(reversed(before))
        kept.extend(after)
        inner = inner.parent
    return list(kept)


def _blocks(parts: list[str | Node], best: Node) -> list[str]:
    """Texts of the blocks in page order."""
    blocks: list[str] = []
    open_: list[str] = []
    whole = best.tag in ("body", "html")

    def shut() -> None:
        if open_:
            if text := " ".join("".join(open_).split()):
                blocks.append(text)
            open_.clear()

    stack: list = [(part, False) for part in reversed(parts)]
    while stack:
        part, inside = stack.pop()
        if part is None:
            shut()
        elif isinstance(part, str):
            open_.append(part)
        elif part.grade > INSIDE and (whole or not inside) or part.grade and not inside:
            shut()
        elif whole and part.tag in ("ul", "ol", "table", "dl") and part.text and _density(part) > 0.6:
            shut()  # a list of links, such as a menu, of a page without a container
        else:
            inside = inside or part is best
            block = part.tag in BLOCKS
            if block:
                shut()
                stack.append((None, inside))
            stack.extend((p, inside) for p in reversed(part.parts))
    shut()
    return blocks


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = _measure(parse(page))
    best = best_container(nodes)
    return " ".join(_blocks(_kept(best), best)) if best is not None else ""


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    A null or empty page, or one without text, has the empty text; broken and cut markup is read as far as it goes; a page
    of any length is read whole; repeated rows are extracted each; other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return over_batches(pages.select("page_id", "url", "html"), run, SCHEMA)
