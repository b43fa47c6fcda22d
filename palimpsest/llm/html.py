"""Main text of web pages by tree scoring.

A page is parsed into a tree (unclosed elements are closed as browsers do for paragraphs, list items and table parts). Each paragraph-like
block earns points for its length and its commas; its parent gets them in full, the grandparent half, further ancestors less. A candidate's
points are discounted by its link density. The best container is kept, and of its siblings all that are not mostly links: headings, lists,
paragraphs, bare text and containers, however short. What stands in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments is left out, and so is what the page hides.

Null or empty html gives the empty text; so does a page without text. Text outside any tag counts as a block. Of containers that score alike
the first counts. Character references are decoded, broken ones stay as they are. No step recurses, so elements may be nested however deep.
Pages are treated one by one, so repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import chunks, frugal

# Element names, and the words in class, id and role that mark what is not part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
DROPPED = frozenset("nav footer aside form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SCORED = frozenset("p pre blockquote td li dd".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|side|widget|header|masthead|footer|foot|cookies?|consent|gdpr|notice|alert|popup|modal|overlay"
    r"|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|pagination|pager|skip|toolbar|copyright)(?:$|[\s_-])"
)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|text|blog|story)(?:$|[\s_-])")

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | <[/!?][^>]*+> | <[a-zA-Z/][^<>]*+> | (?P<text>[^<]++|<)""", re.S | re.X
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "sidebar"}
#: Share of link text from which a sibling of the best container is left out, and ancestors that get points.
LINKED, ANCESTORS = 0.5, 40
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "kind", "links", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, kind: str = ""):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.children: list = []
        self.points, self.size, self.links = 0.0, 0, 0


def parse(html: str) -> Node:
    root = Node("html", None)
    now, at = root, 0
    n = len(html)
    is_open: Counter[str] = Counter()

    def leave(upto: Node) -> Node:
        """Close what is open below a node."""
        x = now
        while x is not upto:
            is_open[x.tag] -= 1
            x = x.parent
        return upto

    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        if m["text"] is not None:
            now.children.append(unescape(m["text"]))
            continue
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["close"]:
            if is_open[tag] > 0:
                x = now
                while x.tag != tag:
                    x = x.parent
                now = leave(x.parent)
            elif tag == "br":
                now.children.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = n
            continue
        if tag in ("html", "body"):
            continue
        if tag == "a" and is_open["a"] > 0:
            x = now
            while x.tag != "a":
                x = x.parent
            now = leave(x.parent)
        if tag in BLOCKS and is_open["p"] > 0:
            x = now  # a block ends the paragraph it stands in, with what is open there
            while x.parent and x.tag not in BLOCKS:
                x = x.parent
            if x.tag == "p":
                now = leave(x.parent)
        if tag in CLOSES and any(is_open[x] > 0 for x in CLOSES[tag]):
            x, stop = now, SCOPES.get(tag, ("table",))
            last = None
            while x.parent and x.tag not in stop:
                if x.tag in CLOSES[tag]:
                    last = x
                x = x.parent
            if last:
                now = leave(last.parent)
        node = Node(tag, now, _kind(m["attributes"]))
        now.children.append(node)
        if tag not in VOID and not (tag not in BLOCKS and _SELF_CLOSED.search(m["attributes"])):
            now = node
            is_open[tag] += 1
    return root


def _kind(attributes: str) -> str:
    """Class, id and role in one lower-case string; ``!`` for what a page hides."""
    if not attributes.strip():
        return ""
    out = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "style" and _HIDES.search(value):
            out.append("!")
        elif name in ("class", "id"):
            out.append(value.replace("!", ""))
        elif name == "role":
            out.append(_ROLES.get(value, ""))
    return " ".join(out)


def unwanted(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED or node.tag == "head" or node.kind.startswith("!") or " !" in node.kind:
        return True
    if node.tag == "header":
        return not in_article
    return bool(node.kind) and node.tag not in ("article", "main") and node.tag not in HEADINGS and UNWANTED.search(node.kind) is not None and not (ARTICLE.search(node.kind) and not re.search(r"comment|nav|footer|sidebar|ad\b", node.kind))


def _pruned(root: Node) -> None:
    """Take out what is unwanted, and count text and link text below each node."""
    stack = [(root, False, False)]
    order = []
    while stack:
        node, in_article, in_link = stack.pop()
        in_article = in_article or node.tag in ("article", "main")
        in_link = in_link or node.tag == "a"
        node.children = [x for x in node.children if isinstance(x, str) or not unwanted(x, in_article)]
        order.append((node, in_link))
        stack += [(x, in_article, in_link) for x in node.children if isinstance(x, Node)]
    for node, in_link in reversed(order):
        for x in node.children:
            size = len(x.strip()) if isinstance(x, str) else x.size
            node.size += size
            node.links += (size if in_link else 0) if isinstance(x, str) else x.links


def _scored(root: Node) -> list[Node]:
    found: dict[int, Node] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        below = [x for x in node.children if isinstance(x, Node)]
        stack += below
        prose = node.tag in SCORED or node.tag in ("div", "section", "article", "main", "html") and any(isinstance(x, str) and x.strip() for x in node.children)
        if prose and node.size:
            text = "".join(x for x in node.children if isinstance(x, str)) + " ".join(_inline(x) for x in below if x.tag not in BLOCKS)
            length = len(text)
            points = (1 + text.count(",") + min(length / 100, 3)) * (1 - node.links / node.size)
            owner, share = (node.parent or node) if node.tag in SCORED else node, 1.0
            depth = 0
            while owner is not None and depth < ANCESTORS:
                owner.points += points * share
                found[id(owner)] = owner
                depth += 1
                share = 1 / (2 if depth == 1 else 3 * depth)
                owner = owner.parent
    return list(found.values())


def _inline(node: Node) -> str:
    """The text of an element without that of blocks in it."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif x.tag not in BLOCKS or x is node:
            stack += reversed(x.children)
    return "".join(out)


def _bonus(node: Node) -> float:
    return {"article": 25, "main": 20}.get(node.tag, 0) + (10 if node.kind and ARTICLE.search(node.kind) else 0)


def blocks(node: Node) -> list[str]:
    """The text blocks below a node in page order; white space within a block is one space."""
    out, line = [], []

    def close() -> None:
        if line:
            text = _WHITE.sub(" ", "".join(line)).strip()
            if text:
                out.append(text)
            line.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in BLOCKS:
            close()
            stack.append(None)
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    close()
    return out


def extract(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    root = parse(html)
    _pruned(root)
    candidates = _scored(root)
    if not candidates:
        return "\n".join(blocks(root))

    def value(x: Node) -> float:
        return (x.points + _bonus(x)) * (1 - x.links / x.size if x.size else 1)

    best = max(candidates, key=value)
    top, around = value(best), best.parent or best
    kept = Node(around.tag, None)
    run: list = []  # bare text and inline elements that stand together

    def end_run() -> None:
        size = sum(len(x.strip()) if isinstance(x, str) else x.size for x in run)
        if sum(0 if isinstance(x, str) else x.links for x in run) <= LINKED * size:
            kept.children.extend(run)
        run.clear()

    for x in around.children:
        if isinstance(x, str) or x.tag not in BLOCKS and x is not best:
            run.append(x)
            continue
        end_run()
        if x is best or x.links < LINKED * x.size or (x.points and value(x) >= max(10.0, top / 5)):
            kept.children.append(x)
    end_run()
    return "\n".join(blocks(kept) or blocks(root))


def main_text(pages: DataFrame) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``; one narrow stage."""

    def run(batches):
        for b in batches:
            at = 0
            for ids, texts in chunks([b]):
                urls = b.column("url").slice(at, len(ids))
                at += len(ids)
                found = [extract(x) for x in texts]
                yield pa.RecordBatch.from_pydict({"page_id": ids, "url": urls, "text": pa.array(found, pa.string()), "n_chars": pa.array([len(x) for x in found], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("doc_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(frugal(run), "page_id long, url string, text string, n_chars long")
