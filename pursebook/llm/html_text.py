"""Main text of HTML pages by tree scoring (operator 2).

1. A page is tokenised leniently and built into a tree with implied end tags.
2. Scripts, menus, form controls, headers, footers, side bars and hidden elements are left out
   by element, role or attribute; of an article's own header its headings stay.  The rest is
   cut into blocks, each with its text and the part of it that is links.  A form goes too,
   unless it is wrapped around the page's prose: most of its points, or an article.
3. A class or id only raises a suspicion.  One made of boilerplate words alone ("ad-slot",
   "cookie-notice") drops its element, unless prose of most of the page's points is inside; one
   with another word in it ("share-price") does so only where links make up the text.
4. Every paragraph passes points for its length and its commas to its next
   ``SCORED_ANCESTORS`` containers: all, a half, a third, ...  A container's score is its
   points, discounted by the share of its text that is links.
5. The container with the best score is widened to a parent whose score is nearly as good,
   or that adds no text.  It is kept, and with it the siblings that score high enough, share
   its class, or are headings or paragraphs of prose.  Of what is kept, lists of many short
   links go, which are menus.

Defined results: null or empty html has an empty text; broken markup is read as far as
it goes; a page without any block outside the boilerplate has an empty text; nothing is
cut off; repeated rows get equal texts; of equal scores the container that starts first
wins.  The work on a page is proportional to its length, however deep it nests.  Only the
named column is read, so extra or clashing columns do no harm.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.common import column_function, read_table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(["article", "main"])
#: Blocks that pass their points on; any other block counts as a container itself.
PARAGRAPHS = frozenset("p pre li td th dd dt blockquote figcaption summary".split())
DROPPED = frozenset(
    "head nav footer aside script style noscript template iframe button select input textarea label legend datalist svg canvas object embed audio video map "
    "dialog menu title xmp noembed noframes search annotation annotation-xml".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion sidebar sidebars aside rail menu "
    "menus nav navbar navigation navigations breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments commentlist respond replies disqus "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations pagination pager widget widgets copyright disclaimer skip outbrain taboola hidden".split()
)
HEADER_WORDS = frozenset("header masthead banner".split())
#: Words that say where or how an element stands, and nothing of what is in it.
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons col column component container content desktop fixed form global group head heading holder icon icons inner item "
    "items js large left link links list main mobile module outer page panel region right row section site slot small sticky text title top unit wrap wrapper zone "
    "article post entry story news the a of and to on us our by".split()
)
#: Beginnings of names that say something about the page, not about the element.
_ABOUT_PAGE = frozenset("has with no without is".split())
#: A start tag of the key ends the open elements named, in the same list or table.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th"), "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th"),
}
_CLOSABLE = frozenset("p li dt dd option tr td th".split())
_CELLS = frozenset(["tr", "td", "th"])
_WALLS = frozenset("ul ol dl table select article section div body html main aside nav header footer form blockquote td th".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.S)
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
_COMMAS = re.compile(r"[,،、，]")
_SENTENCE_END = re.compile(r"[.!?。！？…][\"'»”’)\]]*$")
#: What a cited title has and a menu's entry has not.
_REFERENCE = re.compile(r"[,.:;\"“«]|\b\d{4}\b|(?:\S+\s+){5}")

SCORED_ANCESTORS = 5
ARTICLE_WEIGHT = 1.5
#: Share of links that makes a suspicious element boilerplate, and a list a menu.
SUSPECT_DENSITY, MENU_DENSITY, MENU_LINKS = 0.35, 0.6, 5
WIDEN_SHARE, SIBLING_SHARE, SIBLING_POINTS, PROSE_DENSITY, PROSE_CHARS = 0.66, 0.2, 10.0, 0.25, 80


class Node:
    __slots__ = ("tag", "attrs", "parent", "outer", "children", "open", "suspect", "dropped", "in_article", "headings_only", "has_article", "chars", "link_chars", "prose", "own", "points")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        #: The nearest block around it, or the root.
        self.outer: Node | None = None
        self.children: list = []
        #: Nearest open element of each closable kind that a start tag here could end.
        self.open: dict[str, Node] = {}
        self.suspect = 0
        self.dropped = self.in_article = self.headings_only = self.has_article = False
        self.chars = self.link_chars = self.prose = 0
        self.own = self.points = 0.0

    @property
    def density(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0

    @property
    def score(self) -> float:
        return self.points * (1 - self.density) * (ARTICLE_WEIGHT if self.tag in ARTICLES else 1)


def tag_end(html: str, at: int, unclosed: set[str]) -> int:
    """Where the '>' of a tag is; quoted values may hold one.  A quote that never closes,
    which is found out once for the page, is an ordinary character."""
    while True:
        at = _PLAIN.match(html, at).end()
        if at >= len(html) or html[at] == ">":
            return at
        close = -1 if html[at] in unclosed else html.find(html[at], at + 1)
        if close < 0:
            unclosed.add(html[at])
            at += 1
        else:
            at = close + 1


def parse(html: str) -> list[Node]:
    """The page's elements in page order, the root first; children are nodes and texts."""
    root = Node("#root", {}, None)
    nodes, stack, counts, unclosed = [root], [root], {}, set()
    at, n = 0, len(html)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            counts[stack.pop().tag] -= 1

    while at < n:
        m = _MARKUP.search(html, at)
        if not m:
            stack[-1].children.append(_html.unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(_html.unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        end = tag_end(html, at, unclosed)
        rest, at = html[at:end], end + 1
        tag = m[2].lower()
        if m[1]:
            # An inline end tag does not reach out of its cell or article.
            if counts.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    if tag not in BLOCK and stack[depth].tag in ("td", "th", "table", "article", "main"):
                        break
                    depth -= 1
                if stack[depth].tag == tag:
                    pop_to(depth)
            continue
        if tag in BLOCK:
            ended = [stack[-1].open[t] for t in ("p", *_ENDS.get(tag, ())) if t in stack[-1].open]
            if ended:
                outermost = min(ended, key=lambda x: x.own)
                pop_to(int(outermost.own))
                for x in ended:
                    x.own = 0.0
        attrs = {a[1].lower(): (a[2] or "").strip("\"'") for a in _ATTR.finditer(rest)} if rest and not rest.isspace() else {}
        parent = stack[-1]
        new = Node(tag, attrs, parent)
        nodes.append(new)
        parent.children.append(new)
        if tag in RAW:
            found = _RAW_END[tag].search(html, at)
            at = found.end() if found else n
        elif tag not in VOID and not (rest.endswith("/") and tag not in BLOCK):
            if tag in _WALLS:
                new.open = {k: v for k, v in parent.open.items() if k in _CELLS} if tag in ("td", "th") else {}
            else:
                new.open = parent.open
            if tag in _CLOSABLE:
                new.open = new.open | {tag: new}
                new.own = float(len(stack))  # its depth, while it is open
            stack.append(new)
            counts[tag] = counts.get(tag, 0) + 1
    for x in nodes:
        x.own, x.open = 0.0, {}
    return nodes


def suspicion(node: Node) -> int:
    """2: a name made of boilerplate words; 1: a name with one among others; 0: none."""
    if node.tag in ("html", "body") or node.tag in ARTICLES or not node.attrs:
        return 0
    names = node.attrs.get("class", "").split()
    if node.tag not in HEADINGS:  # the id of a heading is what links point to
        names += node.attrs.get("id", "").split()
    most = 0
    for name in names:
        words = [w.lower() for w in _SPLIT.split(name) if w]
        found = BOILERPLATE.intersection(words)
        if not found or words[0] in _ABOUT_PAGE:
            continue
        if node.in_article and found <= HEADER_WORDS:
            node.headings_only = True
            continue
        only = all(w in BOILERPLATE or w in NEUTRAL or w.isdigit() for w in words)
        most = max(most, 1 + (only and node.tag not in HEADINGS))
    return most


def is_dropped(node: Node) -> bool:
    """Whether element, role or attribute say that it is not the article."""
    attrs = node.attrs
    if node.tag in DROPPED or node.tag == "header" and not node.in_article:
        return True
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in DROPPED_ROLES or bool(_HIDDEN.search(attrs.get("style", ""))))


def blocks_of(root: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, characters inside links) in page order, without what is
    dropped by element, role or attribute."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    block, linked_chars = root, 0

    def flush() -> None:
        nonlocal linked_chars
        text = " ".join("".join(parts).split()) if parts else ""
        if text and not (block.headings_only and block.tag not in HEADINGS):
            out.append((block, text, min(len(text), linked_chars)))
        parts.clear()
        linked_chars = 0

    # (element, its next child, inside a link?, the block around it)
    todo: list[tuple[Node, int, bool, Node]] = [(root, 0, False, root)]
    while todo:
        node, i, linked, outer = todo.pop()
        own = node if node.tag in BLOCK else outer
        if i == 0 and node.tag in BLOCK:
            flush()
        block = own
        for j in range(i, len(node.children)):
            c = node.children[j]
            if isinstance(c, str):
                parts.append(c)
                linked_chars += len(c) if linked else 0
                continue
            if c.tag in ("br", "wbr"):
                parts.append(" " if c.tag == "br" else "")
                continue
            c.outer = own
            c.in_article = node.in_article or node.tag in ARTICLES
            c.headings_only = node.headings_only or c.tag == "header"  # an article's own header
            c.dropped = is_dropped(c)
            if c.dropped or c.tag == "hr":
                if c.tag in BLOCK:
                    flush()
                continue
            c.suspect = suspicion(c)
            is_link = c.tag == "a" and "href" in c.attrs
            todo.append((node, j + 1, linked, outer))
            todo.append((c, 0, linked or is_link, own))
            break
        else:
            if node.tag in BLOCK:
                flush()
                block = outer
    flush()
    return out


def points_of(text: str, link_chars: int) -> float:
    return (1 + len(_COMMAS.findall(text)) + min(len(text) / 100, 3.0)) * (1 - link_chars / len(text))


def add_up(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Totals of every element, from the leaves to the root, in one pass."""
    for x in nodes:
        x.chars = x.link_chars = x.prose = 0
        x.own = 0.0
    for node, text, link in blocks:
        node.chars += len(text)
        node.link_chars += link
        node.own += points_of(text, link)
        node.prose = max(node.prose, len(text) - link)
    for x in reversed(nodes[1:]):
        up = x.parent
        up.chars += x.chars
        up.link_chars += x.link_chars
        up.own += x.own
        up.prose = max(up.prose, x.prose)
        up.has_article = up.has_article or x.has_article or x.tag in ARTICLES


def is_form(node: Node) -> bool:
    return node.tag == "form" or node.attrs.get("role", "").lower() == "form"


def drop_suspects(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks outside forms and outside the elements whose name and text say that they are boilerplate."""
    add_up(nodes, blocks)
    total = nodes[0].own
    for x in nodes[1:]:
        strong = x.suspect == 2 and not x.has_article and x.own <= max(total / 2, SIBLING_POINTS)
        form = is_form(x) and not x.has_article and (x.own <= total / 2 or x.prose <= PROSE_CHARS)
        x.dropped = x.dropped or x.parent.dropped or strong or form or (x.suspect == 1 and not x.has_article and x.density >= SUSPECT_DENSITY)
    return [b for b in blocks if not b[0].dropped]


def score(blocks: list[tuple[Node, str, int]]) -> None:
    """Passes points to containers."""
    for node, text, link in blocks:
        if node.tag in HEADINGS:
            continue
        points = points_of(text, link)
        up, level = node.outer if node.tag in PARAGRAPHS else node, 1
        while up is not None and level <= SCORED_ANCESTORS:
            up.points += points / level
            up, level = up.outer, level + 1


def best_container(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> Node | None:
    """The container with the greatest score; of equal ones the first."""
    add_up(nodes, blocks)
    score(blocks)
    best = max(nodes, key=lambda x: x.score)
    return best if best.score > 0 else None


def main_blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks that make up the article."""
    blocks = drop_suspects(nodes, blocks_of(nodes[0]))
    best = best_container(nodes, blocks)
    if best is None:  # headings alone, or nothing but links
        return [text for node, text, _ in blocks if node.in_article or node.tag in ARTICLES]
    top = widened(best)
    kept = {id(top)}
    if top.parent is not None:
        kept |= {id(c) for c in top.parent.children if isinstance(c, Node) and c is not top and not c.dropped and c.chars and is_kept_sibling(c, top, best.score)}
    inside: set[int] = set()
    for x in nodes:
        if id(x) in kept or id(x.parent) in inside:
            inside.add(id(x))
    # An inline or paragraph sibling has its text in a block of its own or of the parent.
    menus = menu_blocks([b for b in blocks if id(b[0]) in inside])
    return [text for node, text, _ in blocks if id(node) in inside and id(node) not in menus]


def widened(best: Node) -> Node:
    """The container or a parent that scores nearly as well or adds no text; never the body."""
    top, up = best, best.parent
    while up is not None and up.tag not in ("body", "html", "#root"):
        if up.score >= WIDEN_SHARE * best.score or up.chars == top.chars:
            top = up
        elif up.tag in BLOCK:
            break
        up = up.parent
    return top


def is_kept_sibling(c: Node, top: Node, most: float) -> bool:
    density = c.density
    if c.tag in HEADINGS or c.headings_only:
        return density < PROSE_DENSITY
    if c.tag in PARAGRAPHS or c.tag in ("ul", "ol", "dl", "table"):
        return density < PROSE_DENSITY and c.chars > PROSE_CHARS or density == 0 and bool(_SENTENCE_END.search(last_text(c)))
    same = bool(top.attrs.get("class")) and c.attrs.get("class") == top.attrs.get("class") and density < PROSE_DENSITY
    return same or c.score >= max(SIBLING_POINTS, SIBLING_SHARE * most)


def last_text(node: Node) -> str:
    """The last text inside an element."""
    while node.children:
        for c in reversed(node.children):
            if isinstance(c, str):
                if c.strip():
                    return c.rstrip()
            elif c.chars or c.tag not in BLOCK and c.children:
                node = c
                break
        else:
            return ""
    return ""


def menu_blocks(blocks: list[tuple[Node, str, int]]) -> set[int]:
    """Blocks of lists of many short links: menus that no element or name gives away."""
    lists: dict[int, list] = {}
    around: dict[int, int | None] = {}

    def list_of(node: Node) -> int | None:
        path = []
        while node is not None and id(node) not in around and node.tag not in ("ul", "ol", "dl"):
            path.append(id(node))
            node = node.parent
        found = None if node is None else around.get(id(node), id(node))
        for p in path:
            around[p] = found
        return found

    for node, text, link in blocks:
        if (k := list_of(node)) is not None:
            entry = lists.setdefault(k, [0, 0, 0, 0, []])
            entry[0] += len(text)
            entry[1] += link
            entry[2] += link > 0
            entry[3] += link > 0 and bool(_REFERENCE.search(text))
            entry[4].append(id(node))
    menus = (e for e in lists.values() if e[2] >= MENU_LINKS and e[1] >= MENU_DENSITY * e[0] and 2 * e[3] < e[2])
    return {n for e in menus for n in e[4]}


def extract_text(html: str | None) -> str:
    return "\n".join(main_blocks(parse(html))) if html else ""


@column_function(pa.string())
def main_text(html: pa.Array) -> pa.Array:
    """html -> the article's blocks, joined by line ends."""
    return pa.array([extract_text(h.as_py()) for h in html], pa.string())


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", main_text("html").alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))
