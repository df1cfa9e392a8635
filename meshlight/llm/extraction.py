"""Main text of web pages by scores on the element tree.

A page is read into a tree, leniently: unclosed and misnested elements end where a browser would
end them, and a tag that the page breaks off in is dropped. Every paragraph passes points for its
length and commas to its ancestors, fewer with the distance; an ancestor's points are discounted by
its link density. The container with the most points is widened to the ``main`` or else the outermost
``article`` it lies in, and kept with those siblings that score alike; where no element marks the
article, with all siblings but menus and those that are mostly links.

Menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
neither score nor appear. They are known by element, by role, or by a class or id each of whose words
names such a part or its place (``sidebar``, ``main-sidebar``), or that ends in such a word. A name that
tells a state (``no-sidebar``, ``comments-open``) is none, and neither is a header inside an article. An
``article`` or ``main`` and what holds one go only by a name of exactly one such word. What holds most
of the page's unlinked text is kept, unless it is comments, adverts or consent, or an article stands
elsewhere.

Null and empty pages have the empty text, and so do pages without text; an empty table has no rows. Pages
are read whole whatever their length; each row is read for itself, so that repeated rows have repeated
results. Of containers with equal points the outermost, then the first one counts.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from meshlight.llm.batches import appended

# A name, then attributes whose quoted values may hold ">". Possessive: nothing is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var".split()
)
_PARAGRAPH = frozenset("p pre blockquote li dt dd td th h1 h2 h3 h4 h5 h6 figcaption summary address".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that a start tag of one of these kinds ends, up to the element that bounds the search.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_BOUNDS = frozenset("table td th button caption object body html".split())

# Elements whose text is not read at all, and elements that are left out unless they hold the article.
_DROPPED = frozenset(
    "head nav button select textarea dialog menu object embed canvas audio video svg applet input".split()
) | _RAW
_DOUBTED = frozenset("footer aside form fieldset".split())
_DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split()
)
# Words of a class or id that name what is no part of an article.
_HEADER = frozenset("header masthead".split())
_NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr "
    "comment comments commentlist reply replies respond disqus".split()
)
_UNWANTED = _HEADER | _NEVER | frozenset(
    "promo promos promotion banner banners notice notices notification popup modal overlay newsletter subscribe "
    "subscription paywall signup login discussion sidebar sidebars widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer footnav topbar toolbar share sharing social related recommended recommendations "
    "pagination pager outbrain taboola disclaimer alert alerts".split()
)
_UNWANTED_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply related teaser".split())
# Words that stand beside those in names of the same parts.
_PLACES = frozenset(
    "left right top bottom primary secondary first second page site web global local box bar wrap wrapper container inner "
    "outer area section block list links link items item panel column col region zone slot unit holder group row main "
    "body content text form buttons button icons icon media title message messages thread post posts article articles".split()
)
# Words that make a name a state of something else.
_STATES = frozenset(
    "no non not has have had with without is are open opened closed off on free disabled enabled allowed ready active hide "
    "hidden show shown loaded".split()
)
_WANTED = frozenset("article main content post entry story body text".split())
_OF_ARTICLE = frozenset("article entry post story content".split())
_SHARE = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)  # of a paragraph's points, from the nearest ancestor outwards


class _Node:
    __slots__ = (
        "parent", "tag", "unread", "doubt", "dropped", "wanted", "score", "own", "length", "linked", "links", "first",
        "article", "block", "menu", "kept", "marks", "h1",
    )

    def __init__(self, parent: _Node | None, tag: str):
        self.parent, self.tag = parent, tag
        self.unread = parent is not None and parent.unread
        self.doubt = ""  # why it may be left out: an element, a class (exact or not), or never to be kept
        self.dropped = False
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.wanted = 0.0
        self.score = self.own = 0.0
        self.length = self.linked = self.links = self.marks = 0
        self.first = 0
        self.block: _Node = parent.block if parent is not None and tag in _INLINE else self
        self.menu = self.kept = self.h1 = False


def _name_doubt(name: str, node: _Node) -> str:
    """What a class or id says about an element: "", "class", "exact" or "never"."""
    words = [w.lower() for w in _WORD.findall(name)]
    found = set(words)
    if found & _WANTED:
        node.wanted = 10.0
    named = found & _UNWANTED
    if node.tag in ("article", "main"):
        return "never" if len(words) == 1 and words[0] in _UNWANTED_ARTICLE else ""
    if not named or found & _STATES or (named <= _HEADER and (node.article or found & _OF_ARTICLE)):
        return ""
    if words[-1] not in _UNWANTED and not all(w in _UNWANTED or w in _PLACES or len(w) <= 2 or w.isdigit() for w in words):
        return ""
    return "never" if found & _NEVER else "exact" if len(words) == 1 else "class"


def _judge(node: _Node, attributes: str) -> None:
    """Set ``unread`` or ``doubt`` by the element's tag and attributes."""
    tag = node.tag
    if tag in _DROPPED:
        node.unread = True
        return
    doubts = ["element"] if tag in _DOUBTED or (tag == "header" and not node.article) else []
    for name, double, single, bare in _ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else []:
        value, name = double or single or bare, name.lower()
        if (
            name == "hidden" or (name == "aria-hidden" and value == "true")
            or (name == "style" and "display:none" in value.replace(" ", "").lower())
        ):
            node.unread = tag not in ("html", "body")
        if name == "role" and value.lower() in _DROPPED_ROLES and not (node.article and value.lower() == "banner"):
            doubts.append("element")
        if name in ("class", "id"):
            doubts += [_name_doubt(token, node) for token in value.split()]
    if tag in ("html", "body") or tag in _HEADINGS:
        return
    node.doubt = next((d for d in ("never", "exact", "element", "class") if d in doubts), "")
    if node.doubt and tag in _INLINE:
        node.unread = True


def _end_of_raw(page: str, tag: str, begin: int) -> int:
    """Where the closing tag of a raw element begins; the end of the page if there is none."""
    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(page, begin)
    return found.start() if found else len(page)


def _parse(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements in page order, and the text blocks: (block element, text, characters in links)."""
    root = _Node(None, "")
    nodes, stack, blocks = [root], [root], []
    pending: list[str] = []
    linked: list[str] = []
    opened: dict[str, int] = {}  # open elements by tag, so that nothing is sought in vain

    def flush() -> None:
        nonlocal pending, linked
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                blocks.append((stack[-1].block, text, len(" ".join("".join(linked).split()))))
            pending, linked = [], []

    def end(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        open_ = page.find("<", at)
        if open_ < 0:
            open_ = size
        if open_ > at and not stack[-1].unread:
            text = html.unescape(page[at:open_])
            pending.append(text)
            if opened.get("a"):
                linked.append(text)
        if open_ == size:
            break
        if page.startswith("<!--", open_):
            close = page.find("-->", open_ + 4)
            at = size if close < 0 else close + 3
            continue
        follower = page[open_ + 1 : open_ + 2]
        if follower in ("!", "?"):
            close = page.find(">", open_)
            at = size if close < 0 else close + 1
            continue
        found = _TAG.match(page, open_)
        if not found:
            if follower.isalpha() or (follower == "/" and page[open_ + 2 : open_ + 3].isalpha()):
                close = page.find(">", open_)  # an unbalanced quote, or the page breaks off in the tag
                if close < 0:
                    break
                found = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>").match(page, open_)
            else:
                if not stack[-1].unread:
                    pending.append("<")
                at = open_ + 1
                continue
        at = found.end()
        closing, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
        if tag == "br":
            if not stack[-1].unread:
                pending.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if closing:
            for depth in [] if not opened.get(tag) else range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    end(depth)
                    break
                if inline and stack[depth].tag not in _INLINE:
                    break
            continue
        if tag in _VOID:
            continue
        if not inline:
            ends, bounds = _ENDS.get(tag, (frozenset(), frozenset()))
            for depth in range(len(stack) - 1, 0, -1) if any(opened.get(t) for t in ends) else []:
                if stack[depth].tag in ends:
                    end(depth)
                    break
                if stack[depth].tag in bounds:
                    break
            for depth in range(len(stack) - 1, 0, -1) if opened.get("p") else []:
                if stack[depth].tag == "p":
                    end(depth)
                    break
                if stack[depth].tag in _BOUNDS:
                    break
        node = _Node(stack[-1], tag)
        if not node.unread:
            _judge(node, attributes)
        if tag in _RAW:
            close = _end_of_raw(page, tag, at)
            after = page.find(">", close)
            at = size if after < 0 else after + 1
            continue
        node.first = len(nodes)
        nodes.append(node)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return nodes, blocks


def _density(node: _Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _measured(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Characters, linked characters, links, articles and main headings in every element."""
    for node in nodes:
        node.length = node.linked = node.links = 0
        node.marks = int(node.tag in ("article", "main"))
        node.h1 = node.tag == "h1"
    for node, text, linked in blocks:
        node.length += len(text)
        node.linked += linked
        node.links += linked > 0
    for node in reversed(nodes[1:]):  # children come after their parents
        up = node.parent
        up.length += node.length
        up.linked += node.linked
        up.links += node.links
        up.marks += node.marks
        up.h1 |= node.h1


def _drop(nodes: list[_Node]) -> None:
    """Decide on the doubted elements, once it is known what they and the page hold."""
    page = nodes[0]
    unlinked = page.length - page.linked
    for node in nodes[1:]:
        node.dropped = node.parent.dropped
        if node.dropped or not node.doubt:
            continue
        most = 2 * (node.length - node.linked) > unlinked
        elsewhere = page.marks > node.marks and not node.article
        holds = node.marks > 0 and node.tag not in ("article", "main")
        node.dropped = node.doubt == "never" or not ((most and not elsewhere) or (holds and node.doubt != "exact"))


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by two newlines; empty if the page has none."""
    nodes, blocks = _parse(page)
    if not blocks:
        return ""
    _measured(nodes, blocks)
    if any(n.doubt for n in nodes):
        _drop(nodes)
        blocks = [b for b in blocks if not b[0].dropped]
        _measured(nodes, blocks)
    for node in nodes[1:]:  # a list or table that holds little but links is a menu
        node.menu = node.parent.menu or (
            node.tag in ("ul", "ol", "dl", "table") and node.links >= 3 and node.linked * 5 >= node.length * 4
        )
    blocks = [b for b in blocks if not b[0].menu]
    for node, text, linked in blocks:
        if node.tag in _HEADINGS:
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        points *= 1 - linked / len(text)
        up = node
        if node.tag in _PARAGRAPH:
            node.own += points
            up = node.parent
        for share in _SHARE:
            if up is None:
                break
            up.score += points * share
            up = up.parent
    scored = [n for n in nodes if n.score > 0]
    if not scored:
        best = nodes[0]
    else:
        best = max(scored, key=lambda n: ((n.score + n.wanted) * (1 - _density(n)), -n.first))
    article = main = None
    up = best
    while up is not None:  # the whole article, not one of its sections
        article = up if up.tag == "article" else article
        main = up if up.tag == "main" else main
        up = up.parent
    marked = article is not None or main is not None
    core = article or main or best
    region = main if main is not None and article is not None and main.first <= article.first else core
    while not marked and region.parent is not None and region.parent.length == region.length:
        core = region = region.parent  # a wrapper that holds nothing else
    least = 0.2 * (core.score + core.own)

    def scores_alike(node: _Node) -> bool:
        return (node.score + node.own) * (1 - _density(node)) >= least

    def alike(sibling: _Node) -> bool:
        if sibling.menu or _density(sibling) >= 0.5:
            return False
        if not marked:  # no element says where the article ends: only menus and links are left out
            return True
        return (sibling.h1 and sibling.first < region.first) or scores_alike(sibling)

    towards, up = set(), core  # elements between the region and its article
    while up is not region:
        up = up.parent
        towards.add(up)
    inside = set()
    for node in nodes:
        up = node.parent
        if node is core or up in inside:
            inside.add(node)
        if node is region or node in inside or node in towards:
            node.kept = True
        elif up is not None and up.kept:  # beside the article, in the same main
            node.kept = not node.menu and _density(node) < 0.5 and (node.tag != "article" or scores_alike(node))
        else:
            node.kept = up is not None and up is region.parent and alike(node)
            if node.kept:
                inside.add(node)  # whole
    beside = None if marked else region.parent  # whose own text stands beside the best container
    return "\n\n".join(text for node, text, linked in blocks if node.kept or (node is beside and linked * 2 < len(text)))


def _extracted(pages: pa.Array) -> dict[str, pa.Array]:
    return {"text": pa.array([main_text(p) for p in pages.to_pylist()], pa.string())}


def extracted(df: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text``, the main text of each whole page, page by page and without a shuffle.

    An input column named ``text`` is replaced.
    """
    return appended(df, page, "text string", _extracted, keep)
