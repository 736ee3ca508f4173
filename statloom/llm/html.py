"""Main text of HTML pages by tree scoring.

A page becomes a tree by the rules of HTML for tags, attributes and raw text. Parts that a tag name or a class, id or role word marks
as page furniture are cut out, but not what is around a main or the longest
article, and not by words if nothing would be left. Each block of running text gives points (one,
its commas, and its length up to a limit) to the elements around it: all to its
parent, half to the next, then a third of the rest and so on. A container's
points are discounted by the share of its text that is link text. The best
container is kept: in an article the whole of it, in a main all that is not
mostly links, elsewhere with those siblings that score well or read like prose,
and with the headings, quotes and short paragraphs between or beside these.

One pass over a page's tags and one over its tree; each page is worked on alone
in the task that read it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
FURNITURE = frozenset(
    "nav header footer aside script style noscript template button select option textarea input label fieldset iframe object embed svg annotation annotation-xml "
    "head title menu dialog canvas audio video noembed noframes xmp".split()
)
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
# Words of class, id and role that mark furniture anywhere in a name, and those that do so only as what the name is of.
ALWAYS_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comments consent cookie cookies disqus footer gdpr modal nav navbar navigation newsletter "
    "pagination popup promo promoted recommended related replies sidebar social sponsor sponsored subscribe complementary contentinfo".split()
)
HEAD_WORDS = frozenset("alert banner comment disclaimer header login masthead menu notice notices pager promotion reply search share sharing signup tags toolbar widget".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
# Words that tell of a part, place or form of what a name is of.
PART_WORDS = frozenset(
    "area bar block body bottom box button buttons column container content count field form group icon icons inner item items left link links list meta "
    "outer panel primary right row secondary section slot text title top unit wrap wrapper".split()
)
# Words that make a class or id tell of a state of the element, not of what it is.
STATE_WORDS = frozenset("closed disabled enabled has hide is no not off on open show with without".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class _Node:
    __slots__ = ("blocks", "content", "gone", "kids", "marked", "score", "tag", "up", "weak")

    def __init__(self, tag: str, up: _Node | None, gone: bool, content: bool, marked: bool = False, weak: bool = False) -> None:
        self.tag, self.up, self.gone, self.content, self.marked, self.kids, self.score, self.blocks, self.weak = tag, up, gone, content, marked, [], 0.0, False, weak


def _marks(attributes: dict[str, str]) -> tuple[bool, bool, bool, bool]:
    """Whether attributes hide an element, mark it as furniture, as content, and whether the mark is a weak one.

    Each name stands alone: one that tells of a state marks no furniture, and a
    name of content alone saves the element from its other names. A mark is weak where a word of
    furniture only tells of what the name is about, as in social-history.
    """
    marked = strong = content = saved = False
    gone = "hidden" in attributes or bool(_HIDING.search(attributes.get("style", "")))
    for kind in ("class", "id", "role"):
        for name in attributes.get(kind, "").split():
            found = [part for w in _WORD.findall(name) for part in _parted(w.lower())]
            furniture = _is_furniture(found)
            if furniture and not STATE_WORDS.intersection(found):
                marked, strong = True, strong or _is_of_furniture(found)
            content = content or not CONTENT_WORDS.isdisjoint(found)
            saved = saved or not furniture and not CONTENT_WORDS.isdisjoint(found)
    return gone, marked and not saved, content, not strong


def _parted(word: str) -> list[str]:
    """The word, or the two it is put together of if these are furniture and a part of it: commentlist, sharebar."""
    for i in range(3, len(word) - 2):
        if word[i:] in PART_WORDS and (word[:i] in ALWAYS_WORDS or word[:i] in HEAD_WORDS) and word not in ALWAYS_WORDS and word not in HEAD_WORDS:
            return [word[:i], word[i:]]
    return [word]


def _is_of_furniture(name: list[str]) -> bool:
    """Whether the thing that the name is of is furniture: social-share does, related-work does not."""
    rest = list(name)
    while len(rest) > 1 and rest[-1] in PART_WORDS:
        rest.pop()
    return bool(rest) and (rest[-1] in ALWAYS_WORDS or rest[-1] in HEAD_WORDS)


def _is_furniture(name: list[str]) -> bool:
    """Whether a name's words call the element furniture: share-buttons does, share-price and entry-header do not."""
    if not ALWAYS_WORDS.isdisjoint(name):
        return True
    rest = list(name)
    while len(rest) > 1 and rest[-1] in PART_WORDS:
        rest.pop()
    if not rest or rest[-1] not in HEAD_WORDS:
        return False
    return not (rest[-1] == "header" and CONTENT_WORDS.intersection(rest))


def _tag_end(html: str, at: int) -> tuple[int, dict[str, str], bool]:
    """Where the tag with attributes from ``at`` on ends (-1: the page ends first), these, and whether ``/`` ends it."""
    attributes: dict[str, str] = {}
    n = len(html)
    while True:
        gap = _GAP.match(html, at)
        at = gap.end()
        if at >= n:
            return -1, attributes, False
        if html[at] == ">":
            return at + 1, attributes, gap[0].endswith("/")
        m = _ATTRIBUTE.match(html, at)
        name = m[1].lower()
        if name in ("class", "id", "role", "style", "hidden") and name not in attributes:
            attributes[name] = unescape(m[2] or m[3] or m[4] or "")
        at = m.end()


def _tokens(html: str) -> Iterator[tuple[str, str, dict[str, str] | bool]]:
    """Tokens of a page by the rules of HTML: ("", text, {}), ("/", tag, {}) and (tag, "/" if self-closing, attributes).

    Comments, declarations and the content of raw elements make no token; what
    a page that ends within a tag holds of it is dropped.
    """
    at, n = 0, len(html)
    while at < n:
        open_ = html.find("<", at)
        if open_ < 0:
            yield "", html[at:], {}
            return
        after = html[open_ + 1 : open_ + 2]
        closing = after == "/"
        name = _NAME.match(html, open_ + 1 + closing)
        if not name:
            if closing or after in ("!", "?"):
                if open_ > at:
                    yield "", html[at:open_], {}
                if html.startswith("<!--", open_):
                    if html.startswith((">", "->"), open_ + 4):
                        at = html.index(">", open_) + 1
                        continue
                    end = html.find("-->", open_ + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = html.find(">", open_ + 2)
                    at = n if end < 0 else end + 1
            else:
                yield "", html[at : open_ + 1], {}
                at = open_ + 1
            continue
        if open_ > at:
            yield "", html[at:open_], {}
        tag = name[0].lower()
        end, attributes, slash = (name.end() + 1, {}, False) if html.startswith(">", name.end()) else _tag_end(html, name.end())
        if end < 0:
            return
        at = end
        if closing:
            yield ("br", "", {}) if tag == "br" else ("/", tag, {})
            continue
        yield tag, "/" if slash else "", attributes
        if tag in RAW:
            close = _END[tag].search(html, at)
            if not close:
                return
            at = _tag_end(html, close.end())[0]
            if at < 0:
                return


def parse(html: str) -> _Node:
    """The element tree; text stands between elements as strings, furniture is marked."""
    root = here = _Node("#root", None, False, False)
    depth: dict[str, int] = {}
    for tag, value, attributes in _tokens(html):
        if not tag:
            here.kids.append(value)
            continue
        if tag == "/":
            if depth.get(value):
                while here.tag != value:
                    depth[here.tag] -= 1
                    here = here.up
                depth[value] -= 1
                here = here.up
            continue
        if tag in CLOSES_P and depth.get("p"):
            while here.tag != "p":
                depth[here.tag] -= 1
                here = here.up
            depth["p"] -= 1
            here = here.up
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and here.tag == tag:
            depth[tag] -= 1
            here = here.up
        gone, marked, content, weak = _marks(attributes) if attributes else (False, False, False, False)
        if tag == "form":
            marked, weak = True, False
        elif tag == "header" and (depth.get("article") or depth.get("main")):
            pass  # the header of an article belongs to it
        elif tag in ("html", "body", "main", "article"):
            gone = False
        else:
            gone = gone or tag in FURNITURE
        if tag == "p" or tag in _HEADINGS:
            marked = marked and not content and bool(attributes.get("class") or attributes.get("role"))
        node = _Node(tag, here, gone, content or tag in ("article", "main"), marked, weak)
        here.kids.append(node)
        here.blocks = here.blocks or tag not in INLINE and tag not in VOID
        if tag in VOID or tag in RAW or value == "/" and tag not in CLOSES_P and tag not in INLINE:
            continue
        depth[tag] = depth.get(tag, 0) + 1
        here = node
    return root


#: Characters, and the largest share of them in links, of what counts as prose under a weak mark.
PROSE, LINKED = 100, 0.2


def _is_prose(top: _Node) -> bool:
    """Whether an element holds running text rather than links."""
    total = linked = 0
    stack: list = [(top, False)]
    while stack:
        node, link = stack.pop()
        for kid in node.kids:
            if isinstance(kid, str):
                total += len(kid.strip())
                linked += len(kid.strip()) if link else 0
            elif not kid.gone and not (kid.marked and not kid.weak):
                stack.append((kid, link or kid.tag == "a"))
    return total >= PROSE and linked <= LINKED * total


def _unmark(root: _Node) -> None:
    """Takes the marks off the elements around each main and around the longest article, and weak ones off prose inside these."""
    length: dict[_Node, int] = {}
    stack: list = [(root, None, False)]
    while stack:
        node, article, inside = stack.pop()
        if node.marked and node.weak and inside and _is_prose(node):
            node.marked = False
        inside = inside or node.tag in ("article", "main")
        if node.tag == "main":
            _clear(node)
        if node.tag == "article":
            article = article if node.marked else node
        for kid in node.kids:
            if isinstance(kid, str):
                if article is not None:
                    length[article] = length.get(article, 0) + len(kid.strip())
            elif not kid.gone:
                stack.append((kid, article, inside))
    if length:
        _clear(max(length, key=length.get))


def _clear(node: _Node | None) -> None:
    while node is not None:
        node.marked = False
        node = node.up


def _clean(parts: list[str]) -> str:
    """Decoded text of a block; white space inside becomes one space."""
    return _SPACE.sub(" ", unescape("".join(parts))).strip()


def _walk(top: _Node, blocks: list[tuple[str, _Node, int]], marks: bool = True) -> None:
    """The blocks of running text under ``top`` in page order: text, container, link length.

    Without ``marks`` only hidden elements and tags of furniture are cut out.
    """
    parts: list[str] = []
    links: list[str] = []
    owner = top

    def close() -> None:
        text = _clean(parts)
        if text:
            blocks.append((text, owner, len(_clean(links))))
        parts.clear()
        links.clear()

    stack: list = [(top, iter(top.kids), False)]
    while stack:
        node, kids, link = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                if not parts:
                    owner = node
                    while owner.tag in INLINE and owner.up is not None:
                        owner = owner.up
                parts.append(kid)
                if link:
                    links.append(kid)
            elif kid.gone or marks and kid.marked and kid.tag not in ("html", "body", "main"):
                if kid.tag not in INLINE and kid.tag not in ("button", "select", "input", "label"):
                    close()
            elif kid.tag == "br":
                parts.append(" ")
            elif kid.tag in VOID:
                if kid.tag == "hr":
                    close()
            else:
                if kid.tag not in INLINE:
                    close()
                stack.append((kid, iter(kid.kids), link or kid.tag == "a"))
                break
        else:
            if node.tag not in INLINE:
                close()
            stack.pop()
    close()


# Elements that are themselves a block and pass their points on.
_BLOCKS = frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote figcaption caption address summary".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol dl table figure math".split())


def _heading_only(node: _Node) -> bool:
    """Whether the only text of an element's direct content is that of headings (and their own wrappers)."""
    while True:
        kids = [k for k in node.kids if (k.strip() if isinstance(k, str) else not k.gone and not k.marked and (k.kids or k.tag not in VOID))]
        if len(kids) != 1 or isinstance(kids[0], str):
            return bool(kids) and all(not isinstance(k, str) and k.tag in _HEADINGS for k in kids)
        if kids[0].tag in _HEADINGS:
            return True
        node = kids[0]


def main_text(html: str | None) -> str:
    """The main text of a page; empty if it has none."""
    if not html:
        return ""
    root = parse(html)
    blocks: list[tuple[str, _Node, int]] = []
    _unmark(root)
    _walk(root, blocks)
    if not blocks:
        _walk(root, blocks, marks=False)
    if not blocks:
        return ""
    size: dict[_Node, int] = {}
    linked: dict[_Node, int] = {}
    scored: list[_Node] = []
    for text, owner, link in blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        node, level = owner, 0
        while node is not None:
            size[node] = size.get(node, 0) + len(text)
            linked[node] = linked.get(node, 0) + link
            if (node.tag not in _BLOCKS or node.tag == "td" and node.blocks) and level < 6:  # a cell with blocks is a container
                if not node.score:
                    scored.append(node)
                node.score += points * (1.0, 0.5, 0.3, 0.2, 0.1, 0.05)[level]
                level += 1
            node = node.up
    dense = lambda n: linked[n] / max(size[n], 1)
    final = {n: n.score * (1 - dense(n)) * (1.5 if n.content else 1.0) for n in scored}
    best = max(scored, key=lambda n: final[n])  # the first of equals in page order
    points = final[best]
    path = []  # from the best container up to an article around it, or to a main
    node = best
    while node is not None and node.tag not in ("article", "main"):
        path.append(node)
        node = node.up
    inner: set = set()
    if node is not None and node.tag == "article":
        best = node
    elif node is not None:
        inner = {id(x) for x in (*path[1:], node)} - {id(best)}
    kept = {id(best)}
    if node is not None and node is not best:  # in a main: all that is not mostly links
        for up in (*path[1:], node):
            for kid in up.kids:
                if not isinstance(kid, str) and kid in size and id(kid) not in inner and (kid.tag in _HEADINGS or dense(kid) < 0.5):
                    kept.add(id(kid))
    elif best.up is not None:
        least = max(10.0, 0.2 * points)
        kids = [k for k in best.up.kids if not isinstance(k, str) and k in size]
        for kid in kids:
            prose = kid.tag == "p" and (size[kid] > 80 and dense(kid) < 0.25)
            if final.get(kid, 0.0) >= least and dense(kid) < 0.5 or prose:
                kept.add(id(kid))
        if node is None and dense(best.up) < 0.5:  # no article: headings, quotes and short prose between or beside what is kept
            for run in (kids, kids[::-1]):
                beside = False
                for kid in run:
                    beside = id(kid) in kept or beside and (kid.tag in _HEADINGS or _heading_only(kid) or (kid.tag in _BLOCKS or kid.tag in _LISTS) and dense(kid) < 0.5)
                    if beside:
                        kept.add(id(kid))
    out = []
    for text, owner, link in blocks:
        if id(owner) in inner and 2 * link < len(text):
            out.append(text)
            continue
        node = owner
        while node is not None and id(node) not in kept:
            node = node.up
        if node is not None:
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages(page_id, url, html)``.

    Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined by one space in page order. Null and
    empty pages, and such without text, give the empty string. Of several equal
    articles outside a main the first is the page's. Tags that are
    cut off or never closed end with the page. Repeated rows stay; other
    columns are ignored.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": [main_text(h) for h in batch["html"]]})

    src = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    made = src.mapInPandas(task, "page_id string, url string, text string")
    return made.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
