"""Main-text extraction from HTML by tree scoring.

The page becomes a tree (void elements, raw text elements and implied end tags as browsers treat
them, unclosed elements end with their parent).  Elements that are never article text go: menus,
page headers and footers, asides, forms, scripts, notices, adverts, reader comments.  Paragraphs
pass points for their length and commas to their ancestors, half as many with each level; the element's
name (an article 25, a main element 10, ...) and class count too, and the sum is discounted by link
density.  The best container is kept, widened while the one around it keeps half of the score
(:func:`widened`), and of its siblings those that score or read like article text.

Captions are blocks; formulas (without their annotations, which are not shown) and the fallback text of
media elements are text like any other.  Drawings (svg) are not text.

Text is decoded, white space inside a block is one space, blocks are joined by one newline.

Defined cases: null or empty html gives an empty text; a page cut anywhere ends there; a page
without any paragraph that scores gives its article, main or body element's blocks; repeated rows
are extracted each on its own; an empty table gives an empty result; further columns are not read;
pages of any length and depth are read whole, in time that grows with their length.  Ids are long integers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import no_null, pieces

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

_RAW_NAMES = "script style textarea title noscript iframe xmp noembed noframes template svg".split()
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(_RAW_NAMES)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in _RAW_NAMES}
_GONE = frozenset("nav aside form button select dialog menu annotation annotation-xml head".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"li", "dd", "dt"}
#: Starting one of these ends an open one of those, unless an element of the third kind lies between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_SCOPE = frozenset("body table td th button".split())

_BAD = frozenset(
    "ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs byline combx comment comments commentlist cookie cookies consent disqus disclaimer footer footnav gdpr header masthead menu modal nav navbar navigation newsletter notice notification outbrain pager pagination popup promo promoted promotion recommend recommended related replies respond rss share sharing shoutbox sidebar skyscraper social sponsor sponsored subscribe subscription taboola tags teaser toolbar widget".split()
)
_GOOD = frozenset("article body content entry hentry main page post story text blog".split())
_NOT_ARTICLE = frozenset("ad ads advert comment comments promo related replies respond sponsored teaser".split())
_NOT_GOOD = _NOT_ARTICLE | frozenset("cookie footer menu nav share sidebar".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_START = {"article": 25, "main": 10, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5, "table": -3}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "score", "size", "linked", "commas", "holds", "_names")

    def __init__(self, tag: str, attrs: str, up: Node | None) -> None:
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list = []
        self.score, self.size, self.linked, self.commas = 0.0, 0, 0, 0
        self.holds = False
        self._names = None

    def attributes(self) -> dict[str, str]:
        return {a.lower(): unescape(b or c or d) for a, b, c, d in _ATTR.findall(self.attrs)} if self.attrs else {}

    def names(self) -> frozenset[str]:
        """The words of class and id."""
        if self._names is None:
            a = self.attributes() if "class" in self.attrs.lower() or "id" in self.attrs.lower() else {}
            self._names = frozenset(_PARTS.findall(_CAMEL.sub(" ", f"{a.get('class', '')} {a.get('id', '')}").lower()))
        return self._names


class _Open:
    """The open elements, outermost first, and for each name the depths at which it is open; so a tag that ends one is
    settled without a walk to the root."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def deepest(self, tags) -> int:
        """The depth of the innermost open element with one of these names, -1 without one."""
        return max((d[-1] for t in tags if (d := self.at.get(t))), default=-1)

    def cut(self, depth: int) -> None:
        """Ends all elements from this depth on, but never the root."""
        depth = max(depth, 1)
        while len(self.stack) > depth:
            self.at[self.stack.pop().tag].pop()


def parse(html: str) -> Node:
    root = Node("html", "", None)
    open_, at = _Open(root), 0
    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            open_.stack[-1].kids.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, attrs = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            depth = open_.deepest((name,))
            # an inline element's end does not reach out of a table's cell
            if depth > 0 and (name in _BLOCK or name in ("table", "td", "th") or depth > open_.deepest(("table", "td", "th"))):
                open_.cut(depth)
            continue
        if name in _RAW:
            if not attrs.endswith("/") or name != "svg":
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
            continue
        if name == "html" or name == "body" and open_.at.get("body"):
            continue
        if name in _ENDS_P and (p := open_.at.get("p")) and p[-1] > open_.deepest(_SCOPE):
            open_.cut(p[-1])
        if name in _IMPLIED:
            ends, until = _IMPLIED[name]
            out = open_.deepest(until)
            while (depth := open_.deepest(ends)) > out:
                open_.cut(depth)
        node = Node(name, attrs, open_.stack[-1])
        node.up.kids.append(node)
        if name not in _VOID and not (attrs.endswith("/") and name not in _BLOCK and name != "a"):
            open_.push(node)
    if at < len(html):
        open_.stack[-1].kids.append(unescape(html[at:]))
    return root


def _elements(root: Node) -> list[Node]:
    """All elements, parents before their children."""
    order = [root]
    for x in order:  # grows
        order += [k for k in x.kids if not isinstance(k, str)]
    return order


def _chain(x: Node | None) -> Iterator[Node]:
    while x is not None:
        yield x
        x = x.up


def _unwanted(x: Node, inside: bool) -> bool:
    """Whether an element is never article text; inside: within an article or main element."""
    if x.tag in _GONE or (x.tag in ("header", "footer") and not (inside and x.tag == "header")):
        return True
    if not x.attrs or x.tag in ("body", "html"):
        return False
    low = x.attrs.lower()
    if "hidden" in low or "none" in low:
        a = x.attributes()
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
            return True
    if "role" in low and x.attributes().get("role", "").lower() in _BAD_ROLES:
        return True
    bad = x.names() & _BAD
    if not bad or x.tag == "main":
        return False
    if x.tag == "article":
        return bool(bad & _NOT_ARTICLE)
    if x.names() & _GOOD and not bad & _NOT_GOOD:
        return False
    return not x.holds  # a page's layout may be named after its sidebar: what holds the article itself stays


def prune(root: Node) -> None:
    for x in reversed(_elements(root)):
        if x.up is not None and (x.holds or x.tag == "main" or x.tag == "article" and not x.names() & _NOT_ARTICLE):
            x.up.holds = True
    todo = [(root, False)]
    while todo:
        x, inside = todo.pop()
        inside = inside or x.tag in ("article", "main")
        x.kids = [k for k in x.kids if isinstance(k, str) or not _unwanted(k, inside)]
        todo += [(k, inside) for k in x.kids if not isinstance(k, str)]


def _weigh(root: Node) -> None:
    """Text size, linked text and commas of every element."""
    order = [(root, root.tag == "a")]
    for x, link in order:  # grows: parents before their children
        order += [(k, link or k.tag == "a") for k in x.kids if not isinstance(k, str)]
    for x, link in reversed(order):
        for k in x.kids:
            if isinstance(k, str):
                n = len(k.strip())
                x.size += n
                x.linked += n if link else 0
                x.commas += k.count(",") + k.count("、") + k.count("，")
            else:
                x.size += k.size
                x.linked += k.linked
                x.commas += k.commas


def _density(x: Node) -> float:
    return x.linked / x.size if x.size else 0.0


def _own_text(x: Node) -> bool:
    return any(isinstance(k, str) and k.strip() or not isinstance(k, str) and k.tag not in _BLOCK and k.size for k in x.kids)


_SCORED = frozenset("p pre blockquote td h2 h3 div section article main li".split())
_OWN = frozenset("div section article main".split())


def points(x: Node) -> float:
    """What an element with text of its own is worth: for its length and its commas."""
    if x.size < 1 or x.up is None or x.tag not in _SCORED or not _own_text(x):
        return 0.0
    return 1 + x.commas + min(x.size // 100, 3) if x.size >= 25 else 0.5


def _score(root: Node) -> Node | None:
    """Sets the scores of all elements that points reach; the best one, the first of equals.

    An element's points go to itself if it is a container, else to its parent, and from there on to each ancestor half
    of what its child got, so one pass from the leaves up does it however deep the tree."""
    order = _elements(root)
    for x in reversed(order):
        if own := points(x):
            (x if x.tag in _OWN else x.up).score += own
        if x.up is not None:
            x.up.score += x.score / 2
    best = None
    for x in order:
        if x.score > 0:
            x.score = (x.score + _START.get(x.tag, 0) + (25 if x.names() & _GOOD and x.tag not in ("body", "html") else 0)) * (1 - _density(x))
            if best is None or x.score > best.score:
                best = x
    return best


def _like_text(s: Node) -> bool:
    return not s.size or _density(s) < 0.25


def widened(best: Node) -> Node:
    """The best container, or the outermost one around it that step by step keeps half of the score: a part of an article
    gives way to the article, as an article or a part's name counts too and links count against.  What is neither an
    article nor a main element nor named like one must hold nothing but text beside."""
    x = best
    while x.up is not None and x.up.tag not in ("body", "html") and x.up.score >= 0.5 * x.score:
        if x.up.tag not in ("article", "main") and not x.up.names() & _GOOD and not all(isinstance(k, str) or k is x or _like_text(k) for k in x.up.kids):
            break
        x = x.up
    return x


def _find(root: Node, tags: tuple[str, ...]) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag in tags:
            out.append(x)
        todo += [k for k in reversed(x.kids) if not isinstance(k, str)]
    return out


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(text)
            run.clear()

    # (node, whether its end is reached): no recursion, however deep the tree
    todo: list = [(n, False) for n in reversed(nodes)]
    while todo:
        x, over = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif over:
            end()
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in _BLOCK:
                end()
                todo.append((x, True))
            todo += [(k, False) for k in reversed(x.kids)]
    end()
    return out


def main_text(html: str) -> str:
    if not html:
        return ""
    root = parse(html)
    prune(root)
    _weigh(root)
    best = _score(root)
    if best is None or best.score <= 0:
        best = next(iter(sorted(_find(root, ("article", "main")), key=lambda x: -x.size)), None) or next(iter(_find(root, ("body",))), root)
        return "\n".join(blocks([best]))
    best = widened(best)
    kept, least = [], max(10.0, 0.2 * best.score)
    for s in best.up.kids if best.up is not None else [best]:
        if isinstance(s, str):
            continue
        if s is best or s.score >= least and _like_text(s) or s.tag == "p" and s.size > 80 and _like_text(s) or s.tag in ("h1", "h2"):
            kept.append(s)
    return "\n".join(blocks(kept))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array([main_text(h) for h in part.column("text").to_pylist()], pa.string())], ["key", "url", "text"])

    from pyspark.sql import functions as F

    src = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, "key bigint, url string, text string")
