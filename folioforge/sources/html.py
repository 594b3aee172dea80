"""A small element tree from HTML, by the standard library's tokenizer.

Void elements hold nothing, an open p, li, td, th or tr ends where a browser ends it, an end tag
without its start is ignored, and what is open at the end ends there.  Scripts, styles, menus and
noscript parts are left out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("script style nav noscript".split())
ENDED_BY = {"p": {"div", "p", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "footer", "header"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
BLANKS = re.compile("[　  \t]+")


class Element:
    __slots__ = ("tag", "classes", "id", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Element | None) -> None:
        self.tag, self.up = tag, up
        self.classes, self.id = attrs.get("class", "").split(), attrs.get("id", "")
        self.kids: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """All elements below, in page order."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [k for k in reversed(e.kids) if isinstance(k, Element)]

    def strings(self) -> Iterator[str]:
        todo: list[Element | str] = list(reversed(self.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                yield k
            else:
                todo += reversed(k.kids)

    def raw(self) -> str:
        return "".join(self.strings())

    def text(self) -> str:
        """Pieces of text, each trimmed, joined by a space; runs of blanks as one."""
        return BLANKS.sub(" ", " ".join(s for x in self.strings() if (s := x.strip()))).strip()

    def first(self, tag: str | None = None, cls: str | None = None, id: str | None = None) -> Element | None:
        return next((e for e in self.walk() if (tag is None or e.tag == tag) and (cls is None or cls in e.classes) and (id is None or e.id == id)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.here.up is not None and tag in ENDED_BY.get(self.here.tag, ()):
            self.here = self.here.up
        e = Element(tag, {a: b or "" for a, b in attrs}, self.here)
        self.here.kids.append(e)
        if tag not in VOID:
            self.here = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        e = self.here
        while e is not None and e.tag != tag:
            e = e.up
        if e is not None and e.up is not None:
            self.here = e.up

    def handle_data(self, data: str) -> None:
        self.here.kids.append(data)


def tree(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    todo = [b.root]
    while todo:
        e = todo.pop()
        e.kids = [k for k in e.kids if isinstance(k, str) or k.tag not in LEFT_OUT]
        todo += [k for k in e.kids if isinstance(k, Element)]
    return b.root
