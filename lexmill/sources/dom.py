"""A small document tree from HTML, with the standard library's tokenizer.

Elements are kept in document order with the number of those below them, so a search runs over a slice. Markup that is
plain throughout (quoted or bare attributes, no entities in them, no comments, no scripts) is cut by one expression, to the
same tree; all else goes to the tokenizer."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BREAKS = {"address", "article", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "section", "table", "tr", "ul", "ol"}
HIDDEN = {"script", "style", "template", "head"}
#: an opened tag that closes these first
CLOSES = {"li": {"li"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}}


#: tags whose content is no markup to the tokenizer
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}
#: a start tag with its attributes, an end tag, or text
_PLAIN = re.compile(r"""<([A-Za-z][A-Za-z0-9]*)((?:[ \n]+[A-Za-z][A-Za-z0-9_-]*(?:="[^"<>&\0]*"|=[A-Za-z0-9._-]+)?)*)[ \n]*>|</([A-Za-z][A-Za-z0-9]*)>|([^<\0]+)""")
_ATTRIBUTE = re.compile(r"""([A-Za-z][A-Za-z0-9_-]*)(?:="([^"]*)"|=([^ \n]+))?""")


class Element:
    __slots__ = ("tag", "attrs", "children", "parent", "order", "at", "size")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.order: list[Element] = parent.order if parent else []
        self.at, self.size = len(self.order), 1
        self.order.append(self)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def below(self) -> list[Element]:
        """All below it, in document order."""
        return self.order[self.at + 1 : self.at + self.size]

    def find(self, test: Callable[[Element], bool]) -> list[Element]:
        return [e for e in self.below() if test(e)]

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self.below() if test(e)), None)

    def text(self, lines: bool = False) -> str:
        """Its text; with ``lines`` block elements begin and end lines."""
        if not lines and len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0].strip()
        out: list[str] = []
        todo: list[Element | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in HIDDEN or x is self:
                edge = ["\n"] if lines and x.tag in BREAKS else []
                todo += [*edge, *reversed(x.children), *edge]
        text = "".join(out)
        if not lines:
            return text.strip()
        rows = (" ".join(r.split()) for r in text.split("\n"))
        return "\n".join(r for r in rows if r)

    def following(self, tag: str) -> Element | None:
        """The next sibling element, if it has that tag."""
        own = [c for c in self.parent.children if isinstance(c, Element)] if self.parent else []
        at = own.index(self) + 1 if self in own else len(own)
        return own[at] if at < len(own) and own[at].tag == tag else None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = CLOSES.get(tag, ())
        while self.here.tag in closes and self.here.parent:
            self.here = self.here.parent
        e = Element(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(e)
        if tag not in VOID:
            self.here = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.here = self.here.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        e = self.here
        while e.parent and e.tag != tag:
            e = e.parent
        if e.tag == tag and e.parent:  # an end without a start is left out
            self.here = e.parent

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines aren't counted

    def plain(self, html: str) -> bool:
        """Reads plain markup; false, with a part read, where something else comes."""
        done = 0
        for m in _PLAIN.finditer(html):
            start, attrs, end, text = m.groups()
            if m.start() != done:
                return False
            done = m.end()
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            elif end:
                self.handle_endtag(end.lower())
            else:
                tag = start.lower()
                if tag in RAW:
                    return False
                self.handle_starttag(tag, [(k.lower(), v or w) for k, v, w in _ATTRIBUTE.findall(attrs)] if attrs else [])
        return done == len(html)


def parse(html: str | None) -> Element:
    b = _Builder()
    if not b.plain(html or ""):
        b = _Builder()
        b.feed(html or "")
        b.close()
    for e in reversed(b.root.order):
        if e.parent:
            e.parent.size += e.size
    return b.root


def tagged(tag: str, cls: str | None = None, **attrs: str) -> Callable[[Element], bool]:
    if not attrs:
        return (lambda e: e.tag == tag) if cls is None else (lambda e: e.tag == tag and cls in e.classes)
    return lambda e: e.tag == tag and (cls is None or cls in e.classes) and all(e.attrs.get(k) == v for k, v in attrs.items())


def classed(cls: str) -> Callable[[Element], bool]:
    return lambda e: cls in e.classes
