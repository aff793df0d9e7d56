"""HTML to text blocks: a forgiving scan of tags that keeps, for every block, its place in the document tree."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

#: Elements whose content is no text of the page.
SILENT = frozenset(("script", "style", "template", "svg", "iframe", "noscript", "head", "object", "canvas"))
#: Elements that run inside a block; all others begin and end one.
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input",
                    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
                    "tt", "u", "var", "wbr", "meta", "link", "base"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: An element that opens while the key's is the innermost open block closes it.
CLOSES = {"p": None, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)),
          "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}

_SPECIAL = re.compile(r"[>\"']")
_NAME_END = re.compile(r"[\s/>]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    names: frozenset[str]
    depth: int
    parent: Element | None = None
    path: frozenset[str] = field(default_factory=frozenset)  # tags and names on the way from the root


@dataclass
class Block:
    text: str
    element: Element
    linked: int  # characters inside links
    order: int


class Tags:
    """The comments, tags and declarations of a page, found from left to right; no part of a page is read once for every "<".

    A tag is "<", perhaps "/", a letter and more of its name, then anything up to the first ">" outside quotes; where the rest of
    the page has no such ">" the "<" is text. Where a tag ends depends only on the next quote or ">", and that is worked out once.
    """

    def __init__(self, page: str):
        self.page = page
        self.special = [m.start() for m in _SPECIAL.finditer(page)]
        self.breaks = [m.start() for m in _NAME_END.finditer(page)]
        self.ends: dict[int, int] = {}      # place of a quote or ">" outside quotes: behind the tag's ">", or -1
        self.in_name: dict[int, int] = {}   # end of a name: the last quote in front of it from which a tag ends, or -1
        self.greater = -2                   # the ">" found last; -1: none further on

    def _end(self, at: int) -> int:
        """Behind the first ">" outside quotes from ``at`` on; -1 without one."""
        way, found = [], -1
        while (i := bisect_left(self.special, at)) < len(self.special):
            place = self.special[i]
            if place in self.ends:
                found = self.ends[place]
                break
            way.append(place)
            if self.page[place] == ">":
                found = place + 1
                break
            close = self.page.find(self.page[place], place + 1)
            if close < 0:
                break
            at = close + 1
        self.ends.update(dict.fromkeys(way, found))
        return found

    def _tag(self, name: int) -> tuple[int, int] | None:
        """(end of the name, end of the tag) for a name that begins at ``name``."""
        i = bisect_left(self.breaks, name)
        stop = self.breaks[i] if i < len(self.breaks) else len(self.page)
        if (end := self._end(stop)) >= 0:
            return stop, end
        if stop not in self.in_name:  # a quote inside the name may open an attribute after all
            self.in_name[stop] = -1
            i = bisect_left(self.special, stop) - 1
            while i >= 0 and self.special[i] > (self.breaks[b - 1] if (b := bisect_left(self.breaks, stop)) else -1):
                if self._end(self.special[i]) >= 0:
                    self.in_name[stop] = self.special[i]
                    break
                i -= 1
        quote = self.in_name[stop]
        return (quote, self._end(quote)) if quote > name else None

    def after(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(start, end, name or None, whether it closes, attributes) of the next tag, comment or declaration."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("!--", at + 1):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, None, False, ""
            closing = page.startswith("/", at + 1)
            name = at + 1 + closing
            if page[name:name + 1].isascii() and page[name:name + 1].isalpha() and (tag := self._tag(name)):
                return at, tag[1], page[name:tag[0]], closing, page[tag[0]:tag[1] - 1]
            if page[at + 1:at + 2] in ("!", "?", "/") and (end := self._greater(at + 2)) >= 0:
                return at, end + 1, None, False, ""
            at += 1
        return None

    def _greater(self, at: int) -> int:
        """The next ">" in quotes or not."""
        if -1 != self.greater < at:
            self.greater = self.page.find(">", at)
        return self.greater


def _element(tag: str, attributes: str, parent: Element | None) -> Element:
    names: set[str] = set()
    if attributes and "=" in attributes:
        for found in _NAMES.findall(attributes):
            names.update("." + w.lower() for w in _PART.findall(" ".join(found)))
    path = (parent.path if parent else frozenset()) | names | {tag}
    return Element(tag, frozenset(names), parent.depth + 1 if parent else 0, parent, path)


def blocks_of(page: str | None) -> list[Block]:
    """The blocks with text, in page order. Character references are decoded, white space runs become one space."""
    page = page or ""
    root = Element("#", frozenset(), 0)
    here, out, parts, linked, in_link, at = root, [], [], 0, False, 0

    def close_block():
        nonlocal parts, linked, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, here, min(linked, len(text)), len(out)))
        parts, linked, in_link = [], 0, False

    def take(text: str):
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def left(element: Element) -> Element:
        opened[element.tag] -= 1
        return element.parent

    tags, unclosed, opened = Tags(page), set(), Counter()
    while found := tags.after(at):
        start, end, tag, closing, attributes = found
        take(page[at:start])
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SILENT and not closing:
            if not attributes.endswith("/") and tag not in unclosed:
                close = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                at = close.end() if close else (at if tag == "head" else len(page))
                if not close:
                    unclosed.add(tag)  # none further on either
            if tag not in ("svg", "object", "canvas"):
                close_block()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                parts.append(" ")
            continue
        close_block()
        if closing:
            if opened[tag]:
                while here.tag != tag:
                    here = left(here)
                here = left(here)
        else:
            ends = CLOSES.get(here.tag, frozenset())
            while here.parent is not None and (ends is None or tag in ends):
                here = left(here)
                ends = CLOSES.get(here.tag, frozenset())
            if tag not in VOID and not attributes.endswith("/"):
                here = _element(tag, attributes, here)
                opened[tag] += 1
    take(page[at:])
    close_block()
    return out


def tree_distance(a: Element, b: Element) -> int:
    """Edges on the way between two elements."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent or a
        else:
            b = b.parent or b
        steps += 1
    return steps
