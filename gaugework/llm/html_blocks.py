"""A page's blocks in order: the text runs between block-level tags, with the open elements around them."""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from html import unescape
from typing import NamedTuple

#: Elements that don't end a block, have no end tag, or whose content is no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title template noscript iframe object svg textarea select".split())
#: Of these the content is no markup: without an end tag they reach to the end of the page, as in browsers.
RAW = frozenset("script style title textarea iframe".split())
#: What can stand in a head; any other start tag ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: An open element of the key ends where a start tag named in the value comes.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}
}
TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>"
    r"|<[!?][^>]*+>|<[/!?a-zA-Z][^>]*+\Z",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
def ends(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?![a-zA-Z0-9])[^>]*>?", re.IGNORECASE)


#: Elements that say nothing without a class, id or role: a page looks the same with more or fewer of them.
PLAIN = frozenset({"div", "span"})
PATHS = 512


@functools.lru_cache(50_000)
def marks(label: str, outer: str) -> int:
    """Bits of the buckets of an element's name, of its class words, and of the pair of it and the element around it."""
    tag, *words = label.split(" ")
    mask = 0
    for name in (tag, f"{outer}>{tag}", *("." + w for w in words)):
        mask |= 1 << zlib.crc32(name.encode()) % PATHS
    return mask


class Element:
    """An open element that isn't plain: its name, the words of its class, id and role with it, the bits of the whole path of
    such elements from the outermost to it, and their number."""

    __slots__ = ("tag", "label", "mask", "depth")

    def __init__(self, around: Element | None, label: str):
        self.label, self.tag = label, label.split(" ", 1)[0]
        self.mask = marks(label, around.tag if around else "") | (around.mask if around else 0)
        self.depth = around.depth + 1 if around else 1


class Block(NamedTuple):
    text: str
    inside: Element | None  # the innermost open element that isn't plain
    linked: int  # characters in links


class Stack:
    """The open elements, with the places of each tag: what a tag costs doesn't depend on the depth."""

    def __init__(self):
        self.open: list[tuple[str, Element | None]] = []  # the name, and the innermost element that isn't plain
        self.at: dict[str, list[int]] = defaultdict(list)

    def top(self) -> Element | None:
        return self.open[-1][1] if self.open else None

    def last(self, *tags: str) -> int:
        k = -1
        for t in tags:
            if (own := self.at[t]) and own[-1] > k:
                k = own[-1]
        return k

    def push(self, label: str) -> None:
        tag, top = label.split(" ", 1)[0], self.top()
        self.at[tag].append(len(self.open))
        self.open.append((tag, top if label in PLAIN else Element(top, label)))

    def close(self, k: int) -> None:
        while len(self.open) > k:
            self.at[self.open.pop()[0]].pop()


def element(tag: str, attributes: str) -> str:
    words = [w for m in ATTRIBUTE.finditer(attributes) for w in NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    return " ".join([tag, *words])


def head_end(html: str, at: int) -> int:
    """Where a head's content ends: behind </head>, or before the first tag or text that cannot stand in a head."""
    missing: set[str] = set()
    while m := TAG.search(html, at):
        if html[at : m.start()].strip():
            return at
        end, tag = (m[1], m[2]) if m[2] else (m[4], m[5])
        tag = (tag or "").lower()
        if end and tag in ("head", "body", "html"):
            return m.end() if tag == "head" else m.start()
        if tag and not end and tag not in IN_HEAD and tag != "head":
            return m.start()
        at = m.end()
        if not end and tag in HIDDEN and tag not in missing and (over := ends(tag).search(html, at)):
            at = over.end()
        elif not end and tag in RAW:
            return len(html)
        elif not end and tag in HIDDEN:
            missing.add(tag)
    return at


def blocks(html: str) -> list[Block]:
    """All blocks with text: character references decoded, white space as one space, trimmed."""
    found: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    linked = at = 0
    missing: set[str] = set()  # hidden elements of which no end tag follows

    def flush() -> None:
        nonlocal linked
        if text := " ".join("".join(parts).split()):
            found.append(Block(text, stack.top(), min(linked, len(text))))
        parts.clear()
        linked = 0

    while True:
        m = TAG.search(html, at)
        if own := html[at : m.start() if m else len(html)]:
            own = unescape(own)
            parts.append(own)
            linked += len(own) if stack.at["a"] else 0
        if not m:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if (k := stack.last(tag)) >= 0:
                if tag not in INLINE:
                    flush()
                stack.close(k)
            elif tag == "p":
                flush()
            continue
        if tag in HIDDEN:
            if tag == "head":
                at = head_end(html, at)
            elif not attributes.endswith("/"):
                if tag not in missing and (over := ends(tag).search(html, at)):
                    at = over.end()
                else:
                    missing.add(tag)
                    at = len(html) if tag in RAW else at
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if (k := stack.last("p")) >= 0 and stack.last("table", "button", "td", "th") < k:
                stack.close(k)
            for inner, by in CLOSED_BY.items():
                if tag in by and (k := stack.last(inner, "ul", "ol", "dl", "table")) >= 0 and stack.open[k][0] == inner:
                    stack.close(k)
        if tag not in VOID and not (attributes.endswith("/") and tag not in INLINE):
            stack.push(element(tag, attributes))
    flush()
    return found
