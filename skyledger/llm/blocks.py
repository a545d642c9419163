"""HTML as a sequence of text blocks, each with the tags it stands in."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from html import unescape
from typing import Any

# Elements whose content is no text, elements without content, and
# elements that do not break a block.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s"
    " samp small span strike strong sub sup time tt u var wbr".split()
)
#: Of the first, those that run to the end of the page without an end tag.
OPEN_RAW = frozenset(("script", "style", "title", "textarea"))
#: Elements that a new one of the same group closes.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
#: Besides elements whose content is no text, those that do not close an open head.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_END = {tag: re.compile(rf"</{tag}[\s>/]", re.IGNORECASE) for tag in RAW}
_PART = re.compile(r"[a-z]+")


class Place:
    """An open element: its own tokens, and the element around it.

    Blocks share the places they stand in, so a page of many open tags costs
    their number and not the sum of all paths.
    """

    __slots__ = ("around", "known", "tokens")

    def __init__(self, around: Place | None, tokens: tuple[str, ...]) -> None:
        self.around = around
        self.tokens = tokens
        self.known: dict[str, Any] = {}

    def inward(self) -> Iterator[tuple[str, ...]]:
        """Tokens of this element, then of those around it."""
        at: Place | None = self
        while at is not None:
            yield at.tokens
            at = at.around

    def last(self, n: int) -> tuple[str, ...]:
        """The last tokens of the path."""
        found: tuple[str, ...] = ()
        for tokens in self.inward():
            found = tokens + found
            if len(found) >= n:
                break
        return found[-n:]

    def summed(self, name: str, start: Any, add: Callable[[Any, tuple[str, ...]], Any]) -> Any:
        """``add`` over the path from outside in, each place worked out once."""
        open_: list[Place] = []
        at: Place | None = self
        while at is not None and name not in at.known:
            open_.append(at)
            at = at.around
        value = start if at is None else at.known[name]
        for place in reversed(open_):
            value = place.known[name] = add(value, place.tokens)
        return value


@dataclass
class Block:
    """A run of text between block-level tags."""

    place: Place
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    marked: bool = False

    @property
    def path(self) -> tuple[str, ...]:
        """Tags, classes, ids and roles from outside in."""
        return tuple(t for tokens in reversed(list(self.place.inward())) for t in tokens)

    @cached_property
    def text(self) -> str:
        """The text, worked out once; asked for when the pieces are complete."""
        return " ".join(unescape("".join(self.pieces)).split())


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role."""
    named = [tag]
    if attributes:
        for _, value in _NAMED.findall(attributes):
            named += [f".{w}" for w in _PART.findall(value.lower())]
    return tuple(named)


class _Open:
    """The open elements, with counts of what is asked for often."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Place, bool]] = []
        self.count: Counter[str] = Counter()
        self.marks = 0
        self.root = Place(None, ())

    @property
    def place(self) -> Place:
        return self.stack[-1][1] if self.stack else self.root

    def push(self, tag: str, tokens: tuple[str, ...], mark: bool) -> None:
        self.stack.append((tag, Place(self.place, tokens), mark))
        self.count[tag] += 1
        self.marks += mark

    def cut(self, k: int) -> None:
        for tag, _, mark in self.stack[k:]:
            self.count[tag] -= 1
            self.marks -= mark
        del self.stack[k:]

    def close(self, tag: str) -> None:
        """Closes the nearest element of this name and all within it."""
        if self.count[tag] > 0:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.cut(k)

    def close_implied(self, closed: tuple[str, ...]) -> None:
        """Closes the nearest of these, unless a block container stands before it."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in closed:
                self.cut(k)
                return
            if self.stack[k][0] not in INLINE:
                return


def parse(html: str) -> list[Block]:
    """The blocks with text, in page order."""
    blocks: list[Block] = []
    opened = _Open()
    endless: set[str] = set()
    current: Block | None = None
    at, end = 0, len(html)

    def add(piece: str) -> None:
        nonlocal current
        if current is None:
            if not piece.strip():
                return
            opened.close("head")
            current = Block(opened.place, marked=opened.marks > 0)
            blocks.append(current)
        current.pieces.append(piece)
        if opened.count["a"]:
            current.linked += len(piece)

    while at < end:
        opens = html.find("<", at)
        if opens < 0:
            add(html[at:])
            break
        if opens > at:
            add(html[at:opens])
        m = _TAG.match(html, opens) or _LOOSE.match(html, opens)
        if not m:
            add("<")
            at = opens + 1
            continue
        at = m.end()
        name = m.group(2) if m.lastindex else None
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            if tag not in INLINE:
                current = None
            opened.close(tag)
            continue
        if tag in RAW:
            if not m.group(3).endswith("/"):
                closing = None if tag in endless else _END[tag].search(html, at)
                if closing:
                    at = html.find(">", closing.start()) + 1 or end
                else:
                    endless.add(tag)
                    at = end if tag in OPEN_RAW else at
            continue
        if tag not in IN_HEAD:
            opened.close("head")
        if tag not in INLINE:
            current = None
            if tag in CLOSES:
                opened.close_implied(CLOSES[tag])
        elif tag == "br" and current is not None:
            current.pieces.append(" ")
        if tag not in VOID and not m.group(3).endswith("/"):
            # Marks that rearranged pages carry leave no trace in the path.
            tokens = () if tag == "x-main" else _tokens(tag, m.group(3))
            opened.push(tag, tokens, "data-main" in m.group(3))
    return [b for b in blocks if b.text]
