"""Text blocks of web pages in page order, each with the path of elements around it.

A tolerant reader of tag soup: markup is found by one expression, elements that end without a tag are closed where
the HTML rules say so, unmatched end tags are passed over. Scripts, styles and the like have no text. A block
is the text between two places where a block element begins or ends, or a line break stands; inline
elements and comments do not divide it. Character references are decoded, white space becomes one space.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html input legend li main menu nav ol option p pre search section select"
    " summary table tbody td textarea tfoot th thead title tr ul".split()
)
# Their content is text up to their end tag.
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
# Nothing in them is shown as text of the page.
SILENT = frozenset("head noscript template svg select datalist object audio video canvas button".split())
IN_HEAD = frozenset("meta link title style script base noscript template".split())
# Start tags that end an open element of the listed names, and the elements that such an end does not cross.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NO_P_END = frozenset("table td th caption button object template html".split())
_CLOSES_P = BLOCK - {"br", "button", "caption", "col", "colgroup", "input", "legend", "option", "select", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr"}

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_TOKEN = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Elements of a path that are remembered: the outermost and the innermost.
OUTER, INNER = 6, 12


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]  # names of elements, outermost first
    tokens: tuple[tuple[str, ...], ...]  # words of their classes, ids and roles
    linked: int  # characters within links


def _tokens(attributes: str) -> tuple[str, ...]:
    found = []
    for value in _NAMED.findall(attributes):
        found += _TOKEN.findall(_CAMEL.sub(" ", value.strip("\"'")).lower())
    return tuple(found[:12])


class _Reader:
    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter[str] = Counter()
        self.silent = 0
        self.parts: list[str] = []
        self.where: list[tuple[str, tuple[str, ...]]] | None = None
        self.linked = 0
        self.blocks: list[Block] = []

    def text(self, raw: str) -> None:
        if not raw or self.silent:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if self.where is None and not text.isspace():
            deep = len(self.stack) > OUTER + INNER
            self.where = self.stack[:OUTER] + self.stack[-INNER:] if deep else list(self.stack)
        if self.open["a"]:
            self.linked += len(text.strip())
        self.parts.append(text)

    def flush(self) -> None:
        if self.where is not None and (text := " ".join("".join(self.parts).split())):
            names, tokens = zip(*self.where, strict=True) if self.where else ((), ())
            self.blocks.append(Block(text, names, tokens, self.linked))
        self.parts, self.where, self.linked = [], None, 0

    def push(self, name: str, tokens: tuple[str, ...]) -> None:
        self.stack.append((name, tokens))
        self.open[name] += 1
        self.silent += name in SILENT

    def pop(self) -> str:
        name, _ = self.stack.pop()
        self.open[name] -= 1
        self.silent -= name in SILENT
        return name

    def close(self, names: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
        """End the innermost element of these names, and what is open within it, unless a barrier stands before."""
        for name, _ in reversed(self.stack):
            if name in names:
                while self.pop() not in names:
                    pass
                return
            if name in barrier:
                return

    def start(self, name: str, attributes: str) -> None:
        opened = self.open
        if name in BLOCK:
            self.flush()
        if opened["head"] and name not in IN_HEAD:
            self.close({"head"}, set())
        if name in _CLOSES_P and opened["p"]:
            self.close({"p"}, _NO_P_END)
        if name in ENDS and any(opened[n] for n in ENDS[name][0]):
            self.close(*ENDS[name])
        if name == "a" and opened["a"]:
            self.close({"a"}, _NO_P_END)
        if name not in VOID:
            self.push(name, _tokens(attributes) if attributes else ())

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        if self.open[name]:
            while self.pop() != name:
                pass


def read_blocks(page: str) -> list[Block]:
    """The page's blocks that have text."""
    reader, at = _Reader(), 0
    while match := _MARKUP.search(page, at):
        reader.text(page[at : match.start()])
        at = match.end()
        name = match[2]
        if not name:
            continue
        name = name.lower()
        if match[1]:
            reader.end(name)
            continue
        if name in RAW:
            if name in BLOCK:
                reader.flush()
            closing = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if closing:
                at = closing.start()
            elif name not in ("title", "textarea"):
                at = len(page)
            continue
        reader.start(name, match[3])
    reader.text(page[at:])
    reader.flush()
    return reader.blocks
