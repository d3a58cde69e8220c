"""A small reader of web pages: open elements, implied ends, raw-text elements and blocks of text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe noembed".split())
#: Elements whose content is text as it stands, up to their end tag.
LITERAL = frozenset(("xmp",))
#: Roots of formulas and drawings, whose elements may end themselves; block elements of the page end them.
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | FOREIGN
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
PARAGRAPH_BOUNDS = frozenset("html body table td th caption button object".split())
#: Elements that end an open one of the same set, up to the given bounds.
SIBLINGS = {name: (frozenset(group.split()), frozenset(bounds.split())) for group, bounds in (
    ("li", "ul ol menu"), ("dt dd", "dl"), ("tr", "table thead tbody tfoot"), ("td th", "tr table"), ("option", "select datalist"),
    ("thead tbody tfoot", "table")) for name in group.split()}

END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW | LITERAL}


@dataclass
class Page:
    """Nodes in page order: elements, and texts (tag ``#text``) with their text and number of block."""

    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)

    def add(self, tag: str, names: str, parent: int, text: str = "", block: int = 0) -> int:
        self.tag.append(tag)
        self.names.append(names)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.text.append(text)
        self.block.append(block)
        return len(self.tag) - 1


class Stack:
    """Open elements, and for each name where they lie, so that ends are found without going through them."""

    def __init__(self, page: Page, root: int) -> None:
        self.page, self.open, self.places = page, [root], {}

    def push(self, node: int) -> None:
        self.places.setdefault(self.page.tag[node], []).append(len(self.open))
        self.open.append(node)

    def innermost(self, names: frozenset) -> int:
        """Place of the innermost open element of these names, or 0."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, wanted: frozenset, bounds: frozenset = frozenset()) -> None:
        """Ends the innermost open element in ``wanted`` and all inside it, unless one of ``bounds`` lies further inside."""
        place = self.innermost(wanted)
        if place and place > self.innermost(bounds):
            for node in self.open[place:]:
                self.places[self.page.tag[node]].pop()
            del self.open[place:]


def read_page(html: str | None) -> Page:
    page = Page()
    stack, block, position = Stack(page, page.add("#page", "", -1)), 0, 0
    html = html or ""

    def text(piece: str) -> None:
        parent = stack.open[-1]
        if page.tag[-1] == "#text" and page.parent[-1] == parent and page.block[-1] == block:
            pieces[-1].append(piece)
        else:
            page.add("#text", "", parent, "", block)
            pieces.append([piece])
            written.append(len(page.tag) - 1)

    pieces: list[list[str]] = []
    written: list[int] = []
    literal: set[int] = set()
    while match := TOKEN.match(html, position):
        position = match.end()
        tag = match[2]
        if tag is None:
            piece = match[0]
            if piece[0] != "<" or piece == "<":
                text(piece)
            continue
        tag = tag.lower()
        foreign = stack.innermost(FOREIGN)
        block += tag not in INLINE and not (foreign and tag not in ENDS_PARAGRAPH)
        if match[1]:
            stack.close(frozenset((tag,)))
            continue
        if tag in ENDS_PARAGRAPH:
            stack.close(FOREIGN)
            stack.close(frozenset(("p",)), PARAGRAPH_BOUNDS)
        if tag in SIBLINGS:
            stack.close(*SIBLINGS[tag])
        if tag in RAW or tag in LITERAL:
            if not match[3].endswith("/"):
                end = END[tag].search(html, position)
                if tag in LITERAL:
                    stack.push(page.add(tag, attributes(match[3]), stack.open[-1]))
                    text(html[position : end.start() if end else len(html)])
                    literal.add(written[-1])
                    stack.close(frozenset((tag,)))
                    block += 1
                position = end.end() if end else len(html)
            continue
        node = page.add(tag, attributes(match[3]), stack.open[-1])
        if tag not in VOID and not (match[3].endswith("/") and (foreign or tag in FOREIGN)):
            stack.push(node)
    for node, parts in zip(written, pieces):
        whole = "".join(parts)
        page.text[node] = unescape(whole) if "&" in whole and node not in literal else whole
    return page


def attributes(tag: str) -> str:
    return " ".join("".join(found) for found in NAMES.findall(tag)) if tag else ""


def joined(page: Page, chosen: list[bool]) -> str:
    """Text of the chosen text nodes: white space inside a block as one space, blocks joined by one space."""
    blocks: dict[int, list[str]] = {}
    for i, tag in enumerate(page.tag):
        if tag == "#text" and chosen[i]:
            blocks.setdefault(page.block[i], []).append(page.text[i])
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return " ".join(line for line in lines if line)
