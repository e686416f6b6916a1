"""A tolerant HTML reader: block-level elements as nodes, and the text blocks between their borders."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head script style textarea title iframe noembed noframes xmp template svg math canvas object select button noscript audio video".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul
    """.split()
)
#: Start tags that may stand in a head; any other one ends it, as text does. Its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CONTROLS = frozenset("input button select textarea label option".split())
#: A start tag on the left closes an open element of the second set, looked for up to one of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: Tags with unclosed quotes after which a page's quotes are not looked at.
MOST_OPEN_QUOTES = 16
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|data-testid)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、]")


@dataclass
class Page:
    """Nodes in page order (a parent before its children), and blocks as (node, text)."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    named: list[str] = field(default_factory=list)  # attribute values that name an element
    hidden: list[bool] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)  # of each block

    def open(self, tag: str, parent: int, attributes: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.named.append(" ".join(next(filter(None, m.groups()[1:]), "") for m in ATTRIBUTE.finditer(attributes)) if attributes.strip() else "")
        self.hidden.append(bool(attributes) and HIDDEN.search(attributes) is not None)
        self.controls.append(0)
        return len(self.tag) - 1


def clean(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


class _Open:
    """The open elements, with the places of each name and of the block-level ones, so that no tag searches the stack."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.nodes: list[int] = []  # of block-level elements, else -1
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, node: int) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        if node >= 0:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def pop(self) -> tuple[str, int]:
        name, node = self.names.pop(), self.nodes.pop()
        self.at[name].pop()
        if node >= 0:
            self.blocks.pop()
        return name, node

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)


def _tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag, comment or declaration; the caller sends where to go on, or None.

    A tag ends at a > outside of quotes, or, where quotes are not closed, at the next one. After
    MOST_OPEN_QUOTES such tags quotes are not looked at any more, and behind the last > there is
    only text, so that no broken page is read over and over.
    """
    at, broken, end = 0, 0, source.rfind(">") + 1
    while found := (TAG if broken < MOST_OPEN_QUOTES else PLAIN_TAG).search(source, at, end):
        if found.lastindex is None and found.end() == end and source.startswith("<!--", found.start()) and not found.group().endswith("-->"):
            yield found.start(), len(source), "", "", ""
            return
        broken += found.re is TAG and found.group(5) is not None
        groups = found.group(1, 2, 3) if found.re is PLAIN_TAG or found.group(2) else found.group(4, 5, 6)
        at = (yield (found.start(), found.end(), *(x or "" for x in groups))) or found.end()
    opened = source.find("<!--", at)
    if opened >= 0:
        yield opened, len(source), "", "", ""


def parse(source: str | None) -> Page:
    """Read a page in time linear in its length; anything is a page, and an empty one has a root and no blocks."""
    source = source or ""
    page = Page()
    root = page.open("html", -1, "")
    stack = _Open()
    stack.push("html", root)
    node, links, dropped = root, 0, 0
    pieces: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = clean("".join(pieces))
            if text:
                page.blocks.append((node, text))
                page.link_chars.append(min(linked, len(text)))
            pieces.clear()
        linked = 0

    def close_to(i: int) -> None:
        """Close the open elements from place i on."""
        nonlocal node, links, dropped
        while len(stack.names) > i:
            if stack.nodes[-1] >= 0:
                end_block()
            name, _ = stack.pop()
            links -= name == "a"
            dropped -= name in DROPPED
            node = stack.nodes[stack.blocks[-1]]

    def add(text: str) -> None:
        nonlocal linked
        if dropped and stack.names[-1] == "head" and text.strip():
            close_to(len(stack.names) - 1)
        if text and not dropped:
            pieces.append(text)
            if links:
                linked += len(text)

    at, go_on = 0, None
    tags = _tags(source)
    while True:
        try:
            start, end, ends, name, attributes = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        add(source[at:start])
        at = end
        if not name:
            continue
        name = name.lower()
        if ends:
            place = stack.last(name)
            # an inline element ends within its block
            if place > 0 and (place > stack.blocks[-1] or name in BLOCK or name in DROPPED):
                close_to(place)
            continue
        if dropped and stack.names[-1] == "head" and name not in IN_HEAD:
            close_to(len(stack.names) - 1)
        if name in CONTROLS:
            page.controls[node] += 1
        if name == "br" or name == "img":
            if not dropped:
                pieces.append(" ")
            continue
        if name in ("html", "body"):
            # an open head ends with what is left open in it; a template's content is not the page's
            if dropped and name == "body" and (head := stack.last("head")) > stack.last("template"):
                close_to(head)
            end_block()
            continue
        if name == "head" and dropped and stack.last("head") > 0:
            continue
        if name in BLOCK:
            end_block()
            if page.tag[node] == "p":
                close_to(stack.blocks[-1])
            if name in CLOSES:
                targets, borders = CLOSES[name]
                place = stack.last(*targets)
                if place > 0 and place > stack.last(*borders):
                    close_to(place)
            if name in VOID:
                continue
            node = page.open(name, node, attributes)
            stack.push(name, node)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}[\s/>]|\Z", re.I).search(source, at)
            finish = source.find(">", closing.start())
            at = go_on = len(source) if finish < 0 else finish + 1
            continue
        stack.push(name, -1)
        links += name == "a"
        dropped += name in DROPPED
    add(source[at:])
    end_block()
    return page
