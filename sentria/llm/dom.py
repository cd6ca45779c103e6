"""A forgiving reader of HTML: blocks of text in a tree, with what describes each node."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MARKUP = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text of the page.
RAW = frozenset("script style template noscript iframe svg object title textarea select canvas math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
#: Open elements that a start tag closes.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "body": {"head"},
}
#: Open elements that closing by the table above does not look beyond.
FENCES = frozenset("ul ol dl table body div article section main".split())


@dataclass
class Node:
    """An element that holds blocks or a run of text."""

    tag: str
    attributes: str
    parent: int
    depth: int
    run: bool = False
    marked: bool = False
    parts: list[str] = field(default_factory=list)
    links: int = 0


def parse(html: str | None) -> list[Node]:
    """Nodes in page order, parents before children; node 0 is the page.

    Text lies in nodes with ``run``: the inline content of a block between two of
    its block children. Elements of ``RAW`` and comments leave nothing. Unclosed
    elements end with their parents, stray end tags are ignored.
    """
    nodes = [Node("#page", "", -1, 0)]
    stack: list[tuple[str, int]] = [("#page", 0)]
    html = html or ""
    at, run, in_link = 0, -1, 0

    def text(chunk: str) -> None:
        nonlocal run
        if not chunk:
            return
        if run < 0:
            if chunk.isspace():
                return
            owner = stack[-1][1]
            own = nodes[owner]
            run = len(nodes)
            nodes.append(Node(own.tag, own.attributes, owner, own.depth + 1, True, own.marked))
        nodes[run].parts.append(chunk)
        if in_link:
            nodes[run].links += len(chunk)

    while True:
        found = MARKUP.search(html, at)
        if not found:
            text(html[at:])
            return nodes
        text(html[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if found.group(1):
            if tag == "a":
                in_link = 0
            if tag in INLINE:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    run, in_link = -1, 0
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if not found.group(3).rstrip().endswith("/"):
                at = end.end() if end else len(html)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in INLINE:
            in_link = 1 if tag == "a" else in_link
            continue
        run, in_link = -1, 0
        if tag in VOID:
            continue
        if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (stack[-1][0] == "p" or tag[0] == "h" or tag == "p"):
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in FENCES:
                    break
        owner = stack[-1][1]
        attributes = found.group(3)
        nodes.append(Node(tag, attributes, owner, nodes[owner].depth + 1, False, "data-main" in attributes))
        if not attributes.rstrip().endswith("/"):
            stack.append((tag, len(nodes) - 1))


def described(attributes: str) -> str:
    """class, id and role of a tag, in lower case."""
    if "=" not in attributes:
        return ""
    return " ".join(
        (m[1] or m[2] or m[3]).lower() for m in ATTRIBUTE.findall(attributes) if m[0].lower() in ("class", "id", "role")
    )
