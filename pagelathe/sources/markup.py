"""A small XML reader: events from one scanner, a tree for callers that want one.

Document type declarations are refused; entities are the five named ones and
numeric ones; what is not a scalar value becomes U+FFFD; unknown entities stay.
Names carry the prefix that the caller gives their namespace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

MOST_DEPTH = 256
_XML = "http://www.w3.org/XML/1998/namespace"
_TOKEN = re.compile(
    r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(?P<cdata>.*?)\]\]>|(?P<dtd><!)|</(?P<close>[^>]*)>"
    r"|<(?P<open>[^\s<>/=\"'!?&]+)(?P<attrs>(?:\s+[^\s=<>/\"']+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?P<empty>/?)>|(?P<text>[^<]+)|(?P<bad><)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=<>/\"']+)\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)')")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|(lt|gt|amp|quot|apos));")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


class MarkupError(ValueError):
    pass


def decode_entities(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3]]
        digits, base = (m[1], 16) if m[1] else (m[2], 10)
        code = int(digits, base) if len(digits.lstrip("0")) <= 8 else -1
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "�"

    return _ENTITY.sub(one, text) if "&" in text else text


@dataclass
class Node:
    name: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)

    def all(self, name: str | None = None) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and (name is None or c.name == name)]

    def first(self, name: str) -> Node | None:
        return next(iter(self.all(name)), None)

    def find(self, name: str) -> Node | None:
        """Depth-first, this node's descendants."""
        for c in self.all():
            if c.name == name:
                return c
            if (deep := c.find(name)) is not None:
                return deep
        return None

    @property
    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text for c in self.children)


def tokens(text: str) -> Iterator[re.Match]:
    for m in _TOKEN.finditer(text):
        if m["dtd"]:
            raise MarkupError("a document type declaration is not accepted")
        if m["bad"]:
            raise MarkupError("malformed markup")
        yield m


def parse(text: str, prefixes: dict[str, str | list[str]] | None = None) -> Node:
    """The root of a document; prefixes: wanted prefix -> namespace or namespaces."""
    wanted = {_XML: "xml"}
    for prefix, spaces in (prefixes or {}).items():
        wanted |= dict.fromkeys([spaces] if isinstance(spaces, str) else spaces, prefix)

    def named(raw: str, scope: dict, attribute: bool) -> str:
        prefix, _, local = raw.rpartition(":")
        space = None if attribute and not prefix else scope.get(prefix)
        return raw if not space else f"{wanted[space]}:{local}" if space in wanted else f"{{{space}}}{local}"

    top = Node("#document")
    open_: list[tuple[Node, str, dict]] = [(top, "", {"xml": _XML})]
    for m in tokens(text):
        node, raw, scope = open_[-1]
        if m["close"] is not None:
            if len(open_) == 1 or m["close"].strip() != raw:
                raise MarkupError("an end tag does not fit")
            open_.pop()
        elif m["open"] is not None:
            pairs = [(k, decode_entities(a or b)) for k, a, b in _ATTRIBUTE.findall(m["attrs"])]
            spaces = {k[6:]: v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
            scope = scope | spaces if spaces else scope
            made = Node(named(m["open"], scope, False), {named(k, scope, True): v for k, v in pairs if k != "xmlns" and not k.startswith("xmlns:")})
            node.children.append(made)
            if not m["empty"]:
                if len(open_) > MOST_DEPTH:
                    raise MarkupError("nested too deeply")
                open_.append((made, m["open"], scope))
        else:
            piece = m["cdata"] if m["cdata"] is not None else decode_entities(m["text"] or "")
            if piece and node.children and isinstance(node.children[-1], str):
                node.children[-1] += piece
            elif piece:
                node.children.append(piece)
    if len(open_) > 1:
        raise MarkupError("incomplete")
    if not top.all():
        raise MarkupError("no element")
    return top.all()[0]
