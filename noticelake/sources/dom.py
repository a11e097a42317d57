"""A small element tree of a page, with the few selections that scans need.

Broken markup gives what could be read: stray ends are passed over, elements
without an end reach to the end of the element around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
_SELECTOR = re.compile(r"^([a-z0-9]*)(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:='([^']*)')?\])?$")


class Node:
    """An element: its name, attributes, children (elements and texts) and parent."""

    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in page order."""
        stack = [x for x in reversed(self.children) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node))

    def strings(self) -> Iterator[str]:
        """The texts below that aren't blank, stripped."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    if child.name not in SILENT:
                        stack.append(iter(child.children))
                        break
                elif child.strip():
                    yield child.strip()
            else:
                stack.pop()

    def text(self) -> str:
        return " ".join(" ".join(self.strings()).split())

    def above(self) -> Iterator[Node]:
        """The elements around, from the nearest; the page itself is the last."""
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def enclosing(self, name: str) -> Node | None:
        return next((n for n in self.above() if n.name == name), None)

    def links(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.name == "a" and "href" in n.attrs)

    def matches(self, selector: str) -> bool:
        """``tag``, ``.class``, ``#id``, ``[attribute]`` or ``[attribute='value']``, the
        last four also after a tag."""
        tag, label, ident, attribute, value = _SELECTOR.match(selector).groups()
        if tag and tag != self.name:
            return False
        if label and label not in self.attrs.get("class", "").split():
            return False
        if ident and ident != self.attrs.get("id"):
            return False
        return not attribute or (attribute in self.attrs and (value is None or self.attrs[attribute] == value))

    def select(self, selectors: Sequence[str]) -> list[Node]:
        """Elements below that match any of the selectors, in page order."""
        return [n for n in self.walk() if any(n.matches(s) for s in selectors)]

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [x for x in self.parent.children if x is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.open.get(tag):
            name, self.here = self.here.name, self.here.parent
            self.open[name] -= 1
            if name == tag:
                return

    def handle_data(self, data):
        self.here.children.append(data)


def parse(html: str | None) -> Node:
    """The root above a page's elements."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
