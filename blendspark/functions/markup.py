"""A page as a small tree, for use inside ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# What an opening tag closes when its own kind is still open.
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Node:
    """An element; ``children`` holds nodes and strings."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find_all(self, tag: str | None = None, **attrs: str) -> list[Node]:
        """Elements by tag and exact attribute; ``class_`` looks for one class name."""
        wanted = attrs.pop("class_", None)
        return [
            n for n in self.walk()
            if (tag is None or n.tag == tag)
            and (wanted is None or wanted in n.classes)
            and all(n.attrs.get(k) == v for k, v in attrs.items())
        ]

    def find(self, tag: str | None = None, **attrs: str) -> Node | None:
        return next(iter(self.find_all(tag, **attrs)), None)

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                stack.extend(reversed(item.children))

    def text(self, separator: str = "") -> str:
        """Trimmed strings, the empty ones left out."""
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)

    def next_sibling(self, tag: str | None = None) -> Node | None:
        after = self.parent.children[self.parent.children.index(self) + 1 :] if self.parent else []
        return next((n for n in after if isinstance(n, Node) and (tag is None or n.tag == tag)), None)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def html(self) -> str:
        """The markup; pages may be nested to any depth, so nothing here recurses."""
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            at = todo.pop()
            if isinstance(at, _Tag):
                out.append(at)
            elif isinstance(at, Node):
                if at.tag:
                    attrs = "".join(f' {k}="{escape(v)}"' for k, v in at.attrs.items())
                    out.append(f"<{at.tag}{attrs}>")
                    if at.tag in VOID:
                        continue
                    todo.append(_Tag(f"</{at.tag}>"))
                todo.extend(reversed(at.children))
            else:
                out.append(escape(at, quote=False))
        return "".join(out)


class _Tag(str):
    """A closing tag that waits for what stands before it."""


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = self.at
        while node.parent is not None and node.tag not in STOPS.get(tag, ()):
            if node.tag in CLOSES.get(tag, ()):
                self.at = node.parent
                if tag != "tr":
                    break
            node = node.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def first(root: Node, choices: list[Callable[[Node], bool]]) -> Node | None:
    """The first element that meets the earliest choice met by any."""
    for choice in choices:
        for node in root.walk():
            if choice(node):
                return node
    return None
