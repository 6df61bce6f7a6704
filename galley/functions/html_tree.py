"""A flat document tree on the standard library's HTML parser.

The tree is a pre-order table: node i has a parent and an exclusive end of its
subtree, so a subtree is a range and "document order" is the index.  End tags
close the nearest open element of that name, unmatched ones are ignored, open
elements close with their ancestor, and nothing is closed by implication.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound command frame keygen".split())
TEXT, COMMENT, OTHER = "#text", "#comment", "#other"


class Document(HTMLParser):
    """``name``, ``attrs``, ``parent``, ``end`` and ``text`` by node number."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.name: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.text: list[str] = []
        self._open: list[int] = []
        self.feed(html)
        self.close()
        self._close_to(0)
        self.dropped = bytearray(len(self.name))

    def _add(self, name: str, attrs: dict[str, str] | None = None, text: str = "") -> int:
        self.name.append(name)
        self.attrs.append(attrs or {})
        self.parent.append(self._open[-1] if self._open else -1)
        self.text.append(text)
        self.end.append(len(self.name))
        return len(self.name) - 1

    def _close_to(self, depth: int) -> None:
        while len(self._open) > depth:
            self.end[self._open.pop()] = len(self.name)

    def handle_starttag(self, tag, attrs):
        kept: dict[str, str] = {}
        for k, v in attrs:
            kept[k] = v or ""
        n = self._add(tag, kept)
        if tag not in VOID:
            self._open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close_to(len(self._open) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self.name[self._open[depth]] == tag:
                self._close_to(depth)
                return

    def handle_data(self, data):
        if self.name and self.name[-1] == TEXT and self.parent[-1] == (self._open[-1] if self._open else -1) and self.end[-1] == len(self.name):
            self.text[-1] += data
        else:
            self._add(TEXT, text=data)

    def handle_comment(self, data):
        self._add(COMMENT, text=data)

    def handle_decl(self, decl):
        self._add(OTHER, text=decl)

    def handle_pi(self, data):
        self._add(OTHER, text=data)

    def unknown_decl(self, data):
        self._add(OTHER, text=data)

    def drop(self, node: int) -> None:
        """Takes a subtree out."""
        self.dropped[node : self.end[node]] = b"\x01" * (self.end[node] - node)

    def nodes(self, first: int = 0, last: int | None = None):
        """Numbers of the nodes still there, in document order."""
        for i in range(first, len(self.name) if last is None else last):
            if not self.dropped[i]:
                yield i

    def classes(self, node: int) -> list[str]:
        return self.attrs[node].get("class", "").lower().split()

    def visible(self, node: int) -> str:
        """The text of a subtree, its white space collapsed."""
        parts = (self.text[i].strip() for i in self.nodes(node, self.end[node]) if self.name[i] == TEXT)
        return " ".join(" ".join(p for p in parts if p).split())
