"""A small, forgiving HTML reader: tags and text into a tree, as far as main-text extraction needs it."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: A comment's start, a declaration, or a tag. A quote opens a value only right behind an equals sign.
TOKEN = re.compile(r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag ends open elements of these names, up to the element that bounds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: A start tag of a block ends an open paragraph, unless one of these lies between.
BOUNDS = frozenset("button td th table caption object".split())


#: Elements that ``Node.holds`` tells of.
ASKED = frozenset("a h1 h2 h3 h4 h5 h6 p blockquote pre".split())


class Node:
    __slots__ = ("attributes", "children", "kept", "parent", "tag", "text")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.text: str | None = None
        self.kept: dict = {}  # what others have worked out about this element

    def attribute_values(self) -> dict[str, str]:
        if not self.attributes:
            return {}
        if (values := self.kept.get("values")) is None:
            values = self.kept["values"] = self._attribute_values()
        return values

    def _attribute_values(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attributes)} if self.attributes.strip(" /") else {}

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.elements()))

    def plain(self) -> str:
        """All text below, white space as single spaces; kept for reuse."""
        if self.text is None:
            # Boxes that hold one element and no text of their own share its text.
            same, node = [self], self
            while (inner := node.only_child()) is not None:
                same.append(node := inner)
            if (text := node.text) is None:
                parts: list[str] = []
                todo: list[Node | str] = [node]
                while todo:
                    x = todo.pop()
                    if isinstance(x, str):
                        parts.append(x)
                    elif x.tag not in RAW:
                        if x.tag in BLOCK or x.tag == "br":
                            parts.append(" ")
                        todo.extend(reversed(x.children))
                text = " ".join("".join(parts).split())
            for x in same:
                x.text = text
        return self.text

    def only_child(self) -> Node | None:
        if self.tag in RAW or not self.children or len(self.children) > 3:
            return None
        elements = [c for c in self.children if not isinstance(c, str)]
        if len(elements) != 1 or elements[0].tag in RAW or any(isinstance(c, str) and not c.isspace() for c in self.children):
            return None
        return elements[0]

    def holds(self, tag: str) -> bool:
        """Whether an element of this kind is below; worked out for the whole tree below at once."""
        if (known := self.kept.get("holds")) is None:
            for x in reversed([*self.walk()]):
                below: set[str] = set()
                for c in x.children:
                    if isinstance(c, Node):
                        if c.tag in ASKED:
                            below.add(c.tag)
                        below |= c.kept["holds"]
                x.kept["holds"] = below
            known = self.kept["holds"]
        return tag in known


def parse(html: str) -> Node:
    root = Node("#root", "", None)
    here, at, n = root, 0, len(html)
    last = html.rfind(">") + 1  # no tag ends behind it
    lowered: str | None = None
    opened: Counter[str] = Counter()  # elements that are open, by name

    def up_to(node: Node) -> Node:
        """Closes what is open below ``node``."""
        x = here
        while x is not node:
            opened[x.tag] -= 1
            x = x.parent
        return node

    for m in iter(lambda: TOKEN.search(html, at, last), None):
        if m.start() > at:
            here.children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                end = html.find("-->", at)
                at = n if end < 0 else end + 3
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = up_to(node.parent)
            continue
        if tag in BLOCK and opened["p"]:
            node = here
            while node is not root and node.tag not in BOUNDS and node.tag != "p":
                node = node.parent
            if node.tag == "p":
                here = up_to(node.parent)
        if tag in ENDS:
            ends, bounds = ENDS[tag]
            if any(opened[x] for x in ends):
                node, outer = here, None
                while node is not root and node.tag not in bounds:
                    if node.tag in ends:
                        outer = node
                    node = node.parent
                if outer is not None:
                    here = up_to(outer.parent)
        if tag == "html" and opened["html"]:
            continue
        node = Node(tag, m[3] or "", here)
        here.children.append(node)
        if tag in RAW:
            if lowered is None:
                lowered = html.lower()
                if len(lowered) != n:  # a character whose lower case has another length
                    lowered = html
            end = lowered.find("</" + tag, at)
            stop = n if end < 0 else end
            if tag in ("textarea", "title"):
                node.children.append(unescape(html[at:stop]))
            close = html.find(">", stop)
            at = n if end < 0 or close < 0 else close + 1
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            here = node
            opened[tag] += 1
    if at < n:
        here.children.append(unescape(html[at:]))
    return root
