"""A small HTML tree and the lenient parser that builds it.

Recovery rules: void elements have no content; an opening tag closes open
elements that can't hold it (``p`` before blocks, ``li`` before ``li``, table
parts, options, definition items); a closing tag closes up to its nearest open
match and is ignored without one; whatever is open at the end is closed.  A
document always has ``html`` and ``body``; head elements before any content go
to ``head``.  Scripts and styles are raw text.  The walk is a loop, so depth is
no limit.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Classes of HTML elements.
VOID = set("area base br col embed frame hr img input link meta param source track wbr basefont isindex keygen".split())
HEAD = set("title base link meta style script".split())
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
COMMENT, INSTRUCTION = "#comment", "#pi"
RAW = {"script", "style"}


class Node:
    """Element, comment or instruction; ``text`` before its first child,
    ``tail`` after its end."""

    __slots__ = ("tag", "attrs", "text", "tail", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: "Node | None" = None) -> None:
        self.tag, self.attrs, self.text, self.tail = tag, attrs or {}, "", ""
        self.children: list[Node] = []
        self.parent = parent
        if parent is not None:
            parent.children.append(self)

    @property
    def is_element(self) -> bool:
        return self.tag[0] != "#"

    def add_text(self, s: str) -> None:
        if self.children:
            self.children[-1].tail += s
        else:
            self.text += s

    def walk(self) -> Iterator["Node"]:
        """This node and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def find(self, tag: str) -> "Node | None":
        return next((n for n in self.walk() if n.tag == tag), None)

    def ancestors(self) -> Iterator["Node"]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self) if self.parent else 0

    def _give_text(self, s: str) -> None:
        """Text that takes this node's place, after it is taken out."""
        i = self.index()
        if i:
            self.parent.children[i - 1].tail += s
        else:
            self.parent.text += s

    def unwrap(self) -> None:
        """Take the element out, keep what it holds."""
        i, p = self.index(), self.parent
        inner, tail = self.children, self.tail
        self._give_text(self.text)
        p.children[i : i + 1] = inner
        for c in inner:
            c.parent = p
        if inner:
            inner[-1].tail += tail
        elif i:
            p.children[i - 1].tail += tail
        else:
            p.text += tail
        self.parent = None

    def drop(self) -> None:
        """Take the element out with what it holds; its tail stays."""
        self._give_text(self.tail)
        self.parent.children.remove(self)
        self.parent = None

    def content(self) -> str:
        """All text inside."""
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
                continue
            if n.is_element:
                parts.append(n.text)
            for c in reversed(n.children):
                stack += [c.tail, c]
        return "".join(parts)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.head: Node | None = None
        self.body: Node | None = None
        self.open: list[Node] = [self.root]

    # -- places ---------------------------------------------------------------
    def _in_body(self) -> None:
        if self.body is None:
            self.body = Node("body", parent=self.root)
            self.open = [self.root, self.body]
        elif len(self.open) < 2:
            self.open = [self.root, self.body]

    def _place(self, tag: str) -> None:
        """Make the place where an element of this tag may stand."""
        if self.body is None and tag in HEAD:
            if self.head is None:
                self.head = Node("head", parent=self.root)
            if self.head not in self.open:
                self.open = [self.root, self.head]
        elif self.head in self.open and self.open[-1].tag in RAW | {"title"} and tag not in HEAD:
            pass
        else:
            self._in_body()

    def _close(self, stop: set[str], tags: set[str]) -> None:
        """Close open elements of ``tags`` down to the nearest of ``stop``."""
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in stop:
                return
            if self.open[i].tag in tags:
                last = i
                # close the outermost of them in this stretch
                while last - 1 > 1 and self.open[last - 1].tag in tags and self.open[last - 1].tag not in stop:
                    last -= 1
                del self.open[last:]
                return

    # -- events ----------------------------------------------------------------
    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values: dict[str, str] = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        if tag == "html":
            for k, v in values.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = Node("head", values, self.root)
                self.open = [self.root, self.head]
            return
        if tag == "body":
            if self.body is None:
                self.body = Node("body", values, self.root)
                self.open = [self.root, self.body]
            else:
                for k, v in values.items():
                    self.body.attrs.setdefault(k, v)
            return
        self._place(tag)
        if tag in BLOCKS:
            self._close({"table", "td", "th", "button", "object", "li", "div"} - {tag}, {"p"})
        if tag in CLOSES:
            tags, stop = CLOSES[tag]
            self._close(stop, tags)
        node = Node(tag, values, self.open[-1])
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head in self.open:
                self.open = [self.root]
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag and self.open[i] is not self.body:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top is self.root or top is self.head:
            if not data.strip():
                if self.head is not None or self.body is not None:
                    top.add_text(data)
                return
            self._in_body()
        self.open[-1].add_text(data)

    def handle_comment(self, data: str) -> None:
        Node(COMMENT, parent=self.open[-1]).text = data

    def handle_pi(self, data: str) -> None:
        Node(INSTRUCTION, parent=self.open[-1]).text = data

    def handle_decl(self, decl: str) -> None:
        pass

    def unknown_decl(self, data: str) -> None:
        pass


def parse(source: str | bytes, encoding: str | None = None) -> Node:
    """Tree of a page.  Bytes are decoded by ``encoding``, else by the page's
    own statement, else as UTF-8; what doesn't fit is replaced."""
    if isinstance(source, bytes):
        if encoding is None:
            m = re.search(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", source[:2048])
            encoding = m.group(1).decode() if m else "utf-8"
        try:
            source = source.decode(encoding, "replace")
        except LookupError:
            source = source.decode("utf-8", "replace")
    b = _Builder()
    b.feed(source)
    b.close()
    if b.body is None:
        b.body = Node("body", parent=b.root)
    return b.root


def _attrs(attrs: dict[str, str]) -> str:
    return "".join(f' {k}="{_html.escape(v, quote=True)}"' for k, v in attrs.items())


def serialize(root: Node, slot: Callable[[Node, bool, str], str] | None = None) -> str:
    """HTML of a tree.  ``slot(node, is_tail, text)`` may write the text."""

    def text(node: Node, is_tail: bool, s: str) -> str:
        if slot is not None:
            return slot(node, is_tail, s)
        return _html.escape(s, quote=False)

    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        tail = text(n, True, n.tail) if n is not root else ""
        if n.tag == COMMENT:
            out.append(f"<!--{n.text}-->{tail}")
        elif n.tag == INSTRUCTION:
            out.append(f"<?{n.text}>{tail}")
        elif n.tag in VOID and not n.children and not n.text:
            out.append(f"<{n.tag}{_attrs(n.attrs)}>{tail}")
        else:
            out.append(f"<{n.tag}{_attrs(n.attrs)}>" + (n.text if n.tag in RAW else text(n, False, n.text)))
            stack.append(f"</{n.tag}>{tail}")
            stack.extend(reversed(n.children))
    return "".join(out)


def kill_tags(root: Node, tags: set[str], keep_child: bool = True) -> None:
    """Take elements out, with or without what they hold."""
    for n in [n for n in root.walk() if n.tag in tags and n.parent is not None]:
        if n.parent is None:
            continue
        n.unwrap() if keep_child else n.drop()


def rename_tags(root: Node, renames: dict[str, str]) -> None:
    for n in root.walk():
        n.tag = renames.get(n.tag, n.tag)


# What the default and the strict cleaner take out.
EMBEDDED_DROPPED = {"applet", "frame", "frameset", "noframes", INSTRUCTION}
EMBEDDED_UNWRAPPED = {"iframe", "embed", "layer", "object", "param"}
STRICT_DROPPED = {"script", "style", "link", "meta", COMMENT, "form"} - {"form", "meta"}


def clean(root: Node, strict: bool = False) -> Node:
    """Default: no instructions, frames and embedded objects (their fallback
    content stays); strict: also no scripts, styles, links and comments."""
    kill_tags(root, EMBEDDED_DROPPED | (STRICT_DROPPED if strict else set()), keep_child=False)
    kill_tags(root, EMBEDDED_UNWRAPPED)
    return root
