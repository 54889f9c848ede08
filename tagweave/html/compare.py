"""Differences of two trees, first difference first, level by level."""

from __future__ import annotations

from collections import deque

from tagweave.html.tree import Node


def node_path(node: Node) -> str:
    """``index:tag/`` steps from the root to the node."""
    return "".join(f"{n.index()}:{n.tag}/" for n in reversed(list(node.ancestors())) if n.parent is not None)


def node_difference(left: Node, right: Node, texts: bool = True) -> str | None:
    """What differs between two nodes: tag, attributes, text, tail (blanks at
    the ends aside), number of children."""
    if left.tag != right.tag:
        return f"tag: {left.tag} / {right.tag}"
    if sorted(left.attrs.items()) != sorted(right.attrs.items()):
        return f"attributes: {sorted(left.attrs.items())} / {sorted(right.attrs.items())}"
    if texts:
        for name, a, b in (("text", left.text, right.text), ("tail", left.tail, right.tail)):
            if a.strip() != b.strip():
                return f"{name}: {a.strip()} / {b.strip()}"
    if len(left.children) != len(right.children):
        return f"children: {len(left.children)} / {len(right.children)}"
    return None


def tree_difference(left: Node, right: Node, texts: bool = True) -> tuple[str, str] | None:
    """``(path, difference)`` of the first differing pair, or None."""
    queue = deque([(left, right)])
    while queue:
        a, b = queue.popleft()
        found = node_difference(a, b, texts)
        if found:
            return node_path(a), found
        queue.extend(zip(a.children, b.children))
    return None
