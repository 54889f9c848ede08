"""Loaded pages: plain, annotated with spans, annotated with inline tags.

All give a tree in which annotations are markers in the text."""

from __future__ import annotations

import re

from tagweave.html.tree import Node, clean, parse


def load_plain(source: str | bytes, encoding: str | None = None, strict: bool = False) -> Node:
    return clean(parse(source, encoding), strict)


def use_annotated_title(root: Node) -> None:
    """The first ``wa-title`` takes the place of the title's content; without a
    title it is dropped."""
    marked = root.find("wa-title")
    if marked is None:
        return
    title = root.find("title")
    if title is None:
        marked.drop()
        return
    title.text, title.children, title.attrs = marked.text, marked.children, {}
    for c in title.children:
        c.parent = title
    marked.text, marked.children = "", []
    marked.drop()


def load_annotated(source: str | bytes, known_entities: set[str] | None = None, encoding: str | None = None) -> Node:
    """Spans with ``wa-id`` and ``wa-type`` -> markers: the start before the
    first span's text, the end behind the last span's text (before its
    children); the type is the first span's."""
    root = parse(source, encoding)
    use_annotated_title(root)
    spans = [n for n in root.walk() if n.tag == "span"]
    if known_entities:
        for n in spans:
            if "wa-type" in n.attrs and n.attrs["wa-type"] not in known_entities:
                n.unwrap()
    by_id: dict[str, list[Node]] = {}
    for n in spans:
        if n.parent is not None and "wa-id" in n.attrs:
            by_id.setdefault(n.attrs["wa-id"], []).append(n)
    for members in by_id.values():
        kind = members[0].attrs.get("wa-type", "")
        members[0].text = f" __START_{kind}__ {members[0].text}"
        members[-1].text = f"{members[-1].text} __END_{kind}__ "
        for n in members:
            n.unwrap()
    for n in [n for n in root.walk() if n.tag == "wa-color"]:
        n.drop()
    return clean(root)


def load_inline(source: str | bytes, known_entities: set[str] | None, encoding: str | None = None) -> Node:
    """``<ORG>..</ORG>`` -> markers, before parsing."""
    if known_entities is None:
        raise ValueError("known_entities is required: all entity types of the data")
    text = source.decode(encoding or "utf-8", "replace") if isinstance(source, bytes) else source
    types = "|".join(map(re.escape, sorted(known_entities, key=len, reverse=True)))
    text = re.sub(f"<({types})>", r" __START_\1__ ", text, flags=re.I)
    text = re.sub(f"</({types})>", r" __END_\1__ ", text, flags=re.I)
    return load_plain(text)


def read_colors(root: Node) -> dict[str, tuple[str, str, int]]:
    """Entity colours of a page's ``wa-color`` elements."""
    out = {}
    for n in root.walk():
        if n.tag == "wa-color":
            out[n.attrs.get("type", "")] = (n.attrs.get("fg", ""), n.attrs.get("bg", ""), int(re.sub(r"\D", "", n.attrs.get("id", "0")) or 0))
    return out
