"""Markers in a tree -> HTML with coloured spans.

The page is a sequence of text slots in document order.  The k-th start goes
with the k-th end; an entity covers the rest of its first slot, all slots
between (not those of comments, instructions, scripts and styles, nor blank
ones) and the beginning of its last slot.  Spans are written while the tree is
serialised, so the tree needs no surgery.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

from tagweave.html.tree import RAW, Node, serialize

# Foreground and background of the first entity types.
PALETTE = [
    ("#000000", "#33CCFF"), ("#000000", "#FF0000"), ("#000000", "#33FF33"), ("#000000", "#CC66CC"), ("#000000", "#FF9900"), ("#000000", "#99FFFF"), ("#000000", "#FF6666"), ("#000000", "#66FF99"),
    ("#FFFFFF", "#3333FF"), ("#FFFFFF", "#660000"), ("#FFFFFF", "#006600"), ("#FFFFFF", "#663366"), ("#FFFFFF", "#993300"), ("#FFFFFF", "#336666"), ("#FFFFFF", "#666600"), ("#FFFFFF", "#009900"),
]
TITLE_STYLE = "box-shadow:0 0 1em black;border:2px solid blue;padding:0.5em;"
_MARK = re.compile(r" __(START|END)_(\w+?)__ ")

Colors = dict[str, tuple[str, str, int]]


def color_of(index: int) -> tuple[str, str]:
    """Palette colours by index; beyond it colours made from the index."""
    if index < len(PALETTE):
        return PALETTE[index]
    h = hashlib.md5(str(index).encode()).hexdigest()
    return ("#000000", "#FFFFFF")[int(h[0], 16) % 2], "#" + h[1:7].upper()


def assign(colors: Colors, kind: str) -> tuple[str, str, int]:
    """Colours of a type; a new type takes the next index."""
    if kind not in colors:
        index = max((c[2] for c in colors.values()), default=-1) + 1
        colors[kind] = (*color_of(index), index)
    return colors[kind]


def slots(root: Node) -> list[tuple[Node, bool]]:
    out: list[tuple[Node, bool]] = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, after = stack.pop()
        out.append((node, after))
        if not after:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    return out


def enclosures(starts: list[tuple[int, int, str]], ends: list[tuple[int, int, str]], skip: list[bool], lengths: list[int]) -> list[tuple[int, int, int, int, str]]:
    """``(slot, from, to, id, type)`` pieces of the paired markers; markers are
    ``(slot, position in the text without markers, type)``."""
    if len(starts) != len(ends):
        raise ValueError("number of starts and ends differs")
    out = []
    for k, ((a, i, kind), (b, j, _)) in enumerate(zip(starts, ends)):
        if a == b:
            out.append((a, i, j, k, kind))
            continue
        out.append((a, i, lengths[a], k, kind))
        out += [(s, 0, lengths[s], k, kind) for s in range(a + 1, b) if not skip[s]]
        out.append((b, 0, j, k, kind))
    return out


def to_annotated(root: Node, colors: Colors | None = None, url: str | None = None) -> str:
    """HTML with spans, title copy, colour elements and base."""
    colors = {} if colors is None else colors
    order = slots(root)
    texts, starts, ends = [], [], []
    for s, (node, is_tail) in enumerate(order):
        source = node.tail if is_tail else node.text
        parts, at, size = [], 0, 0
        if node.is_element or is_tail:
            for m in _MARK.finditer(source):
                parts.append(source[at : m.start()])
                size += m.start() - at
                (starts if m.group(1) == "START" else ends).append((s, size, m.group(2)))
                at = m.end()
        parts.append(source[at:])
        texts.append("".join(parts))
    skip = [not t.strip() or (not is_tail and (not n.is_element or n.tag in RAW)) for t, (n, is_tail) in zip(texts, order)]
    pieces: dict[int, list[tuple[int, int, int, str]]] = {}
    for s, a, b, k, kind in enclosures(starts, ends, skip, [len(t) for t in texts]):
        if texts[s].strip():
            pieces.setdefault(s, []).append((a, b, k, kind))
    number = {(id(n), t): s for s, (n, t) in enumerate(order)}
    for _, _, kind in starts:
        assign(colors, kind)

    def slot(node: Node, is_tail: bool, _: str) -> str:
        s = number.get((id(node), is_tail))
        if s is None:
            return _html.escape(node.tail if is_tail else node.text, quote=False)
        text, out, at = texts[s], [], 0
        for a, b, k, kind in sorted(pieces.get(s, [])):
            fg, bg, _i = colors[kind]
            out.append(_html.escape(text[at:a], quote=False))
            out.append(f'<span wa-id="{k}" wa-type="{kind}" wa-subtypes="" style="color:{fg}; background-color:{bg};" class="WebAnnotator_{kind}">{_html.escape(text[a:b], quote=False)}</span>')
            at = b
        return "".join([*out, _html.escape(text[at:], quote=False)])

    title, body = root.find("title"), root.find("body")
    extra = [f'<wa-color id="WA-color-{i}" bg="{bg}" fg="{fg}" class="WebAnnotator_{kind}" type="{kind}"></wa-color>' for kind, (fg, bg, i) in sorted(colors.items(), key=lambda kv: kv[1][2])]
    copy = ""
    if title is not None and body is not None:
        copy = f'<wa-title style="{TITLE_STYLE}">{slot(title, False, "")}{"".join(serialize(c, slot) + slot(c, True, "") for c in title.children)}</wa-title>'
    out = serialize(root, slot)
    if body is not None:
        end = out.rindex("</body>") + len("</body>")
        out = out[:end] + "".join(extra) + copy + out[end:]
    if title is not None and body is not None:
        plain = _html.escape("".join(texts[number[id(n), t]] for n in title.walk() for t in ((False,) if n is title else (False, True)) if (id(n), t) in number), quote=False)
        out = re.sub(r"<title\b[^>]*>.*?</title>", lambda m: f"<title>{plain}</title>", out, count=1, flags=re.S)
    if url is not None and root.find("base") is None:
        base = f'<base href="{_html.escape(url, quote=True)}">'
        m = re.search(r"<head\b[^>]*>", out)
        out = out[: m.end()] + base + out[m.end() :] if m else re.sub(r"(<html\b[^>]*>)", lambda h: f"{h.group(1)}<head>{base}</head>", out, count=1)
    return out
