"""HTML as a tree of block elements with runs of text as leaves."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# --- fixed values: kinds of elements -------------------------------------------
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol option p pre section select "
    "summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas math".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never text of a page, wherever they stand.
SILENT = frozenset("script style template noscript svg math button select option textarea title head iframe object canvas audio video".split())
#: An opening tag closes an open element of these, up to the fence.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NO_PARAGRAPH = BLOCKS - {"button", "option"}
FENCES = frozenset("table td th caption button object".split())

TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    r"|/([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^>]*+)(?:>|\Z))"
    r"|[!?/][^>]*+(?:>|\Z))",
    re.S,
)
NAMED = re.compile(r"(?i)(?:^|\s)(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none")
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    """An element, or a run of text (``tag`` is ``#text``) with its share of linked characters."""

    tag: str
    parent: int
    names: str = ""
    hidden: bool = False
    label: str = ""
    text: str = ""
    linked: int = 0
    pieces: list[tuple[str, bool]] = field(default_factory=list)


def parse(html: str | None) -> list[Node]:
    """The nodes in page order, parents first; text runs are unescaped with single spaces, empty ones left out.

    Closing tags that fit no open element are ignored, missing ones are
    supplied, and a page that breaks off in a tag or comment ends there.
    """
    html = html or ""
    nodes = [Node("#page", -1)]
    stack, inline, run, at = [0], [], None, 0

    def add(raw: str) -> None:
        nonlocal run
        if raw:
            if run is None:
                run = len(nodes)
                nodes.append(Node("#text", stack[-1]))
            nodes[run].pieces.append((raw, "a" in inline))

    def close(tags, fence=frozenset()) -> bool:
        nonlocal run
        for depth in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[depth]].tag
            if tag in tags:
                del stack[depth:]
                run = None
                return True
            if tag in fence:
                return False
        return False

    while True:
        m = TOKEN.search(html, at)
        add(html[at : m.start()] if m else html[at:])
        if m is None:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                add(" ")
            elif tag in BLOCKS:
                close({tag})
                run = None
                if tag in ("td", "th", "table", "body"):
                    inline.clear()
            elif tag in inline:
                del inline[len(inline) - 1 - inline[::-1].index(tag) :]
        elif m[2]:
            tag, attrs = m[2].lower(), m[3] if m[3] is not None else m[4] or ""
            if tag in RAW:
                end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag == "br":
                add(" ")
            elif tag in BLOCKS:
                run = None
                if tag in NO_PARAGRAPH:
                    close({"p"}, FENCES)
                if tag in CLOSES:
                    close(*CLOSES[tag])
                if tag in VOID:
                    continue
                found = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(attrs)} if attrs else {}
                names = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
                nodes.append(Node(tag, stack[-1], names, bool(attrs and HIDDEN.search(attrs)), found.get("data-y", "")))
                if not attrs.endswith("/") or tag not in ("svg", "iframe"):
                    stack.append(len(nodes) - 1)
            elif tag not in VOID and not attrs.endswith("/"):
                inline.append(tag)
                if len(inline) > 256:
                    del inline[:128]
    return _compact(nodes)


def _compact(nodes: list[Node]) -> list[Node]:
    """Join and clean the pieces of runs; drop empty runs."""
    places, out = {}, []
    for i, n in enumerate(nodes):
        if n.tag == "#text":
            n.text = SPACE.sub(" ", unescape("".join(p for p, _ in n.pieces))).strip()
            n.linked = min(len(n.text), sum(len(p.strip()) for p, a in n.pieces if a))
            n.pieces = []
            if not n.text:
                continue
        n.parent = places.get(n.parent, -1)
        places[i] = len(out)
        out.append(n)
    return out
