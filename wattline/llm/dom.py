"""Leaf blocks of HTML pages: runs of text between the edges of block elements, each with its open elements.

A tolerant reader in one pass: end tags that are missing are implied where HTML implies them, end tags without a start are ignored, comments,
declarations and the content of elements that show no text of the page (scripts, styles, templates, titles, ...) are skipped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

# fixed values of the HTML standard
HIDDEN = "script style template noscript title textarea svg math iframe object noembed noframes xmp canvas audio video map"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
                  "hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
            "tbody": ("tr", "td", "th", "tbody", "thead", "tfoot"), "tfoot": ("tr", "td", "th", "tbody", "thead", "tfoot"), "body": ("head",)}
FENCE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
NO_PARAGRAPH = BLOCK - {"button", "label", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "select", "html", "head", "body"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(HIDDEN.split()) + r")(?=[\s/>])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1(?=[\s/>])[^>]*>?|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>?", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_MARK = re.compile(r"\bdata-main\s*=\s*[\"']?([01])")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Block:
    """A leaf block: its open elements from the root (tag, names), its text with single blanks, code points inside links, and the label of a marked page."""

    __slots__ = ("label", "linked", "path", "text")

    def __init__(self, path: tuple, text: str, linked: int, label: int):
        self.path, self.text, self.linked, self.label = path, text, linked, label


def names_of(attributes: str) -> tuple[str, ...]:
    """Lower-case parts of class, id and role, camel case taken apart."""
    out: dict[str, None] = {}
    for m in _NAMES.finditer(attributes):
        for w in _WORD.findall(m[2] or m[3] or m[4] or ""):
            out[w.lower()] = None
    return tuple(out)


def blocks(page: str, known: dict | None = None) -> Iterator[Block]:
    """The page's leaf blocks that hold text, in page order.  `known` keeps names by attribute text between pages."""
    known = {} if known is None else known
    stack: list[tuple[str, tuple, int]] = []               # tag, names, label
    parts: list[str] = []
    is_open: Counter = Counter()
    linked, at = 0, 0

    def done():
        nonlocal linked
        text = html.unescape("".join(parts)) if parts else ""
        text = " ".join(text.split())
        parts.clear()
        n, linked = linked, 0
        if text:
            return Block(tuple((t, names) for t, names, _ in stack), text, min(n, len(text)), stack[-1][2] if stack else 0)
        return None

    def close_to(i: int) -> None:
        is_open.subtract(t for t, _, _ in stack[i:])
        del stack[i:]

    def find(tags: tuple, fence: tuple = ()) -> int:
        if not any(is_open[t] for t in tags):
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in fence:
                return -1
        return -1

    for m in _TOKEN.finditer(page):
        piece = page[at:m.start()]
        at = m.end()
        if piece:
            parts.append(piece)
            if is_open["a"]:
                linked += len(piece)
        if m[3] is None:
            continue
        tag, end = m[3].lower(), m[2] == "/"
        if tag in BLOCK:
            b = done()
            if b:
                yield b
        if end:
            i = find((tag,), () if tag in BLOCK else tuple(BLOCK))
            if i >= 0:
                close_to(i)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in NO_PARAGRAPH and (i := find(("p",), ("table", "td", "th", "button", "body"))) >= 0:
            close_to(i)
        if tag in ENDED_BY:
            while (i := find(ENDED_BY[tag], ("table", *FENCE.get(tag, ())))) >= 0:
                close_to(i)
        raw = m[4]
        label = stack[-1][2] if stack else 0
        if raw:
            if raw not in known:
                if len(known) > 50_000:
                    known.clear()
                mark = _MARK.search(raw)
                known[raw] = (names_of(raw), None if mark is None else int(mark[1]))
            names, mark = known[raw]
            label = label if mark is None else mark
        else:
            names = ()
        stack.append((tag, names, label))
        is_open[tag] += 1
    parts.append(page[at:])
    b = done()
    if b:
        yield b
