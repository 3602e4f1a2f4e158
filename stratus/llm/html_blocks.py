"""HTML pages as sequences of leaf blocks with their tag paths."""

from __future__ import annotations

import re
from html import unescape

from stratus.llm.common import ship_by_value

ship_by_value(__name__)

#: fixed values: elements that do not end a block, that have no content, and whose content is no text
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: an opening tag ends an open element of these, its siblings
ENDS_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tbody thead select body div section article".split())

#: skipped with what they hold if they are closed; may hold other elements, and one another
SKIPPED = frozenset("svg template noscript".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|iframe)\b[^>]*>(?:.*?</\1\s*>|.*?(?=<body\b)|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*>?"
    r"|<[!?/][^>]*>?",
    re.S | re.I,
)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[A-Za-z]+")


def names_of(attributes: str) -> tuple[str, ...]:
    """Lower-case letter runs of class, id and role, words of a compound name included."""
    found: dict[str, None] = {}
    for m in NAMED.finditer(attributes):
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "")
        found |= dict.fromkeys(x.lower() for x in NAME_PART.findall(value))
    return tuple(found)


def skips_of(tokens: list[re.Match]) -> dict[int, int]:
    """Numbers of the tokens that open an element of ``SKIPPED``, with those that close it."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in SKIPPED}
    for k, m in enumerate(tokens):
        tag = (m[3] or "").lower()
        if tag in SKIPPED:
            if not m[2]:
                if tag != "svg" or not m[4].endswith("/"):  # only foreign elements close themselves
                    opened[tag].append(k)
            elif opened[tag]:
                ends[opened[tag].pop()] = k
    return ends


def blocks_of(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """``(path, text, linked characters)`` of every leaf block with text, in page order.

    A path names the open elements, each tag followed by ``.name`` for its classes, id and role.
    References are decoded; white space in a block becomes one space.  Scripts, styles, titles, closed
    elements of ``SKIPPED`` and comments give nothing; one that is not closed is its tag alone.  The
    head is no element of a path: its end may be left out.  Unclosed and unopened tags are borne.
    """
    blocks: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # element and its path entries
    parts: list[str] = []
    linked = 0

    def path() -> tuple[str, ...]:
        return tuple(x for tag, entries in stack if tag not in INLINE for x in entries)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append((path(), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(names: tuple[str, ...]) -> None:
        """Close the innermost open element of ``names`` and what it holds, within its list or table."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in SCOPE:
                return

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if any(tag == "a" for tag, _ in stack):
                linked += len(text)

    at, html = 0, html or ""
    tokens = list(TOKEN.finditer(html))
    ends, skip_to = skips_of(tokens), -1
    for k, m in enumerate(tokens):
        if k <= skip_to:
            continue
        add(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if tag in SKIPPED:
            parts.append(" ")
            if k in ends:
                skip_to = ends[k]
                at = tokens[skip_to].end()
            continue
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        if tag in INLINE:
            if m[2]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] not in INLINE:
                        break
                    if stack[i][0] == tag:
                        del stack[i]
                        break
            elif tag not in VOID:
                stack.append((tag, ()))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if tag == "head":
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in ENDS_PARAGRAPH:
            close(("p",))
            while stack and stack[-1][0] in INLINE:  # an inline element left open does not reach into the next block
                stack.pop()
        if tag in ENDS_SIBLING:
            close(ENDS_SIBLING[tag])
        if tag not in VOID:
            stack.append((tag, (tag, *("." + n for n in names_of(m[4] or "")))))
    add(html[at:])
    flush()
    return blocks
