"""Leaf text blocks of an HTML page, with the tags and names around them.

A tolerant one-pass scan, not a full parser: comments, declarations, scripts and
styles are skipped, elements with optional end tags are closed by their successors
(``head`` by the first thing that belongs to the body), unknown end tags are ignored,
an unfinished tag at the end of a cut page is dropped. A script or style without its
end tag goes to the end of the page, as in a browser; of other elements of raw text
without end tag only the text up to the next tag is skipped.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!/a-zA-Z][^<>]*\Z", re.S)
_NAME = re.compile(r"(class|id|role|aria-label|itemprop|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of the HTML standard: elements without content, elements of raw text, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
TO_THE_END = frozenset(("script", "style"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
    "object noscript svg text tspan math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mspace semantics annotation".split()
)
#: What a head may hold, and a list of choices; the texts of choices are no blocks.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CHOICES = frozenset(("select", "datalist"))
IN_CHOICES = frozenset("option optgroup hr script template".split())
#: What an element's start closes first, and where the search for it stops.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu", "nav"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "thead", "tbody", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


_ends = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


class Block(NamedTuple):
    text: str
    tags: tuple[str, ...]  # from the root down
    names: frozenset[str]  # parts of classes, ids and roles of all elements around it
    linked: int  # characters inside links
    label: str  # of the nearest element that carries one: training pages only


def _names(attributes: str) -> tuple[frozenset[str], str]:
    parts, label = set(), ""
    for key, *values in _NAME.findall(attributes):
        value = values[0] or values[1] or values[2]
        if key.lower() == "data-label":
            label = value
        else:
            parts.update(p.lower() for p in _PART.findall(value))
    return frozenset(parts), label


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; character references decoded, white space made single blanks, blank ones left out."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str], str]] = []
    text: list[str] = []
    linked = at = 0
    links = 0  # open <a> elements

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words and not any(s[0] in CHOICES for s in stack):
                names = frozenset().union(*(s[1] for s in stack)) if stack else frozenset()
                label = next((s[2] for s in reversed(stack) if s[2]), "")
                found.append(Block(words, tuple(s[0] for s in stack), names, min(linked, len(words)), label))
            text.clear()
        linked = 0

    def pop_to(index: int) -> None:
        nonlocal links
        links -= sum(s[0] == "a" for s in stack[index:])
        del stack[index:]

    while True:
        match = _TOKEN.search(page, at)
        piece = page[at : match.start()] if match else page[at:]
        if piece:
            if stack and stack[-1][0] == "head" and not piece.isspace():
                pop_to(len(stack) - 1)
            text.append(piece)
            if links:
                linked += len(piece)
        if not match:
            break
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        closing = bool(match[1])
        if tag not in INLINE:
            flush()
        elif tag == "br":
            text.append(" ")
        if closing:
            for index in range(len(stack) - 1, -1, -1):
                if stack[index][0] == tag:
                    pop_to(index)
                    break
            continue
        for index in range(len(stack) - 1, -1, -1):
            outer = stack[index][0]
            if (outer == "head" and tag not in IN_HEAD) or (outer in CHOICES and tag not in IN_CHOICES):
                flush()
                pop_to(index)
                break
        if tag in RAW and not (match[3] or "").endswith("/"):
            end = _ends[tag].search(page, at)
            next_tag = page.find("<", at)
            at = end.end() if end else next_tag if next_tag >= 0 and tag not in TO_THE_END else len(page)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            for index in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[index][0] == "p":
                    pop_to(index)
                    break
                if stack[index][0] not in INLINE:
                    break
        if tag in _CLOSES:
            for index in range(len(stack) - 1, -1, -1):
                if stack[index][0] in _SCOPE[tag]:
                    break
                if stack[index][0] in _CLOSES[tag]:
                    pop_to(index)
                    break
        if (match[3] or "").endswith("/"):
            continue
        names, label = _names(match[3]) if match[3] else (frozenset(), "")
        stack.append((tag, names, label))
        links += tag == "a"
    flush()
    return found
