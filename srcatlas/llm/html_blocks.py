"""HTML pages as sequences of leaf blocks: text, path of enclosing elements, link share."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Elements that never hold running text, whatever stands in them.
SILENT = frozenset("script style noscript template head title iframe object svg canvas audio video select option "
                   "button textarea datalist input".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var nobr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup "
                   "msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd mspace mstyle "
                   "mpadded mphantom merror menclose mfenced maction semantics annotation annotation-xml".split())
#: An open element of the first kind ends where one of the second kind begins.
ENDS = {"p": frozenset("p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 "
                       "blockquote pre hr figure address fieldset".split()),
        "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
        "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]),
        "tr": frozenset(["tr", "tbody"]), "option": frozenset(["option"])}
#: What may stand in ``head``; any other element and any text end it.
IN_HEAD = frozenset("title meta link base script style noscript template".split())
#: A silent element that lacks its end tag ends where one of these begins.
BLOCK_LEVEL = ENDS["p"] | frozenset("body li dt dd tr td th tbody thead tfoot caption details summary center".split())
#: Elements that do not nest in themselves.
FLAT = frozenset("button select option datalist".split())

#: Other elements that break the line; an element in none of these lists stands inside a line, as in browsers.
BLOCKS = BLOCK_LEVEL | frozenset("html head body hgroup menu dialog legend dir listing xmp plaintext figcaption frameset "
                                 "noframes search colgroup template title".split())

# A quote opens a value only behind an equals sign; a value without quotes ends at white space or the tag's end.
# Every alternative takes what it can and gives nothing back, and a tag without an end takes the rest of the page,
# so a page is read once.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^>\s"'][^>\s]*+)?+)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # (element, words of its class, id and role) from the outside in
    link_chars: int


def name_words(attributes: str) -> tuple[str, ...]:
    """The words in class, id, role and itemprop: ``postBody main-text`` gives post, body, main, text."""
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        found += [w.lower() for w in _NAME_PART.findall(m[2] or m[3] or m[4] or "")]
    return tuple(found)


def closed(page: str, tag: str) -> set[int]:
    """Where the elements of a name begin that have an end tag of their own."""
    opened: list[int] = []
    out = set()
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", page, re.I):
        if not m[1]:
            if tag in FLAT:
                opened.clear()
            opened.append(m.start())
        elif opened:
            out.add(opened.pop())
    return out


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order; text between two block-level tags is one block.

    Inline, void and unknown elements, and silent ones inside a line (buttons, images, scripts), break no block.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = silent = link_chars = 0
    whole: dict[str, set[int]] = {}
    lax: set[int] = set()  # depths at which a silent element without an end tag stands

    def flush() -> None:
        nonlocal link_chars, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(stack), link_chars))
            parts.clear()
        link_chars = links = 0

    def say(raw: str) -> None:
        nonlocal link_chars
        if raw and not silent:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                link_chars += len(text.strip())

    def close(depth: int, inside_line: bool = False) -> None:
        nonlocal silent
        if not inside_line:
            flush()
        while len(stack) > depth:
            silent -= stack.pop()[0] in SILENT
            lax.discard(len(stack))

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        raw = page[at:m.start() if m else len(page)]
        if raw and stack and stack[-1][0] == "head" and not raw.isspace():
            close(len(stack) - 1)
        say(raw)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[1] and stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if m[1] else 1))
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID and tag != "hr" or tag not in BLOCKS and tag not in SILENT and tag != "hr":
            continue
        inside_line = tag not in BLOCKS and tag != "hr"
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                close(depth, inside_line)
            elif not inside_line:
                flush()
            continue
        if not inside_line:
            flush()
        while stack and (tag in ENDS.get(stack[-1][0], ()) or tag in BLOCK_LEVEL and len(stack) - 1 in lax):
            close(len(stack) - 1, inside_line)
        if tag == "hr" or m[3].endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if end is None and tag not in ("script", "style"):
                continue
            at = end.end() if end else len(page)
            continue
        if tag in SILENT and tag != "head":
            if tag not in whole:
                whole[tag] = closed(page, tag)
            if m.start() not in whole[tag]:
                lax.add(len(stack))
        stack.append((tag, name_words(m[3])))
        silent += tag in SILENT
    flush()
    return out
