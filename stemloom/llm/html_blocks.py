"""Leaf blocks of an HTML page: its text between block-level tags, with the tags it stands in.

A page is read by one regular expression over tags and comments, raw-text
elements up to their end tag, and an open-element stack. Text in drawings and
choices is skipped while they are on the stack; what can't stand in them ends
them. Broken markup is taken as browsers take it
where that matters here: a new paragraph or list item ends the open one, an end
tag ends what is open inside its element, and one without a start is ignored. A
line break ends a block, as a paragraph does; pictures and fields in a line don't.
A tag whose attribute's quote never ends is read up to its first ``>``.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe)(?=[\s/>])[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)(?=[\s/])([^<>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
RAW_END = {k: re.compile(rf"</{k}(?=[\s/>])[^>]*>", re.I) for k in "script style noscript template textarea title iframe".split()}
SELF_CLOSED = re.compile(r"(?<![^\s\"'])/\Z|(?:^|[\s\"'])[^\s=\"']*/\Z")
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
# fixed values: element kinds of the HTML standard
INLINE = frozenset("a abbr acronym audio b bdi bdo big button canvas cite code data del dfn em embed font i img input ins kbd label map meter object output picture progress mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body article section main nav aside header footer div table ul ol dl form td th blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is no content, and the start tags that end them where their own end tag is missing.
SKIPPED = frozenset("svg select option".split())
ENDS_CHOICE = frozenset("html body article section main nav aside header footer table ul ol dl li dd dt tr td th form blockquote p pre input".split()) | HEADINGS
ENDS_DRAWING = (ENDS_CHOICE | frozenset("b big br center code div em embed hr i img menu ruby s small span strong strike sub sup tt u var".split())) - {"input"}


class Block(NamedTuple):
    text: str
    path: tuple[tuple[str, str], ...]
    linked: float


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = size = links = at = 0
    skip: int | None = None  # place of the outermost skipped element on the stack

    def flush() -> None:
        nonlocal linked, size
        text = " ".join(unescape("".join(parts)).split())
        if text and not any(t == "head" for t, _ in stack):
            out.append(Block(text, tuple(x for x in stack[:skip] if x[0] not in INLINE), min(1.0, linked / max(1, size))))
        parts.clear()
        linked = size = 0

    def add(text: str) -> None:
        nonlocal linked, size
        if text and skip is None:
            parts.append(text)
            size += len(text)
            if links:
                linked += len(text)

    while m := TAG.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if m[1]:
            if skip is None or not m[0].endswith("/>"):  # in a drawing an element may close itself
                end = RAW_END[m[1].lower()].search(html, at)
                at = end.end() if end else len(html)
            continue
        ending, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6] or "", m[7])
        name = name.lower()
        if not name:
            continue
        if ending:
            inner = next((k for k in range(len(stack) - 1, skip - 1, -1) if stack[k][0] == name), None) if skip is not None else None
            if inner is not None:
                del stack[inner:]
                skip = skip if len(stack) > skip else None
                continue
            found = None
            for k in range(len(stack if skip is None else stack[:skip]) - 1, -1, -1):
                if stack[k][0] == name:
                    found = k
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            if name not in INLINE and name not in SKIPPED and (skip is None or found is not None):
                flush()
            if found is not None:
                del stack[found:]
                skip = None
        else:
            closed = bool(SELF_CLOSED.search(rest))
            if skip is not None:
                root = stack[skip][0]
                foreign = root == "svg" and any(t in ("foreignobject", "desc") for t, _ in stack[skip:])
                lone = root == "option" and name == "div" and not any(t == "datalist" for t, _ in stack)
                if (name in (ENDS_DRAWING if root == "svg" else ENDS_CHOICE) or lone) and not foreign:
                    del stack[skip:]
                    skip = None
                elif name == root != "svg":  # the next choice
                    del stack[skip + 1 :]
                    continue
                else:
                    if not closed and name not in VOID:
                        stack.append((name, ""))
                    continue
            if name not in INLINE and name not in SKIPPED:
                flush()
            if name in VOID or name == "svg" and closed:
                continue
            if name in SCOPES and name not in CLOSES or name in HEADINGS:
                ends, stop = {"p"}, SCOPES
            else:
                ends, stop = CLOSES.get(name, set()), SCOPES - CLOSES.get(name, set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in stop:
                    break
            if name == "body":
                stack[:] = [x for x in stack if x[0] == "html"]
            names = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(rest)) if rest else ""
            stack.append((name, names))
            if name in SKIPPED:
                skip = len(stack) - 1
        links = sum(t == "a" for t, _ in stack) if name == "a" else (links and sum(t == "a" for t, _ in stack))
    add(html[at:])
    flush()
    return out
