"""Flat text blocks of HTML pages.

A page is cut into text blocks in one pass over its tags: comments and the
elements ``head``, ``script`` and ``style`` go with their content, the tags
``a b i em strong span`` leave no trace, every other tag is a boundary.  Each
block also carries the boundary tag before it and the share of its characters
inside links, which the classifiers need.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

_DROP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(head|script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|<[!?][^<>]*>")
_INLINE = frozenset(("a", "b", "i", "em", "strong", "span"))
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Block(NamedTuple):
    """One text block: its text, the boundary tag before it, the share of its characters inside links."""

    text: str
    tag: str
    link: float


def decode(page: bytes | None) -> str:
    """UTF-8 text of a page; bytes that are no UTF-8 become U+FFFD."""
    return bytes(page).decode("utf-8", "replace") if page else ""


def declared_language(html: str) -> str:
    """``lang`` of the html tag in lower case before any ``-``; '' for none."""
    found = _LANG.search(html)
    if not found:
        return ""
    lang = next((x for x in found.groups() if x is not None), "").strip().lower().split("-")[0]
    return "" if lang == "und" else lang


def page_blocks(html: str) -> list[Block]:
    """Blocks of a page in page order; ``block_no`` is the list index."""
    out: list[Block] = []
    texts: list[str] = []
    linked = 0
    in_link = False
    tag = ""
    parts = _TAG.split(_DROP.sub("", html))
    texts.append(parts[0])
    for i in range(1, len(parts), 4):
        closing, name, text = parts[i], parts[i + 1], parts[i + 3]
        name = name.lower() if name else "!"
        if name in _INLINE:
            if name == "a":
                in_link = not closing
            if text:
                texts.append(text)
                if in_link:
                    linked += len(text)
            continue
        raw = "".join(texts)
        body = " ".join((unescape(raw) if "&" in raw else raw).split())
        if body:
            out.append(Block(body, tag, min(1.0, linked / len(body))))
        tag = (closing or "") + name
        in_link = False
        linked = 0
        texts = [text]
    body = " ".join(unescape("".join(texts)).split())
    if body:
        out.append(Block(body, tag, min(1.0, linked / len(body))))
    return out
