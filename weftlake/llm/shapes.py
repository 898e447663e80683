"""Pages of keywords, links or product tags in place of sentences.

Every line (text block) of a page's own content is reduced to a shape: how many
words it has, how many of them begin with a capital, how many separators stand
between them, how much of it is link text, and whether it ends as a sentence
does.  Lines of one shape are grouped; a page is flagged when a few shapes that
are no sentences hold most of its words.  All lines of the page count, wherever
they stand, but for its furniture, which :mod:`mainbody` tells by word counts
and link densities of a line and its neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from .pages import Block

_END = re.compile(r"[.!?…。][\"'»”’)\]]*$")
_SEPARATOR = re.compile(r"[,;|/·•–—>»]|\s-\s")
#: A line of fewer words is no sentence, whatever it ends with.
SENTENCE_WORDS = 5
#: So many shapes may together make up the flagged share.
FEW = 3


class Shape(tuple):
    """(words, capitals, separators, links, sentence), each a small class number."""

    @property
    def sentence(self) -> bool:
        return bool(self[4])


def shape(text: str, link: float) -> tuple[Shape, int]:
    """The shape of a line and its number of words."""
    words = text.split()
    n = len(words)
    size = 0 if n < 2 else 1 if n < 4 else 2 if n < 8 else 3 if n < 16 else 4
    capital = sum(w[0].isupper() for w in words) / max(1, n)
    marks = len(_SEPARATOR.findall(text)) / max(1, n)
    whole = n >= SENTENCE_WORDS and bool(_END.search(text)) and link < 0.9
    return Shape(
        (
            size,
            0 if capital < 0.15 else 1 if capital < 0.75 else 2,
            0 if marks < 0.05 else 1 if marks < 0.25 else 2,
            0 if link < 0.1 else 1 if link < 0.9 else 2,
            int(whole),
        )
    ), n


def own_shapes(blocks: Sequence[Block]) -> Counter:
    """Words by shape of the lines given, headings of pages left out."""
    out: Counter = Counter()
    for b in blocks:
        if b.tag != "h1":
            kind, n = shape(b.text, b.link)
            out[kind] += n
    return out


def stuffed_share(blocks: Sequence[Block]) -> float:
    """Share of a page's own words that the :data:`FEW` largest shapes hold that are no sentences."""
    words = own_shapes(blocks)
    bad = sorted((n for s, n in words.items() if not s.sentence), reverse=True)
    return sum(bad[:FEW]) / max(1, sum(words.values()))
