"""Main body of web pages: flat text blocks judged by decision trees.

A block is described by its own word count, sentences and link density, by
those of the blocks before and after it, by the boundary tag before it, by the
kind of heading it stands under, by how many blocks of its kind follow each
other, and by whether the page has paragraphs of several sentences at all.
Containers play no part, so an article may spread over as many as it likes.

Two trees over these features are trained on the labelled table of
:mod:`labels` when they are first needed in a process.  One tells a page's own
content from its furniture, which is what :mod:`shapes` looks at; the other one
picks the main body of pages that are not stuffed.  Pages are judged one by
one, without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from .labels import FURNITURE, MAIN, labelled_pages
from .pages import Block
from .shapes import stuffed_share
from .tree import Tree

_SENTENCE = re.compile(r"[.!?…。][\"'»”’)\]]*(?:\s|$)")
_CLOSED = re.compile(r"[.!?…。][\"'»”’)\]]*$")
_ENDINGS = frozenset(".!?…。\"'»”’)]")
#: Kinds of boundary tags; all others are 0, plain text.
_KIND = {"button": -1, "small": -1, "li": 1, "dd": 1, "blockquote": 2, "h6": 3, "h5": 3, "h4": 3, "h3": 3, "h2": 4, "h1": 5}
FEATURES = "words sentences link words_before words_after link_before link_after sentences_before sentences_after kind under deepest run".split()
#: The main body is judged without the last one.
BODY = len(FEATURES) - 1
#: Words a sentence of prose has at least, on average.
PACE = 9
#: Share of a page's own words in few non-sentence shapes beyond which it is stuffed.
STUFFED = 0.5


def block_features(blocks: Sequence[Block]) -> np.ndarray:
    """One row of :data:`FEATURES` for each block.

    ``under`` is 1 below the page's h1 or in a page without, 2 below a later h2
    and 3 below a later lower heading; before the h1 it is less by 3;
    ``deepest`` are the most sentences of a plain block of the page that has
    :data:`PACE` words a sentence, which tells pages of paragraphs from pages
    of single lines; ``run`` counts the blocks in a row, this one among them,
    that are of the same kind and linked alike.
    """
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words, sentences, kinds, unders = [], [], [], []
    under = -2 if any(b.tag == "h1" for b in blocks) else 1
    deepest = 0
    for text, tag, link in blocks:
        size, told, kind = text.count(" ") + 1, 0, _KIND.get(tag, 0)
        if kind > 2:
            under = 1 if kind == 5 else (6 if under > 0 else 3) - kind
        if text[-1] in _ENDINGS and _CLOSED.search(text, max(0, len(text) - 6)):
            told = len(_SENTENCE.findall(text))
            if link < 0.5 and not kind and size >= PACE * told:
                deepest = max(deepest, told)
        words.append(size)
        sentences.append(told)
        kinds.append(kind)
        unders.append(under)
    x[:, 0], x[:, 1], x[:, 2] = words, sentences, [b.link for b in blocks]
    x[:, 9], x[:, 10] = kinds, unders
    alike = x[:, 9] * 2 + (x[:, 2] >= 0.5)
    number = np.cumsum(np.concatenate([[0], alike[1:] != alike[:-1]]))
    x[:, 11], x[:, 12] = deepest, np.bincount(number)[number]
    for own, before in ((0, 3), (2, 5), (1, 7)):
        x[1:, before], x[:-1, before + 1] = x[:-1, own], x[1:, own]
    return x


@lru_cache(1)
def page_trees() -> tuple[Tree, Tree]:
    """The trees for own content and for the main body, trained on all rows of the labelled table."""
    pages = list(labelled_pages())
    rows = [block_features(p.blocks) for p in pages]
    label = [np.array(p.labels) for p in pages]
    own = Tree(max_depth=12, min_leaf=4).fit(np.concatenate(rows), np.concatenate(label) != FURNITURE)
    plain = [i for i, p in enumerate(pages) if not p.stuffed]
    main = np.concatenate([label[i] for i in plain]) == MAIN
    x = np.concatenate([rows[i] for i in plain])[:, :BODY]
    return own, Tree(max_depth=12, min_leaf=4).fit(x, main)


class Judged:
    """What the trees say about some pages."""

    def __init__(self, pages: Sequence[Sequence[Block]]) -> None:
        self.pages = pages
        ends = np.cumsum([len(b) for b in pages])[:-1]
        x = np.concatenate([block_features(b) for b in pages]) if pages else np.zeros((0, len(FEATURES)))
        own, body = page_trees()
        self._own, self._main = (np.split(p, ends) if len(x) else [p] * len(pages) for p in (own.predict(x), body.predict(x[:, :BODY])))

    def stuffed(self) -> list[bool]:
        """Whether each page is dominated by few shapes that are no sentences."""
        return [stuffed_share([b for b, o in zip(p, own) if o]) > STUFFED for p, own in zip(self.pages, self._own)]

    def main(self) -> list[np.ndarray]:
        """Numbers of each page's main-body blocks, in order; stuffed pages have none."""
        none = np.zeros(0, int)
        return [none if s else np.flatnonzero(m) for s, m in zip(self.stuffed(), self._main)]


def main_blocks(pages: Sequence[Sequence[Block]]) -> list[np.ndarray]:
    """For each page the numbers of its main-body blocks, in order."""
    return Judged(pages).main()


def is_stuffed(blocks: Sequence[Block]) -> bool:
    """True when few non-sentence shapes dominate the page's own words."""
    return Judged([blocks]).stuffed()[0]
