"""The labelled table of text blocks that the page trees are trained on.

Pages are put together from the package's own prose and from short phrases
written for this purpose, always the same ones: menus, cookie notices, sidebars
and footers around an article, or around a heap of keywords, links or tags.
Articles stand in one container or in several, with a sidebar before, after or
in the midst of them; some have long paragraphs, some paragraphs of a single
sentence.  :data:`PAGES` bounds the table, which has some twenty thousand blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from random import Random
from typing import NamedTuple

from .pages import Block
from .prose import lines

#: Pages of the table.
PAGES = 960
#: What a block is: furniture of the page, something said among the content, main body, stuffing.
FURNITURE, ASIDE, MAIN, STUFFING = range(4)

_MENU = "Start|Hilfe|Karte|Sign in|Weather|Tous les sujets|Главная|Buscar|Contatti|Over ons|Your account|Plan|Notícias|Blog".split("|")
_HEADS = "Others also read|Les mieux notés|Читайте также|Anzeige|Meistgelesen|Para seguir leyendo|Announcements|Zie ook|More from the same shelf|Que leer después de esto|Anche questo".split("|")
_NOTICES = (
    "We use small files called cookies to make the site work.",
    "You can read more about them below at any time. Nothing else is kept.",
    "Diese Seite verwendet Cookies, damit sie besser bedient werden kann.",
    "Nous mesurons le nombre de visites à l'aide de petits fichiers appelés cookies.",
    "Si sigue leyendo, acepta que guardemos algunos datos.",
)
_FEET = (
    "© 2011 Harbour Post. All rights reserved.",
    "Alle Angaben auf diesen Seiten sind ohne jede Gewähr.",
    "Imprint · Contact · Help",
    "Все права защищены.",
    "Textes réservés à un usage privé, toute autre utilisation étant interdite ici.",
    "27 mal weitergesagt",
    "The pictures on these pages may not be copied without a written permission.",
)
_PROMPTS = (
    "Share · Print",
    "More stories for you",
    "Liked it? Pass it on.",
    "Anzeige",
    "Partagé 14 fois",
    "Понравилось? Расскажите об этом.",
    "Seen something wrong? Tell us about it.",
    "Condividi con chi vuoi",
)
_BYLINES = ("By Ada Quill · 3 March 2011 · 6 min read", "Von Ute Halm, zuletzt geändert am 4. Mai 2019", "Claire, rédaction du soir", "Written by J. Reed")
_NAMES = "Ada Bruno Celeste Dagmar Emil Flora Gustav Hanna Ivo Jutta Karel Lena Milo Nora Otto Petra".split()
_GOODS = "stove kite cheap piano best violin sale скрипка rug candle new offer lantern saddle deal couch".split()


class Labelled(NamedTuple):
    """A page of the table: the label of each block, and whether the page is stuffed."""

    labels: list[int]
    blocks: list[Block]
    stuffed: bool


class _Writer:
    """Writes the parts of one page; a part is a list of (label, tag, share of link text, text)."""

    def __init__(self, rng: Random, prose: list[str]) -> None:
        self.rng, self.prose = rng, prose

    def sentence(self) -> str:
        """A sentence, at times only its last words."""
        text = self.rng.choice(self.prose)
        return " ".join(text.split()[-self.rng.randint(9, 14) :]) if self.rng.random() < 0.5 else text

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(least, most)))

    def name(self) -> str:
        return " ".join(self.rng.sample(_NAMES, self.rng.randint(1, 5)))

    def some_link(self) -> float:
        return self.rng.choice((0, 0, 0, 0, 0.03, 0.1, 0.3))

    def menu(self) -> list[tuple]:
        own = self.rng.sample(_MENU, self.rng.randint(3, 9))
        if self.rng.random() < 0.25:
            return [(FURNITURE, self.rng.choice(("div", "p", "td")), self.rng.choice((0, 1)), " | ".join(own))]
        return [(FURNITURE, "li", 1, x) for x in own]

    def cookies(self) -> list[tuple]:
        own = self.rng.sample(_NOTICES, self.rng.randint(1, 2))
        return [(FURNITURE, self.rng.choice(("p", "div")), 0, x) for x in own] + [(FURNITURE, "button", 0, "OK")]

    def sidebar(self) -> list[tuple]:
        out = []
        for _ in range(self.rng.randint(1, 2)):
            out.append((FURNITURE, self.rng.choice(("h3", "h3", "h4")), 0, self.rng.choice(_HEADS) if self.rng.random() < 0.7 else self.name()))
            form = self.rng.random()
            if form < 0.3:
                out.append((FURNITURE, "div", 0, ", ".join(self.rng.choice(_NAMES) for _ in range(self.rng.randint(6, 18)))))
            else:
                for _ in range(self.rng.randint(2, 7)):
                    item = (FURNITURE, "li", 1, self.name()) if form < 0.65 else (
                        FURNITURE, "p", self.rng.choice((0, 0, 0.05, 1)), self.sentences(1, 1))
                    out.append(item)
        return out

    def footer(self) -> list[tuple]:
        out = [(FURNITURE, self.rng.choice(("p", "div", "small")), 0, x) for x in self.rng.sample(_FEET, self.rng.randint(1, 3))]
        if self.rng.random() < 0.2:
            out.append((FURNITURE, "p", self.rng.choice((0, 0.05)), self.sentences(1, 1)))
        return out

    def start(self) -> list[tuple]:
        out = [(MAIN, "h1", 0, self.name())]
        if self.rng.random() < 0.6:
            out.append((ASIDE, self.rng.choice(("div", "p")), self.rng.choice((0, 0, 0.3)), self.rng.choice(_BYLINES)))
        return out

    def article(self) -> list[tuple]:
        """Long paragraphs with single sentences as notices between them, short paragraphs only, or a list only."""
        rng = self.rng
        form = rng.random()
        long = form < 0.8
        if form > 0.9:
            return self.listed()
        tag = rng.choice(("p", "p", "p", "div", "br", "td"))
        out: list[tuple] = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.25:
                out.append((MAIN, rng.choice(("h2", "h2", "h2", "h3")) if long else "h2", 0, self.name()))
            for _ in range(rng.randint(1, 3)):
                out.append((MAIN, tag, self.some_link(), self.sentences(2, 6) if long else rng.choice(self.prose)))
            if rng.random() < 0.3:
                whole = rng.random() < 0.6
                items = [self.sentences(1, 2) if whole else self.name() for _ in range(rng.randint(3, 9))]
                out += [(MAIN, "li", self.some_link(), x) for x in items]
            if rng.random() < 0.3:
                out.append((MAIN, "blockquote", self.some_link(), self.sentences(1, 2)))
        for _ in range(rng.randint(0, 2)):
            said = self.sentences(1, 1) if long and rng.random() < 0.6 else rng.choice(_PROMPTS)
            out.insert(rng.randint(1, len(out)), (ASIDE, rng.choice((tag, "p", "div")), rng.choice((0, 0, 0, 0.05, 1)), said))
        return out

    def listed(self) -> list[tuple]:
        """A list of sentences, with notices or prompts."""
        rng = self.rng
        out = [(MAIN, "li", self.some_link(), self.sentences(1, 1) if rng.random() < 0.8 else self.name()) for _ in range(rng.randint(5, 25))]
        for _ in range(rng.randint(0, 2)):
            said = self.sentences(1, 1) if rng.random() < 0.5 else rng.choice(_PROMPTS)
            out.insert(rng.randint(1, len(out)), (ASIDE, rng.choice(("p", "div")), 0, said))
        return out

    def stuffing(self) -> list[tuple]:
        """Keywords, tags or links, with a sentence or two among them."""
        rng = self.rng
        goods = rng.sample(_GOODS, rng.randint(4, 8))
        word = lambda: rng.choice(goods)
        form = rng.random()
        if form < 0.35:
            linked = rng.random() < 0.5
            out = [(STUFFING, "li", 1 if linked else self.some_link(), " ".join(word() for _ in range(rng.randint(2, 6)))) for _ in range(rng.randint(14, 40))]
        elif form < 0.5:
            tag = rng.choice(("p", "div", "td", "br"))
            out = [(STUFFING, tag, self.some_link(), " ".join(word() for _ in range(rng.randint(4, 12)))) for _ in range(rng.randint(8, 40))]
        else:
            mark = " " if form < 0.75 else rng.choice((" / ", ", ", " #", " | "))
            tag = rng.choice(("p", "div", "td", "br"))
            heaps = [mark.join(word() + (f" {word()}" if mark != " " else "") for _ in range(rng.randint(20, 110))) for _ in range(rng.randint(1, 7))]
            out = [(STUFFING, tag, self.some_link() / 3, x) for x in heaps]
        for _ in range(rng.randint(0, 2)):
            out.insert(rng.randint(0, len(out)), (ASIDE, rng.choice(("p", "div")), 0, rng.choice((self.sentences(1, 1), rng.choice(_PROMPTS)))))
        return out


def _ordered(w: _Writer, content: list[tuple]) -> list[tuple]:
    """A page's parts in one of many orders, the sidebar sometimes within the content."""
    rng = w.rng
    before, after = [], []
    for part, share in ((w.cookies, 0.4), (w.menu, 0.8)):
        if rng.random() < share:
            (after if rng.random() < 0.2 else before).append(part())
    if rng.random() < 0.6:
        side = w.sidebar()
        place = rng.random()
        if place < 0.15 and len(content) > 1:
            at = rng.randint(1, len(content) - 1)
            content = content[:at] + side + content[at:]
        else:
            (before if place < 0.45 else after).append(side)
    if rng.random() < 0.65:
        after.append(w.footer())
    rng.shuffle(before)
    rng.shuffle(after)
    first = w.start()
    if rng.random() < 0.15:  # the heading stands in the page's head, with the menu below it
        before, first = [first, *before], []
    return [x for part in (*before, first, content, *after) for x in part]


def labelled_pages() -> Iterator[Labelled]:
    """All pages of the table, every fourth of them stuffed."""
    texts, languages = lines()
    spoken = sorted(set(languages))
    for i in range(PAGES):
        rng = Random(i)
        own = rng.choice(spoken)
        w = _Writer(rng, [t for t, lang in zip(texts, languages) if lang == own])
        stuffed = i % 4 == 3
        rows = _ordered(w, w.stuffing() if stuffed else w.article())
        yield Labelled([r[0] for r in rows], [Block(text, tag, link) for _, tag, link, text in rows], stuffed)
