"""p10: text decoded with a wrong character encoding, found and restored.

A hidden Markov model labels each character outside ASCII.  One state stands
for clean text, one for each encoding pair (text written in one encoding and
read in another), and one for characters lost on the way.  A pair state takes
as many characters at a time as make up one character of the original, and
emits them with the likelihood of that original after the one before; the clean
state emits a character with its own likelihood.  Both come from one character
model trained on clean text.  What the inverse transform of a pair cannot read
is impossible in its state.  ASCII looks the same in every state and only tells
a little by its letters.  The best sequence of states (Viterbi) gives the
spans, which may begin and end anywhere in a word, and each span gets its
state's inverse transform.  A span is restored only where its original is
clearly likelier than it; other spans are left as they are and still reported.

Most texts are clean, and entering a state only costs.  So for each maximal run
of characters outside ASCII, met again and again, it is worked out once how
much each state could gain there at most; a text on which no state can gain
what entering it costs is clean throughout and needs no search, and in the
others only the states that can are searched.

Null and empty texts are no case; null ``doc_id`` rows cannot be named and are
left out.  Texts are read whole.  Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread
from ..sources.tables import table

#: Encodings that UTF-8 was read in.
READERS = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "gbk")
#: (encoding of the text, encoding it was read in) where neither is UTF-8.
PAIRS = (
    ("cp1252", "latin_1"),
    ("cp1251", "cp1252"),
    ("koi8_r", "cp1251"),
    ("koi8_r", "cp1252"),
    ("cp1251", "koi8_r"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
    ("iso8859_5", "cp1251"),
    ("cp1251", "iso8859_5"),
    ("cp1252", "mac_roman"),
    ("mac_roman", "cp1252"),
    ("cp1252", "cp437"),
    ("cp850", "cp1252"),
    ("cp1250", "cp1252"),
    ("iso8859_2", "cp1252"),
)
#: Natural logarithms: entering a state, staying in it, leaving it; and what entering
#: costs besides where Latin letters were read as other Latin letters or signs, as
#: one such letter proves little.
ENTER, STAY, LEAVE = math.log(1e-5), math.log(0.99), math.log(0.05)
LATIN_PAIR = math.log(1e-4)
#: Worth of each ASCII letter between two runs of a Cyrillic single-byte state.
FOREIGN = -2.5
#: So many of them count in a row at most, as names stay Latin.
FOREIGN_LETTERS = 12
#: Likelihood of a character of which bytes were lost, and of one lost as a whole.
LOST, GONE = math.log(1e-5), -2.0
#: What entering a state costs besides after a clean character that is no ASCII.
INSIDE = math.log(0.1)
#: How much likelier than spans their originals must be for them to be restored.
MARGIN = 3.0
REPLACEMENT = "\ufffd"
_RUNS = re.compile("[^\x00-\x7f]+")
_LETTERS = re.compile("[A-Za-z]")
#: Central European text for the character model besides the samples, which lack it,
#: and how often each line counts, so that it weighs about as much as a language sampled.
CENTRAL_WEIGHT = 6
CENTRAL = (
    "Mówią, że nikt już nie wie, skąd wziął się ten zwyczaj, ale każdy go przestrzega.",
    "Jeśli coś się nie uda, należy spróbować jeszcze raz, choćby następnego dnia.",
    "Książkę znaleziono dopiero po wielu latach, pod podłogą małego pokoju na piętrze.",
    "Źródło bije tuż za kościołem, więc ludzie przychodzą tu po wodę także zimą.",
    "Dzieci biegły brzegiem rzeki, a starsi siedzieli w cieniu i rozmawiali o żniwach.",
    "Říká se, že už nikdo neví, odkud ten zvyk pochází, ale každý ho dodržuje.",
    "Když se něco nepodaří, je třeba to zkusit znovu, třeba hned příští den.",
    "Knihu našli až po mnoha letech pod podlahou malého pokoje v prvním patře.",
    "Pramen vyvěrá těsně za kostelem, a tak sem lidé chodí pro vodu i v zimě.",
    "Děti běžely podél řeky, starší seděli ve stínu a mluvili o žních a počasí.",
)


def _byte_map(codec: str, controls: bool = False) -> dict[str, bytes]:
    """Character to byte of a one-byte encoding; undefined bytes stand for themselves.

    With ``controls`` what Latin-1 makes of bytes is taken besides.
    """
    out = {}
    for b in range(0x80, 0x100):
        c = bytes([b]).decode(codec, "replace")
        out[c if c != REPLACEMENT else chr(b)] = bytes([b])
    if controls:
        out = {chr(b): bytes([b]) for b in range(0x80, 0x100)} | out
    return out


class _Double(dict):
    """Character to bytes of a two-byte encoding, as asked for."""

    def __init__(self, codec: str) -> None:
        self.codec = codec

    def __missing__(self, c: str) -> bytes:
        raw = c.encode(self.codec, "ignore")
        self[c] = raw
        return raw


class Unit(NamedTuple):
    """Characters that a pair state takes together: how many, and what they were."""

    size: int
    text: str


def _lead(byte: int) -> int:
    """Bytes of the UTF-8 character that begins with ``byte``; 0 when none does."""
    return 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 0


class State:
    """An encoding pair: the inverse of writing in one encoding and reading in another."""

    def __init__(self, wrote: str, read: str, times: int = 1) -> None:
        self.name = f"{wrote}>{read}" + ("" if times == 1 else f"x{times}")
        self.utf8 = wrote == "utf_8"
        self.cyrillic = wrote in ("cp1251", "koi8_r", "cp866", "iso8859_5")
        self.double = read == "gbk"
        self.controls = read == "latin_1"
        self.times = times
        self.codes = _Double(read) if self.double else _byte_map(read, self.utf8 and read == "cp1252")
        if self.controls:
            self.codes = {chr(b): bytes([b]) for b in range(0x80, 0xA0)}
        if not self.utf8:
            texts = {c: b.decode(wrote, "replace") for c, b in self.codes.items()}
            self.single = {c: Unit(1, t) for c, t in texts.items() if t != REPLACEMENT}

    def unit(self, run: str, at: int) -> Unit | None:
        """What the state takes at a place of a run; None when the pair cannot have made it."""
        if not self.utf8:
            return self.single.get(run[at])
        if self.times == 1:
            return self._double(run, at) if self.double else self._character(run, at)
        inner, i = "", at
        while i < len(run):
            step = self._character(run, i)
            if step is None or step.text == REPLACEMENT or step.text < "\x80":
                break
            inner += step.text
            i += step.size
            whole = self._character(inner, 0)
            need = _lead(self.codes.get(inner[0], b"\0")[0])
            if not need:
                return None
            if len(inner) == need:
                return whole and Unit(i - at, whole.text)
        return Unit(i - at, REPLACEMENT) if len(inner) > 1 else None

    def _character(self, run: str, at: int) -> Unit | None:
        """One UTF-8 character; U+FFFD for one of which the last bytes are missing."""
        codes = self.codes
        raw = codes.get(run[at])
        need = _lead(raw[0]) if raw else 0
        if not need:
            return None
        i = at + 1
        while i < len(run) and i < at + need:
            more = codes.get(run[i])
            if not more or not 0x80 <= more[0] < 0xC0:
                break
            raw += more
            i += 1
        if len(raw) == need:
            text = raw.decode("utf-8", "replace")
            return Unit(need, text) if REPLACEMENT not in text else None
        if i < len(run) and run[i] == REPLACEMENT:
            return Unit(i + 1 - at, REPLACEMENT)
        return Unit(i - at, REPLACEMENT) if len(raw) > 1 else None

    def _double(self, run: str, at: int) -> Unit | None:
        """UTF-8 characters that two-byte characters make up together."""
        raw = b""
        for i in range(at, min(len(run), at + 6)):
            more = self.codes[run[i]]
            if not more:
                return None
            raw += more
            try:
                return Unit(i + 1 - at, raw.decode("utf-8"))
            except UnicodeDecodeError as e:
                if e.reason != "unexpected end of data":
                    return None
        return None

    def inverse(self, run: str) -> str | None:
        """The original of a whole run; lost bytes give U+FFFD; None when the pair cannot have made it."""
        out, i = "", 0
        while i < len(run):
            own = self.unit(run, i)
            if own is None:
                return None
            out += own.text
            i += own.size
        return out


def states() -> list[State]:
    """All pair states, in the order of their labels from 1 on; 0 is clean, the label after the last one lost."""
    return [*(State("utf_8", r) for r in READERS), State("utf_8", "cp1252", 2), *(State(*p) for p in PAIRS)]


#: Marks and spaces that printed text of any language may hold.
_PRINTED = frozenset("\u2018\u2019\u201c\u201d\u201e\u2013\u2014\u2026\u00ab\u00bb\u00a0\u00b7")


def _prior(c: str) -> float:
    """Likelihood of a character that the training text does not hold."""
    n = ord(c)
    if n < 0x80:
        return 1e-4
    if c == REPLACEMENT or 0x80 <= n < 0xA0:
        return 1e-11
    if c in _PRINTED:
        return 3e-2
    kind = unicodedata.category(c)
    if 0x2010 <= n <= 0x203A or n in (0x20AC, 0xA3, 0xB0, 0xA7, 0xA1, 0xBF):
        return 1e-3
    if kind[0] == "L":
        return 1e-4 if n < 0x100 else 2e-5 if n < 0x180 else 1e-5 if 0x400 <= n < 0x460 else 1e-6
    if kind in ("Mn", "Mc"):
        return 1e-5
    return 1e-4 if n < 0x100 else 1e-6


def _drawn(c: str) -> bool:
    """True for arrows, mathematical signs, box drawing and blocks."""
    return "\u2190" <= c <= "\u25ff"


def character_counts(texts: Iterable[str]) -> Counter:
    """How often the folded texts, each behind a space, hold each character and each two characters in a row."""
    out: Counter = Counter()
    for t in texts:
        t = " " + t.lower()
        out.update(t)
        out.update(map("".join, zip(t, t[1:])))
    return out


class CharacterModel:
    """Bigrams of folded characters, with what case and rare characters cost.

    Trained on ``texts`` and on the ``counts`` that :func:`character_counts` gives of others.
    """

    #: Pairs of characters of which the likelihood is remembered at most.
    KEPT = 200_000

    def __init__(self, texts: Iterable[str], counts: Mapping[str, int] | None = None) -> None:
        held = character_counts(texts)
        held.update(counts or {})
        total = sum(n for c, n in held.items() if len(c) == 1) or 1
        self.one = {c: n / total for c, n in held.items() if len(c) == 1}
        self.two = {(p[0], p[1]): n / held[p[0]] for p, n in held.items() if len(p) == 2}
        self._known: dict[tuple[str, str], float] = {}

    def step(self, last: str, c: str) -> float:
        """Log-likelihood of a character after the character ``last``."""
        known = self._known.get((last, c))
        if known is None:
            if len(self._known) >= self.KEPT:
                self._known.clear()
            known = self._known[last, c] = self._step(last, c)
        return known

    def _step(self, last: str, c: str) -> float:
        low = c.lower() if len(c.lower()) == 1 else c
        p = 0.6 * self.two.get((last.lower(), low), 0.0) + 0.3 * self.one.get(low, 0.0) + 0.1 * _prior(c)
        if _drawn(c):
            p = 2e-2 if _drawn(last) else 1e-6 if last.isalpha() else 3e-4
        elif last.isalpha() and unicodedata.category(c)[0] == "S":
            p *= 0.1
        case = 0.0
        if c.isupper() and last.isalpha():
            case = 0.0 if last.isupper() else -5.0
        elif c.isupper():
            case = -0.7
        return math.log(p) + case

    def score(self, run: str, before: str) -> float:
        """Log-likelihood of a run after the character ``before``."""
        return sum(self.step(a, b) for a, b in zip(before + run, run))


class _Gain(NamedTuple):
    """What a state can gain over clean in a run: anywhere, from its start, up to its end, and in the whole of it."""

    best: float
    start: float
    end: float
    whole: float


_NOTHING = -1e9


class Labeller:
    """The hidden Markov model; remembers what it has worked out of runs."""

    #: Distinct runs remembered at most.
    KEPT = 300_000

    def __init__(self, model: CharacterModel) -> None:
        self.model = model
        self.states = states()
        self.lost = len(self.states) + 1
        self.enter = [ENTER + (0 if s.utf8 or s.cyrillic or s.controls else LATIN_PAIR) for s in self.states]
        self._gains: dict[tuple[str, str], dict[int, _Gain]] = {}

    def emission(self, last: str, unit: Unit) -> float:
        """Log-likelihood of a pair state's unit after the original character ``last``."""
        total = 0.0
        for c in unit.text:
            if c == REPLACEMENT:
                total += LOST
                continue
            total += self.model.step(last, c) + (-8.0 if _drawn(c) or c < " " or "\x7f" <= c < "\xa0" else 0.0)
            last = c
        return total

    def gains(self, run: str, before: str) -> dict[int, _Gain]:
        """By label, for those states that can gain anything in a run."""
        known = self._gains.get((run, before))
        if known is None:
            if len(self._gains) >= self.KEPT:
                self._gains.clear()
            known = self._gains[run, before] = self._worked_out(run, before)
        return known

    def _worked_out(self, run: str, before: str) -> dict[int, _Gain]:
        step, n = self.model.step, len(run)
        clean = [0.0]
        for a, b in zip(before + run, run):
            clean.append(clean[-1] + step(a, b))
        out = {}
        for k, state in enumerate(self.states, 1):
            best = _NOTHING
            reached: list[tuple[float, str] | None] = [None] * (n + 1)  # ending here, begun anywhere
            first: list[tuple[float, str] | None] = [None] * (n + 1)  # ending here, begun with the run
            first[0] = (0.0, before)
            for i in range(n):
                unit = state.unit(run, i)
                if unit is None:
                    continue
                j = i + unit.size
                last = unit.text[-1]
                plain = clean[j] - clean[i]
                own = self.emission(run[i - 1] if i else before, unit) - plain
                if reached[i]:
                    own = max(own, reached[i][0] + self.emission(reached[i][1], unit) - plain)
                if reached[j] is None or own > reached[j][0]:
                    reached[j] = (own, last)
                best = max(best, own)
                if first[i]:
                    first[j] = (first[i][0] + self.emission(first[i][1], unit) - plain, last)
            if best > 0:
                start = max([f[0] for f in first[1:] if f], default=_NOTHING)
                out[k] = _Gain(best, start, reached[n][0] if reached[n] else _NOTHING, first[n][0] if first[n] else _NOTHING)
        return out

    def _active(self, runs: list[tuple[str, str]]) -> list[int]:
        """Labels of the states that can gain over a text what entering them costs."""
        total: dict[int, float] = {}
        before: dict[int, float] = {}  # gain of the best stretch that ends with the run before
        for run, last in runs:
            now = {}
            for k, g in self.gains(run, last).items():
                going = before.get(k, _NOTHING)
                top = max(g.best, going + g.start)
                if top > total.get(k, 0.0):
                    total[k] = top
                now[k] = max(g.end, going + g.whole)
            before = now
        return [k for k, gain in total.items() if gain + self.enter[k - 1] > 0]

    def labels(self, text: str) -> list[tuple[int, int, int]]:
        """Spans ``(start, end, label)`` of characters that are not clean; none for clean texts.

        Labels count the pair states from 1; the last label is that of lost characters.
        """
        found = [(m.start(), m[0]) for m in _RUNS.finditer(text)]
        active = self._active([(run, text[i - 1] if i else " ") for i, run in found])
        if not active and REPLACEMENT not in text:
            return []
        return self._viterbi(text, found, active)

    def _viterbi(self, text: str, found: list[tuple[int, str]], active: list[int]) -> list[tuple[int, int, int]]:
        step = self.model.step
        labels = [*active, self.lost]
        enter = {k: ENTER if k == self.lost else self.enter[k - 1] for k in labels}
        # Of each state at a place: likelihood, last original character, and the path: (start, label, path before).
        clean: tuple = (0.0, None)
        inside: dict[int, tuple] = {}
        end = 0
        for begin, run in found:
            before = text[begin - 1] if begin else " "
            letters = min(FOREIGN_LETTERS, len(_LETTERS.findall(text, end, begin))) if end else 0
            inside = {
                k: (v + letters * (FOREIGN if k != self.lost and self.states[k - 1].cyrillic else 0.0), before if begin > end else last, path)
                for k, (v, last, path) in inside.items()
            }
            n = len(run)
            at: list[dict[int, tuple]] = [inside, *({} for _ in range(n))]
            plain: list[tuple | None] = [clean, *([None] * n)]
            for i in range(n):
                own = plain[i]
                for v, _, path in at[i].values():
                    if own is None or v + LEAVE > own[0]:
                        own = (v + LEAVE, path)
                if own is None:
                    continue
                last = run[i - 1] if i else before
                plain[i + 1] = _better(plain[i + 1], (own[0] + step(last, run[i]), own[1]))
                for k in labels:
                    unit = (Unit(1, REPLACEMENT) if run[i] == REPLACEMENT else None) if k == self.lost else self.states[k - 1].unit(run, i)
                    if unit is None:
                        continue
                    gone = k == self.lost
                    new = own[0] + enter[k] + (INSIDE if i else 0.0) + (GONE if gone else self.emission(last, unit))
                    j, here = i + unit.size, begin + i
                    best = (new, unit.text[-1], (here, here + unit.size, k, own[1]))
                    if k in at[i]:
                        v, original, path = at[i][k]
                        stay = v + STAY + (GONE if gone else self.emission(original, unit))
                        if stay >= new:
                            if path[1] == here:
                                path = (path[0], here + unit.size, k, path[3])
                            else:  # the state goes on beyond ASCII characters
                                path = (here, here + unit.size, k, path)
                            best = (stay, unit.text[-1], path)
                    if k not in at[j] or best[0] > at[j][k][0]:
                        at[j][k] = best
            inside = at[n]
            clean = plain[n]
            for v, _, path in inside.values():
                clean = _better(clean, (v + LEAVE, path))
            end = begin + n
        top = clean
        for v, _, path in inside.values():
            top = _better(top, (v, path))
        spans, path = [], top[1]
        while path:
            spans.append(path[:3])
            path = path[3]
        return spans[::-1]

    def restore(self, text: str, spans: list[tuple[int, int, int]]) -> str:
        """The text with its spans replaced by their originals; lost characters stay U+FFFD.

        Spans of one label with nothing but ASCII between them are taken
        together, and left alone unless their originals are clearly likelier.
        """
        originals: list[str | None] = []
        gains: list[float] = []  # of the group that each span is in
        for n, (i, j, k) in enumerate(spans):
            run, before = text[i:j], text[i - 1] if i else " "
            own = self.states[k - 1].inverse(run) if k != self.lost else None
            gain = 0.0 if own is None else self.emission(before, Unit(j - i, own)) - self.model.score(run, before)
            same = n > 0 and spans[n - 1][2] == k and text[spans[n - 1][1] : i].isascii()
            originals.append(own)
            gains.append(gain + (gains[-1] if same else 0.0))
        for n in range(len(spans) - 2, -1, -1):
            if spans[n][2] == spans[n + 1][2] and text[spans[n][1] : spans[n + 1][0]].isascii():
                gains[n] = gains[n + 1]
        out, end = [], 0
        for (i, j, _), own, gain in zip(spans, originals, gains):
            out += text[end:i], text[i:j] if own is None or gain < MARGIN else own
            end = j
        out.append(text[end:])
        return "".join(out)

    def names(self, spans: list[tuple[int, int, int]]) -> list[str]:
        """Names of the labels among the spans, in order."""
        return sorted({self.states[k - 1].name if k != self.lost else "lost" for *_, k in spans})


def _better(a: tuple | None, b: tuple) -> tuple:
    return b if a is None or b[0] > a[0] else a


def train(samples: DataFrame) -> CharacterModel:
    """The character model of all clean texts of ``samples (text)``.

    They are counted where they lie; only the counts, of as many distinct pairs
    of characters as there are, come to the driver.
    """
    ship_package(samples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = character_counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["chars", "n"])

    counts = samples.select("text").where("text is not null").mapInArrow(run, "chars string, n bigint")
    rows = counts.groupBy("chars").agg(F.sum("n").alias("n")).collect()
    return CharacterModel(CENTRAL * CENTRAL_WEIGHT, {r.chars: r.n for r in rows})


def garbled(documents: DataFrame, model: CharacterModel) -> DataFrame:
    """Documents with a garbled passage: ``doc_id, restored, pairs``.

    ``restored`` is the text with every garbled span restored as far as it can
    be, ``pairs`` names the encoding pairs met (``lost`` for lost characters).
    """
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = Labeller(model)
        for batch in batches:
            ids, texts, names = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text.isascii() and (spans := hmm.labels(text)):
                    ids.append(doc)
                    texts.append(hmm.restore(text, spans))
                    names.append(hmm.names(spans))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(names, pa.list_(pa.string()))],
                ["doc_id", "restored", "pairs"],
            )

    rows = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike("[^\\x00-\\x7f]"))
    return spread(rows).mapInArrow(run, "doc_id bigint, restored string, pairs array<string>")


def p10_restored(spark, sf):
    found = garbled(table(spark, sf, "documents"), train(table(spark, sf, "lang_samples")))
    return found.select("doc_id", "restored", F.array_join("pairs", " ").alias("pairs"))


def p10_found(spark, sf):
    return p10_restored(spark, sf).select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
SQL: dict[str, str] = {}
