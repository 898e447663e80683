"""p8: the corpus as ids of a public byte-level BPE vocabulary, and back.

Pieces of the text (words with their space, numbers, marks, white space) are
encoded one by one, each distinct piece once per worker.  An Aho-Corasick
automaton gives all vocabulary tokens at all positions of a piece in one pass;
the encoder takes the longest token at each position and checks it against the
token before: two tokens may stand side by side only when byte-pair merging
would not have merged across their border.  If not, it tries the next shorter
token, or goes back one token; positions found hopeless are never tried again,
so the work is linear in the piece.  What comes out is exactly what merging by
rank gives.  Decoding looks up token bytes in one buffer by an offset table.

Null and empty texts give an empty list.  Strings that look like special tokens
are plain text.  A null ``doc_id`` stays null; repeated rows come out as often
as they stand in the table; further columns are ignored.  Texts are encoded
whole, whatever their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package, spread
from ..sources.tables import table

#: Folder of the vocabulary files, and the vocabulary used.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: how texts are cut into pieces before any merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces, and token pairs, that a worker remembers at most.
REMEMBERED = 500_000
#: Characters of text that are encoded before their ids are sent off.
SLICE_CHARS = 4_000_000

_NEVER = 1 << 62


class Bpe:
    """Encoder and decoder of one vocabulary of byte strings, ranked by their ids."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.buffer = b"".join(tokens)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._find = regex.compile(PIECES).findall

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is ``token``; None for a single byte."""
        if token not in self._halves:
            text, found = self.tokens[token], None
            for i in range(1, len(text)):
                a, b = self.rank.get(text[:i], _NEVER), self.rank.get(text[i:], _NEVER)
                if a < token and b < token and self._unmerged(a, b, token):
                    found = (a, b)
                    break
            self._halves[token] = found
        return self._halves[token]

    def _spine(self, token: int, side: int) -> list[int]:
        """The tokens at one end of ``token`` while it is merged, the last first."""
        out = [token]
        while half := self.halves(out[-1]):
            out.append(half[side])
        return out

    def _unmerged(self, a: int, b: int, before: int = _NEVER) -> bool:
        """True when no merge of a rank under ``before`` crosses the border of ``a`` and ``b``.

        Merging goes by rising rank, so the token at the border on either side
        lasts from its own rank to that of the next one on its spine.  While
        both stand there, their merge would come first if its rank is under
        the left one's end and not over the right one's, as equal ranks merge
        from the left.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        x, y = left.pop(), right.pop()
        while True:
            end_x = left[-1] if left else _NEVER
            end_y = right[-1] if right else _NEVER
            merged = self.rank.get(self.tokens[x] + self.tokens[y], _NEVER)
            if merged < before and merged < end_x and merged <= end_y:
                return False
            if end_x == end_y == _NEVER:
                return True
            if end_x <= end_y:
                x = left.pop()
            else:
                y = right.pop()

    def compatible(self, a: int, b: int) -> bool:
        """True when ``a`` and ``b`` may follow each other; kept in the pair table."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[a, b] = self._unmerged(a, b)
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        whole = self.rank.get(piece)
        if whole is not None and len(piece) == 1:
            return (whole,)
        at: list[list[int]] = [[] for _ in piece]
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            at[end + 1 - len(self.tokens[token])].append(token)  # shorter ones come first
        out: list[int] = []
        tries: list[int] = []  # tokens not yet tried at each position taken
        hopeless = bytearray(len(piece) + 1)
        pos, left = 0, len(at[0])
        while pos < len(piece):
            for k in range(left - 1, -1, -1):
                token = at[pos][k]
                end = pos + len(self.tokens[token])
                if not hopeless[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    tries.append(k)
                    pos, left = end, len(at[end]) if end < len(piece) else 0
                    break
            else:
                hopeless[pos] = 1
                token, left = out.pop(), tries.pop()
                pos -= len(self.tokens[token])
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        known = self._pieces
        if len(known) >= REMEMBERED:
            known.clear()
        pieces = self._find(text)
        try:
            return list(chain.from_iterable([known[p] for p in pieces]))
        except KeyError:
            for p in pieces:
                if p not in known:
                    known[p] = self.encode_piece(p.encode())
        return list(chain.from_iterable([known[p] for p in pieces]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        starts, ends = self.offsets[ids], self.offsets[np.asarray(ids) + 1]
        return b"".join([self.buffer[a:b] for a, b in zip(starts, ends)]).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Bpe:
    """The encoder of a vocabulary file (one line each: base64 of the bytes, rank)."""
    lines = (x.split() for x in Path(folder, f"{name}.tiktoken").read_bytes().splitlines() if x)
    ranked = sorted((int(n), base64.b64decode(t)) for t, n in lines)
    return Bpe([t for _, t in ranked])


def _sent(spark: SparkSession, folder: str, name: str) -> None:
    """Send a vocabulary file, of a megabyte or so, along with the job; workers have it in :func:`_received`."""
    spark.sparkContext.addFile(str(Path(folder, f"{name}.tiktoken")))


def _received(name: str) -> Bpe:
    return vocabulary(SparkFiles.getRootDirectory(), name)


def _ids(batch: pa.RecordBatch, bpe: Bpe) -> Iterator[pa.RecordBatch]:
    ids, sizes, start, chars = [], [], 0, 0
    texts = batch.column("text").to_pylist()
    for i, text in enumerate(texts):
        own = bpe.encode(text) if text else ()
        ids.append(np.array(own, np.int32))
        sizes.append(len(own))
        chars += len(text or "")
        if chars >= SLICE_CHARS or i == len(texts) - 1:
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(start, i + 1 - start), lists], ["doc_id", "ids"]
            )
            ids, sizes, start, chars = [], [], i + 1, 0


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids`` of every row of ``documents (doc_id, text)``."""
    ship_package(documents.sparkSession)
    _sent(documents.sparkSession, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _received(name)
        for batch in batches:
            if batch.num_rows:
                yield from _ids(batch, bpe)

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_texts(encoded: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``text`` of ``encoded (doc_id, ids)``; null ids give a null text."""
    ship_package(encoded.sparkSession)
    _sent(encoded.sparkSession, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _received(name)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, int)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def p8_ids(spark, sf):
    return token_ids(table(spark, sf, "documents"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
