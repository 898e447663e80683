"""Row keys: a digest spelled in letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: second letters of the pairs that spell a byte; the first run through the alphabet.
SECOND = "acegikmoqs"


def pair_index(byte: int) -> int:
    """Which letter pair spells an unsigned byte of the digest."""
    return 255 if byte == 0 else byte if byte < 128 else byte - 1


def letter_pair(index: int) -> str:
    """The pair at an index of the table."""
    return chr(97 + index % 26) + SECOND[index // 26]


def hash_key(text: Column) -> Column:
    """SHA-1 of a text, two letters for each byte; null for null."""
    digest = F.sha1(text)
    pairs = F.array(*(F.lit(letter_pair(pair_index(b))) for b in range(256)))
    letters = F.transform(
        F.sequence(F.lit(0), F.lit(19)),
        lambda i: F.element_at(pairs, F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1),
    )
    return F.when(text.isNotNull(), F.array_join(letters, ""))
