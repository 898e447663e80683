"""Column functions over plain text: trimming, tokens, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest token that an index takes.
MAX_TOKEN = 30

# Words of url paths that no index takes.
URL_STOP_WORDS = """
404 500 action amp api assets auth backup cgi confirm content css csv debug detail error feed gif ico id image images img
item jpeg jpg js json list login logout m mobile new old page pdf png q query ref register rss search session sessionid sid
signin signup sitemap src static svg temp tmp token txt utm verify view xml
""".split()

# Image descriptions, and words of them, that no index takes.
ALT_STOP_WORDS = """
ad advertisement avatar banner default footer header icon image img loading logo photo picture placeholder profile promo
spacer thumb thumbnail user
""".split()


def trim_controls(c: Column) -> Column:
    """Without blanks and control characters at either end."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def words_between(c: Column, other: str) -> Column:
    """Lower-case pieces of a text between runs of the characters ``other`` (a regex class)."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), f"{other}+", " "), " "), lambda t: t != "")


def _indexed(tokens: Column, pattern: str) -> Column:
    return F.filter(tokens, lambda t: t.rlike(pattern) & (F.length(t) <= MAX_TOKEN))


def title_tokens(title: Column) -> Column:
    """Distinct tokens of a title: a letter, then letters and digits; named entities are blanks."""
    plain = F.regexp_replace(F.lower(title), "&[a-z]+;", " ")
    return F.array_distinct(_indexed(words_between(plain, "[^a-z0-9]"), "^[a-z][a-z0-9]*$"))


def path_tokens(path: Column) -> Column:
    """Distinct tokens of a decoded url path: two letters or more, stop words left out."""
    tokens = F.filter(words_between(path, "[^a-z]"), lambda t: F.length(t).between(2, MAX_TOKEN))
    return F.array_except(tokens, F.array(*map(F.lit, URL_STOP_WORDS)))


def query_terms(query: Column) -> Column:
    """Terms of a search string in lower case; a repeated term counts again."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")


def truncated(c: Column, n: int) -> Column:
    """Texts longer than ``n`` end in three dots instead."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def number(c: Column, kind: str, default: Column | None = None) -> Column:
    """A number in text form; what is none gives null or the default."""
    parsed = c.try_cast(kind)
    return parsed if default is None else F.coalesce(parsed, default)


def fixed(c: Column, digits: int) -> Column:
    """A number with so many digits after the point."""
    return F.format_string(f"%.{digits}f", c)


def padded(c: Column, width: int) -> Column:
    """A text with blanks after it up to a width; longer ones stay whole."""
    return F.format_string(f"%-{width}s", c)
