"""Per-key work that a few very frequent keys cannot hold up.

Two devices, both exact.  Algebraic aggregates are left to Catalyst's two-phase
hash aggregation: every task folds its rows into a bounded hash table of
mergeable states (falling back to sorting, hence spilling, when full), so a hot
key costs one state per task in the shuffle, not one row per record.  For that
a state must be of fixed width: a time and a row id go into one number (see
:func:`moment`), as a struct of them would be aggregated by sorting.  Joins
back to the rows split off the hot keys, which are few by counting: at most
``n`` keys can each hold more than one ``n``-th of all rows, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows; so at most so many are.
HOT_SHARE = 1000


def key_sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows per key: the keys and ``n``; null keys are left out."""
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(sizes: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """Keys of ``sizes (..., n)`` with more than one in ``share`` of all rows.

    At most ``share - 1`` keys can be, so the result may be broadcast always.
    """
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.where(F.col("n") * share > total).drop("n")


def join_by_key(
    rows: DataFrame, stats: DataFrame, sizes: DataFrame | None, *keys: str, hot: DataFrame | None = None
) -> DataFrame:
    """Inner join of many ``rows`` with one row of ``stats`` per key, without skew.

    ``sizes`` has the keys and ``n``, how many ``rows`` each has.  Rows of hot
    keys meet their statistics by broadcast, all others by a join in which no
    key holds more than one in ``HOT_SHARE`` rows.  Null keys match nothing.
    Where the same rows are joined again and again, ``hot``, the result of
    :func:`hot_keys`, is given in place of ``sizes``.
    """
    on = list(keys)
    hot = F.broadcast((hot_keys(sizes) if hot is None else hot).select(on))
    few = rows.join(F.broadcast(stats.join(hot, on, "left_semi")), on)
    rest = rows.join(hot, on, "left_anti").join(stats, on)
    return few.unionByName(rest)


def counted_token(token: str | Column = "token") -> Column:
    """A token as it counts: lower case, no blanks around it, null when nothing is left."""
    text = F.lower(F.btrim(F.col(token) if isinstance(token, str) else token, F.lit(" \t\n\x0b\f\r")))
    return F.when(text != "", text)


#: Row ids, null among them, that one microsecond has room for in a moment.
_IDS = 2 * 10**19
#: Microseconds that stand for no time at all, before every time there is.
_NO_TIME = -(10**18)


def moment(time: Column, row_id: Column) -> Column:
    """One number, decimal(38, 0), that orders as the pair of a time and a row id (bigint) does, nulls first.

    A time without zone is read in the session's zone.
    """
    wide = lambda c: c.cast("decimal(20,0)")
    at = wide(F.coalesce(F.unix_micros(time.cast("timestamp")), F.lit(_NO_TIME)))
    place = F.coalesce(wide(row_id) + F.lit(str(2**63 + 1)).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (at * F.lit(str(_IDS)).cast("decimal(20,0)") + place).cast("decimal(38,0)")


def moment_row(moment: Column) -> Column:
    """The row id of a moment."""
    place = F.pmod(moment, F.lit(str(_IDS)).cast("decimal(38,0)"))
    return F.when(place > 0, (place - F.lit(str(2**63 + 1)).cast("decimal(38,0)")).cast("bigint"))


def moment_time(moment: Column) -> Column:
    """The time of a moment."""
    ids = F.lit(str(_IDS)).cast("decimal(38,0)")
    micros = F.call_function("div", moment - F.pmod(moment, ids), ids)
    return F.when(micros != _NO_TIME, F.timestamp_micros(micros))


def first_holders(index: DataFrame) -> DataFrame:
    """Which posting first brought each url to its token, in order of time.

    ``index`` has ``row_id, token, urls, indexed_at``; the result has
    ``token, url, indexed_at, row_id``: one row for each pair of counted token
    and url, with the least ``(indexed_at, row_id)`` that holds it.  The least
    is algebraic, so a token with a third of all rows only sends one state for
    each url and task.
    """
    kind = index.schema["indexed_at"].dataType
    pairs = index.select(
        counted_token().alias("token"),
        F.explode("urls").alias("url"),
        moment(F.col("indexed_at"), F.col("row_id")).alias("at"),
    ).where("token is not null and url is not null")
    first = pairs.groupBy("token", "url").agg(F.min("at").alias("at"))
    return first.select("token", "url", moment_time(F.col("at")).cast(kind).alias("indexed_at"), moment_row(F.col("at")).alias("row_id"))


def redundant_rows(index: DataFrame) -> DataFrame:
    """Rows of an index that add nothing to their token: ``row_id``.

    A row adds a url when no earlier row of the same counted token, by
    ``(indexed_at, row_id)``, holds it; rows that add none come out.

    Rows without token (null or blank) or without any url that is not null are
    no case.  A null ``indexed_at`` counts as earlier than every time; null
    ``row_id`` rows cannot be named and are left out, though their urls count.
    A row repeated in full adds nothing beside its twin, yet both carry the
    same ``row_id``, which then counts as adding.  Further columns are ignored,
    and no table, however empty, fails.
    """
    own = index.select("row_id", "token", "urls", "indexed_at")
    with_url = own.where(
        F.col("row_id").isNotNull()
        & counted_token().isNotNull()
        & (F.size(F.filter("urls", lambda u: u.isNotNull())) > 0)
    ).select("row_id")
    adding = first_holders(own).select("row_id").distinct()
    return with_url.join(adding, "row_id", "left_anti").distinct()


def token_growth(index: DataFrame) -> DataFrame:
    """What each index row adds to its token: ``row_id, token, new_urls, n_new``.

    Only rows that add something appear; see :func:`redundant_rows` for the rest.
    """
    return (
        first_holders(index)
        .groupBy("row_id", "token")
        .agg(F.array_sort(F.collect_list("url")).alias("new_urls"))
        .withColumn("n_new", F.size("new_urls").cast("bigint"))
    )
