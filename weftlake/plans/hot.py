"""Queries on keys that hold most of the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import skew
from ..sources.tables import table


def p4_found(spark, sf):
    return skew.redundant_rows(table(spark, sf, "pt_page_index"))


def p4_growth(spark, sf):
    grown = skew.token_growth(table(spark, sf, "pt_page_index"))
    return grown.select("row_id", "token", F.array_join("new_urls", " ").alias("new_urls"), "n_new")


def p4_tokens(spark, sf):
    first = skew.first_holders(table(spark, sf, "pt_page_index"))
    return first.groupBy("token").agg(
        F.count("url").alias("n_urls"), F.count_distinct("row_id").alias("n_adding")
    )


_FIRST = r"""
with pairs as (
  select row_id, indexed_at, lower(regexp_replace(token, '^\s+|\s+$', '', 'g')) as token, unnest(urls) as url
  from pt_page_index where row_id is not null and token is not null),
ranked as (
  select *, row_number() over (partition by token, url order by indexed_at, row_id) as rn
  from pairs where url is not null and token <> ''),
first as (select * from ranked where rn = 1)
"""

QUERIES = {"p4_found": p4_found, "p4_growth": p4_growth, "p4_tokens": p4_tokens}
SQL = {
    "p4_found": _FIRST + "select distinct row_id from ranked where row_id not in (select row_id from first)",
    "p4_growth": _FIRST
    + "select row_id, token, string_agg(url, ' ' order by url) as new_urls, count(*)::bigint as n_new from first group by row_id, token",
    "p4_tokens": _FIRST
    + "select token, count(url)::bigint as n_urls, count(distinct row_id)::bigint as n_adding from first group by token",
}
