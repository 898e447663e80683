"""Ranked keyword search over the title and url indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..sources.tables import table

#: Weights of the title index, the url index and the host's rank.
TITLE, URL, RANK = 1.5, 1.0, 5000.0
#: Records assumed to be indexed; results kept before and after the title boost.
RECORDS, KEPT, SHOWN = 30_000, 60, 50
#: What a title equal to the search string, or beginning with it, adds.
EQUAL, PREFIX = 50.0, 25.0


def idf(df: Column, records: int = RECORDS) -> Column:
    """Weight of a term by how many records it has."""
    return F.ln(F.lit(float(records)) / (F.lit(1.0) + df))


def _matches(terms: DataFrame, words: list[str], index: DataFrame, weight: float, source: str) -> DataFrame:
    """``url, source, score`` for each posting of each term.

    The terms are literals of the scan's filter, so of an index that is sorted
    or bucketed by token only the row groups that may hold them are read.
    """
    pairs = (
        index.where(F.col("token").isin(words)).join(F.broadcast(terms), "token")  # terms of one search string
        .select("token", "times", F.explode("urls").alias("url"))
        .where("url is not null")
        .distinct()
    )
    df = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    scored = pairs.join(F.broadcast(df), "token")  # one row for each term
    return scored.select("url", F.lit(source).alias("source"), (F.lit(weight) * idf(F.col("df")) * F.col("times")).alias("score"))


def latest_titles(crawl: DataFrame) -> DataFrame:
    """``url, title``: the last title that is not blank."""
    named = crawl.where("url is not null and trim(title) <> ''")
    return named.groupBy("url").agg(F.max_by("title", F.struct("fetched_at", "crawl_id")).alias("title"))


def scores(query: str, title_index: DataFrame, url_index: DataFrame, ranks: DataFrame) -> DataFrame:
    """``url, title_score, url_score, rank_score`` of everything that holds a term."""
    spark = title_index.sparkSession
    terms = spark.createDataFrame([(query,)], "q string").select(F.explode(T.query_terms(F.col("q"))).alias("token"))
    counted = [(r.token, r["count"]) for r in terms.groupBy("token").count().collect()]  # of one search string
    words, terms = [t for t, _ in counted], spark.createDataFrame(counted, "token string, times bigint")
    found = _matches(terms, words, title_index, TITLE, "title").union(_matches(terms, words, url_index, URL, "url"))
    part = lambda s: F.coalesce(F.sum(F.when(F.col("source") == s, F.col("score"))), F.lit(0.0)).alias(f"{s}_score")
    by_url = found.groupBy("url").agg(part("title"), part("url")).withColumn("host", U.strict_host(F.col("url")))
    ranked = by_url.join(ranks.select("host", "rank"), "host", "left")
    return ranked.select("url", "title_score", "url_score", (F.coalesce("rank", F.lit(0.0)) * RANK).alias("rank_score"))


def search(query: str, title_index: DataFrame, url_index: DataFrame, ranks: DataFrame, crawl: DataFrame) -> DataFrame:
    """The results shown: ``url, title, score``, best first.

    Only the best by terms and rank are looked at for their titles; those that
    equal the search string, or begin with it, move up among these.
    """
    base = scores(query, title_index, url_index, ranks).select(
        "url", F.round(F.col("title_score") + F.col("url_score") + F.col("rank_score"), 6).alias("score")
    )
    best = base.orderBy(F.desc("score"), "url").limit(KEPT)
    titles = latest_titles(crawl.join(F.broadcast(best.select("url")), "url", "left_semi"))  # KEPT rows at most
    text = F.coalesce("title", F.col("url"))
    wanted = query.strip().lower()
    boost = F.when(F.lower(text) == wanted, EQUAL).when(F.lower(text).startswith(wanted), PREFIX).otherwise(0.0)
    shown = best.join(titles, "url", "left").select("url", text.alias("title"), F.round(F.col("score") + boost, 6).alias("score"))
    return shown.orderBy(F.desc("score"), "url").limit(SHOWN)


def explained(query: str, title_index: DataFrame, url_index: DataFrame, ranks: DataFrame, crawl: DataFrame) -> DataFrame:
    """Where the scores of the results that are looked at come from: ``url, title_score, url_score, rank_score, title_match``."""
    parts = ("title_score", "url_score", "rank_score")
    base = scores(query, title_index, url_index, ranks).select("url", *(F.round(p, 6).alias(p) for p in parts))
    best = base.orderBy(F.desc(F.round(F.col("title_score") + F.col("url_score") + F.col("rank_score"), 6)), "url").limit(KEPT)
    titles = latest_titles(crawl.join(F.broadcast(best.select("url")), "url", "left_semi"))  # KEPT rows at most
    text, wanted = F.lower(F.coalesce("title", F.col("url"))), query.strip().lower()
    match = F.when(text == wanted, EQUAL).when(text.startswith(wanted), PREFIX).otherwise(0.0)
    return best.join(titles, "url", "left").select("url", *parts, match.alias("title_match"))


SEARCH = "the island and the river"


def _inputs(spark, sf):
    return (table(spark, sf, t) for t in ("pt_title_index", "pt_url_index", "pt_pageranks"))


def search_topk(spark, sf):
    return search(SEARCH, *_inputs(spark, sf), table(spark, sf, "pt_crawl"))


def search_breakdown(spark, sf):
    out = scores(SEARCH, *_inputs(spark, sf))
    return out.select("url", *(F.round(c, 6).alias(c) for c in ("title_score", "url_score", "rank_score")))


def search_explained(spark, sf):
    return explained(SEARCH, *_inputs(spark, sf), table(spark, sf, "pt_crawl"))


_SCORES = """with q as (select token, count(*) as times from (select unnest(['the', 'island', 'and', 'the', 'river']) as token) group by token),
tp as (select distinct token, url from (select token, unnest(urls) as url from pt_title_index) where url is not null and token in (select token from q)),
up as (select distinct token, url from (select token, unnest(urls) as url from pt_url_index) where url is not null and token in (select token from q)),
td as (select token, count(*) as df from tp group by token), ud as (select token, count(*) as df from up group by token),
m as (select url, 1.5::double * ln(30000.0::double / (1.0::double + df)) * times as t, 0.0::double as u from tp join td using (token) join q using (token)
  union all select url, 0.0, 1.0::double * ln(30000.0::double / (1.0::double + df)) * times from up join ud using (token) join q using (token)),
b as (select url, sum(t) as title_score, sum(u) as url_score from m group by url),
s as (select url, title_score, url_score, coalesce(rank, 0.0::double) * 5000.0::double as rank_score
  from b left join pt_pageranks on host = lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)))
"""
QUERIES = {"search_topk": search_topk, "search_explained": search_explained, "search_breakdown": search_breakdown}
SQL = {
    "search_topk": _SCORES
    + """, k as (select url, round(title_score + url_score + rank_score, 6) as score from s order by score desc, url limit 60),
l as (select url, title from (select url, title, row_number() over (partition by url order by fetched_at desc nulls last, crawl_id desc) as rn from pt_crawl where trim(title) <> '') where rn = 1),
f as (select k.url, coalesce(title, k.url) as title, score from k left join l on k.url = l.url)
select url, title, round(score + case when lower(title) = 'the island and the river' then 50.0::double when starts_with(lower(title), 'the island and the river') then 25.0::double else 0.0::double end, 6) as score
from f order by score desc, url limit 50""",
    "search_explained": _SCORES
    + """, r as (select url, round(title_score, 6) as title_score, round(url_score, 6) as url_score, round(rank_score, 6) as rank_score from s),
k as (select * from r order by round(title_score + url_score + rank_score, 6) desc, url limit 60),
l as (select url, title from (select url, title, row_number() over (partition by url order by fetched_at desc nulls last, crawl_id desc) as rn from pt_crawl where trim(title) <> '') where rn = 1)
select k.*, case when lower(coalesce(title, k.url)) = 'the island and the river' then 50.0::double when starts_with(lower(coalesce(title, k.url)), 'the island and the river') then 25.0::double else 0.0::double end as title_match
from k left join l on k.url = l.url""",
    "search_breakdown": _SCORES + "select url, round(title_score, 6) as title_score, round(url_score, 6) as url_score, round(rank_score, 6) as rank_score from s",
}
