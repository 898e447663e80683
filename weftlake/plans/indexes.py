"""Inverted indexes over titles, urls, page bodies, image descriptions and anchor texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators.skew import counted_token, join_by_key
from ..session import cut_lineage, spread
from ..sources.tables import table

#: Postings of one row of an index; a token with more has several parts.
MAX_POSTINGS = 100_000


def postings(rows: DataFrame, tokens: Column, url: str = "url") -> DataFrame:
    """Distinct pairs ``token, url`` of an array of tokens per row."""
    return rows.select(F.explode(tokens).alias("token"), F.col(url).alias("url")).dropna().distinct()


def with_parts(pairs: DataFrame, *order: Column) -> DataFrame:
    """Distinct pairs ``token, url, …`` with ``part``, which cuts a token's urls into parts of bounded size.

    Tokens with few postings have the part 0 only.  The others are cut by
    ranges of ``order`` (by default the url), so that their parts, one after
    the other, are the whole list in that order.  Counts meet the pairs by a
    join that a frequent token cannot hold up.
    """
    pairs = cut_lineage(pairs)  # read several times below
    sizes = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") > MAX_POSTINGS
    crowded = sizes.agg(F.sum(F.when(large, F.col("n")))).first()[0] or 0
    if not crowded:
        return pairs.withColumn("part", F.lit(0).cast("bigint"))
    named = join_by_key(pairs, sizes.select("token", large.alias("_large")), sizes, "token")
    few = named.where("not _large").drop("_large").withColumn("part", F.lit(0).cast("bigint"))
    # ranges are found by sampling, so there are twice as many as would do
    ranges = named.where("_large").drop("_large").repartitionByRange(2 * -(-crowded // MAX_POSTINGS), "token", *(order or (F.col("url"),)))
    placed = cut_lineage(ranges.withColumn("_range", F.spark_partition_id()))
    first = placed.groupBy("token").agg(F.min("_range").alias("_first"), F.count(F.lit(1)).alias("n"))
    many = join_by_key(placed, first.drop("n"), first.drop("_first"), "token")
    return few.unionByName(many.withColumn("part", (F.col("_range") - F.col("_first")).cast("bigint")).drop("_range", "_first"))


def inverted(pairs: DataFrame) -> DataFrame:
    """Index rows ``token, part, urls`` (sorted) of distinct pairs.

    No row and no task holds all postings of a frequent token.
    """
    return with_parts(pairs).groupBy("token", "part").agg(F.array_sort(F.collect_list("url")).alias("urls"))


def document_frequency(pairs: DataFrame) -> DataFrame:
    """``token, df``."""
    return pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def title_pairs(crawl: DataFrame) -> DataFrame:
    """Pairs of title tokens and urls."""
    return postings(crawl.select("url", "title"), T.title_tokens(F.col("title")))


def url_pairs(crawl: DataFrame) -> DataFrame:
    """Pairs of tokens of the url's own path and urls."""
    return postings(crawl.select("url"), T.path_tokens(U.strict_path(F.col("url"))))


def _pages(crawl: DataFrame) -> DataFrame:
    """Urls and pages of a scan, spread over the cores, as reading a page takes long."""
    return spread(crawl.select("url", "page").where("octet_length(page) > 0"))


def page_pairs(crawl: DataFrame) -> DataFrame:
    """Pairs of words of the page body and urls."""
    return postings(_pages(crawl), H.page_tokens(H.page_text(F.col("page"))))


def alt_pairs(crawl: DataFrame) -> DataFrame:
    """Pairs of words of image descriptions and urls."""
    return postings(_pages(crawl), H.alt_tokens(H.page_text(F.col("page"))))


def anchor_positions(crawl: DataFrame) -> DataFrame:
    """``token, url, positions``: where in texts of links to a target a word stands, from 1 on, sorted."""
    found = _pages(crawl).select(F.explode(H.anchors(H.page_text(F.col("page")))).alias("a"))
    words = found.select(F.col("a.target").alias("url"), F.posexplode("a.words").alias("at", "token"))
    return words.groupBy("token", "url").agg(F.array_sort(F.collect_set(F.col("at") + 1)).alias("positions"))


def anchor_index(crawl: DataFrame) -> DataFrame:
    """``token, part, targets``: targets as ``url:positions``, those with most positions first."""
    rows = with_parts(anchor_positions(crawl).withColumn("n", F.size("positions")), F.desc("n"), F.col("url"))
    entry = F.concat_ws(":", "url", F.array_join(F.transform("positions", lambda p: p.cast("string")), " "))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("url").alias("url"), entry.alias("entry"))))
    return rows.groupBy("token", "part").agg(F.array_join(F.transform(listed, lambda e: e["entry"]), ",").alias("targets"))


def _joined(index: DataFrame) -> DataFrame:
    return index.select("token", "part", F.array_join("urls", " ").alias("urls"))


def title_index(spark, sf):
    return _joined(inverted(title_pairs(table(spark, sf, "pt_crawl"))))


def title_index_topdf(spark, sf):
    df = document_frequency(title_pairs(table(spark, sf, "pt_crawl")))
    return df.orderBy(F.desc("df"), "token").limit(50)


def url_index(spark, sf):
    return _joined(inverted(url_pairs(table(spark, sf, "pt_crawl"))))


def page_index(spark, sf):
    return document_frequency(page_pairs(table(spark, sf, "pt_crawl")))


def page_postings(spark, sf):
    return _joined(inverted(page_pairs(table(spark, sf, "pt_crawl"))))


def _with_images(spark, sf) -> DataFrame:
    # the pages hold no images, so one is put before each page, described by its title
    crawl = table(spark, sf, "pt_crawl").where("octet_length(page) > 0 and title is not null")
    image = F.concat(F.lit('<img src="a.png" alt="'), F.replace("title", F.lit('"'), F.lit("")), F.lit('">'), F.col("page").cast("string"))
    return crawl.select("url", F.encode(image, "UTF-8").alias("page"))


def alt_index(spark, sf):
    return _joined(inverted(alt_pairs(_with_images(spark, sf))))


def anchor_index_query(spark, sf):
    return anchor_index(table(spark, sf, "pt_crawl"))


def _stored_pairs(spark, sf) -> DataFrame:
    rows = table(spark, sf, "pt_title_index").select(counted_token().alias("token"), "urls")
    return rows.select("token", F.explode("urls").alias("url")).dropna().distinct()


def stored_index_merged(spark, sf):
    """Numbers of urls in the partial posting lists of the stored index, merged by counted token."""
    return document_frequency(_stored_pairs(spark, sf))


def stored_index_postings(spark, sf):
    """Partial posting lists of the stored index, merged by counted token."""
    return _joined(inverted(_stored_pairs(spark, sf)))


def tokens_with_df(spark, sf):
    """Each posting of the stored url index with its token's frequency, skew-free."""
    pairs = table(spark, sf, "pt_url_index").select("token", F.explode("urls").alias("url")).dropna().distinct()
    df = document_frequency(pairs)
    return join_by_key(pairs, df, df.withColumnRenamed("df", "n"), "token")


_TITLE = r"""
t as (select url, list_distinct(list_filter(string_split_regex(regexp_replace(lower(title), '&[a-z]+;', ' ', 'g'), '[^a-z0-9]+'),
      lambda x: regexp_matches(x, '^[a-z][a-z0-9]*$') and length(x) <= 30)) as tokens from pt_crawl where title is not null),
p as (select distinct token, url from (select url, unnest(tokens) as token from t) where url is not null)
"""
_PATHS = (
    r"""
u as (select url, list_distinct(list_filter(string_split_regex(lower(url_decode(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1))), '[^a-z]+'),
      lambda x: length(x) between 2 and 30 and not list_contains(["""
    + ", ".join(f"'{w}'" for w in T.URL_STOP_WORDS)
    + r"""], x))) as tokens from pt_crawl where url is not null),
p as (select distinct token, url from (select url, unnest(tokens) as token from u))
"""
)
_INDEX = "select token, 0::bigint as part, string_agg(url, ' ' order by url) as urls from p group by token"
_PAGE = r"""
b as (select url, regexp_replace(regexp_replace(decode(page), '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g') as h
      from pt_crawl where octet_length(page) > 0),
x as (select url, h, list_filter(list_transform(
        regexp_extract_all(h, '(?is)<p[^>]*>.*?</p>|<div[^>]*>.*?</div>|<article[^>]*>.*?</article>|<section[^>]*>.*?</section>'),
        lambda s: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?is)^<(p|div|article|section)[^>]*>', ''), '(?is)</(p|div|article|section)>$', ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))),
        lambda s: length(s) > 50) as blocks from b),
y as (select url, case when length(coalesce(array_to_string(blocks, chr(10)), '')) < 80
        then trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) else array_to_string(blocks, chr(10)) end as s from x),
z as (select url, list_distinct(list_filter(string_split_regex(regexp_replace(lower(s), 'https?://\S+', ' ', 'g'), '[^a-z0-9]+'),
        lambda t: regexp_matches(t, '^[a-z]+$') and length(t) <= 30)) as tokens from y),
p as (select distinct token, url from (select url, unnest(tokens) as token from z) where url is not null)
"""
_ALT = (
    r"""
a as (select url, lower(trim(replace(title, '"', ''))) as alt from pt_crawl where octet_length(page) > 0 and title is not null),
t as (select url, list_distinct(list_filter(string_split_regex(alt, '[^a-z]+'), lambda x: x <> '' and length(x) <= 30 and not list_contains([STOP], x))) as tokens
      from a where length(alt) > 3 and not list_contains([STOP], alt) and not regexp_matches(alt, '^[0-9]+$')),
p as (select distinct token, url from (select url, unnest(tokens) as token from t) where url is not null)
""".replace("STOP", ", ".join(f"'{w}'" for w in T.ALT_STOP_WORDS))
)
_ANCHORS = r"""
with l as (select unnest(regexp_extract_all(decode(page), '(?i)<a\s+[^>]*href\s*=\s*"[^"]+"[^>]*>.*?</a>')) as a from pt_crawl where octet_length(page) > 0),
m as (select trim(regexp_extract(a, '(?i)^<a\s+[^>]*href\s*=\s*"([^"]+)"', 1)) as url,
        list_filter(string_split_regex(lower(regexp_replace(regexp_extract(a, '(?i)^<a\s+[^>]*href\s*=\s*"[^"]+"[^>]*>(.*?)</a>$', 1), '(?s)<[^>]*>', ' ', 'g')), '[^a-z0-9]+'),
          lambda t: regexp_matches(t, '^[a-z][a-z0-9]*$') and length(t) <= 30) as w from l),
n as (select distinct url, w[i] as token, i from (select url, w, unnest(range(1, len(w) + 1)) as i from m)),
g as (select token, url, count(*) as c, string_agg(i::varchar, ' ' order by i) as pos from n group by token, url)
select token, 0::bigint as part, string_agg(url || ':' || pos, ',' order by c desc, url) as targets from g group by token
"""
QUERIES = {
    "title_index": title_index,
    "title_index_topdf": title_index_topdf,
    "url_index": url_index,
    "page_index": page_index,
    "page_postings": page_postings,
    "alt_index": alt_index,
    "anchor_index": anchor_index_query,
    "stored_index_merged": stored_index_merged,
    "stored_index_postings": stored_index_postings,
    "tokens_with_df": tokens_with_df,
}
SQL = {
    "title_index": "with " + _TITLE + _INDEX,
    "title_index_topdf": "with " + _TITLE + "select token, count(*)::bigint as df from p group by token order by df desc, token limit 50",
    "url_index": "with " + _PATHS + _INDEX,
    "page_index": "with " + _PAGE + "select token, count(*)::bigint as df from p group by token",
    "page_postings": "with " + _PAGE + _INDEX,
    "alt_index": "with " + _ALT + _INDEX,
    "anchor_index": _ANCHORS,
    "stored_index_merged": r"""
select token, count(distinct url)::bigint as df from (
  select nullif(lower(regexp_replace(token, '^\s+|\s+$', '', 'g')), '') as token, unnest(urls) as url from pt_title_index)
where token is not null and url is not null group by token""",
    "stored_index_postings": r"""
with p as (select distinct * from (
  select nullif(lower(regexp_replace(token, '^\s+|\s+$', '', 'g')), '') as token, unnest(urls) as url from pt_title_index)
  where token is not null and url is not null)
""" + _INDEX,
    "tokens_with_df": """
select token, url, count(*) over (partition by token)::bigint as df
from (select distinct token, url from (select token, unnest(urls) as url from pt_url_index) where token is not null and url is not null)""",
}
