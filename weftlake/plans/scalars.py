"""Queries over the scalar functions: keys, urls, HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, robots
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..sources.tables import table


def _url():
    return F.col("url")


def _html():
    return H.page_text(F.col("page"))


def _urls(spark, sf):
    return table(spark, sf, "pt_crawl").select("url").where("url is not null").distinct()


def _pages(spark, sf, *more):
    return table(spark, sf, "pt_crawl").where("octet_length(page) > 0").select("crawl_id", *more, "page")


def hash_key(spark, sf):
    return _urls(spark, sf).select("url", hashing.hash_key(_url()).alias("key"))


def url_parse(spark, sf):
    return _urls(spark, sf).select("url", F.inline(F.array(U.url_parts(_url()))))


def url_host(spark, sf):
    return _urls(spark, sf).select("url", U.strict_host(_url()).alias("host"), U.strict_path(_url()).alias("path"))


def url_normalize(spark, sf):
    return _urls(spark, sf).select("url", U.normal_url(_url()).alias("normal"))


def url_filters(spark, sf):
    return _urls(spark, sf).select(
        "url", U.is_crawlable(_url()).alias("crawlable"), U.has_skipped_ending(_url()).alias("skipped"),
        U.is_foreign_wikipedia(_url()).alias("foreign_wiki"), U.is_blocked(_url()).alias("blocked"),
        U.top_domain(U.host(_url())).alias("tld"),
    )


def url_patterns(spark, sf):
    return _urls(spark, sf).select("url", F.inline(F.array(U.url_flags(_url()))))


def url_resolved(spark, sf):
    links = _pages(spark, sf, "url").where("url is not null").select("url", F.explode(H.links(_html())).alias("href")).distinct()
    return links.select("url", "href", U.resolve(F.col("url"), F.col("href")).alias("target"))


def html_title(spark, sf):
    return _pages(spark, sf).select("crawl_id", H.title(_html()).alias("title"))


def html_links(spark, sf):
    return _pages(spark, sf).select("crawl_id", F.posexplode(H.links(_html())).alias("pos", "href"))


def html_site_links(spark, sf):
    pages = _pages(spark, sf, "url").where("url is not null")
    found = pages.select("crawl_id", "url", F.explode(H.graph_hrefs(_html())).alias("href"))
    return found.select("crawl_id", U.site_link(F.col("href"), _url()).alias("target")).where("target is not null").distinct()


def html_lang(spark, sf):
    return _pages(spark, sf).select("crawl_id", H.is_english(_html()).alias("english"), H.language_class(_html()).alias("class"))


def response_kinds(spark, sf):
    crawl = table(spark, sf, "pt_crawl")
    return crawl.groupBy(U.is_redirect(F.col("responsecode")).alias("redirect"), U.base_mime(F.col("contenttype")).alias("mime")).agg(
        F.count(F.lit(1)).alias("n")
    )


def host_kinds(spark, sf):
    hosts = table(spark, sf, "pt_pageranks").select("host")
    made = hosts.select(F.explode(F.array("host", F.lit("en.wikipedia.org"), F.lit("x.com"), F.lit("www.reddit.com"))).alias("host"))
    h = F.col("host")
    return made.where("host is not null").groupBy(U.is_wiki_family(h).alias("wiki"), U.is_social(h).alias("social")).agg(F.count(F.lit(1)).alias("n"))


def titles_cut(spark, sf):
    crawl = table(spark, sf, "pt_crawl").where("title is not null")
    return crawl.select("crawl_id", T.truncated(F.col("title"), 20).alias("short"))


def lengths_parsed(spark, sf):
    orders = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), F.col("o_orderkey"))).otherwise(F.col("o_orderkey").cast("string"))
    return orders.select("o_orderkey", T.number(text, "bigint", F.lit(-1)).alias("parsed"))


ROBOTS = """# rules
User-agent: other
Disallow: /
User-agent: *
Disallow: /wiki # not these
Allow: /index
Disallow: /index.php
Crawl-delay: 0.5
Crawl-delay: 2
"""


def robots_allow(spark, sf):
    paths = _urls(spark, sf).select("url", U.url_parts(_url())["path"].alias("path"))
    allow = robots.robots_allow("weftlake")
    return paths.select("url", allow(F.lit(ROBOTS), "path").alias("allowed"))


_U = "with u as (select distinct url from pt_crawl where url is not null), "
_P = "with p as (select crawl_id, url, decode(page) as h from pt_crawl where octet_length(page) > 0) "
_AUTH = r"""a as (select url, regexp_matches(url, '(?s)^[^/].*?//|^/[^/].*?//') as parted,
  regexp_extract(url, '(?s)^(.*?).//', 1) as s, regexp_extract(url, '(?s)^.*?.//([^/]*)', 1) as auth, regexp_extract(url, '(?s)^.*?.//[^/]*(/.*)$', 1) as rest from u)"""
_PARTS = (
    _AUTH
    + """, parts as (select url, case when parted then s end as scheme,
  case when parted then case when strpos(auth, ':') > 1 then left(auth, strpos(auth, ':') - 1) else auth end end as host,
  case when parted and strpos(auth, ':') > 1 then substr(auth, strpos(auth, ':') + 1) end as port,
  case when parted then case when rest = '' then '/' else rest end else url end as path from a)"""
)
_HREFS = r"""l as (select crawl_id, url, unnest(regexp_extract_all(h, '(?is)<\s*a\b[^>]*>')) as t from p),
r as (select crawl_id, url, regexp_extract(t, '(?is)href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1) as raw from l)"""


def _letters() -> str:
    pairs = ", ".join(f"'{hashing.letter_pair(hashing.pair_index(b))}'" for b in range(256))
    return f"list_element([{pairs}], 1 + ('0x' || substr(sha1(url), 2 * i + 1, 2))::int)"


def _either(parts: list[str]) -> str:
    return U._quoted(parts)


QUERIES = {
    f.__name__: f
    for f in (
        hash_key, url_parse, url_host, url_normalize, url_filters, url_patterns, url_resolved, html_title, html_links,
        html_site_links, html_lang, response_kinds, host_kinds, titles_cut, lengths_parsed, robots_allow,
    )
}
SQL = {
    "hash_key": _U + f"k as (select url, i, {_letters()} as pair from u, range(20) t(i)) select url, string_agg(pair, '' order by i) as key from k group by url",
    "url_parse": _U + _PARTS + " select * from parts",
    "url_host": _U + r"""x as (select url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) as h,
  url_decode(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)) as path from u) select url, nullif(lower(h), '') as host, path from x""",
    "url_normalize": _U + _PARTS + r""" select url, lower(coalesce(nullif(scheme, ''), 'http')) || '://' || coalesce(lower(host), '') || ':' ||
  coalesce(try_cast(port as int)::varchar, case when lower(scheme) = 'https' then '443' else '80' end) ||
  regexp_replace(case when starts_with(path, '/') then path else '/' || path end, '(?s)#.*$', '') as normal from parts""",
    "url_filters": _U + _PARTS + rf""" select url, regexp_matches(url, '(?i)^https?://') as crawlable, regexp_matches(url, '(?i)\.(jpg|jpeg|gif|png|txt)$') as skipped,
  coalesce(contains(lower(host), 'wikipedia.org') and split_part(lower(host), '.', 1) not in ('en', 'www'), false) as foreign_wiki,
  coalesce(coalesce(regexp_matches(lower(host), '{_either(U.HOST_CONTAINS)}') or regexp_matches(lower(host), '(?:{_either(U.HOST_ENDS)})$')
    or (regexp_matches(lower(host), '(?:{_either(U.HOST_ENDS_UNLESS_ENGLISH)})$') and not starts_with(lower(host), 'en.')), false)
    or regexp_matches(lower(url), '(?:{_either(U.URL_ENDS)})$') or contains(lower(url), 'download') or regexp_matches(url, '{_either(U.URL_CONTAINS)}'), true) as blocked,
  regexp_extract(rtrim(lower(host), '.'), '([^.]*)$', 1) as tld from parts""",
    "url_patterns": _U + _PARTS + r""" select url, len(string_split(rtrim(path, '/'), '/')) > 5 as deep, contains(url, '?') as query, contains(url, '#') as fragment, length(url) > 200 as long from parts""",
    "html_title": _P + r"""select crawl_id, case when regexp_matches(h, '(?is)<\s*title\b[^>]*>.*?<\s*/\s*title\s*>') then (
  select case when length(t) > 200 then left(t, 197) || '...' else t end from (select trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_extract(h, '(?is)<\s*title\b[^>]*>(.*?)<\s*/\s*title\s*>', 1), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&[a-zA-Z0-9]+;', ' ', 'g')) as t)) end as title from p""",
    "html_links": _P + ", " + _HREFS + r""", v as (select crawl_id, row_number() over () as rn, raw from r where raw <> '')
select crawl_id, (row_number() over (partition by crawl_id order by rn) - 1)::int as pos, trim(case when left(raw, 1) in ('"', '''') then substr(raw, 2, length(raw) - 2) else raw end) as href from v""",
    "html_site_links": _P + r""", l as (select crawl_id, url, unnest(regexp_extract_all(h, '(?is)<a[^>]*>')) as t from p where url is not null),
r as (select crawl_id, url, regexp_extract(t, '(?is)href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1) as raw from l),
x as (select crawl_id, url, case when left(raw, 1) in ('"', '''') then substr(raw, 2, length(raw) - 2) else raw end as href from r where raw <> ''),
y as (select crawl_id, case when starts_with(href, 'http') then href when starts_with(href, '//') then 'http:' || href
  when starts_with(href, '/') then regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) || '://' || regexp_extract(url, '^[^:]*://([^/?#:]*)', 1) || href end as u from x)
select distinct crawl_id, regexp_replace(u, '(?s)#.*$', '') as target from y where u is not null""",
    "html_lang": _P + r"""select crawl_id, regexp_matches(h, '(?is)<\s*html[^>]*\s+lang\s*=\s*["'']en["'']') as english,
  case when contains(lower(h), '<html lang="en">') or contains(lower(h), '<html lang=''en''>') then 'en' when contains(lower(h), '<html lang=') then 'other' else 'none' end as class from p""",
    "response_kinds": "select responsecode in (301, 302, 303, 307, 308) as redirect, lower(trim(split_part(contenttype, ';', 1))) as mime, count(*)::bigint as n from pt_crawl group by all",
    "host_kinds": r"""with h as (select unnest([host, 'en.wikipedia.org', 'x.com', 'www.reddit.com']) as host from pt_pageranks)
select regexp_matches(host, '\.(wikipedia|wikibooks|wikiquote|wikinews|wikivoyage|wikiversity|wikidata|wikimedia|wiktionary)\.org$') as wiki,
  host = 'x.com' or regexp_matches(host, '^(www\.)?(facebook|instagram|linkedin|pinterest|reddit|tiktok|twitter|youtube)\.com$') as social, count(*)::bigint as n
from h where host is not null group by all""",
    "titles_cut": "select crawl_id, case when length(title) > 20 then left(title, 17) || '...' else title end as short from pt_crawl where title is not null",
    "lengths_parsed": "select o_orderkey, case when o_orderkey % 5 = 0 then -1 else o_orderkey end::bigint as parsed from orders",
    "robots_allow": _U + _PARTS + " select url, case when starts_with(path, '/wiki') then false when starts_with(path, '/index') then true else true end as allowed from parts",
}
