"""Reports on the quality of a crawl, over all of its rows or a systematic sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..operators.dataset import systematic_sample
from ..sources.tables import table

#: Hosts of the report's list, and those whose share of all rows is told.
LISTED, SHARED = 20, 10
SIZES = ((1_000, "tiny"), (10_000, "small"), (100_000, "medium"), (500_000, "large"))


def sampled(crawl: DataFrame, size: int) -> DataFrame:
    """Rows that the reports look at: ``size`` of them in order of the key, or all."""
    return systematic_sample(crawl, "crawl_id", size)


def percent(part, whole):
    """Share in percent, 0 where there is no whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def _shares(rows: DataFrame, key) -> DataFrame:
    counts = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counts.where("key is not null").select("key", "n", F.round(percent(F.col("n"), total), 6).alias("percent"))


def hosts(rows: DataFrame) -> DataFrame:
    """Hosts of most rows: ``key, n, percent``."""
    return _shares(rows, U.host(F.col("url"))).orderBy(F.desc("n"), "key").limit(LISTED)


def host_concentration(rows: DataFrame) -> DataFrame:
    """Number of hosts, share of the largest ones, and what that means."""
    all_hosts = _shares(rows, U.host(F.col("url")))
    top = all_hosts.orderBy(F.desc("n"), "key").limit(SHARED).agg(F.sum("percent").alias("top_percent"))
    n = all_hosts.agg(F.count(F.lit(1))).scalar()
    share = F.coalesce("top_percent", F.lit(0.0))
    verdict = F.when(share > 80, "concentrated").when(share > 60, "somewhat concentrated").otherwise("spread")
    return top.select(n.alias("hosts"), F.round(share, 4).alias("top_percent"), verdict.alias("verdict"))


def codes(rows: DataFrame) -> DataFrame:
    """Status codes, the most frequent first: ``key, n, percent``."""
    return _shares(rows, F.col("responsecode").cast("string")).orderBy(F.desc("n"), "key")


def types(rows: DataFrame) -> DataFrame:
    """Content types without parameters, the most frequent first: ``key, n, percent``."""
    return _shares(rows, U.base_mime(F.col("contenttype"))).orderBy(F.desc("n"), "key")


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The middle of a column of ints in order, of two the upper: one row ``median``, null without values.

    Values are counted by stretches of 4,096, of which the type allows a
    million; only those of the stretch that holds the middle are then ranked.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("median"), F.shiftright(value, 12).alias("_to"))
    counts = known.groupBy("_to").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_to")) - F.col("n")
    middle = counts.agg(F.floor(F.sum("n") / 2)).scalar()
    hit = counts.withColumn("_before", before).where((F.col("_before") <= middle) & (F.col("_before") + F.col("n") > middle)).first()
    if hit is None:
        return known.agg(F.max("median").alias("median"))
    near = known.where(F.col("_to") == hit["_to"]).groupBy("median").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("median")) + hit["_before"]
    return near.withColumn("_upto", upto).where(F.col("_upto") > middle).agg(F.min("median").alias("median"))


def sizes(rows: DataFrame) -> DataFrame:
    """Count, least, greatest, average, upper median and classes of known page sizes."""
    known = rows.select(F.col("length").try_cast("int").alias("length")).where("length is not null")
    classes, low = [], None
    for limit, name in SIZES:
        cond = F.col("length") < limit if low is None else (F.col("length") >= low) & (F.col("length") < limit)
        classes.append(F.count_if(cond).alias(name))
        low = limit
    classes.append(F.count_if(F.col("length") >= low).alias("huge"))
    return known.agg(
        F.count(F.lit(1)).alias("n"), F.min("length").alias("least"), F.max("length").alias("greatest"), F.round(F.avg("length"), 4).alias("average"),
        *classes,
    ).select("*", upper_median(known, "length").scalar().alias("median"))


def language(rows: DataFrame) -> DataFrame:
    """Pages by what their html tag declares."""
    pages = rows.where("octet_length(page) > 0").select(H.language_class(H.page_text(F.col("page"))).alias("class"))
    n = F.count(F.lit(1))
    of = lambda c: F.count_if(F.col("class") == c)
    share = lambda c: F.round(percent(of(c), F.greatest(n, F.lit(1))), 4)
    return pages.agg(
        n.alias("pages"), of("en").alias("english"), of("other").alias("other"), of("none").alias("undeclared"), share("en").alias("english_percent")
    )


def diversity(rows: DataFrame) -> DataFrame:
    """Distinct hosts and top domains."""
    found = rows.select(U.host(F.col("url")).alias("host")).where("host is not null").distinct()
    return found.agg(F.count("host").alias("hosts"), F.count_distinct(U.top_domain(F.col("host"))).alias("domains"))


def patterns(rows: DataFrame) -> DataFrame:
    """Urls with deep paths, queries, fragments and great length."""
    flags = rows.where("url is not null").select(F.inline(F.array(U.url_flags(F.col("url")))))
    return flags.agg(*(F.count_if(F.col(c)).alias(c) for c in ("deep", "query", "fragment", "long")))


def content(rows: DataFrame) -> DataFrame:
    """Rows with title and content, short and reasonable content, and the score made of them."""
    size = F.coalesce(F.octet_length("page"), F.lit(0))
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("title") != "").alias("with_title"), F.count_if(size > 0).alias("with_content"),
        F.count_if(size == 0).alias("empty"), F.count_if((size > 0) & (size < 100)).alias("very_short"),
        F.count_if(size.between(100, 50_000)).alias("reasonable"),
    )
    score = F.col("with_title") * 0.3 + F.col("with_content") * 0.5 + F.col("reasonable") * 0.2
    return counts.withColumn("score", F.round(percent(score, F.greatest("n", F.lit(1))), 4))


def _report(f):
    def query(spark, sf):
        return f(table(spark, sf, "pt_crawl"))

    return query


def quality_sampled_content(spark, sf):
    return content(sampled(table(spark, sf, "pt_crawl"), 500))


_HOST = r"lower(case when strpos(auth, ':') > 1 then left(auth, strpos(auth, ':') - 1) else auth end)"
_H = rf"""h as (select {_HOST} as key from (select regexp_extract(url, '(?s)^.*?.//([^/]*)', 1) as auth from pt_crawl where regexp_matches(url, '(?s)^.+?//')))"""
_SHARE = "select key, count(*)::bigint as n, round(count(*) * 100.0::double / (select count(*) from pt_crawl), 6) as percent from {} where key is not null group by key"
_CONTENT = """select count(*)::bigint as n, count(*) filter (title <> '')::bigint as with_title, count(*) filter (s > 0)::bigint as with_content,
  count(*) filter (s = 0)::bigint as empty, count(*) filter (s > 0 and s < 100)::bigint as very_short, count(*) filter (s between 100 and 50000)::bigint as reasonable,
  round((count(*) filter (title <> '') * 0.3::double + count(*) filter (s > 0) * 0.5::double + count(*) filter (s between 100 and 50000) * 0.2::double) * 100.0::double / count(*), 4) as score
from (select title, coalesce(octet_length(page), 0) as s from {})"""
QUERIES = {
    "quality_hosts": _report(hosts),
    "quality_concentration": _report(host_concentration),
    "quality_codes": _report(codes),
    "quality_types": _report(types),
    "quality_sizes": _report(sizes),
    "quality_language": _report(language),
    "quality_diversity": _report(diversity),
    "quality_patterns": _report(patterns),
    "quality_content": _report(content),
    "quality_sampled_content": quality_sampled_content,
}
SQL = {
    "quality_hosts": f"with {_H} " + _SHARE.format("h") + " order by n desc, key limit 20",
    "quality_concentration": f"with {_H}, s as ({_SHARE.format('h')}), t as (select sum(percent) as p from (select percent from s order by n desc, key limit 10)) "
    "select (select count(*) from s)::bigint as hosts, round(p, 4) as top_percent, case when p > 80 then 'concentrated' when p > 60 then 'somewhat concentrated' else 'spread' end as verdict from t",
    "quality_codes": _SHARE.format("(select responsecode::varchar as key from pt_crawl)"),
    "quality_types": _SHARE.format("(select lower(trim(split_part(contenttype, ';', 1))) as key from pt_crawl)"),
    "quality_sizes": """with k as (select length from pt_crawl where length is not null), r as (select length, row_number() over (order by length) as i, count(*) over () as n from k)
select count(*)::bigint as n, min(length) as least, max(length) as greatest, round(avg(length), 4) as average, count(*) filter (length < 1000)::bigint as tiny,
  count(*) filter (length >= 1000 and length < 10000)::bigint as small, count(*) filter (length >= 10000 and length < 100000)::bigint as medium,
  count(*) filter (length >= 100000 and length < 500000)::bigint as large, count(*) filter (length >= 500000)::bigint as huge,
  (select length from r where i = n // 2 + 1) as median from k""",
    "quality_language": """with c as (select case when contains(h, '<html lang="en">') or contains(h, '<html lang=''en''>') then 'en' when contains(h, '<html lang=') then 'other' else 'none' end as c
  from (select lower(decode(page)) as h from pt_crawl where octet_length(page) > 0))
select count(*)::bigint as pages, count(*) filter (c = 'en')::bigint as english, count(*) filter (c = 'other')::bigint as other, count(*) filter (c = 'none')::bigint as undeclared,
  round(count(*) filter (c = 'en') * 100.0::double / greatest(count(*), 1), 4) as english_percent from c""",
    "quality_diversity": f"with {_H} select count(distinct key)::bigint as hosts, count(distinct regexp_extract(rtrim(key, '.'), '([^.]*)$', 1))::bigint as domains from h",
    "quality_patterns": r"""with p as (select url, case when regexp_matches(url, '(?s)^.+?//') then coalesce(nullif(regexp_extract(url, '(?s)^.*?.//[^/]*(/.*)$', 1), ''), '/') else url end as path
  from pt_crawl where url is not null)
select count(*) filter (len(string_split(rtrim(path, '/'), '/')) > 5)::bigint as deep, count(*) filter (contains(url, '?'))::bigint as query,
  count(*) filter (contains(url, '#'))::bigint as fragment, count(*) filter (length(url) > 200)::bigint as long from p""",
    "quality_content": _CONTENT.format("pt_crawl"),
    "quality_sampled_content": """with t as (select greatest(1, count(*) // 500) as step, count(*) as total from pt_crawl),
r as (select title, page, row_number() over (order by crawl_id) - 1 as i from pt_crawl) """
    + _CONTENT.format("(select title, page from r, t where total <= 500 or (i % step = 0 and i < step * 500))"),
}
