"""Crawls, round by round, as joins of their frontier.

:func:`crawl` follows links between pages given; :class:`Crawler` is the whole
pipeline with robots rules, waits for hosts, statuses, redirects, languages and
rescans, over a web that is a table or the network.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.robots import robots_allow, robots_delay
from ..session import cut_lineage
from ..sources.tables import table

#: Bytes of a page that are read; wait between two fetches of one host where its robots file names none.
MAX_BYTES, DELAY_MS = 500_000, 1000
#: A crawl with fewer rows looks for more in the pages it stored, so many times at most.
MIN_ROWS, RESCANS = 100, 5


def not_fetched(candidates: DataFrame, crawl: DataFrame) -> DataFrame:
    """Urls of ``candidates (url)`` that have no stored page."""
    done = crawl.where("url is not null and octet_length(page) > 0").select("url")
    return candidates.join(done, "url", "left_anti")


def next_frontier(fetched: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct targets of ``fetched (links)`` that were not visited: ``url``."""
    found = fetched.select(F.explode("links").alias("url")).where("url is not null")
    return found.where(~U.has_skipped_ending(F.col("url"))).distinct().join(visited.select("url"), "url", "left_anti")


def crawl(
    seeds: DataFrame, pages: DataFrame, robots: DataFrame | None = None, agent: str = "weftlake", rounds: int | None = None
) -> DataFrame:
    """Visits ``url, round, found`` of a crawl from ``seeds (url)`` over ``pages (url, links)``.

    Every round visits the frontier: urls that robots rules (``host, body``)
    forbid are left out, the others are looked up among the pages, and the
    links of those found make up the next frontier, as far as they were not
    visited.  It ends with an empty frontier; a crawl that has not ended after
    ``rounds`` rounds, where a number is given, fails.  Rounds are joins and
    end in a checkpoint.
    """
    allow = robots_allow(agent)
    frontier = seeds.select("url").where("url is not null").distinct()
    visited = None
    for step in count():
        if step == rounds:
            raise RuntimeError(f"the crawl has not ended after {rounds} rounds")
        if robots is not None:
            with_host = frontier.withColumn("host", U.host(F.col("url"))).join(robots, "host", "left")
            frontier = with_host.where(allow("body", U.url_parts(F.col("url"))["path"])).select("url")
        looked = frontier.join(pages.select("url", "links"), "url", "left")
        round_ = cut_lineage(looked.select("url", F.lit(step).alias("round"), F.col("links").isNotNull().alias("found"), "links"))
        seen = round_.drop("links")
        visited = seen if visited is None else cut_lineage(visited.union(seen))
        frontier = cut_lineage(next_frontier(round_.where("links is not null"), visited))
        if frontier.isEmpty():
            return visited


def politeness(fetches: DataFrame, delay_ms: int = 1000) -> DataFrame:
    """``fetches (host, url, at)`` with ``wait_ms``: how long each has to wait for its host's delay.

    The first fetch of a host does not wait; each later one waits until the
    delay after the one before it in order of time.  Fetches are compared
    within a host's day, days by their last fetch, so that a host with very
    many fetches is spread over tasks.
    """
    rows = fetches.withColumn("_ms", F.unix_millis(F.col("at").cast("timestamp"))).withColumn("_day", F.floor(F.col("_ms") / 86_400_000))
    days = rows.groupBy("host", "_day").agg(F.max("_ms").alias("_last"))
    earlier = days.select("host", "_day", F.lag("_last").over(Window.partitionBy("host").orderBy("_day")).alias("_before"))
    within = F.lag("_ms").over(Window.partitionBy("host", "_day").orderBy("_ms", "url"))
    last = F.coalesce(F.col("_within"), F.col("_before"))
    joined = rows.withColumn("_within", within).join(earlier, ["host", "_day"])
    wait = F.coalesce(F.greatest(F.lit(0), delay_ms - (F.col("_ms") - last)), F.lit(0)).cast("bigint")
    return joined.withColumn("wait_ms", wait).drop("_ms", "_day", "_within", "_before")


def stored_links(pages: DataFrame) -> DataFrame:
    """``url, target``: where the links of ``pages (url, page)`` lead, in normal form; each target once a page.

    Images and texts are left out, and so is what is no web page or a
    Wikipedia in another language.
    """
    hrefs = pages.where("octet_length(page) > 0").select("url", F.explode(H.links(H.page_text(F.col("page")))).alias("href"))
    # explode keeps the filters below from working each target out again
    found = hrefs.distinct().select("url", F.explode(F.array(U.resolve(F.col("url"), F.col("href")))).alias("target")).where("target is not null")
    target = F.col("target")
    return found.where(U.is_crawlable(target) & ~U.has_skipped_ending(target) & ~U.is_foreign_wikipedia(target)).distinct()


def rescan(stored: DataFrame) -> DataFrame:
    """Urls to go on with when a crawl ran dry: ``url``.

    Links of all pages ``stored (url, page)``, without what rescans skip and
    without pages that are stored; urls tried without success come again.
    """
    found = stored_links(stored).where(~U.is_blocked(F.col("target"))).select(F.col("target").alias("url")).distinct()
    return not_fetched(found, stored)


def from_table(web: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetcher that answers from ``web (url, responsecode, contenttype, length, page, location)``; others do not answer."""
    return lambda urls: urls.join(web.select("url", "responsecode", "contenttype", "length", "page", "location"), "url")


class Crawler:
    """A crawl with all its rules.

    ``fetch`` maps a table of ``url`` to one of the answers ``url,
    responsecode, contenttype, length, page, location``, such as
    :func:`from_table` or :func:`weftlake.sources.web.fetch_pages`; a url
    without an answer leaves no row.  ``robots (host, body)`` are the hosts'
    robots files.  A round takes ``round_ms``; in it a host is asked as often
    as its delay allows, and not before that delay has gone by since it was
    asked last; what has to wait is put back into the frontier.  ``clock``
    gives the milliseconds of each round.

    State is three tables, each written anew or added to in every round:
    answers, hosts with the time they were last asked, and the frontier.
    """

    def __init__(
        self, fetch: Callable[[DataFrame], DataFrame], robots: DataFrame | None = None, agent: str = "weftlake",
        round_ms: int = 60_000, clock: Callable[[], int] | None = None, min_rows: int = MIN_ROWS, rescans: int = RESCANS,
    ) -> None:
        self.fetch, self.robots, self.agent = fetch, robots, agent
        self.round_ms, self.min_rows, self.rescans = round_ms, min_rows, rescans
        self.clock = clock or (lambda: int(time.time() * 1000))

    def _allowed(self, frontier: DataFrame) -> DataFrame:
        """``url, host, delay`` of the urls that robots rules allow."""
        named = frontier.withColumn("host", U.host(F.col("url")))
        if self.robots is None:
            return named.withColumn("delay", F.lit(DELAY_MS).cast("bigint"))
        rules = named.join(self.robots.select("host", "body"), "host", "left")
        allow, delay = robots_allow(self.agent), robots_delay(self.agent)
        asked = rules.where(allow("body", U.url_parts(F.col("url"))["path"])).withColumn("_delay", delay("body"))
        return asked.select("url", "host", F.when(F.col("_delay") >= 0, F.col("_delay")).otherwise(DELAY_MS).alias("delay"))

    def _turn(self, frontier: DataFrame, hosts: DataFrame | None, now: int) -> DataFrame:
        """``url, host, goes``: whether it is a url's turn in this round.

        Of a host the first urls by name go, as many as fit into a round.
        """
        rows = self._allowed(frontier)
        if hosts is not None:
            rows = rows.join(hosts, "host", "left").withColumn("rests", F.coalesce(F.lit(now) - F.col("last") < F.col("delay"), F.lit(False)))
        else:
            rows = rows.withColumn("rests", F.lit(False))
        slots = F.greatest(F.lit(1), F.floor(F.lit(self.round_ms) / F.greatest(F.col("delay"), F.lit(1))))
        place = F.row_number().over(Window.partitionBy("host").orderBy("url"))
        # the fixed bound lets every task cut a host's urls down before they are brought together
        first = rows.where("not rests").withColumn("place", place).where(F.col("place") <= max(1, self.round_ms)).where(F.col("place") <= slots)
        return rows.join(first.select("url", F.lit(True).alias("goes")), "url", "left").select("url", "host", F.coalesce("goes", F.lit(False)).alias("goes"))

    def _answers(self, urls: DataFrame) -> DataFrame:
        """Rows of :data:`SCHEMA` and where a redirect leads: ``next``."""
        answer = self.fetch(urls)
        kind = U.base_mime(F.col("contenttype"))
        body = F.substring(F.col("page"), 1, MAX_BYTES)
        english = (F.col("responsecode") == 200) & (kind == "text/html") & H.is_english(H.page_text(body))
        page = F.when(F.coalesce(english, F.lit(False)), body)
        title = H.title(H.page_text(page))
        leads = F.when(U.is_redirect(F.col("responsecode")), U.resolve(F.col("url"), F.col("location")))
        return answer.select(
            "url", "responsecode", kind.alias("contenttype"), "length", page.alias("page"), F.when(title != "", title).alias("title"), leads.alias("next")
        )

    def run(self, seeds: DataFrame) -> DataFrame:
        """All rows of a crawl from ``seeds (url)``: ``url, responsecode, contenttype, length, page, title, round``.

        Seeds are taken in normal form; what is no web page is left out.  It
        ends when the frontier is empty and a rescan, made while there are few
        rows, finds nothing more.  A url is asked once, and once more for each
        rescan that comes upon it while it has no page; its last row counts.
        """
        frontier = seeds.where("url is not null").select(U.normal_url(F.trim("url")).alias("url"))
        frontier = cut_lineage(frontier.where(U.is_crawlable(F.col("url"))).distinct())
        stored: DataFrame | None = None
        hosts: DataFrame | None = None
        rescans = 0
        for step in count():
            if frontier.isEmpty():
                if stored is None or rescans >= self.rescans or stored.count() >= self.min_rows:
                    break
                rescans += 1
                frontier = cut_lineage(rescan(stored))
                if frontier.isEmpty():
                    break
            now = self.clock()
            turn = cut_lineage(self._turn(frontier.where(~U.is_foreign_wikipedia(F.col("url"))), hosts, now))
            going = turn.where("goes").select("url")
            if going.isEmpty():  # all hosts rest
                frontier = turn.select("url")
                continue
            asked = turn.where("goes").select("host").distinct().withColumn("last", F.lit(now).cast("bigint"))
            hosts = cut_lineage(asked if hosts is None else hosts.join(asked, "host", "left_anti").union(asked))
            answers = cut_lineage(self._answers(going).withColumn("round", F.lit(step)))
            rows = answers.drop("next")
            kept = rows if stored is None else stored.join(going, "url", "left_anti").unionByName(rows)
            stored = cut_lineage(kept)
            led = answers.where("next is not null").select(F.col("next").alias("url"))
            led = led.where(U.is_crawlable(F.col("url")) & ~U.has_skipped_ending(F.col("url")))
            found = led.union(stored_links(answers).select(F.col("target").alias("url"))).distinct()
            waiting = turn.where(~F.col("goes")).select("url")
            unseen = found.join(stored.select("url"), "url", "left_anti").join(going, "url", "left_anti")
            frontier = cut_lineage(unseen.union(waiting).distinct())
        if stored is not None:
            return stored
        return self._answers(frontier).drop("next").withColumn("round", F.lit(0)).limit(0)


def _parts_graph(spark, sf):
    lines = table(spark, sf, "lineitem")
    from_supplier = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("url"), F.concat(F.lit("p"), "l_partkey").alias("to"))
    from_part = lines.where("l_returnflag = 'R'").select(F.concat(F.lit("p"), "l_partkey").alias("url"), F.concat(F.lit("s"), "l_suppkey").alias("to"))
    return from_supplier.union(from_part).distinct()


def crawl_bfs(spark, sf):
    edges = _parts_graph(spark, sf)
    pages = cut_lineage(edges.groupBy("url").agg(F.collect_list("to").alias("links")))
    seeds = spark.createDataFrame([("s1",)], "url string")
    return crawl(seeds, pages).select("url", "round", "found")


def crawl_frontier_round(spark, sf):
    edges = _parts_graph(spark, sf)
    pages = edges.groupBy("url").agg(F.collect_list("to").alias("links"))
    seeds = spark.createDataFrame([("s1",), ("s2",)], "url string")
    return next_frontier(pages.join(seeds, "url", "left_semi"), seeds)


def crawl_pending(spark, sf):
    listed = table(spark, sf, "pt_url_index").select(F.explode("urls").alias("url")).where("url is not null").distinct()
    return not_fetched(listed, table(spark, sf, "pt_crawl"))


def crawl_waits(spark, sf):
    c = table(spark, sf, "pt_crawl").where("url is not null and fetched_at is not null")
    return politeness(c.select(U.host(F.col("url")).alias("host"), F.concat_ws(" ", "url", "crawl_id").alias("url"), F.col("fetched_at").alias("at")), 3_600_000).select("host", "url", "wait_ms")


def _trade_web(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A web of suppliers and parts, and its robots files.

    Supplier pages link to their parts, pages of returned parts to suppliers;
    some parts lead elsewhere, are gone or no pages, some suppliers write
    German, and one host wants no visits.
    """
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    part_url = F.concat(F.lit("http://P"), F.col("l_partkey") % 50, F.lit(".example/"), F.col("l_partkey"))
    to_parts = lines.select("l_suppkey", F.concat(F.lit("<a href='"), part_url, F.lit("#x'>p</a>")).alias("a")).distinct()
    supplier = to_parts.groupBy(F.col("l_suppkey").alias("k")).agg(F.array_join(F.collect_list("a"), "").alias("body"))
    lang = F.when(F.col("k") % 7 == 0, "de").otherwise("en")
    head = lambda name: F.concat(F.lit("<html lang='"), lang, F.lit("'><title>"), name, F.lit("</title>"))
    html = lambda c: F.encode(c, "utf-8")
    text, none = F.lit("Text/HTML; charset=utf-8"), F.lit(None).cast("string")
    pages = supplier.select(
        F.concat(F.lit("http://s"), "k", F.lit(".example:80/")).alias("url"), F.lit(200).alias("responsecode"), text.alias("contenttype"),
        F.lit(None).cast("int").alias("length"), html(F.concat(head(F.concat(F.lit("Supplier "), "k")), "body")).alias("page"), none.alias("location"),
    )
    back = lines.where("l_returnflag = 'R'").select("l_partkey", F.concat(F.lit('<a href="//s'), "l_suppkey", F.lit('.example">s</a>')).alias("a")).distinct()
    returned = back.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_join(F.collect_list("a"), "").alias("body"))
    parts = table(spark, sf, "part").join(returned, "p_partkey", "left").withColumn("k", F.lit(1)).withColumn("kind", F.col("p_partkey") % 10)
    code = F.when(F.col("kind") == 3, 301).when(F.col("kind") == 4, 404).otherwise(200)
    more = parts.select(
        F.concat(F.lit("http://p"), F.col("p_partkey") % 50, F.lit(".example:80/"), "p_partkey").alias("url"), code.alias("responsecode"),
        F.when(F.col("kind") == 5, "application/pdf").otherwise(text).alias("contenttype"), F.lit(None).cast("int").alias("length"),
        F.when(code == 200, html(F.concat(head(F.col("p_name")), F.coalesce("body", F.lit(""))))).alias("page"),
        F.when(code == 301, F.concat(F.lit("/"), F.col("p_partkey") + 50)).alias("location"),
    )
    rules = spark.createDataFrame([("p7.example", "User-agent: *\nDisallow: /\nCrawl-delay: 2"), ("p8.example", "Crawl-delay: 5")], "host string, body string")
    return pages.union(more), rules


def crawl_full(spark, sf):
    web, rules = _trade_web(spark, sf)
    crawler = Crawler(from_table(cut_lineage(web)), rules, round_ms=60_000_000, clock=count(0, 60_000_000).__next__)
    rows = crawler.run(spark.createDataFrame([("HTTP://S1.example",), ("ftp://s2.example/",)], "url string"))
    return rows.select("url", "responsecode", "contenttype", F.col("page").isNotNull().alias("has_page"), "title")


def crawl_rescan(spark, sf):
    return rescan(table(spark, sf, "pt_crawl"))


_E = """e as (select distinct * from (select 's' || l_suppkey as url, 'p' || l_partkey as target from lineitem
  union all select 'p' || l_partkey, 's' || l_suppkey from lineitem where l_returnflag = 'R'))"""
QUERIES = {f.__name__: f for f in (crawl_bfs, crawl_frontier_round, crawl_pending, crawl_waits, crawl_full, crawl_rescan)}
SQL = {
    "crawl_bfs": "with recursive " + _E + """,
v as (select 's1' as url, 0 as round union select target, round + 1 from v join e using (url) where round < 5)
select url, min(round)::int as round, url in (select url from e) as found from v group by url""",
    "crawl_frontier_round": "with " + _E + " select distinct target as url from e where url in ('s1', 's2') and target not in ('s1', 's2')",
    "crawl_full": """with recursive sup as (select distinct l_suppkey as s, l_partkey as p from lineitem),
ret as (select distinct l_partkey as p, l_suppkey as s from lineitem where l_returnflag = 'R'),
edge as (select 's' || s as a, 'p' || p as b from sup where s % 7 <> 0
  union all select 'p' || p, 's' || s from ret join part on p_partkey = p where p % 10 not in (3, 4, 5)
  union all select 'p' || p_partkey, 'p' || (p_partkey + 50) from part where p_partkey % 10 = 3),
v as (select 's1' as n union select b from v join edge on a = n where not (b[1] = 'p' and b[2:]::bigint % 50 = 7))
select 'http://p' || (p_partkey % 50) || '.example:80/' || p_partkey as url, case p_partkey % 10 when 3 then 301 when 4 then 404 else 200 end::int as responsecode,
  case p_partkey % 10 when 5 then 'application/pdf' else 'text/html' end as contenttype, p_partkey % 10 not in (3, 4, 5) as has_page,
  case when p_partkey % 10 not in (3, 4, 5) then p_name end as title from part where 'p' || p_partkey in (select n from v)
union all select 'http://s' || s || '.example:80/', 200::int, 'text/html', s % 7 <> 0, case when s % 7 <> 0 then 'Supplier ' || s end
  from (select distinct s from sup) where 's' || s in (select n from v)""",
    "crawl_rescan": r"""with p as (select url, decode(page) as h from pt_crawl where octet_length(page) > 0 and url is not null),
t as (select url, unnest(regexp_extract_all(h, '(?is)<\s*a\b[^>]*>')) as t from p),
r as (select url, regexp_extract(t, '(?is)href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1) as raw from t),
x as (select url, case when left(raw, 1) in ('"', '''') then substr(raw, 2, length(raw) - 2) else raw end as href from r where raw <> ''),
y as (select distinct lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[^:]*://([^/:]*)', 1)) as host,
  regexp_extract(url, '^[^:]*://[^/:]*:([0-9]+)', 1) as port, regexp_replace(href, '(?s)#.*$', '') as path from x where starts_with(href, '/')),
z as (select scheme || '://' || host || ':' || case when port <> '' then port when scheme = 'https' then '443' else '80' end || path as url, host from y)
select distinct url from z where url not in (select url from pt_crawl where url is not null and octet_length(page) > 0)""",
    "crawl_pending": """select distinct url from (select unnest(urls) as url from pt_url_index) where url is not null
  and url not in (select url from pt_crawl where url is not null and octet_length(page) > 0)""",
    "crawl_waits": r"""with p as (select lower(regexp_replace(regexp_extract(url, '(?s)^.*?.//([^/]*)', 1), ':.*$', '')) as host, url || ' ' || crawl_id as url, epoch_ms(fetched_at) as ms
  from pt_crawl where url is not null and fetched_at is not null)
select host, url, coalesce(greatest(0, 3600000 - (ms - lag(ms) over (partition by host order by ms, url))), 0)::bigint as wait_ms from p""",
}
