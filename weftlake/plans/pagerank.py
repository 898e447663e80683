"""Ranks of hosts by the links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators.skew import join_by_key
from ..session import cut_lineage
from ..sources.tables import table

#: Share of a rank that links pass on; most rounds; change per host at which rounds end.
DAMPING, ROUNDS, TOLERANCE = 0.85, 20, 1e-4
#: Hosts of the printed ranking; weight of social hosts in it; name of the merged wiki hosts.
LISTED, SOCIAL_WEIGHT, WIKI = 1000, 0.1, "wiki family"
_EXACT = "decimal(38,16)"
#: Link targets that lie in one row.
TARGETS = 10_000


def host_graph(crawl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts with a stored page ``(host)`` and distinct links ``(src, dst)`` between hosts.

    Of one page no more than so many links count; links within a host stay.
    """
    pages = crawl.where("url is not null and octet_length(page) > 0").select(U.strict_host(F.col("url")).alias("src"), "url", "page")
    pages = pages.where("src is not null")
    # the limit counts links that lead somewhere
    targets = F.filter(
        F.transform(H.graph_hrefs(H.page_text(F.col("page"))), lambda h: U.site_link(h, F.col("url"))), lambda t: t.isNotNull()
    )
    links = pages.select("src", F.explode(F.slice(targets, 1, H.MAX_LINKS)).alias("target"))
    edges = links.select("src", U.strict_host(F.col("target")).alias("dst")).where("dst is not null").distinct()
    return pages.select(F.col("src").alias("host")).distinct(), edges


def pagerank(
    hosts: DataFrame, edges: DataFrame, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE, damping: float = DAMPING
) -> DataFrame:
    """``host, rank`` after ``rounds`` rounds, or fewer when ranks hardly change any more.

    Only ``hosts`` count and send; link targets besides them get a rank but
    send nothing.  The ranks of hosts without links are spread over all.  Ranks
    are rounded to 8 digits in each round, and sums are taken in decimals, so
    results do not depend on the order of rows.  Without a tolerance all rounds
    are made.  A round is one join of the ranks with the hosts' links and one
    aggregate, and ends in a checkpoint; the links of a host with very many of
    them lie in several rows, so that no task has them all.
    """
    n = hosts.count()
    if not n:
        return hosts.select("host", F.lit(0.0).alias("rank"))
    links, degree = _adjacency(hosts, edges)
    nodes = hosts.join(degree, hosts.host == degree.src, "left").select("host", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    ranks = cut_lineage(nodes.withColumn("rank", F.lit(1.0 / n)))
    base, none = (1 - damping) / n, F.lit(None).cast("bigint")
    for step in range(rounds):
        lost = ranks.where("n = 0").agg(F.coalesce(F.sum(F.col("rank").cast(_EXACT)), F.lit(0)).cast("double")).scalar()
        part = ranks.where("n > 0").select("host", (F.col("rank") / F.col("n")).cast(_EXACT).alias("part"))
        sent = links.join(part, "host").select(F.explode("targets").alias("host"), none.alias("n"), "part")
        own = ranks.where("n is not null").select("host", "n", F.lit(0).cast(_EXACT).alias("part"))
        got = sent.union(own).groupBy("host").agg(F.max("n").alias("n"), F.sum("part").cast("double").alias("got"))
        new = cut_lineage(got.select("host", "n", F.round(F.lit(base) + F.lit(damping) * (F.col("got") + lost / n), 8).alias("rank")))
        if tolerance is not None and step:
            old = ranks.select("host", F.col("rank").alias("old"))
            change = new.join(old, "host").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
            ranks = new
            if change < tolerance * n:
                break
        ranks = new
    return ranks.select("host", "rank")


def _adjacency(hosts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host, targets``: the link targets of each host in rows of about TARGETS; and ``src, n``, how many each has."""
    edges = cut_lineage(edges.join(hosts.select(F.col("host").alias("src")), "src", "left_semi"))
    degree = cut_lineage(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
    rows = join_by_key(edges, degree, degree, "src").withColumn("row", F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / TARGETS)))
    listed = rows.groupBy(F.col("src").alias("host"), "row").agg(F.collect_list("dst").alias("targets"))
    return cut_lineage(listed.select("host", "targets")), degree


def ranking(ranks: DataFrame) -> DataFrame:
    """The printed ranking ``place, host, rank``: social hosts weigh little, wiki hosts are one."""
    host = F.lower("host")
    weighed = ranks.where("rank is not null").select(
        F.when(U.is_wiki_family(host), WIKI).otherwise(host).alias("host"),
        (F.col("rank") * F.when(U.is_social(host), SOCIAL_WEIGHT).otherwise(1.0)).cast(_EXACT).alias("rank"),
    )
    listed = weighed.groupBy("host").agg(F.round(F.sum("rank").cast("double"), 8).alias("rank"))
    top = listed.orderBy(F.desc("rank"), "host").limit(LISTED)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), F.col("host").alias("h"))))
    return top.agg(rows.alias("all")).select(F.posexplode("all").alias("i", "x")).select(
        (F.col("i") + 1).cast("bigint").alias("place"), F.col("x.h").alias("host"), (-F.col("x.r")).alias("rank")
    )


def pagerank_lines(spark, sf):
    """The ranking as it is printed: the place, the host in a column of its own, the rank with eight digits."""
    line = F.concat(T.padded(F.concat("place", F.lit(".")), 6), T.padded(F.col("host"), 50), T.fixed(F.col("rank"), 8))
    return pagerank_report(spark, sf).select("place", line.alias("line"))


def _trade(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers, linked to the suppliers of their orders and to whoever ordered next."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    buys = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")
    )
    later = orders.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("o_custkey").alias("before"))
    follows = later.join(orders, "o_orderkey").select(
        F.concat(F.lit("c"), "before").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst")
    )
    hosts = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("host"))
    return hosts, buys.union(follows).distinct()


def pagerank_k5(spark, sf):
    return pagerank(*_trade(spark, sf), rounds=5, tolerance=None)


def pagerank_hosts(spark, sf):
    return pagerank(*host_graph(table(spark, sf, "pt_crawl")))


def pagerank_hosts_k3(spark, sf):
    return pagerank(*host_graph(table(spark, sf, "pt_crawl")), rounds=3, tolerance=None)


def pagerank_graph(spark, sf):
    return host_graph(table(spark, sf, "pt_crawl"))[1]


def pagerank_report(spark, sf):
    ranks = table(spark, sf, "pt_pageranks").select("host", "rank")
    named = F.array(F.struct("host", "rank"), F.struct(F.lit("www.reddit.com").alias("host"), F.col("rank")), F.struct(F.lit("en.wikipedia.org").alias("host"), F.col("rank")))
    return ranking(ranks.where("host is not null").select(F.inline(named)))


_TRADE = """e as (select distinct src, dst from (
  select 'c' || o_custkey as src, 's' || l_suppkey as dst from orders join lineitem on o_orderkey = l_orderkey
  union all select 'c' || a.o_custkey, 'c' || b.o_custkey from orders a join orders b on b.o_orderkey = a.o_orderkey + 1)),
n as (select count(*)::double as n from customer),
g as (select 'c' || c_custkey as host, coalesce(d, 0) as d from customer left join (select src, count(*) as d from e group by src) on src = 'c' || c_custkey),
r0 as (select host, 1.0::double / n as rank from g, n)"""


def _rounds(k: int, tables: str = _TRADE) -> str:
    steps = [tables]
    for i in range(1, k + 1):
        steps.append(
            f"""s{i} as (select g.host, d, rank from g join r{i - 1} on g.host = r{i - 1}.host),
l{i} as (select coalesce(sum(rank::decimal(38,16)), 0)::double as l from s{i} where d = 0),
r{i} as (select host, round(({1 - DAMPING}::double / n) + {DAMPING}::double * (got + l / n), 8) as rank from (
  select host, sum(part)::double as got from (select dst as host, (rank / d)::decimal(38,16) as part from e join s{i} on src = host union all select host, 0 from g) group by host), n, l{i})"""
        )
    return "with " + ",\n".join(steps) + f" select * from r{k}"


_GRAPH = r"""p as (select url, decode(page) as h, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) as src from pt_crawl where octet_length(page) > 0 and url is not null),
t as (select src, url, unnest(regexp_extract_all(h, '(?is)<a[^>]*>')) as t from p),
r as (select src, url, regexp_extract(t, '(?is)href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1) as raw from t),
x as (select src, url, case when left(raw, 1) in ('"', '''') then substr(raw, 2, length(raw) - 2) else raw end as href from r where raw <> ''),
y as (select src, case when starts_with(href, 'http') then href when starts_with(href, '//') then 'http:' || href
  when starts_with(href, '/') then regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) || '://' || regexp_extract(url, '^[^:]*://([^/?#:]*)', 1) || href end as u from x)"""
_LINKS = "select distinct src, lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) as dst from y where u is not null"
_HOSTS = f"""{_GRAPH},
e as ({_LINKS}), g0 as (select distinct src as host from p), n as (select count(*)::double as n from g0),
g as (select g0.host, coalesce(d, 0) as d from g0 left join (select src, count(*) as d from e group by src) on src = g0.host),
r0 as (select host, 1.0::double / n as rank from g, n)"""
_REPORT = r"""with r as (select lower(x.host) as host, x.rank as rank from (select unnest([{'host': host, 'rank': rank}, {'host': 'www.reddit.com', 'rank': rank}, {'host': 'en.wikipedia.org', 'rank': rank}]) as x from pt_pageranks where host is not null)),
w as (select case when regexp_matches(host, '\.(wikipedia|wikibooks|wikiquote|wikinews|wikivoyage|wikiversity|wikidata|wikimedia|wiktionary)\.org$') then 'wiki family' else host end as host,
  (rank * case when host = 'x.com' or regexp_matches(host, '^(www\.)?(facebook|instagram|linkedin|pinterest|reddit|tiktok|twitter|youtube)\.com$') then 0.1::double else 1.0::double end)::decimal(38,16) as rank from r where rank is not null),
s as (select host, round(sum(rank)::double, 8) as rank from w group by host)
select row_number() over (order by rank desc, host)::bigint as place, host, rank from s order by rank desc, host limit 1000"""
QUERIES = {f.__name__: f for f in (pagerank_k5, pagerank_hosts, pagerank_hosts_k3, pagerank_graph, pagerank_report, pagerank_lines)}
SQL = {
    "pagerank_k5": _rounds(5),
    "pagerank_graph": f"with {_GRAPH} {_LINKS}",
    "pagerank_hosts_k3": _rounds(3, _HOSTS),
    "pagerank_report": _REPORT,
    "pagerank_lines": f"select place, place || '.' || repeat(' ', greatest(0, 5 - length(place::varchar))) || host || repeat(' ', greatest(0, 50 - length(host))) || printf('%.8f', rank) as line from ({_REPORT})",
}
