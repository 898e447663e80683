import pytest

from weftlake.operators import skew
from weftlake.plans import crawl, indexes, pagerank, quality, search


def test_pagerank_first_round(spark):
    hosts = spark.createDataFrame([(h,) for h in "abd"], "host string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a")], "src string, dst string")
    got = {r.host: r["rank"] for r in pagerank.pagerank(hosts, edges, rounds=1).collect()}
    assert got == pytest.approx({"a": 0.42777778, "b": 0.28611111, "c": 0.28611111, "d": 0.14444444}, abs=1e-9)
    more = {r.host: r["rank"] for r in pagerank.pagerank(hosts, edges).collect()}
    assert set(more) == set("abcd") and min(more.values()) >= 0.05 - 1e-8
    assert pagerank.pagerank(hosts.limit(0), edges).count() == 0


def test_search_one_term(spark):
    index = spark.createDataFrame([("x", ["http://h/a"])], "token string, urls array<string>")
    ranks = spark.createDataFrame([("h", 0.01)], "host string, rank double")
    crawled = spark.createDataFrame([("http://h/a", "X marks", 1, None)], "url string, title string, crawl_id bigint, fetched_at timestamp")
    rows = search.search(" X ", index, index, ranks, crawled).collect()
    assert len(rows) == 1 and rows[0].title == "X marks"
    assert rows[0].score == pytest.approx(2.5 * 9.615805480084347 + 50 + 25, abs=1e-5)


def test_upper_median(spark):
    for values, want in (([1, 2, 3, 4], 3), ([1, 2, 3], 2), ([5], 5)):
        df = spark.createDataFrame([(v,) for v in values], "length int")
        assert quality.upper_median(df, "length").first().median == want


def test_crawl_with_robots(spark):
    pages = spark.createDataFrame(
        [("http://h:80/", ["http://h:80/a", "http://h:80/no"]), ("http://h:80/a", ["http://h:80/", "http://h:80/b", "http://h:80/p.png"])],
        "url string, links array<string>",
    )
    seeds = spark.createDataFrame([("http://h:80/",), (None,)], "url string")
    rules = spark.createDataFrame([("h", "User-agent: *\nDisallow: /no")], "host string, body string")
    got = {(r.url[11:], r["round"], r.found) for r in crawl.crawl(seeds, pages, rules).collect()}
    assert got == {("/", 0, True), ("/a", 1, True), ("/b", 2, False)}


def web(spark):
    page = lambda *links, lang="en": bytearray(f"<html lang='{lang}'><title>T</title>{''.join(f'<a href={x}>x</a>' for x in links)}".encode())
    rows = [
        ("http://a.test:80/", 200, "text/html", page("/1", "/2", "/3", "//b.test/", "/p.png", "http://de.wikipedia.org/x"), None),
        ("http://a.test:80/1", 301, None, None, "/new"),
        ("http://a.test:80/new", 200, "TEXT/html; x", page("/", "/gone"), None),
        ("http://a.test:80/2", 200, "text/html", page("/never", lang="de"), None),
        ("http://a.test:80/3", 200, "application/pdf", page("/never"), None),
        ("http://a.test:80/gone", 404, "text/html", page("/never"), None),
        ("http://b.test:80/", 200, "text/html", page("/secret", "http://c.ru/"), None),
        ("http://b.test:80/secret", 200, "text/html", page(), None),
        ("http://c.ru:80/", 302, None, None, "/loop"),
        ("http://c.ru:80/loop", 302, None, None, "/"),
    ]
    return spark.createDataFrame([(u, c, t, 5, p, to) for u, c, t, p, to in rows], "url string, responsecode int, contenttype string, length int, page binary, location string")


def test_whole_crawl(spark):
    rules = spark.createDataFrame([("b.test", "User-agent: *\nDisallow: /secret")], "host string, body string")
    seeds = spark.createDataFrame([("HTTP://A.test",), ("mailto:x",), (None,)], "url string")
    ticks = iter(range(0, 10**9, 1000))
    rows = {r.url: r for r in crawl.Crawler(crawl.from_table(web(spark)), rules, round_ms=1000, clock=ticks.__next__, min_rows=0).run(seeds).collect()}
    short = {u.replace(":80", "")[7:]: (r.responsecode, r.page is not None, r.title) for u, r in rows.items()}
    assert short == {
        "a.test/": (200, True, "T"), "a.test/1": (301, False, None), "a.test/new": (200, True, "T"), "a.test/2": (200, False, None),
        "a.test/3": (200, False, None), "a.test/gone": (404, False, None), "b.test/": (200, True, "T"), "c.ru/": (302, False, None), "c.ru/loop": (302, False, None),
    }
    rounds = sorted(r["round"] for u, r in rows.items() if "a.test" in u and u != "http://a.test:80/gone")
    assert len(set(rounds)) == len(rounds)  # one fetch of a host a round
    assert crawl.Crawler(crawl.from_table(web(spark))).run(seeds.limit(0)).count() == 0


def test_hosts_rest_between_rounds(spark):
    ticks = iter(range(0, 10**9, 400))
    page = bytearray(b"<html lang='en'><a href=/1><a href='http://b.test/'>")
    pages = spark.createDataFrame([("http://a.test:80/", page), ("http://a.test:80/1", page), ("http://b.test:80/", page)], "url string, page binary")
    answers = pages.selectExpr("url", "200 as responsecode", "'text/html' as contenttype", "1 as length", "page", "cast(null as string) as location")
    seeds = spark.createDataFrame([("http://a.test/",)], "url string")
    crawler = crawl.Crawler(crawl.from_table(answers), round_ms=400, clock=ticks.__next__, min_rows=10, rescans=1)
    rounds = {r.url: r["round"] for r in crawler.run(seeds).collect()}
    assert rounds == {"http://a.test:80/": 0, "http://b.test:80/": 1, "http://a.test:80/1": 3}  # three rounds make up the delay


def test_rescan(spark):
    stored = spark.createDataFrame(
        [("http://a.test:80/", bytearray(b"<a href=/x><a href=/y.pdf><a href='http://z.ru/'><a href=/z?page=2><a href=/b><a href=/c>")), ("http://a.test:80/b", bytearray(b"p")), ("http://a.test:80/c", None)],
        "url string, page binary",
    )
    assert sorted(r.url for r in crawl.rescan(stored).collect()) == ["http://a.test:80/c", "http://a.test:80/x"]


def test_inverted_spreads_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(indexes, "MAX_POSTINGS", 10)
    pairs = spark.createDataFrame([("t", f"u{i}") for i in range(95)] + [("s", "u1")], "token string, url string")
    rows = indexes.inverted(pairs).collect()
    assert sorted(u for r in rows if r.token == "t" for u in r.urls) == sorted(f"u{i}" for i in range(95))
    assert sum(r.token == "t" for r in rows) > 5 and sum(r.token == "s" for r in rows) == 1


def test_parts_follow_each_other_in_order(spark, monkeypatch):
    monkeypatch.setattr(indexes, "MAX_POSTINGS", 10)
    pairs = spark.createDataFrame([("t", f"u{i:03}") for i in range(300)] + [("s", "u1")], "token string, url string")
    rows = sorted((r.part, r.urls) for r in indexes.inverted(pairs).collect() if r.token == "t")
    assert [u for _, urls in rows for u in urls] == [f"u{i:03}" for i in range(300)] and rows[0][0] == 0 and max(len(u) for _, u in rows) < 60


INDEX = "row_id bigint, token string, urls array<string>, batch_id int, indexed_at timestamp, url string, at int, n int"


def index(spark, rows):
    from datetime import datetime

    data = [(i, t, u, 0, None if s is None else datetime(2024, 1, 1, 0, 0, s), "x", 1, 2) for i, t, u, s in rows]
    return spark.createDataFrame(data, INDEX)


def test_redundant_rows(spark):
    rows = [
        (1, "a", ["u", "v"], 5), (2, " A ", ["u"], 6), (3, "a", ["v", "v"], 4), (4, "a", ["u", None, "w"], 7), (5, None, ["u"], 8),
        (6, "  ", ["u"], 8), (7, "a", [], 9), (8, "a", None, 9), (9, "a", [None], 9), (10, "b", ["u"], 5), (11, "b", ["u"], 5),
        (12, "A", ["w"], None), (13, "c", ["u"], 1), (13, "c", ["u"], 1),
    ]
    got = {r.row_id for r in skew.redundant_rows(index(spark, rows)).collect()}
    assert got == {2, 4, 11}
    assert skew.redundant_rows(index(spark, [])).count() == 0


def test_moments_order_as_pairs(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    times = [None, datetime(1, 1, 2), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(1970, 1, 1), datetime(2024, 5, 6, 7, 8, 9, 123456), datetime(9999, 12, 30)]
    ids = [None, -(2**63), -1, 0, 1, 2**63 - 1]
    rows = spark.createDataFrame([(n, t, i) for n, (t, i) in enumerate((t, i) for t in times for i in ids)], "n int, t timestamp, i bigint")
    m = rows.withColumn("m", skew.moment(F.col("t"), F.col("i"))).withColumn("back", (skew.moment_time(F.col("m")).eqNullSafe(F.col("t"))) & skew.moment_row(F.col("m")).eqNullSafe(F.col("i")))
    got = m.orderBy("m").collect()
    assert [r.n for r in got] == list(range(len(times) * len(ids))) and all(r.back for r in got)


def test_join_by_key_matches_plain_join(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    rows = rows.union(spark.createDataFrame([(None, 1)], "k string, id bigint"))
    sizes = skew.key_sizes(rows, "k")
    stats = sizes.select("k", (F.col("n") * 2).alias("s"))
    assert skew.hot_keys(sizes).collect()[0].k == "hot"
    got = skew.join_by_key(rows, stats, sizes, "k")
    assert got.count() == 20_000 and got.where("k = 'hot'").select("s").distinct().collect()[0].s == 2 * 6667


def test_page_postings_in_parts(spark, monkeypatch):
    monkeypatch.setattr(indexes, "MAX_POSTINGS", 5)
    rows = [(f"u{i:02}", bytearray(f"<p>hot {'rare' if i == 3 else 'cold'}</p>".encode())) for i in range(20)]
    found = indexes.inverted(indexes.page_pairs(spark.createDataFrame(rows, "url string, page binary"))).collect()
    hot = [r for r in found if r.token == "hot"]
    assert sorted(u for r in hot for u in r.urls) == [u for u, _ in rows] and len({r.part for r in hot}) == len(hot) > 1
    assert [(r.part, r.urls) for r in found if r.token == "rare"] == [(0, ["u03"])]


def test_stored_lists_are_merged(tmp_path, spark):
    rows = [("a", ["u", "v"]), (" A ", ["w", "u", None]), ("b", []), (None, ["u"])]
    spark.createDataFrame(rows, "token string, urls array<string>").write.parquet(str(tmp_path / "pt_title_index.parquet"))
    assert [tuple(r) for r in indexes.stored_index_postings(spark, str(tmp_path)).collect()] == [("a", 0, "u v w")]


def test_crawl_ends_with_an_empty_frontier(spark):
    pages = spark.createDataFrame([(f"u{i}", [f"u{i + 1}"]) for i in range(8)], "url string, links array<string>")
    seeds = spark.createDataFrame([("u0",)], "url string")
    assert sorted((r["round"], r.url) for r in crawl.crawl(seeds, pages).collect()) == [(i, f"u{i}") for i in range(9)]
    with pytest.raises(RuntimeError, match="3 rounds"):
        crawl.crawl(seeds, pages, rounds=3)
