import pytest
from pyspark.sql import functions as F

from weftlake.functions import hashing, robots, text
from weftlake.functions import html as H
from weftlake.functions import urls as U

A, B = "https://foo.com:8000/bar/xyz.html", "https://foo.com:8000/bar/foo/xyz.html"


@pytest.mark.parametrize(
    "base, href, want",
    [
        (A, "http://elsewhere.com/abc.html", "http://elsewhere.com:80/abc.html"),
        (A, "/one/two.html", "https://foo.com:8000/one/two.html"),
        (A, "../blubb/123.html", "https://foo.com:8000/blubb/123.html"),
        (A, "#frag", A),
        (A, "#", A),
        (A, "blah.html#test", "https://foo.com:8000/bar/blah.html"),
        (A, "foo/blah.html", "https://foo.com:8000/bar/foo/blah.html"),
        (B, "blubb/123.html", "https://foo.com:8000/bar/foo/blubb/123.html"),
        (B, "../blubb/123.html", "https://foo.com:8000/bar/blubb/123.html"),
        (B, "../../blubb/123.html", "https://foo.com:8000/blubb/123.html"),
        (B, "../../../blubb/123.html", "https://foo.com:8000/../blubb/123.html"),
        (B, "../../../../blubb/123.html", "https://foo.com:8000/../../blubb/123.html"),
        ("http://h/x/y.html", "?q=1", "http://h:80/x/?q=1"),
        (A, "//other.org/x", "https://other.org:443/x"),
        (A, "mailto:x@y.z", None),
        (A, "javascript:void(0)", None),
        (A, "/wiki/File:x.png", None),
        (A, "", None),
        (A, None, None),
        (None, "/a", None),
        (A, "./x/./y/..", "https://foo.com:8000/bar/x/"),
        (A, "a b", None),
        (A, "http:x", None),
        (A, "?q", "https://foo.com:8000/bar/?q"),
        ("nothing", "/a", None),
        ("http://h", "x", "http://h:80/x"),
        (A, "HTTPS://Else.org?x", "https://else.org?x:443/"),
    ],
)
def test_resolved(spark, base, href, want):
    row = spark.createDataFrame([(base, href)], "base string, href string")
    assert row.select(U.resolve(F.col("base"), F.col("href"))).first()[0] == want


@pytest.mark.parametrize(
    "word, key",
    [
        ("literature", "esdmkopclgkkcoeouicikgeqqalgospgnoimmins"),
        ("janet", "iqscncukiovspouksgkidirebmceaqrkcctcgiqo"),
        ("milano", "iqhkochmvshcwklmmsgawitecmvcnctiacmoxqfk"),
        ("match", "esogbkagomfkfopmkmrigovcgefqtijgheeoioto"),
        ("romney", "espguqhsvsbcjslmgevoacgisglchcjqieacmsrg"),
    ],
)
def test_hash_key(spark, word, key):
    assert spark.range(1).select(hashing.hash_key(F.lit(word)).alias("k")).first().k == key


def parts(spark, *urls):
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    return [tuple(r) for r in rows.select(F.inline(F.array(U.url_parts(F.col("url"))))).collect()]


def test_url_parts(spark):
    assert parts(spark, "https://h:8/p?q#f", "http://h", "nothing", "//x/y", "http://:80/", None) == [
        ("https", "h", "8", "/p?q#f"), ("http", "h", None, "/"), (None, None, None, "nothing"), (None, None, None, "//x/y"),
        ("http", ":80", None, "/"), (None, None, None, None),
    ]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_urls(spark):
    u = F.col("u")
    assert one(spark, U.normal_url(u), u="HTTP://Foo.COM/a#b") == "http://foo.com:80/a"
    assert one(spark, U.normal_url(u), u="https://foo.com") == "https://foo.com:443/"
    assert one(spark, U.is_blocked(u), u="https://microsoft.com/x") and not one(spark, U.is_blocked(u), u="https://a.test/x")
    assert one(spark, U.is_foreign_wikipedia(u), u="http://de.wikipedia.org/x") and not one(spark, U.is_foreign_wikipedia(u), u="http://en.wikipedia.org/x")
    assert one(spark, U.base_mime(u), u="Text/HTML ; charset=x") == "text/html"
    assert tuple(one(spark, U.url_flags(u), u="http://h/a/b/c/d/e//?q")) == (True, True, False, False)
    assert one(spark, U.strict_host(u), u="http://a_b.com/") is None
    assert one(spark, U.strict_path(u), u="http://h/a%20b+c") == "/a b+c"


def test_html(spark):
    h = F.col("h")
    page = "<HTML dir=x lang='en'><title> A &amp;lt; b&nbsp;c &copy; </title><a href=/x>One two</a><A HREF='y'>t</A><a name=z>"
    assert one(spark, H.title(h), h=page) == "A < b c" and one(spark, H.title(h), h="<p>") is None
    assert one(spark, H.title(h), h=f"<title>{'x' * 300}</title>") == "x" * 197 + "..."
    assert one(spark, H.links(h), h=page) == ["/x", "y"]
    assert one(spark, H.is_english(h), h=page) and one(spark, H.language_class(h), h=page) == "none"
    assert one(spark, H.language_class(h), h='<html lang="de">') == "other"
    assert one(spark, H.alt_tokens(h), h='<img alt="A Red logo 5"><img alt="12345"><img alt="icon">') == ["a", "red"]
    anchors = one(spark, H.anchors(h), h='<a class=k href="/t"> Big <b>red</b> 9 Dog2</a><a href="/u"></a>')
    assert [(a.target, a.words) for a in anchors] == [("/t", ["big", "red", "dog2"]), ("/u", [])]
    body = "<script>no</script><p>" + "long enough words " * 6 + "</p><div>short</div>"
    assert one(spark, H.page_tokens(h), h=body) == ["long", "enough", "words"]
    assert one(spark, H.page_tokens(h), h="<p>few http://x.y words</p>") == ["few", "words"]


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.title_tokens(t), t="The &eacute; 4x x4 the") == ["the", "x4"]
    assert one(spark, text.path_tokens(t), t="/Wiki/a/index.html/view/wiki") == ["wiki", "index", "html"]
    assert one(spark, text.query_terms(t), t="  The the X! ") == ["the", "the", "x!"]
    assert one(spark, text.truncated(t, 5), t="abcdefg") == "ab..." and one(spark, text.truncated(t, 5), t="abcde") == "abcde"
    assert one(spark, text.trim_controls(t), t="\x01 \t a b \n") == "a b"
    assert one(spark, text.number(t, "int", F.lit(-1)), t="x") == -1


def test_robots():
    rules = robots.parse_robots(
        "User-agent: a\nUser-agent: me\nDisallow: /x # no\nAllow: /x/y\nCrawl-delay: 1.5\nCrawl-delay: 1\n\nUser-agent: *\nDisallow:", "me"
    )
    assert rules.delay_ms == 1500 and not rules.allows("/x/y") and rules.allows("/z") and rules.allows(None)
    other = robots.parse_robots("User-agent: *\nDisallow:\nDisallow: /", "me")
    assert other.allows("/a") and other.delay_ms == -1
    assert robots.parse_robots(None, "me").allows("/") and robots.parse_robots("Disallow: /", "me").allows("/")
