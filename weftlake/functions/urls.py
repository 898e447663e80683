"""Column functions over urls: parts, normal forms, filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTED = r"(?s)^(?!//).+?//"

# Protocols of links that lead to no page, wherever they stand in a link.
OTHER_PROTOCOLS = ("irc:", "javascript:", "mailto:", "tel:", "ftp:", "file:", "news:", "nntp:")
# File name endings that are not crawled.
SKIPPED_ENDINGS = ("jpg", "jpeg", "gif", "png", "txt")
# Status codes that redirect.
REDIRECTS = (301, 302, 303, 307, 308)
# Endings of the hosts of the wiki family.
WIKI_FAMILY = (
    ".wikipedia.org", ".wiktionary.org", ".wikiquote.org", ".wikibooks.org", ".wikinews.org", ".wikivoyage.org", ".wikiversity.org",
    ".wikidata.org", ".wikimedia.org",
)
# Hosts of social networks.
SOCIAL_HOSTS = (
    "facebook.com", "www.facebook.com", "instagram.com", "www.instagram.com", "linkedin.com", "www.linkedin.com", "pinterest.com",
    "www.pinterest.com", "reddit.com", "www.reddit.com", "tiktok.com", "www.tiktok.com", "twitter.com", "www.twitter.com", "x.com",
    "youtube.com", "www.youtube.com",
)
# What a rescan of stored pages skips: parts of hosts.
HOST_CONTAINS = (
    "4chan.org", "adage.com", "adserver.", "airbnb.", "amazon.", "archive.org", "autotrader.", "b-cdn.net", "baidu.", "bing.", "bit.ly",
    "blogspot.", "booking.", "cambridge.org", "clickserve.", "cloudfront.net", "core.ac.uk", "discord.com", "dl.acm.org", "doi.org",
    "doubleclick.", "doubleverify.", "ezinearticles.", "facebook.", "fandom.com", "feedburner.", "google.", "googletagmanager.",
    "googletagservices.", "gstatic.", "hubpages.com", "instagram.", "jstor.org", "kakao.", "lnkd.in", "mailchi.mp", "medium.com",
    "miraheze.", "naver.", "newyorker.com", "nytimes.com", "oxfordhandbooks.", "plato.stanford.edu", "qq.", "realtor.", "reddit.com",
    "semanticscholar", "slate.com", "stackexchange.", "stackoverflow.", "t.co", "tempo.co", "tiktok.", "tinyurl", "tribunnews.com",
    "tripadvisor.", "tumblr.com", "twitter.", "usatoday.", "vox.com", "wayback", "web.archive.org", "wiki.gg", "wikidot.", "wikihow.",
    "wikipedia-on-ipfs", "wikiwand.", "wordpress.com", "worldbank.org", "yahoo.", "youtube.", "zillow.",
)
# Endings of hosts that a rescan skips.
HOST_ENDS = (".cn", ".id", ".ir", ".jp", ".kr", ".ru", ".th", ".tr", ".vn")
# Endings of hosts that a rescan skips unless they begin with "en.".
HOST_ENDS_UNLESS_ENGLISH = (
    ".wikibooks.org", ".wikidata.org", ".wikinews.org", ".wikipedia.org", ".wikiquote.org", ".wikisource.org", ".wikiversity.org",
    ".wikivoyage.org", ".wiktionary.org",
)
# Endings and parts of urls that a rescan skips.
URL_ENDS = (".7z", ".epub", ".gif", ".gz", ".jpeg", ".jpg", ".pdf", ".png", ".rar", ".svg", ".tar", ".zip")
URL_CONTAINS = ("?page=", "&page=", "?search=", "?query=", "&offset=", "&start=")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def url_parts(url: Column) -> Column:
    """Struct ``scheme, host, port, path`` by the text alone.

    The authority stands between the first ``//`` after the start and the next
    ``/``; a url without one is all path; the path keeps query and fragment and
    is ``/`` when there is none.
    """
    parted = url.rlike(_PARTED)
    authority = F.regexp_extract(url, r"(?s)^(?!//).*?.//([^/]*)", 1)
    colon = F.instr(authority, ":")
    rest = F.regexp_extract(url, r"(?s)^(?!//).*?.//[^/]*(/.*)$", 1)
    return F.struct(
        F.when(parted, F.regexp_extract(url, r"(?s)^(?!//)(.*?).//", 1)).alias("scheme"),
        F.when(parted, F.when(colon > 1, F.expr("null")).otherwise(authority)).alias("_plain"),
        F.when(parted, F.when(colon > 1, authority.substr(F.lit(1), colon - 1)).otherwise(authority)).alias("host"),
        F.when(parted & (colon > 1), authority.substr(colon + 1, F.length(authority))).alias("port"),
        F.when(parted, F.when(rest == "", "/").otherwise(rest)).otherwise(url).alias("path"),
    ).dropFields("_plain")


def host(url: Column) -> Column:
    """Host by the text alone, in lower case."""
    return F.lower(url_parts(url)["host"])


def strict_host(url: Column) -> Column:
    """Host of a valid URI in lower case; null for others."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def strict_path(url: Column) -> Column:
    """Percent-decoded path of a valid URI; null for others."""
    return F.try_url_decode(F.replace(F.try_parse_url(url, F.lit("PATH")), F.lit("+"), F.lit("%2B")))


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, the port named, a path, no fragment; http where no scheme is."""
    return _from_parts(url_parts(url))


def _from_parts(p: Column) -> Column:
    scheme = F.lower(F.when((p["scheme"] != ""), p["scheme"]).otherwise("http"))
    port = F.coalesce(p["port"].try_cast("int"), F.when(scheme == "https", 443).otherwise(80))
    path = F.when(p["path"].startswith("/"), p["path"]).otherwise(F.concat(F.lit("/"), p["path"]))
    return F.concat(
        scheme, F.lit("://"), F.coalesce(F.lower(p["host"]), F.lit("")), F.lit(":"), port.cast("string"),
        F.regexp_replace(path, "(?s)#.*$", ""),
    )


def site_link(href: Column, base: Column) -> Column:
    """A link as the host graph takes it: absolute, or from the root of its page's host, without port.

    Relative links give null, and so do links from the root of an invalid base.
    """
    root = F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(base, F.lit("HOST")))
    url = (
        F.when(href.startswith("http"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(root, href))
    )
    return F.regexp_replace(url, "(?s)#.*$", "")


def is_crawlable(url: Column) -> Column:
    """http and https urls."""
    return url.rlike(r"(?i)^https?://")


def has_skipped_ending(url: Column) -> Column:
    """Urls of images and plain texts, by their ending."""
    return url.rlike(r"(?i)\.(" + "|".join(SKIPPED_ENDINGS) + ")$")


def is_foreign_wikipedia(url: Column) -> Column:
    """Wikipedia hosts of a language other than English."""
    h = host(url)
    first = F.split_part(h, F.lit("."), F.lit(1))
    return F.coalesce(h.contains("wikipedia.org") & ~first.isin("en", "www"), F.lit(False))


def _quoted(parts: tuple[str, ...]) -> str:
    return "|".join(p.replace(".", r"\.").replace("?", r"\?") for p in parts)


def is_blocked(url: Column) -> Column:
    """Urls that a rescan of stored pages skips; null urls are skipped."""
    h = host(url)
    low = F.lower(url)
    rules = (
        h.rlike(_quoted(HOST_CONTAINS))
        | h.rlike(f"(?:{_quoted(HOST_ENDS)})$")
        | (h.rlike(f"(?:{_quoted(HOST_ENDS_UNLESS_ENGLISH)})$") & ~h.startswith("en."))
    )
    on_url = low.rlike(f"(?:{_quoted(URL_ENDS)})$") | low.contains("download") | url.rlike(_quoted(URL_CONTAINS))
    return F.coalesce(F.coalesce(rules, F.lit(False)) | on_url, F.lit(True))


def is_redirect(code: Column) -> Column:
    """Status codes that lead elsewhere."""
    return code.isin(*REDIRECTS)


def base_mime(content_type: Column) -> Column:
    """Content type without parameters, in lower case."""
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def top_domain(host_name: Column) -> Column:
    """Last label of a host."""
    return F.element_at(F.split(F.regexp_replace(host_name, r"\.+$", ""), r"\."), -1)


def is_wiki_family(host_name: Column) -> Column:
    """Hosts of the wiki family."""
    return host_name.rlike(f"(?:{_quoted(WIKI_FAMILY)})$")


def is_social(host_name: Column) -> Column:
    """Hosts of social networks."""
    return host_name.isin(*SOCIAL_HOSTS)


def url_flags(url: Column) -> Column:
    """Struct of flags: ``deep`` (more than five path segments), ``query``, ``fragment``, ``long``."""
    path = url_parts(url)["path"]
    segments = F.size(F.split(F.regexp_replace(path, "/+$", ""), "/"))
    return F.struct(
        (segments > 5).alias("deep"),
        url.contains("?").alias("query"),
        url.contains("#").alias("fragment"),
        (F.length(url) > 200).alias("long"),
    )


def _folded(path: Column) -> Column:
    """A path without dot segments; ``..`` segments that lead above the root stay."""
    parts = F.split(path, "/")
    ends = F.transform(parts, lambda p, i: F.struct(p.alias("part"), (i == F.size(parts) - 1).alias("last")))

    def step(done: Column, x: Column) -> Column:
        closed = lambda kept: F.when(x["last"], F.array_append(kept, F.lit(""))).otherwise(kept)
        back = (x["part"] == "..") & (F.size(done) > 1) & (F.element_at(done, -1) != "..")
        return (
            F.when(x["part"] == ".", closed(done))
            .when(back, closed(F.slice(done, 1, F.size(done) - 1)))
            .otherwise(F.array_append(done, x["part"]))
        )

    return F.array_join(F.aggregate(ends, F.array().cast("array<string>"), step), "/")


def resolve(base: Column, href: Column) -> Column:
    """``href`` as an absolute normal url on a page at ``base``; null for what leads to no page.

    Links with another protocol anywhere in them, or any other word before
    their first colon, are none; nor are links with blanks or signs that no url
    may hold.  Surplus ``..`` segments stay in the path, and a bare query
    replaces the last segment of the base's path.
    """
    low = F.lower(F.trim(href))
    word = F.trim(F.split_part(low, F.lit(":"), F.lit(1)))
    other = low.rlike("|".join(OTHER_PROTOCOLS)) | (low.contains(":") & ~word.isin("", "http", "https"))
    barred = href.rlike(r"""[\s<>"{}|\\^`]""")
    scheme = F.lower(F.regexp_extract(base, r"^([^:/?#]*):?//", 1))
    own = F.when(href.startswith("//"), F.concat(F.when(scheme == "", "http").otherwise(scheme), F.lit(":"), href)).otherwise(href)
    site = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    base_path = F.regexp_extract(base, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    path, query = F.regexp_extract(own, r"^([^?#]*)", 1), F.regexp_extract(own, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(F.when(base_path == "", "/").otherwise(base_path), "(?s)^(.*/)", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    folded = F.when(whole.contains("/."), _folded(whole)).otherwise(whole)
    absolute = (
        F.when(href.isNull() | base.isNull() | (href == ""), None)
        .when(href.startswith("#"), base)
        .when(other | barred, None)
        .when(own.rlike("(?i)^https?://[^/?#]+"), own)
        .when(own.rlike("(?i)^https?:") | (site == ""), None)
        .otherwise(F.concat(site, folded, query))
    )
    return bound(absolute, lambda url: bound(url_parts(url), _from_parts))
