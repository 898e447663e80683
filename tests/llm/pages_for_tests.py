"""Small pages for the tests of the page operators."""

SENTENCES = [
    "The old mill by the river was sold twice before it burned down in the dry summer.",
    "Nobody could say afterwards who had left the heavy door to the cellar unlocked.",
    "A new roof was put on the barn in autumn with the help of all the neighbours.",
    "The ferry crosses the lake four times a day as long as the water is free of ice.",
    "In the evening the boats come back and the market opens for an hour or two.",
    "Her letters were found under the floor when the house was pulled down last year.",
    "Three bridges lead across the gorge, and the narrowest of them is the oldest one.",
    "The bell was cast from coins that the villagers had saved for eleven long years.",
]


def page(title, body, lang="en", extra=""):
    """A page with menu, cookie notice, body, sidebar and footer; ``body`` is HTML."""
    return (
        f'<html lang="{lang}"><head><title>{title}</title><script>var a = "<p>no</p>";</script></head><body>'
        '<div class="c"><p>We use cookies to make this site work as it should.</p><button>Fine</button></div>'
        '<div class="m"><ul><li><a href="/a">Home</a></li><li><a href="/b">Help</a></li></ul></div>'
        f'<div class="x"><h1>{title}</h1><div class="by">By Ann Lee · 3 May 2020</div>{body}<p>Share this page</p></div>'
        f'<div class="s"><h3>More</h3><p><a href="/z">A storm took the roof of the mill by the river in the night.</a></p>{extra}</div>'
        '<div class="f"><p>© 2020 All rights reserved.</p></div></body></html>'
    )


def paragraphs(sentences):
    return "".join(f"<p>{s}</p>" for s in sentences)


def crawl(spark, rows):
    """Table of (crawl_id, url, page) with more columns whose names the operators use inside."""
    data = [(i, u, None if p is None else bytearray(p.encode()), 1, "t", ["l"], 2, "h", 7) for i, u, p in rows]
    schema = (
        "crawl_id bigint, url string, page binary, block_no int, text string, lines array<string>, n int, host_id string, id int"
    )
    return spark.createDataFrame(data, schema)
