"""Blocks, main body (p2), stuffed pages (p7), near-duplicates (p1), lines (p6), languages (p5)."""

from pages_for_tests import SENTENCES, crawl, page, paragraphs

from weftlake.llm import p1_forest, p2_mainbody, p5_language, p6_lines
from weftlake.llm.labels import labelled_pages
from weftlake.llm.mainbody import FEATURES, Judged, is_stuffed, main_blocks, page_trees
from weftlake.llm.pages import declared_language, decode, page_blocks
from weftlake.llm.prose import lines

HEAP = "<p>" + "cheap boots sale boots best boots shop boots " * 12 + "</p>"
LINKS = "<ul>" + "".join(f'<li><a href="/{i}">offer boots {w}</a></li>' for i, w in enumerate("Ara Bel Cor Dun Eks Fon Gar Hol".split() * 4)) + "</ul>"


def texts(html):
    return [b.text for b in page_blocks(html)]


def test_blocks():
    html = "a<b>b</b> c<br>&eacute;&nbsp; x<!-- <p>no</p> --><p>d <a href='/x'>e</a></p><style>s</style><div> </div>f<script>g"
    assert texts(html) == ["ab c", "é x", "d e", "f"]
    assert [round(b.link, 2) for b in page_blocks(html)] == [0, 0, 0.33, 0]
    assert texts("") == [] and texts("<p></p>") == [] and texts("plain") == ["plain"]
    assert decode(None) == "" and decode(b"a\xff") == "a�"
    assert texts("<head><title>t</title></head><header>h</header>") == ["h"]


def test_declared_language():
    assert declared_language("<html lang='de-AT'>") == "de" and declared_language("<HTML dir=x LANG=EN>") == "en"
    assert declared_language("<html>") == "" and declared_language('<html lang="und">') == "" and declared_language('<html lang="">') == ""


def test_main_body():
    html = page("A mill", paragraphs(SENTENCES[:3]) + "<p>Advertisement</p><ul><li>Short item</li></ul>")
    blocks = page_blocks(html)
    main = [blocks[i].text for i in main_blocks([blocks])[0]]
    assert main == ["A mill", *SENTENCES[:3], "Short item"]
    assert [list(x) for x in main_blocks([[], blocks[:2]])][0] == [] and main_blocks([]) == []


TWO = [f"{a} {b}" for a, b in zip(SENTENCES[::2], SENTENCES[1::2])]


def main_of(html):
    blocks = page_blocks(html)
    return [blocks[i].text for i in main_blocks([blocks])[0]]


def test_main_body_spread_over_containers():
    for body in (paragraphs(TWO[:2]), paragraphs(SENTENCES[:2])):
        want = ["A mill", *(TWO[:2] if TWO[0] in body else SENTENCES[:2])]
        assert main_of(f"<body><header><h1>A mill</h1></header><div>{body}</div></body>") == want
        assert main_of(f"<body><h1>A mill</h1><article>{body}</article></body>") == want
        assert main_of(f"<table><tr><td><h1>A mill</h1></td></tr><tr><td>{body}</td></tr></table>") == want
    aside = '<aside><h3>More</h3><p><a href="/x">A storm took the roof of the mill in the night.</a></p></aside>'
    assert main_of(f"<h1>A mill</h1><p>{TWO[2]}</p>{aside}{paragraphs(TWO[:2])}") == ["A mill", TWO[2], *TWO[:2]]
    linked = f'<p><a href="/x">{TWO[3]}</a></p>'
    assert main_of(f"<h1>A mill</h1><p>{TWO[2]}</p>{linked}{paragraphs(TWO[:2])}") == ["A mill", TWO[2], *TWO[:2]]
    assert main_of(f'<ul><li><a href="/">Home</a></li><li><a href="/h">Help</a></li></ul>{paragraphs(TWO[:2])}') == TWO[:2]


def test_trees_use_words_and_links_of_neighbours():
    used = [{FEATURES[j] for j in tree.feature if j >= 0} for tree in page_trees()]
    assert all({"words", "link", "words_before", "words_after"} <= u for u in used)
    assert {"link_before", "link_after"} <= used[0] | used[1]
    own = [Judged([p.blocks]) for p in labelled_pages()]
    assert sum(j.stuffed()[0] == p.stuffed for j, p in zip(own, labelled_pages())) >= 0.98 * len(own)


def test_stuffed_lines_anywhere():
    heap = "".join(f"<p>{'cheap boots sale boots best boots shop'}</p>" for _ in range(40))
    for html in (f"<h1>boots</h1><div>{heap}</div>", f"<div><h1>boots</h1><div>{heap}</div></div>", f"<h1>b</h1><p>cheap boots</p><aside><h3>More</h3><p>x</p></aside>{heap}",
                 "<h1>boots</h1><table><tr>" + heap.replace("p>", "td>") + "</tr></table>"):
        assert is_stuffed(page_blocks(html))


def test_stuffed():
    assert is_stuffed(page_blocks(page("boots", HEAP))) and is_stuffed(page_blocks(page("boots", LINKS + f"<p>{SENTENCES[0]}</p>")))
    assert not is_stuffed(page_blocks(page("A mill", paragraphs(SENTENCES))))
    assert not is_stuffed(page_blocks(page("A list", "<ul>" + "".join(f"<li>{s}</li>" for s in SENTENCES * 3) + "</ul>")))
    assert not is_stuffed([]) and not is_stuffed(page_blocks("<h1>only</h1>"))


def test_p2_and_p7_tables(spark):
    long = page("Long", paragraphs(SENTENCES * 2000))
    rows = [(1, "u", page("A mill", paragraphs(SENTENCES[:2]))), (2, "u", None), (3, "u", ""), (None, "u", long), (4, None, page("b", HEAP)),
            (5, "u", "<p></p>"), (6, "u", long), (1, "u", page("A mill", paragraphs(SENTENCES[:2])))]
    found = p2_mainbody.main_body_numbers(crawl(spark, rows)).collect()
    by = {}
    for r in found:
        by.setdefault(r.crawl_id, []).append(r.block_no)
    assert set(by) == {1, 6} and len(by[6]) == 16001 and sorted(by[1]) == sorted([4, 6, 7] * 2)
    assert [r.crawl_id for r in p2_mainbody.stuffed_pages(crawl(spark, rows)).collect()] == [4]
    assert p2_mainbody.main_body(crawl(spark, [])).count() == 0 and p2_mainbody.stuffed_pages(crawl(spark, [])).count() == 0
    assert {r.text for r in p2_mainbody.main_body(crawl(spark, rows[:1])).collect()} == {"A mill", *SENTENCES[:2]}


def test_near_duplicates(spark):
    one, edited, other = SENTENCES, [*SENTENCES[:6], "Something else stands here now instead of it all.", SENTENCES[7]], [s[::-1] for s in SENTENCES]
    make = lambda s: page("Same title", paragraphs(s))
    rows = [(1, "a", make(one)), (2, "b", make(edited)), (3, "c", make(one)), (4, "a", make(one)), (5, "d", make(other)), (6, "e", None),
            (7, None, make(one)), (None, "f", make(one)), (8, "g", page("t", HEAP)), (9, "h", page("t", HEAP)), (10, "i", "<h1>a b</h1>"),
            (11, "j", "<h1>a b</h1>"), (3, "c", make(one))]
    pairs = sorted(tuple(r) for r in p1_forest.similar_pages(crawl(spark, rows)).collect())
    assert pairs == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    assert p1_forest.similar_pages(crawl(spark, [])).count() == 0


def brute_lines(rows):
    from collections import defaultdict

    urls, places = defaultdict(set), []
    for i, u, p in rows:
        if i is None or u is None:
            continue
        for n, b in enumerate(page_blocks(p or "")):
            key = (p6_lines.host_of(u), p6_lines.line_key(b.text))
            urls[key].add(u)
            places.append((i, n, key))
    return sorted((i, n) for i, n, k in places if len(urls[k]) >= p6_lines.SUPPORT)


def test_repeated_lines(spark):
    rows = [(i, f"http://H.test:80/{i % 6}", f"<p>Notice {i}</p><p>Second line</p><p>own {'x' * i}</p>") for i in range(12)]
    rows += [(50 + i, f"http://other.test/{i}", "<p>Second line</p><p>Notice 1</p>") for i in range(4)]
    rows += [(70, None, "<p>Second line</p>"), (None, "http://h.test/9", "<p>Second line</p>"), (71, "http://h.test/x", None), (72, "no authority", "<p>a</p>")]
    found = p6_lines.repeated_blocks(crawl(spark, rows)).collect()
    assert sorted((r.crawl_id, r.block_no) for r in found) == brute_lines(rows)
    assert len({r.block for r in found}) == 1  # the two lines follow each other on every page
    assert p6_lines.repeated_blocks(crawl(spark, [])).count() == 0
    assert p6_lines.host_of("HTTP://A.b:8080/x") == "a.b" and p6_lines.host_of("x") == "" and p6_lines.line_key("A 12b3") == "a #b#"


def test_components(spark):
    from weftlake.llm.components import components

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_languages(spark):
    text, lang = lines()
    held = [i for i in range(len(text)) if i % 6 == 0]
    samples = [(i, lang[i], text[i]) for i in range(len(text)) if i % 6]
    network = p5_language.ByteCnn(sorted(set(lang))).fit([t for *_, t in samples], [x for _, x, _ in samples])
    p = network.probabilities([text[i] for i in held])
    right = sum(network.classes[k] == lang[i] for k, i in zip(p.argmax(axis=1), held))
    assert right >= 0.9 * len(held)
    de = "Wenn es so nicht geht, sollten wir es noch einmal mit einem anderen versuchen."
    en = "If this does not work for them, they should try it again with one of the others."
    rows = [(1, "u", page("t", f"<p>{de}</p><p>{en}</p>")), (2, "u", page("t", f"<p>{en}</p>", lang="")), (3, "u", None), (None, "u", page("t", de)), (4, "u", "")]
    network = p5_language.ByteCnn(sorted(set(lang))).fit(text, lang)
    found = {(r.crawl_id, r.lang) for r in p5_language.mislabelled_blocks(crawl(spark, rows), network).collect() if r.block_no > 5}
    assert {(1, "de"), (2, "en")} <= found and (1, "en") not in found
    pages = {r.crawl_id: r for r in p5_language.page_languages(p5_language.block_languages(crawl(spark, rows), network)).collect()}
    assert pages[1].mixed and pages[2].lang == "en" and 0 < pages[2].confidence <= 1 and set(pages) == {1, 2}
    short = crawl(spark, [(1, "u", "<p>Guten Morgen</p>"), (2, "u", "<p>1 + 2</p>")])
    assert [r.crawl_id for r in p5_language.page_languages(p5_language.block_languages(short, network, p5_language.has_letter)).collect()] == [1]
    both = f"{de} {de.replace('nicht', 'gar nicht')} {en} {en.replace('this', 'that')}"
    parts = sorted(tuple(r) for r in p5_language.language_segments(crawl(spark, [(1, "u", f"<p>{both}</p>"), (2, "u", None)]), network).collect())
    at = both.index(en)
    assert [p[:5] for p in parts] == [(1, 0, 0, at, "de"), (1, 0, at, len(both), "en")] and all(0.5 < p[5] <= 1 for p in parts)
    assert p5_language.language_segments(crawl(spark, []), network).count() == 0
    assert p5_language.block_languages(crawl(spark, []), network).count() == 0
    assert len(network.probabilities([])) == 0 and abs(network.probabilities(["x" * 100_000]).sum() - 1) < 1e-6


def test_segments_of_all_blocks(spark):
    text, lang = lines()
    network = p5_language.ByteCnn(["de", "en"]).fit(*zip(*[(t, x) for t, x in zip(text, lang) if x in ("de", "en")]), steps=200)
    blocks = ["Startseite", "wir müssen nicht", "What is it that she wants. And when will he be back", "1 + 2. 3", "7", "Ja! " * 300 + "Nein!"]
    html = "".join(f"<p>{b}</p>" for b in blocks)
    found = p5_language.language_segments(crawl(spark, [(1, "u", html), (2, "u", "<p></p>"), (None, "u", html)]), network).orderBy("crawl_id", "block_no", "start").collect()
    assert {r.crawl_id for r in found} == {1}
    for n, block in enumerate(blocks):
        own = [r for r in found if r.block_no == n]
        assert own[0].start == 0 and own[-1].end == len(block) and all(a.end == b.start for a, b in zip(own, own[1:]))
    assert [(r.block_no, r.lang, r.confidence) for r in found if r.lang is None] == [(3, None, 0.0), (4, None, 0.0)]
    assert all(0.5 <= r.confidence <= 1 for r in found if r.lang and len(blocks[r.block_no]) > 40)


def test_pages_without_repeated_lines(spark):
    html = lambda own: f"<p>Menu</p><p>{own}</p><p>Shared by all</p><p>Page 7</p>"
    rows = [(i, f"http://h/{i}", html(f"only {w}")) for i, w in enumerate("abcdef")]
    rows += [(0, "http://h/0", html("only a")), (0, "http://h/0", "<p>x</p><p>Menu</p>"), (7, "http://other/", html("only g")), (8, "http://h/8", "<p>MENU</p>"), (9, "http://h/9", None)]
    got = sorted(tuple(r) for r in p6_lines.cleaned_pages(crawl(spark, rows)).collect())
    want = [(i, f"only {w}") for i, w in enumerate("abcdef")] + [(0, "only a"), (0, "x"), (7, "Menu\nonly g\nShared by all\nPage 7"), (8, "")]
    assert got == sorted(want)
    assert p6_lines.cleaned_pages(crawl(spark, [])).count() == 0
