import html
import math
import random
import re
import statistics

import duckdb
import pyarrow as pa

from corpusloom.llm import html_text as ht
from corpusloom.llm import license_scan as ls
from corpusloom.llm.html_text import html_text, main_text


def test_pages_give_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    expected = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body))
        expected[r.page_id] = "\n".join(x for x in blocks if x)
    got = html_text(pages).collect()
    assert {r.page_id: r.text for r in got} == expected and all(r.n_chars == len(r.text) for r in got)


LONG = "word " * 40


def test_parts_that_are_no_article():
    page = f"""<html><head><title>T</title><style>p</style></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies {LONG}</div>
    <nav><a href=x>Home</a></nav><main><article><header><h1>Head &amp; line</h1></header><p>First   {LONG}</p><p>Short.</p><div class="ad-box ad">Buy {LONG}</div>
    <ul><li>One</li><li>Two</li></ul><script>var x = "<p>no</p>";</script><p>Last {LONG}</p><section class="comments"><article><p>Nice {LONG}</p></article></section></article></main>
    <aside>More {LONG}</aside><form><label>Mail</label><input></form><footer>End {LONG}</footer></body></html>"""
    w = LONG.strip()
    assert main_text(page) == f"Head & line\nFirst {w}\nShort.\nOne\nTwo\nLast {w}"


def test_endings_and_wrappers_stay():
    w = LONG.strip()
    ten, two = " ".join([w] * 10), " ".join([w] * 2)
    side = f"<div class='sidebar'><p>{LONG}</p></div>"
    assert main_text(f"<body><div class=post><section><p>{ten}</p></section><section><h2>End</h2><p>short ending</p></section></div></body>") == f"{ten}\nEnd\nshort ending"
    assert main_text(f"<body><article><p>{ten}</p></article>{side}<article><p>{two}</p></article></body>") == f"{ten}\n{two}"
    for name in ("content has-sidebar", "no-sidebar", "layout-with-menu"):
        assert main_text(f"<body><div class='{name}'><article><p>{ten}</p></article>{side}</div></body>") == ten
        assert main_text(f"<body><div class='{name}'><p>{ten}</p><p>x</p></div>{side}</body>") == f"{ten}\nx"
    assert main_text(f"<body><div class='search page'><div><p>{ten}</p><p>{ten}</p></div></div><div class=foot>tiny</div></body>") == f"{ten}\n{ten}"
    assert main_text(f"<body><div class='social page'><article><p>{ten}</p><div class='share'>Share it</div></article></div></body>") == ten
    # what is marked and no wrapper stays out
    assert main_text(f"<body><div><p>{ten}</p></div><div class='comments'><p>{ten}</p></div></body>") == ten
    assert main_text(f"<body><div class='related'><article><p>{LONG}</p></article></div><div><p>{ten}</p></div></body>") == ten


def brute_content(rows, sigma, threshold):
    """The clustering written out: (text, unlinked characters, tags) of each line to the texts of the content lines."""
    raw = [free / max(1, tags) for _, free, tags in rows]
    reach = max(1, int(-(-2 * sigma // 1)))
    smooth = []
    for i in range(len(raw)):
        near = [(math.exp(-k * k / (2 * sigma**2)), raw[min(max(i + k, 0), len(raw) - 1)]) for k in range(-reach, reach + 1)]
        smooth.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    mean = statistics.fmean(smooth)
    return [t for (t, _, _), r in zip(rows, smooth, strict=True) if r >= min(threshold * statistics.pstdev(smooth), mean)]


def test_clustering_equals_its_definition():
    rng = random.Random(3)
    for _ in range(50):
        rows = [(f"line {i}", rng.choice([0, 5, 40, 300, 900]), rng.randrange(1, 8)) for i in range(rng.randrange(1, 30))]
        lines = [ht.Line("x" * free + "y", tags, 1, 0, False, "p") for _, free, tags in rows]
        names = {id(x): t for x, (t, _, _) in zip(lines, rows, strict=True)}
        assert [names[id(x)] for x in ht.content_lines(lines, 1.0, 0.5)] == brute_content(rows, 1.0, 0.5)


def test_names_mark_whole_parts_only():
    w = LONG.strip()
    ten = " ".join([w] * 10)
    page = f"<body><article><p>{ten}</p><p class='share-price'>The price fell.</p><section id='search-methods'><p>How we searched.</p></section><section class='discussion'><p>We discuss.</p></section><p>{w}</p></article></body>"
    assert main_text(page) == f"{ten}\nThe price fell.\nHow we searched.\nWe discuss.\n{w}"
    assert main_text(f"<body><main><div class='notices-of-marriage'><p>{ten}</p><p>short</p></div></main></body>") == f"{ten}\nshort"
    assert main_text(f"<body><main><div class='notices'><p>{ten}</p><p>short</p></div></main></body>") == f"{ten}\nshort"
    for name in ("discussion", "comment-list", "userComments", "social-share", "cookie-banner", "related_posts", "ad-slot-2"):
        assert main_text(f"<body><article><p>{ten}</p><div class='{name}'><div><p>{w}</p></div><div><p>{w}</p></div></div><p>End.</p></article></body>") == f"{ten}\nEnd."


def test_adverts_of_links_only():
    w = LONG.strip()
    ten = " ".join([w] * 10)
    page = f"<body><article><h1><a href=/x>Linked title</a></h1><p>{ten}</p><p><a href=/buy>Buy the best words of all, now cheaper</a></p><div><a href=/a>One</a> <a href=/b>two</a></div><ul><li><a href=/1>m1</a></li><li><a href=/2>m2</a></li></ul><ul><li><a href=/1>First</a></li><li>own item</li></ul><p>With a <a href=/l>link</a>.</p></article></body>"
    assert main_text(page) == f"Linked title\n{ten}\nFirst\nown item\nWith a link."


def test_pages_without_an_article():
    w = LONG.strip()
    ten = " ".join([w] * 10)
    frame = "<body><div><a href=/>Home</a> <a href=/n>News</a></div>{}<div>Copyright 2020 Some House. All rights reserved.</div><div><a href=/i>Imprint</a></div></body>"
    assert main_text(frame.format(f"<div><h1>Title here</h1></div><div><p>{ten}</p><p>{ten}</p></div><div><p>A last sentence.</p></div>")) == f"Title here\n{ten}\n{ten}\nA last sentence."
    assert main_text(frame.format(f"<div><p>{ten}</p><p>{ten}</p></div>")) == f"{ten}\n{ten}"
    assert main_text(frame.format(f"<table><tr><td><h1>T</h1><p>{ten}</p><p>Short one.</p><p>{ten}</p></td></tr></table>")) == f"T\n{ten}\nShort one.\n{ten}"


def test_broken_pages(spark):
    deep = "<div>" * 20_000 + f"<p>{LONG}" * 3
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>cut &lt;off <b"), (4, "u", deep), (4, "u", deep), (None, None, "plain"), (6, "u", "<script>x")]
    got = html_text(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert [r.text for r in got] == ["", "", "cut <off", "\n".join([LONG.strip()] * 3), "\n".join([LONG.strip()] * 3), "plain", ""]
    assert html_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_statistics(lists, tokens):
    known = {tuple(x[i:j]) for x in lists for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    return [next((n for n in range(i + 1, 0, -1) if tuple(tokens[i + 1 - n : i + 1]) in known), 0) for i in range(len(tokens))]


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        lists = [[rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(3)]
        automaton = ls.SuffixAutomaton(lists)
        tokens = [rng.randrange(5) for _ in range(30)]
        sizes, states = automaton.statistics(tokens)
        assert sizes == brute_statistics(lists, tokens)
        for i, (n, s) in enumerate(zip(sizes, states, strict=True)):
            for which, end in automaton.ends[s].items() if n else ():
                assert lists[which][end + 1 - n : end + 1] == tokens[i + 1 - n : i + 1]


def test_base_places_equal_sql_and_spans(spark):
    texts = [
        "MIT License mit-license, gnu general PUBLIC license; cc by! Apache  License", None, "", "cc by cc by", "mit\nlicense " * 400, "x" * 200_000, "gnu general public licenses",
        "Intro. " + ls.TEMPLATES[0][1] + " Outro words follow here.", ls.TEMPLATES[4][1].replace("binary", "any other"),
    ]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, "mit license", "c")]
    got = ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": range(len(texts)), "text": texts}))
    expected = {r[0]: r[1:] for r in con.execute(ls.BASE_SQL).fetchall()}
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[7].labels == "mit" and by[7].spans[0].start == 1 and by[7].score > 0.9 and by[8].labels == "bsd" and by[1].labels == ""
    assert ls.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_that_are_left_open_end_with_their_block():
    w = LONG.strip()
    ten = " ".join([w] * 10)
    assert main_text(f"<div><p><a href=x>top link</p><p>{ten}</p><p>{w}</p></div>") == f"{ten}\n{w}"
    assert main_text(f"<article><h1>Head</h1><p><a href=x>{w}<p>{ten}</p><a href=y>next <p>{w}</p></article>") == f"Head\n{ten}\n{w}"
    assert main_text(f"<article><div><a href=x>one<a href=y>two</a></div><p>{ten}</p></article>") == ten
    # a link around blocks that is closed covers them all
    assert main_text(f"<article><p>{ten}</p><a href=x><div><h4>Card</h4><p>Buy the {w}</p></div></a><p>{w}</p></article>") == f"{ten}\nCard\n{w}"


def test_open_links_never_empty_a_page():
    rng = random.Random(21)
    ten = "word " * 60
    for _ in range(200):
        parts = []
        for k in range(rng.randrange(2, 6)):
            link = rng.choice(["", "", f"<a href=/{k}>", f"<a href=/{k}>here", f"<a href=/{k}>here</a>"])
            parts.append(f"<p>{rng.choice(['', link])}{'' if rng.random() < 0.5 else 'Start '}{link} x {ten} end{k}.{rng.choice(['</p>', ''])}")
        got = main_text(f"<html><body><article><h1>T</h1>{''.join(parts)}<p>{ten}</p></article></body></html>")
        assert got.endswith(ten.strip()) and got.startswith("T")


def test_deep_and_wide_pages_take_linear_time():
    import time

    for page in ("<div>" * 20_000 + "text", "<div>" * 4000 + "".join(f"<p>line {k}</p>" for k in range(4000)), "<ul>" * 3000 + "<li><a href=x>a</a>" * 3000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 2.5
