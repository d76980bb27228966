"""op1 against its SQL and a plain loop; op8 against the pages' articles."""

import html
import time
import re
from datetime import datetime

import duckdb
import pytest

from plinth.llm import html_text as H
from plinth.llm import url_filter as U
from plinth.llm.queries import ORACLE_SQL, QUERIES


def test_op1_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    got = QUERIES["op1_url_filter"](spark, d)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL['op1_url_filter']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[-1] for r in want)


def captures(spark):
    day = lambda m, n=1: datetime(2024, m, n)
    rows = [(1, "HTTP://user@Sub.Bad.example:80/a/b?q#f", day(3)), (2, "http://sub.bad.example./a/b", day(6)), (3, "http://notbad.example/", day(3)), (None, None, day(3)), (5, "http://bad.example", None), (6, "mailto:x", day(3)), (7, "http://ok.example/ads/x/", day(3)), (7, "http://ok.example/ads/x/", day(3)), (8, "http://ok.example/adsx", day(3)), (9, "http://tie.example/", day(2)), (10, "http://ok.example/ads", day(3))]
    lists = [("l", "domain", "Bad.example", "add", day(2)), ("l", "domain", "bad.example", "remove", day(5)), ("m", "host", "sub.bad.example", "add", day(5)), ("m", "prefix", "ok.example/ads/", "add", day(1)), ("m", "prefix", "ok.example/ads", "add", day(1)), ("t", "host", "tie.example", "add", day(2)), ("t", "host", "tie.example", "remove", day(2)), ("n", None, "ok.example", "add", day(1)), ("n", "host", "ok.example", "look", day(1))]
    return spark.createDataFrame([(*r, "k", "v") for r in rows], "page_id long, url string, fetched_at timestamp, key string, matches string"), spark.createDataFrame(lists, U.ENTRIES)


WANT = {1: "l=domain:bad.example", 2: "m=host:sub.bad.example", 3: "", None: "", 5: "", 6: "", 7: "m=prefix:ok.example/ads", 8: "", 9: "", 10: "m=prefix:ok.example/ads"}


def test_op1_edges_and_both_joins(spark, monkeypatch):
    caps, lists = captures(spark)
    for limit in (U.BROADCAST_ROWS, 0):
        monkeypatch.setattr(U, "BROADCAST_ROWS", limit)
        rows = U.url_filter(caps, lists).collect()
        assert len(rows) == 11
        assert all(r.matches == WANT[r.page_id] and r.blocked == bool(r.matches) for r in rows)
    assert U.url_filter(caps.limit(0), lists).count() == 0
    assert not any(r.blocked for r in U.url_filter(caps, lists.limit(0)).collect())


def article(page):
    inner = page.split("<article>")[1].split("</article>")[0]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))).split())


def test_op8_on_the_pages(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = QUERIES["op8_html_text"](spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_op8_markup():
    text = "One long sentence of the article that goes on and on for a while, with a <a href='/x'>link</a> in it. " * 4
    page = f"""<!DOCTYPE html><html><body><header><h1>Site</h1></header><div class='menu-top'><a href=/>Home</a> <a href=/b>B</a></div>
    <div id=main><div><h2>Head&amp;line</h2><p>{text}<p>Short.<br>Line &nbsp; two &lt;b&gt;<p>{text}</div><div class="comments"><p>{text}</p></div></div>
    <aside>{text}</aside><form>{text}</form><script>var a = "<p>{text}</p>";</script><div class="cookie-notice">{text}</div><!-- <p>{text}</p> --><footer>{text}</footer></body></html>"""
    plain = " ".join(re.sub("<[^>]*>", "", text).split())
    assert H.main_text(page) == f"Head&line {plain} Short. Line two <b> {plain}"
    assert H.main_text("<p>only a <i>frag</i>ment") == "only a fragment"
    assert H.main_text("no markup") == "no markup"
    assert [H.main_text(x) for x in (None, "", "<", "<div><nav>x</nav></div>", "<script>x")] == ["", "", "<", "", ""]
    assert H.main_text("<div>" * 30000 + "deep") == "deep"
    assert H.main_text("<article><p>" + "word " * 100000) == " ".join(["word"] * 100000)


def test_op8_edges(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (2, "u", "<p>a", 1), (2, "u", "<p>a", 1)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, H.extract(pages).collect()), key=str) == sorted([(None, None, "", 0), (1, "u", "", 0), (2, "u", "a", 1), (2, "u", "a", 1)], key=str)
    assert H.extract(pages.limit(0)).count() == 0


def test_native_queries_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    for name in ("op2_secret_scan", "op7_quality_rules"):
        got = QUERIES[name](spark, sf)
        want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_op8_wrappers_do_not_cut_the_article():
    text = "One long sentence of the article that goes on and on for a while, and then some more. " * 4
    plain = text.strip()
    for wrap in ("div class='content has-sidebar'", "div id=page-header-wrap", "div class=search", "form action=/x", "div class='share-widget'"):
        page = f"<html><body><nav><a href=/>Home</a></nav><{wrap}><div><p>{text}<p>{text}</div><div class=comments><p>{text}</div></{wrap.split()[0]}></body></html>"
        assert H.main_text(page) == f"{plain} {plain}", wrap
    assert H.main_text(f"<body><main><p>{text}</main><div class='comments'><p>{text}<p>{text}</div></body>") == plain
    assert H.main_text(f"<body><div><p>{text}<p>{text}<section class='related-work'><p>{text}</section></div><div class='cookie-notice'>{text}</div></body>") == f"{plain} {plain} {plain}"


def plain_page(paragraphs, menu=12, foot=1):
    """A page of plain divs: a menu of links, the article, more links and a short last line."""
    links = "".join(f"<div><a href=/{i}>Topic {i}</a></div>" for i in range(menu))
    body = "".join(f"<div>{p}</div>" for p in paragraphs)
    return f"<html><body><div>{links}</div><div><h2>Title</h2><div>{body}</div></div><div>{links}</div>" + "<div>(c) All rights.</div>" * foot + "</body></html>"


def test_op8_density_decides_on_plain_divs(monkeypatch):
    long = [f"Sentence {i} of the article says this and that, and goes on for quite a while. " * 3 for i in range(6)]
    want = " ".join(" ".join(["Title", *long]).split())
    assert H.main_text(plain_page(long)) == want
    short = [*long[:2], "Brief.", *long[2:]]
    assert H.main_text(plain_page(short, menu=60, foot=9)) == " ".join(" ".join(["Title", *short]).split())
    monkeypatch.setattr(H, "density", lambda chars, *_: 1.0 if chars else 0.0)
    assert H.main_text(plain_page(long)) != want


def test_op8_density_alone_finds_most_articles(monkeypatch):
    import pyarrow.parquet as pq

    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    for name in ("ASIDE", "CUT_NAMES", "MAIN"):
        monkeypatch.setattr(H, name, frozenset())
    assert sum(H.main_text(p) == article(p) for p in pages) >= 0.9 * len(pages)


def test_op8_parts_of_an_article_join():
    long = "Sentence of the article says this and that, and goes on for quite a while. " * 4
    page = f"<body><div><h1>Top</h1><div><p>{long}<p>{long}<p>{long}</div><div><p>Between.</div><div><p>{long}<p>{long}</div></div><div><a href=/>{long}</a></div></body>"
    assert H.main_text(page) == " ".join(f"Top {long} {long} {long} Between. {long} {long}".split())


def test_op8_deep_pages_take_time_in_proportion():
    for page in ("<div>" * 40000 + "deep", "<div><td>" * 20000 + "deep" + "</x>" * 20000, "<b>" * 40000 + "deep" + "</i>" * 40000):
        began = time.process_time()
        assert H.main_text(page) == "deep"
        assert time.process_time() - began < 1.5


PROSE = ["Sentence of the article says this and that, and goes on for quite a while. " * 3, "Another paragraph adds more, with details that matter to the reader. " * 3]


@pytest.mark.parametrize("name", ["comments", "comment-list", "comments-area", "user-comments", "comment-section", "responses", "comment-thread-7", "cookie-consent", "ad-slot", "sponsored-content", "related-posts", "site-footer", "sidebar"])
@pytest.mark.parametrize("size", [0.5, 1, 4])
def test_op8_named_branches_never_replace_the_article(name, size):
    want = " ".join("".join(PROSE).split())
    other = "".join(f"<div><p>{PROSE[0] if size >= 1 else PROSE[0][:110]}</p></div>" for _ in range(max(1, int(2 * size))))
    article = "".join(f"<p>{p}</p>" for p in PROSE)
    for page in (f"<body><div><div>{article}</div><div class='{name}'>{other}</div></div></body>", f"<body><div id='{name}'>{other}</div><div>{article}</div></body>", f"<body><div>{article}<section class='x {name}'>{other}</section></div></body>"):
        assert H.main_text(page) == want, page


def test_op1_long_urls_have_few_keys(spark):
    """A URL of a megabyte, deep in path and host, against entries of several depths."""
    deep = "/".join(f"p{i}" for i in range(150_000))
    day = datetime(2024, 5, 1)
    captures = spark.createDataFrame([(1, f"http://a.b.example.com/{deep}", day), (2, "http://" + "x." * 400_000 + "example.com/p0", day), (3, "http://example.com", day)], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("l", "prefix", "a.b.example.com/p0/p1/p2/", "add", day), ("l", "prefix", "a.b.example.com/p0/p2", "add", day), ("m", "domain", "example.com", "add", day), ("n", "prefix", "example.com", "add", day), ("o", "domain", "b.example.com", "add", day)], U.ENTRIES)
    began = time.time()
    got = {r.page_id: r.matches for r in U.url_filter(captures, entries).collect()}
    assert got == {1: "l=prefix:a.b.example.com/p0/p1/p2,m=domain:example.com,o=domain:b.example.com", 2: "m=domain:example.com", 3: "m=domain:example.com,n=prefix:example.com/"}
    assert time.time() - began < 60


def unmarked(page):
    """The page without what names the article or its surroundings."""
    page = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_op8_density_changes_pages_without_names(monkeypatch):
    import pyarrow.parquet as pq

    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    read = [H.main_text(unmarked(p)) for p in pages]
    right = sum(r == article(p) for r, p in zip(read, pages))
    monkeypatch.setattr(H, "density", lambda chars, *_: 1.0 if chars else 0.0)
    other = [H.main_text(unmarked(p)) for p in pages]
    assert right >= 0.9 * len(pages) and sum(a != b for a, b in zip(read, other)) >= 0.1 * len(pages)
    assert sum(r == article(p) for r, p in zip(other, pages)) < right


def test_op8_densities_and_sums_equal_a_plain_count():
    """Every node's measures, counted by walking its whole subtree again."""
    import math

    page = f"<body><div><a href=/>Home</a> <a href=/b>B b</a></div><div><h1>Top</h1><p>{PROSE[0]}<a href=/c>more</a> to read</p><p>{PROSE[1]}</p><div class=comments><p>{PROSE[0]}</p></div></div></body>"
    read = H.Page(page)
    tree, n = read.tree, len(read.tree.tag)
    inside = [[j for j in range(n) if _below(tree.up, j, i) and not read.cut[j]] for i in range(n)]
    chars = [sum(len("".join(t.split())) for k, t in read.items if t and k in set(js)) for js in inside]
    linked = [sum(len("".join(t.split())) for k, t in read.items if t and k in set(js) and any(tree.tag[a] == "a" for a in _above(tree.up, k))) for js in inside]
    share = linked[read.body] / chars[read.body]
    for i in range(n):
        if read.cut[i]:
            continue
        tags, link_tags = len(inside[i]) - 1, sum(tree.tag[j] == "a" for j in inside[i] if j != i)
        assert (read.chars[i], read.in_link[i], read.tags[i], read.link_tags[i]) == (chars[i], linked[i], tags, link_tags)
        if chars[i]:
            c, lc, t, lt = chars[i], linked[i] or 1, tags or 1, link_tags or 1
            base = math.log(c / ((c - linked[i]) or 1) * linked[i] + share * c + math.e)
            want = c / t * math.log(max(c * t / (lc * lt), 1.0)) / (math.log(base) if base > 1 + 1e-9 else 1.0)
            assert math.isclose(read.dense[i], want, rel_tol=1e-9)
        own = sum(len("".join(x.split())) for k, x in read.items if x and k == i)
        alone = H.density(own, 0, own if any(tree.tag[a] == "a" for a in _above(tree.up, i)) else 0, 0, share) if own else 0.0
        assert math.isclose(read.total[i], alone + sum(read.dense[j] for j in range(1, n) if tree.up[j] == i), rel_tol=1e-9, abs_tol=1e-12)


def _above(up, i):
    while i >= 0:
        yield i
        i = up[i]


def _below(up, j, i):
    return i in set(_above(up, j))
