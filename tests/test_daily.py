"""The composed daily run (P1): invariants between its outputs at sf0.001."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from feedloom.plans import fixtures as X
from feedloom.plans.daily import RULE_COLS, run_day
from feedloom.sources.tables import read_table


def test_run_day_outputs_are_consistent(spark):
    pages = read_table(spark, SF_SMALL, "pages").select("page_id", "url", "html")
    seen0 = X.seen_view(pages)
    out = run_day(X.entries_view(pages), pages.select("url", "html"), X.rules_view(spark, *RULE_COLS), seen0,
                  X.state_view(pages), X.run_ts(), "2024-01-12", "Fri", rule_key="rule_key")
    items = out["items"]
    n_items = items.count()
    assert n_items > 0
    # numbering is dense per feed
    per_feed = items.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.max("item_no").alias("mx"),
                                         F.min("item_no").alias("mn"))
    assert per_feed.filter((F.col("mn") != 0) | (F.col("mx") != F.col("n") - 1)).count() == 0
    # one index document per feed with items, counting them
    idx = out["index"].groupBy("feed").agg(F.count_if(F.col("block").startswith('<p><a name="') & ~F.col("block").contains("</html>")).alias("n"),
                                           F.max_by("block", "seq").alias("last")).collect()
    assert sorted((r.feed, r.n) for r in idx) == sorted((r.feed, r.n) for r in per_feed.collect())
    assert all(r.last.endswith("</html>\n") for r in idx)
    # story pages only for levels above 1, at most one per item
    stories = out["stories"]
    assert stories.count() <= items.filter(F.col("levels") > 1).count()
    assert stories.groupBy("feed", "page_no").count().filter(F.col("count") > 1).count() == 0
    # the seen-set only grows; registered sites get the run time
    assert out["seen"].join(seen0, ["site", "item_id"], "left_anti").count() > 0
    assert seen0.join(out["seen"], ["site", "item_id"], "left_anti").count() == 0
    run = X.run_ts()
    assert out["state"].filter(F.col("last_fed") == run).count() > 0
    # every reject has a stage and a reason
    assert out["rejects"].filter(F.col("reason").isNull() | F.col("stage").isNull()).count() == 0


def test_run_day_story_links_are_absolute(spark):
    pages = read_table(spark, SF_SMALL, "pages").select("page_id", "url", "html")
    out = run_day(X.entries_view(pages), pages.select("url", "html"), X.rules_view(spark, *RULE_COLS),
                  X.seen_view(pages), X.state_view(pages), X.run_ts(), "2024-01-12", "Fri", rule_key="rule_key")
    stories = out["stories"]
    assert stories.count() > 0
    assert stories.filter(F.col("html").contains('href="/')).count() == 0
    assert stories.filter(F.col("html").contains("<script")).count() == 0


def test_absolute_links(spark):
    from feedloom.functions import html as H
    df = spark.createDataFrame([('<a href="/a">x</a><a href="b.html">y</a><a href="/a">z</a>',)], "h string")
    got = df.select(H.absolute_links("h", F.lit("http://s.org/d/p.html"))).first()[0]
    assert got == ('<a href="http://s.org/a">x</a><a href="http://s.org/d/b.html">y</a>'
                   '<a href="http://s.org/a">z</a>')


# ---------------------------------------------------------------- small days, whole texts
ENTRY = "feed string, rule_key string, pos bigint, id string, guid string, link string, title string, content string, published string, author string"


def small_day(spark, entries, pages, rule=None, page_schema="url string, html string", seen=(), state=(), **options):
    from feedloom.sources.rules import rules_from_rows
    rows = [dict(rule_key="k", levels=2.0, min_width=3, **(rule or {})), dict(rule_key="half", levels=1.5, min_width=3),
            dict(rule_key="one", levels=1.0, min_width=3)]
    full = [(f, k, i, u, None, u, t, c, None, a) for f, k, i, u, t, c, a in entries]
    return run_day(spark.createDataFrame(full, ENTRY), spark.createDataFrame(pages, page_schema),
                   rules_from_rows(spark, rows, key="rule_key"), spark.createDataFrame(list(seen), "site string, item_id string"),
                   spark.createDataFrame(list(state), "site string, last_fed timestamp"), X.run_ts(), "2024-01-12", "Fri",
                   rule_key="rule_key", **options)


def texts(out):
    index = {}
    for r in out["index"].orderBy("feed", "seq").collect():
        index[r.feed] = index.get(r.feed, "") + r.block
    stories = {(r.feed, r.page_no): r.html for r in out["stories"].collect()}
    return stories, index


def story(feed, key, i, title="T", content="", author=None):
    return (feed, key, i, f"http://{feed}/{i}", f"{title}{i}", content, author)


def test_stories_that_come_to_nothing_leave_the_numbering(spark):
    entries = [story("a.org", "k", i, author="Ann" if i == 0 else None) for i in range(6)] + [story("b.org", "k", 7)]
    pages = [("http://a.org/0", "<body><p>zero</p></body>"), ("http://a.org/1", "<body> &nbsp;<!-- x --><p></p></body>"),
             ("http://a.org/3", "<body>skip me</body>"), ("http://a.org/4", "<body><img src='/i.png'></body>"),
             ("http://a.org/5", '<html><body><h1>H</h1><meta http-equiv="refresh" content="0; url=/n">five</body>'
                                '<body class=x>more</body>')]
    out = small_day(spark, entries, pages, {"skip_content_pats": ["skip me"], "skip_images": False, "nonlocal_images": True})
    stories, index = texts(out)
    assert sorted(stories) == [("a.org", 0), ("a.org", 1), ("a.org", 2)]
    assert "<h1>T0</h1>" in stories["a.org", 0] and "By: Ann\n<p>\n" in stories["a.org", 0]
    assert "<h1>T4</h1>" in stories["a.org", 1] and "<img" in stories["a.org", 1]
    assert 'Meta refresh suppressed.<br /><a href="/n">/n</a><h1>H</h1>' in stories["a.org", 2]
    assert "five" in stories["a.org", 2] and "<body class" not in stories["a.org", 2]
    assert list(index) == ["a.org"]  # a feed of which nothing is shown has no index
    order = [index["a.org"].index(x) for x in ('"0.html"', 'No content for <a href="http://a.org/1">T1</a>',
                                               'http://a.org/2">T2', 'http://a.org/3">T3', '"1.html"', '"2.html"', "[end]")]
    assert order == sorted(order) and index["a.org"].count("[end]") == 1 and 'name="3"' in index["a.org"]
    assert {(r.item_id, r.stage, r.severity, r.reason) for r in out["rejects"].collect()} == {
        ("http://a.org/1", "content", "warn", "No real content"),
        ("http://a.org/2", "fetch", "error", "No content for http://a.org/2"),
        ("http://a.org/3", "content", "info", "no content: matched skip me"),
        ("http://b.org/7", "fetch", "error", "No content for http://b.org/7")}
    # failed stories stay registered; the site that showed nothing does not
    assert {(r.site, r.item_id) for r in out["seen"].collect()} == {("a.org", f"http://a.org/{i}") for i in range(6)}
    assert {r.site for r in out["state"].collect()} == {"a.org"}
    assert sorted(r.path for r in out["manifest"].collect()) == sorted(
        ["01_aorg/", "01_aorg/0.html", "01_aorg/1.html", "01_aorg/2.html", "01_aorg/index.html", ".EOF."])


def test_levels_excerpts_and_index_text(spark):
    entries = [story("c.org", "half", 0, content='<h2 style="x:1">c</h2><a href="/l">l</a>'), story("c.org", "half", 1, content=" "),
               story("d.org", "one", 2, content="<p>long text that is cut", author="Bob")]
    out = small_day(spark, entries, [], None)
    stories, index = texts(out)
    assert list(stories) == [("c.org", 0)]
    body = '<h1>T0</h1>\n<h2 style="x:1">c</h2><a href="http://c.org/l">l</a>\n'
    assert body in stories["c.org", 0] and body in index["c.org"]  # a 1.5-level index shows the cleaned story
    assert "By: Bob" in index["d.org"] and "[[<a href=\"http://d.org/2\">" in index["d.org"]


def test_timeouts_stop_a_feed_unless_it_goes_on(spark):
    entries = [story("a.org", "k", i) for i in range(4)]
    pages = [(f"http://a.org/{i}", f"<body>b{i}</body>", i == 1) for i in range(4)]
    schema = "url string, html string, timed_out boolean"
    out = small_day(spark, entries, pages, None, schema)
    assert sorted(texts(out)[0]) == [("a.org", 0)]
    assert {(r.item_id, r.reason) for r in out["rejects"].collect()} == {
        ("http://a.org/1", "Socket timeout for http://a.org/1"), ("http://a.org/2", "not tried after a timeout"),
        ("http://a.org/3", "not tried after a timeout")}
    assert {r.item_id for r in out["seen"].collect()} == {"http://a.org/0", "http://a.org/1"}
    out = small_day(spark, entries, pages, {"continue_on_timeout": True}, schema)
    assert sorted(texts(out)[0]) == [("a.org", 0), ("a.org", 1), ("a.org", 2)]


def test_bytes_types_redirects_further_pages_and_containers(spark):
    entries = [story("a.org", "k", i) for i in range(4)]
    pages = [("http://a.org/final", "text/html", '<meta charset="iso-8859-1"><body><nav>menu</nav><article>café</article></body>'.encode("latin-1")),
             ("http://a.org/1", "image/png", b"\x89PNG"),
             ("http://a.org/2", "text/html; charset=utf-8", '<body>pé1 <a href="/2?page=3">3</a><a href="/2?page=2">2</a></body>'.encode()),
             ("http://a.org/2?page=2", "", b'<body>second <a href="/2?page=9">9</a></body>'),
             ("http://a.org/2?page=3", "", b'<body>third</body>'), ("http://a.org/2?page=9", "", b"<body>ninth</body>")]
    redirects = spark.createDataFrame([("http://a.org/0", "http://a.org/final"), ("http://a.org/0", "http://a.org/z")],
                                      "url string, final_url string")
    out = small_day(spark, entries, pages, {"multipage_pat": "page=[0-9]+"}, "url string, content_type string, body binary",
                    redirects=redirects, containers={"k": ["article"]})
    stories, _ = texts(out)
    assert len(stories) == 3
    assert "café" in stories["a.org", 0] and "menu" not in stories["a.org", 0]
    assert "Contents not text! (image/png)" in stories["a.org", 1]
    # further pages in the order of their links; pages of further pages are not followed
    body = stories["a.org", 2]
    assert "pé1" in body and body.index("third") < body.index("second") and "ninth" not in body and body.count("<h1>") == 1


def test_due_fed_and_configured_sites(spark):
    import datetime as dt
    from feedloom.operators.plugins import row_plugin
    entries = [story("a.org", "k", 0), story("b.org", "k", 1), story("c.org", "k", 2), story("d.org", "k", 3)]
    pages = [(f"http://{f}.org/{i}", "<body>x</body>") for i, f in enumerate("abcd")]
    fed = spark.createDataFrame([("2024-01-12", "b.org"), ("2024-01-11", "a.org")], "day string, feed string")
    sites = spark.createDataFrame([(f"{f}.org",) for f in "abc"], "feed string")
    out = small_day(spark, entries, pages, {"when": "mo"}, seen=[("a.org", "old"), ("gone.org", "old")],
                    state=[("c.org", dt.datetime(2024, 1, 11)), ("d.org", dt.datetime(2024, 1, 7)), ("a.org", dt.datetime(2024, 2, 1))],
                    fed=fed, sites=sites, gate=True, plugins={"d.org": row_plugin(lambda url, html: html.replace("x", "from " + url))})
    stories, _ = texts(out)
    # a.org: its last run lies ahead (an error), b.org is done, c.org is not due, d.org had a Monday since
    assert list(stories) == [("d.org", 0)] and "from http://d.org/3" in stories["d.org", 0]
    assert {(r.feed, r.stage, r.severity, r.reason) for r in out["rejects"].collect()} == {
        ("a.org", "schedule", "error", "negative span"), ("c.org", "schedule", "info", "not due: mo")}
    assert {(r.site, r.item_id) for r in out["seen"].collect()} == {("a.org", "old"), ("d.org", "http://d.org/3")}
