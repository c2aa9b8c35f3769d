"""Nothing is cut, dropped or swallowed: guards raise, restarts keep ids, null sites stay."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from feedloom.functions import dates
from feedloom.functions import html as H
from feedloom.operators.entries import dedup_greedy
from feedloom.operators.graph import reachable
from feedloom.operators.plugins import apply_plugins, row_plugin
from feedloom.session import ensure_checkpoint_dir, path_exists
from feedloom.sources.feeds import read_entries
from feedloom.streaming import incremental as INC


def _chain(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src bigint, dst bigint")
    return edges, spark.createDataFrame([(0,)], "node bigint"), spark.createDataFrame([(i,) for i in range(n)], "node bigint")


def test_reachability_guard_raises_instead_of_cutting(spark):
    with pytest.raises(RuntimeError, match="not finished"):
        reachable(*_chain(spark, 6), max_rounds=3)
    assert reachable(*_chain(spark, 6)).count() == 7


def test_greedy_guard_raises_instead_of_dropping(spark):
    rows = [("f", i, f"id{i // 2}", f"t{(i + 1) // 2}") for i in range(8)]
    e = spark.createDataFrame(rows, "feed string, pos bigint, item_id string, title string")
    with pytest.raises(RuntimeError, match="undecided"):
        dedup_greedy(e, max_rounds=1)
    kept, ids, titles = [], set(), set()
    for _, pos, i, t in rows:
        if i not in ids and t not in titles:
            kept.append(pos)
            ids.add(i)
            titles.add(t)
    assert sorted(r.pos for r in dedup_greedy(e).collect()) == kept


def test_null_site_keeps_its_page_and_reasons_are_whole(spark):
    def bad(url, html):
        raise type("E" + "x" * 400, (Exception,), {})

    pages = spark.createDataFrame([(1, "s", "u", "a"), (2, None, "u", "b"), (3, "o", "u", "c"), (4, "bad", "u", "d")],
                                  "page_id bigint, site string, url string, html string")
    up = row_plugin(lambda url, html: html.upper())
    ok, rejects = apply_plugins(pages, {"s": up, "bad": row_plugin(bad)})
    assert sorted((r.page_id, r.html) for r in ok.collect()) == [(1, "A"), (2, "b"), (3, "c")]
    assert [r.reason.endswith("E" + "x" * 400) for r in rejects.collect()] == [True]


def test_seen_ids_survive_a_restart_with_a_new_checkpoint(spark):
    d = tempfile.mkdtemp(prefix="feedloom-guard-")
    seen = f"{d}/seen"
    for run, ids in enumerate((["a", "b"], ["c", "a"])):
        src = f"{d}/src{run}"
        spark.createDataFrame([("s", i) for i in ids], "site string, item_id string").write.parquet(src)
        (spark.readStream.schema("site string, item_id string").parquet(src).writeStream
         .foreachBatch(INC.seen_set_batch_writer(seen, ["site", "item_id"]))
         .option("checkpointLocation", f"{d}/cp{run}").trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.item_id for r in spark.read.parquet(seen).collect()) == ["a", "b", "c"]


def test_republication_ttl_survives_late_ids(spark):
    d = tempfile.mkdtemp(prefix="feedloom-ttl-")
    day = dt.datetime(2024, 1, 1)
    schema = "site string, item_id string, ts timestamp, allow_repeats boolean"
    for i, n in (("a", 0), ("z", 20), ("a", 14)):
        spark.createDataFrame([("s", i, day + dt.timedelta(days=n), True)], schema).coalesce(1).write.mode("append").parquet(f"{d}/src")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/src")
    q = (INC.republications(s, "7 days", 7 * 86_400_000).writeStream.format("parquet").option("path", f"{d}/out")
         .option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
    assert {r.item_id for r in spark.read.parquet(f"{d}/out").collect()} == {"a", "z"}


def test_styles_go_from_tags_only(spark):
    df = spark.createDataFrame([("""<p class="a" style='COLOR:red'>x style="color:red" y</p><i style="color:red" id=k>z</i>""",)], "h string")
    r = df.select(H.drop_color_styles(F.col("h")).alias("c"), H.simplify(F.col("h")).alias("s")).first()
    assert r.c == """<p class="a">x style="color:red" y</p><i id=k>z</i>""" and r.s == r.c + " ... "


def test_iso_dates(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T04:04:05.250+01:00",), ("Tue, 02 Jan 2024 03:04:05 GMT",),
                                ("2024-01-02T03:04+00:00",), ("soon",), (None,)], "t string")
    assert [r.s for r in df.select(F.unix_seconds(dates.parse_feed_date(F.col("t"))).alias("s")).collect()] == [
        1704164645, 1704164645, 1704164645, 1704164640, None, None]


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Tide log</title>
<entry><id>t:1</id><title>High &amp; low</title><link rel="self" href="/s"/><link href="http://a.test/1" type="text/html"/>
<author><name>Kim</name></author><published>2024-01-02T03:04:05Z</published><content type="html">&lt;p&gt;x&lt;/p&gt;</content></entry>
<entry><id>t:2</id><title>Two</title></entry></feed>"""
DC = """<rdf:RDF xmlns:rdf="r" xmlns:dc="d" xmlns:content="c"><channel><title>Hills</title></channel>
<item><title>One</title><link>http://h.test/1</link><dc:creator>Lee</dc:creator><dc:date>2024-01-02T03:04:05Z</dc:date>
<content:encoded>body</content:encoded></item></rdf:RDF>"""


def test_feed_files_become_entries(spark):
    d = tempfile.mkdtemp(prefix="feedloom-feeds-")
    for name, text in (("a.xml", ATOM), ("b.rdf", DC)):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    got = {r.title: r for r in read_entries(spark, d).collect()}
    a, b, c = got["High & low"], got["Two"], got["One"]
    assert (a.feed, a.pos, a.id, a.link, a.author, a.content) == ("Tide log", 0, "t:1", "http://a.test/1", "Kim", "<p>x</p>")
    assert [(x.href, x.rel) for x in a.links] == [("/s", "self"), ("http://a.test/1", "alternate")]
    assert b.pos == 1 and b.link is None
    assert (c.feed, c.author, c.published, c.content) == ("Hills", "Lee", "2024-01-02T03:04:05Z", "body")


def test_paths_and_checkpoint_folder(spark):
    base = ensure_checkpoint_dir(spark)
    assert base and ensure_checkpoint_dir(spark) == base
    assert path_exists(spark, "/root/testdata/sf0.001/pages.parquet") and not path_exists(spark, "/no/such")


def test_links_of_all_quote_forms_and_only_in_a_tags(spark):
    page = """<a href='/s'>1</a> <A class="x" HREF="/a">2</a><a href=/u>3</a><link href="/a"> href="/a" <a name=n>4</a><a title='a > b' href='q"r'>"""
    df = spark.createDataFrame([(page, "http://h.test/"), ("none", "http://h.test/"), (None, "x")], "h string, b string")
    got = [tuple(r) for r in df.select(H.hrefs(F.col("h")), H.absolute_links(F.col("h"), F.col("b"))).collect()]
    assert got[0][0] == ["/s", "/a", "/u", 'q"r']
    assert got[0][1] == ("""<a href="http://h.test/s">1</a> <A class="x" href="http://h.test/a">2</a><a href="http://h.test/u">3</a>"""
                         """<link href="/a"> href="/a" <a name=n>4</a><a title='a > b' href="http://h.test/q&quot;r">""")
    assert got[1][1] == "none" and got[2][1] is None


PATTERNS = [r"{foo}", r"a{,2}b", r"[[]x", r"[a&&b]+", r"\w+", r"x.", r"[]y]z", r"(?P<q>\d)-(?P=q)", r"é\b", r"[^]a]"]


@pytest.mark.parametrize("pat", PATTERNS)
def test_rule_patterns_mean_what_python_means(spark, pat):
    import re

    from feedloom.functions.regex import python_pattern_to_java
    texts = ["{foo} bar", "aab b", "[x", "&& a&b", "café x", "x\r\nx\n", "]z yz", "٣-٣ 4-4", "é e", "]abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.regexp_replace("t", python_pattern_to_java(pat), "#")).collect()]
    assert got == [re.sub(pat, "#", t) for t in texts]


def test_unsound_patterns_are_rejects(spark):
    from feedloom.sources.rules import prepare_rules, rules_from_rows
    rules = rules_from_rows(spark, [dict(feed="a", skip_nodes=['div class="["', 'p class="ad"'], multipage_pat="(",
                                         url_substitute=["(", "x"], skip_pats=["{foo}"])])
    fixed, rejects = prepare_rules(rules)
    r = fixed.first()
    assert (r.skip_nodes, r.multipage_pat, r.url_substitute) == (['p class="ad"'], None, [])
    assert sorted(x.reason.split(":")[0] for x in rejects.collect()) == ["multipage_pat", "skip_nodes", "url_substitute"]
