"""Written outputs: manifest order, index documents in rows, single-page versions, container specs."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from feedloom.functions import tree
from feedloom.operators import pages as PG
from feedloom.sinks import documents as D


def test_manifest_file_ends_with_the_sentinel(spark):
    files = spark.createDataFrame([(d, p) for d in ("d1", "d2") for p in ("b/1.html", "a/2.html", "a/pic.png", "x.css")],
                                  "day string, path string")
    out = tempfile.mkdtemp(prefix="feedloom-out-")
    D.write_manifest(D.manifest(files), out)
    for d in ("d1", "d2"):
        lines = [line for f in sorted(glob.glob(f"{out}/day={d}/part-*")) for line in open(f).read().splitlines()]
        assert lines == ["a/", "a/2.html", "b/", "b/1.html", "a/pic.png", "x.css", ".EOF."]


def test_index_rows_spell_the_index_documents(spark):
    blocks = spark.createDataFrame([("d", f, i, f"<{f}{i}>", "Fri", "T") for f in ("a", "b") for i in range(1, 13)],
                                   "day string, feed string, item_no int, block string, day_name string, title string")
    want = {r.feed: r.index_html for r in D.index_documents(blocks).collect()}
    out = tempfile.mkdtemp(prefix="feedloom-out-")
    D.write_index_rows(D.index_rows(blocks), out)
    got = {}
    for f in sorted(glob.glob(os.path.join(out, "day=d", "part-*"))):
        for r in spark.read.parquet(f).collect():
            got[r.feed] = got.get(r.feed, "") + r.block
    assert got == want


def test_single_page_follows_pattern_order_and_replaces_once(spark):
    stories = spark.createDataFrame([
        (1, "http://h/a", '<a href="/p2">x</a><a href="/one?all">y</a>', ["all$", "p2"]),
        (2, "http://h/b", '<base href="http://h/d/"><a href=one>y</a>', ["^one$"]),
        (3, "http://h/c", '<a href="http://h/c">self</a>', ["h/c"]),
        (4, "http://h/e", '<meta http-equiv="refresh" content="0; url=http://h/gone">z', []),
        (5, "http://h/f", None, ["x"]), (6, "http://h/s/a", '<a href="?p=all">x</a>', ["all"])], "id int, url string, html string, pats array<string>")
    pages = spark.createDataFrame([("http://h/one?all", "B"), ("http://h/one?all", "A"), ("http://h/d/one", "D")],
                                  "url string, html string")
    got = PG.with_single_page(stories, PG.by_url(pages), "html", "url", "pats").orderBy("id").collect()
    assert [r.single_url for r in got] == ["http://h/one?all", "http://h/d/one", None, "http://h/gone", None,
                                            "http://h/?p=all"]
    assert [r.html for r in got] == ["A", "D", '<a href="http://h/c">self</a>', got[3].html, None, got[5].html]
    assert got[3].html.endswith("z")


def test_index_container_specs():
    assert tree.parse_index('div class="top news" id=x') == ("div", [("class", "top news"), ("id", "x")])
    assert tree.parse_index("class=\"'n'\"") == ("*", [("class", "n")])
    assert tree.parse_index("") is None and tree.parse_index('div class="') is None
    page = '<ul class="n"><a href="/1">a</a></ul><ol class="n"><a href="/2">b</a></ol><a href="/3">c</a>'
    assert [x["href"] for x in tree.links_in(page, tree.Specs(["class=n"], True))] == ["/1", "/2"]
    assert [x["href"] for x in tree.links_in(page, tree.Specs(["ol"], True))] == ["/2"]
    assert tree.links_in(page, tree.Specs([""], True)) == []



def test_multipage_walk_keeps_order_and_ends_on_cycles(spark):
    stories = spark.createDataFrame([
        (1, "http://h/a", '<a href="?p=3">3</a><a href="/a?p=2">2</a><a href="?p=3">3</a><a href="x">x</a>', "p=[0-9]"),
        (2, "http://h/b", '<a href="?p=1">1</a>', None), (3, "http://h/c", None, "p="), (4, "http://h/a?p=2", '<a href="/a">1</a>', "a$")],
        "id int, url string, html string, pat string")
    pages = spark.createDataFrame([("http://h/?p=3", "third"), ("http://h/a?p=2", '<a href="?p=4">4</a><a href="/a?p=2">me</a>'),
                                   ("http://h/?p=4", '<a href="/?p=3">back</a><a href="/a?p=9">not fetched</a>'), ("http://h/a", "A")],
                                  "url string, html string")

    def urls(hops):
        got = PG.multipage_walk(stories, pages, ["id"], "html", "url", "pat", hops=hops).orderBy("id", "page_no").collect()
        return {i: [r.url for r in got if r.id == i] for i in (1, 2, 3, 4)}

    one = ["http://h/a", "http://h/?p=3", "http://h/a?p=2"]
    assert urls(1) == {1: one, 2: ["http://h/b"], 3: [], 4: ["http://h/a?p=2", "http://h/a"]}
    assert urls(None) == {**urls(1), 1: [*one, "http://h/?p=4"]}


def test_feed_helpers_make_entries_and_failures_reject_their_site(spark):
    from feedloom.operators.plugins import helped_entries

    def two(site):
        yield {"id": "1", "title": site["arg"], "link": "l", "other": "x"}
        yield {"id": "2"}

    def half(site):
        yield {"id": "1"}
        raise RuntimeError("gone")

    sites = spark.createDataFrame([("a", "two", "A"), ("b", "half", "B"), ("c", None, "C"), ("d", "none", "D"), ("e", "", "E")],
                                  "feed string, feed_helper string, arg string")
    entries, rejects = helped_entries(sites, {"two": two, "half": half})
    assert sorted((r.feed, r.pos, r.id, r.title, r.link, r.content) for r in entries.collect()) == [
        ("a", 0, "1", "A", "l", None), ("a", 1, "2", None, None, None)]
    assert sorted((r.feed, r.stage, r.severity, r.reason) for r in rejects.collect()) == [
        ("b", "helper", "error", "RuntimeError: gone"), ("d", "helper", "error", "LookupError: no helper none")]


def test_published_days_are_listed_and_dropped(spark):
    import uuid

    from feedloom.session import scratch_path
    path = scratch_path(spark, f"tree-{uuid.uuid4().hex}")
    page = spark.createDataFrame([("007", 1, "a"), ("a+b c/d", 2, "b"), (None, 3, "c")], "feed string, page_no int, html string")
    for day in ("2024-01-01", "2024-01-02"):
        D.publish_stories(page, path, day)
    D.publish_stories(page.limit(1), path, "2024-01-02")  # replaces the day as a whole
    got = {(r["day"], r["feed"]) for r in D.written_files(spark, path).collect()}
    assert got == {("2024-01-01", "007"), ("2024-01-01", "a+b c/d"), ("2024-01-01", None), ("2024-01-02", "007")}
    D.drop_days(path, spark.createDataFrame([("2024-01-01",), ("2023-12-31",)], "day string"))
    left = D.written_files(spark, path).select("day", F.concat_ws("/", "feed", "file").alias("path"))
    assert [r["path"].split("part-")[0] for r in D.manifest(left).orderBy("section").collect()] == ["007/", "007/", ".EOF."]
