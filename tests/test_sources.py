"""Sources and sinks on small files written by the tests (same shapes as the reference's samples)."""

import os
import uuid

from pyspark.sql import functions as F

from conftest import rows
from feedloom.sinks import seen_cache
from feedloom.sources.feeds import read_feed_files
from feedloom.sources.rules import read_conf_rules


def _dir(spark, name):
    path = os.path.join(spark.conf.get("spark.checkpoint.dir"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


RSS091 = """<?xml version="1.0" encoding="ISO-8859-1"?>
<rss version="0.91"><channel><title>Empty and Failed</title>
<item><title>Missing page</title><description>gone</description><link>http://example.com/missing</link></item>
<item><title>Empty page</title><description></description><link>http://example.com/empty &amp; more</link></item>
</channel></rss>
"""

RDF = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"
  xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel rdf:about="http://example.org/"><title>Site</title></channel>
<item rdf:about="http://example.org/a"><title>First</title><link>http://example.org/a</link>
<dc:creator>someone</dc:creator></item>
<item rdf:about="http://example.org/b"><title>Second</title><link>http://example.org/b</link></item>
<item rdf:about="http://example.org/c"><title>Third</title><link>http://example.org/c</link></item>
</rdf:RDF>
"""


def test_read_rss_and_rdf_items_in_file_order(spark):
    d = _dir(spark, "feeds")
    with open(os.path.join(d, "empty_failed.rss"), "w", encoding="latin-1") as f:
        f.write(RSS091)
    with open(os.path.join(d, "site.rdf"), "w") as f:
        f.write(RDF)
    got = read_feed_files(spark, d).select(F.regexp_extract("feed_file", r"([^/]*)$", 1).alias("f"),
                                           "pos", "title", "link")
    assert rows(got) == [
        ("empty_failed.rss", 0, "Missing page", "http://example.com/missing"),
        ("empty_failed.rss", 1, "Empty page", "http://example.com/empty & more"),
        ("site.rdf", 0, "First", "http://example.org/a"),
        ("site.rdf", 1, "Second", "http://example.org/b"),
        ("site.rdf", 2, "Third", "http://example.org/c"),
    ]


CONF_MAIN = """[DEFAULT]
levels = 2
skip_images = true
save_days = 7

[Harbour Notes]
url = http://feeds.example.org/harbour
levels = 1
page_start = <main data-part="log"
page_end = <p class="tide-table"
"""

CONF_SITE = """# a site file
[Hill Weather]
url = http://feeds.example.com/hill
skip_link_pats =
    /radar/
    /webcam/
; a comment between values
skip_title_pats = Forecast quiz
save_days = 3
"""


def test_conf_rules_sections_default_and_lists(spark):
    d = _dir(spark, "conf")
    with open(os.path.join(d, "main.conf"), "w") as f:
        f.write(CONF_MAIN)
    with open(os.path.join(d, "hill.conf"), "w") as f:
        f.write(CONF_SITE)
    got = {r.feed: r for r in read_conf_rules(spark, d).collect()}
    assert set(got) == {"Harbour Notes", "Hill Weather"}
    s, w = got["Harbour Notes"], got["Hill Weather"]
    assert (s.levels, s.save_days, s.skip_images, s.page_start) == (1.0, 7, True, ['<main data-part="log"'])
    assert (w.levels, w.save_days, w.skip_link_pats, w.skip_title_pats) == (2.0, 3, ["/radar/", "/webcam/"],
                                                                              ["Forecast quiz"])
    assert w.min_width == 25 and w.block_nonlocal_images is True  # built-in defaults


def test_seen_cache_round_trip_with_split_lines(spark):
    seen = spark.createDataFrame([("site a", f"id {i}") for i in range(50)] + [("b", "x")],
                                 "site string, item_id string")
    state = spark.createDataFrame([("b", None)], "site string, last_fed timestamp")
    d = _dir(spark, "cache")
    seen_cache.write_seen_cache(seen, state, d, n_files=3)
    back, rejects = seen_cache.read_seen_cache(spark, d)
    assert rejects.count() == 0
    assert rows(back, ["site", "item_id"]) == sorted(
        [("site+a", f"id+{i}") for i in range(50)] + [("b", "x")])
    lines = seen_cache.cache_lines(seen, state, ids_per_line=10)
    assert lines.filter(F.col("site") == "site a").count() >= 4
    parsed, _ = seen_cache.parse_cache_lines(lines.select(F.col("line").alias("value")))
    assert parsed.count() == 51


def test_prepare_rules_drops_bad_patterns_and_translates(spark):
    from feedloom.sources.rules import prepare_rules, rules_from_rows
    rules = rules_from_rows(spark, [
        dict(feed="a", skip_pats=["ok.*", "(unclosed"], page_start=["(?P<x>a)\\Z"],
             story_url_rewrite=["(http)://x/(\\d+)", "\\1s://y/\\2?$"]),
        dict(feed="b", story_url_rewrite=["only one"]),
    ])
    fixed, rejects = prepare_rules(rules)
    got = {r.feed: r for r in fixed.collect()}
    assert got["a"].skip_pats == ["(?Ud)ok.*"]
    assert got["a"].page_start == ["(?Ud)(?<x>a)\\z"]
    assert got["a"].story_url_rewrite == ["(?Ud)(http)://x/(\\d+)", "$1s://y/$2?\\$"]
    reasons = sorted(r.reason.split(":")[0] for r in rejects.collect())
    assert reasons == ["skip_pats", "story_url_rewrite"]
    # the translated pair works in Spark's regexp_replace
    df = spark.createDataFrame([("http://x/42",)], "link string")
    from feedloom.operators.entries import rewrite_link
    out = df.select(rewrite_link(F.col("link"), F.lit(got["a"].story_url_rewrite)).alias("l")).first().l
    assert out == "https://y/42?$"


def test_feed_titles(spark):
    from feedloom.sources.feeds import read_feed_titles
    d = _dir(spark, "titles")
    with open(os.path.join(d, "a.rss"), "w") as f:
        f.write(RSS091)
    with open(os.path.join(d, "b.rdf"), "w") as f:
        f.write(RDF)
    with open(os.path.join(d, "c.rss"), "w") as f:
        f.write("<rss><channel><item><title>only item</title></item></channel></rss>")
    got = rows(read_feed_titles(spark, d).select(F.regexp_extract("feed_file", r"([^/]*)$", 1), "title"))
    assert got == [("a.rss", "Empty and Failed"), ("b.rdf", "Site"), ("c.rss", "[c.rss]")]


def test_rules_defaults_broadcast_and_percent(spark):
    from feedloom.sources.rules import attach_rules, checked_broadcast, rules_from_rows
    d = _dir(spark, "conf2")
    with open(os.path.join(d, "x.conf"), "w") as f:
        f.write("[Pct]\nskip_pats = 100% sure\n")
    got = read_conf_rules(spark, d).first()
    assert got.skip_pats == ["100% sure"]  # '%' is kept literally (no interpolation)
    rules = rules_from_rows(spark, [dict(feed="a", min_width=40)])
    assert rules.known_rows == 1
    entries = spark.createDataFrame([("a",), ("zzz",)], "feed string")
    out = {r.feed: r for r in attach_rules(entries, rules.select("feed", "min_width", "save_days", "skip_pats"))
           .collect()}
    assert (out["a"].min_width, out["zzz"].min_width, out["zzz"].save_days, out["zzz"].skip_pats) == (40, 25, 7, [])
    big = spark.range(10).withColumnRenamed("id", "k")
    assert "ResolvedHint" not in checked_broadcast(big, max_rows=5)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in checked_broadcast(big, max_rows=50)._jdf.queryExecution().analyzed().toString()


def test_feed_files_round_trip_keeps_item_order(spark):
    from feedloom.sources.feeds import write_feed_files
    items = spark.createDataFrame([("f1", p, f"t{p}", f"http://x/{p}") for p in (5, 1, 3)] +
                                  [("f2", 0, "a & b", "http://y/0")],
                                  "feed string, pos long, title string, link string")
    d = _dir(spark, "rss")
    write_feed_files(items.repartition(1), d)
    back = read_feed_files(spark, d).select(F.regexp_extract("feed_file", r"feed=([^/]*)/", 1).alias("feed"),
                                            "pos", "title", "link")
    assert rows(back) == [("f1", 0, "t1", "http://x/1"), ("f1", 1, "t3", "http://x/3"),
                          ("f1", 2, "t5", "http://x/5"), ("f2", 0, "a & b", "http://y/0")]


def test_url_items_follow_redirects(spark):
    from feedloom.sources.urllists import url_items
    req = spark.createDataFrame([("http://a/1",), ("none",)], "value string")
    lines = spark.createDataFrame([("  http://b/2 ",), ("",)], "value string")
    resolved = spark.createDataFrame([("http://a/1", "https://a/final")], "url string, final_url string")
    got = rows(url_items(req, lines, F.lit("2024-01-12 00:00:00").cast("timestamp"), resolved), ["link", "title"])
    assert got == [("http://b/2", "http://b/2"), ("https://a/final", "https://a/final")]


def test_the_main_conf_file_is_read_first(spark, tmp_path):
    (tmp_path / "main.conf").write_text("[DEFAULT]\nsave_days = 5\n[S]\nurl = main\nlevels = 1\nwhen = mo\n")
    (tmp_path / "a-site.conf").write_text("[S]\nurl = site\nlevels = 2\n")
    (tmp_path / "b-site.conf").write_text("[S]\nlevels = 1.5\n[T]\nurl = t\n")
    got = {r.feed: (r.url, r.levels, r.when, r.save_days) for r in read_conf_rules(spark, str(tmp_path)).collect()}
    assert got == {"S": ("site", 1.5, "mo", 5), "T": ("t", 2.0, "", 5)}
    got = {r.feed: (r.url, r.levels) for r in read_conf_rules(spark, str(tmp_path), main="b-site.conf").collect()}
    assert got["S"] == ("main", 1.0)


def test_feed_bytes_follow_their_declaration_and_cdata_cuts_nothing(spark, tmp_path):
    from feedloom.sources.feeds import read_entries, read_feed_titles
    head = '<?xml version="1.0" encoding="{}"?><rss><channel><title>{}</title>'
    items = ("<item><title>Café</title><link>l1</link></item>"
             "<item><title><![CDATA[a </item> b]]></title><!-- <item> --><link>l2</link></item >"
             "<!-- <item><title>gone</title></item> --><item><title>x &lt; y</title></item></channel></rss>")
    (tmp_path / "a.rss").write_bytes((head.format("ISO-8859-1", "Ünë") + items).encode("latin-1"))
    (tmp_path / "b.rss").write_bytes((head.format("utf-16", "Zwei") + items).encode("utf-16"))
    (tmp_path / "c.rss").write_bytes(b"\xef\xbb\xbf" + (head.format("UTF-8", "<![CDATA[D & rei]]>") + items).encode())
    (tmp_path / "d.rss").write_bytes(head.format("utf-8", "Vier").encode() + b"<item><title>bad \xff byte</title></item>")
    (tmp_path / "e.rss").write_bytes(b"<rss></rss>")
    got = sorted((r.feed, r.pos, r.title, r.link) for r in read_entries(spark, str(tmp_path)).collect())
    want = [(f, i, t, k) for f in ("D & rei", "Zwei", "Ünë")
            for i, (t, k) in enumerate([("Café", "l1"), ("a </item> b", "l2"), ("x < y", None)])]
    assert got == sorted([*want, ("Vier", 0, "bad \\xff byte", None)])
    assert {r.title for r in read_feed_titles(spark, str(tmp_path)).collect()} == {"Ünë", "Zwei", "D & rei", "Vier", "[e.rss]"}
