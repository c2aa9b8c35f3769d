"""Hand-made edge rows for the semantics decisions and FIXTURES 4,
checked against small pure-Python models written here."""

import hashlib
import random
import re
import unicodedata
import urllib.parse
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from feedloom.functions import dates, html as H, images as I, schedule, urls
from feedloom.operators import entries as E
from feedloom.operators import state as S
from feedloom.operators import tokens as TK
from feedloom.sinks import seen_cache


def one(spark, df_rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(df_rows, schema).select(expr.alias("x")).collect()]


# ------------------------------------------------------------------ ids
def test_id_chain_and_anchor_split(spark):
    link_t = "array<struct<href:string,rel:string,type:string>>"
    data = [
        ("a b#x#y", None, None, None),  # id with spaces and two '#'
        (None, "g1", None, None),  # guid only
        (None, None, [("h1", "alternate", "t"), ("h2", "alternate", "t")], None),  # alternate link
        (None, None, [("h3", "self", "t")], "lk"),  # links without alternate: no id even with link
        (None, None, None, "lk2"),  # plain link
        (None, None, None, None),  # nothing
    ]
    df = spark.createDataFrame(data, f"id string, guid string, links {link_t}, link string")
    out = E.with_item_ids(df).select("raw_id", "item_id", "anchor").collect()
    assert [tuple(r) for r in out] == [
        ("a+b#x#y", "a+b#x", "#y"), ("g1", "g1", ""), ("h1", "h1", ""), (None, None, ""),
        ("lk2", "lk2", ""), (None, None, "")]


# --------------------------------------------------------------- dedup
def greedy_model(entries):
    ids, titles, keep = set(), set(), []
    for pos, item_id, title in sorted(entries):
        if item_id in ids or title in titles:
            continue
        ids.add(item_id)
        titles.add(title)
        keep.append(pos)
    return keep


def test_dedup_two_stage_vs_greedy_triple(spark):
    df = spark.createDataFrame([("f", 0, "id1", "t1"), ("f", 1, "id2", "t1"), ("f", 2, "id2", "t2")],
                               "feed string, pos long, item_id string, title string")
    two_stage = E.dedup_titles(E.dedup_ids(df))
    assert [r.pos for r in two_stage.collect()] == [0]
    greedy = E.dedup_greedy(df)
    assert sorted(r.pos for r in greedy.collect()) == [0, 2]


def test_dedup_greedy_matches_model_on_random_chains(spark):
    rnd = random.Random(7)
    data = []
    for feed in ("a", "b"):
        for pos in range(60):
            data.append((feed, pos, f"id{rnd.randint(0, 15)}", f"t{rnd.randint(0, 15)}"))
    df = spark.createDataFrame(data, "feed string, pos long, item_id string, title string")
    got = sorted((r.feed, r.pos) for r in E.dedup_greedy(df).collect())
    want = []
    for feed in ("a", "b"):
        want += [(feed, p) for p in greedy_model([(p, i, t) for f, p, i, t in data if f == feed])]
    assert got == sorted(want)


def test_allow_dup_titles(spark):
    df = spark.createDataFrame([("f", 0, "i1", "t", True), ("f", 1, "i2", "t", True)],
                               "feed string, pos long, item_id string, title string, allow_dup_titles boolean")
    assert E.dedup_titles(df).count() == 2


def test_numbering_is_dense_across_ranges(spark):
    data = [("f", p) for p in (3, 70000, 70001, 200000, 5)] + [("g", 1)]
    df = spark.createDataFrame(data, "feed string, pos long")
    out = E.with_next(E.number_within(df, ["feed"], "pos", size_col="n"), ["feed"], size_col="n")
    got = sorted((r.feed, r.pos, r.item_no, r.next_item) for r in out.collect())
    assert got == [("f", 3, 0, 1), ("f", 5, 1, 2), ("f", 70000, 2, 3), ("f", 70001, 3, 4), ("f", 200000, 4, None),
                   ("g", 1, 0, None)]


# --------------------------------------------------------------- dates
def test_rfc2822_variants(spark):
    texts = ["Thu, 11 Aug 2016 14:46:50 GMT", "Thu, 11 Aug 2016 14:46:50 +0000", "11 Aug 2016 16:46 +0200",
             "garbage", None, "Thu, 11 Aug 2016 10:46:50 EDT"]
    got = one(spark, [(t,) for t in texts], "t string", dates.epoch_seconds(dates.parse_rfc2822(F.col("t"))))
    assert got == [1470926810, 1470926810, 1470926760, None, None, 1470926810]


# ------------------------------------------------------------ schedule
def falls_between_model(when, t1, t2):
    if not when:
        return True
    dd = (t2 - t1).total_seconds() / 86400
    if dd < 0:
        return None
    if re.match(r"^\s*[+-]?[0-9]+\s*$", when):
        dom = int(when)
        if dd > 31:
            return True
        if t1.month == t2.month:
            return t1.day <= dom <= t2.day
        return t1.day < dom or dom <= t2.day
    if len(when) < 2 or when[:2].lower() not in ["mo", "tu", "we", "th", "fr", "sa", "su"]:
        return None
    if dd > 7:
        return True
    return (t2.weekday() - ["mo", "tu", "we", "th", "fr", "sa", "su"].index(when[:2].lower())) % 7 < dd


def test_schedule_gate_matches_model(spark):
    rnd = random.Random(3)
    rules = ["", "mo", "Tue", "we", "th", "fr", "sa", "su", "1", "15", "28", "31", "x", "q", "blah"]
    cases = []
    for _ in range(600):
        t1 = datetime(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 60 * 24 * 90))
        span = rnd.choice([0.5, 3, 8, 32, 1.2, 6.9, -1]) * 86400 + rnd.randint(0, 5000)
        cases.append((rnd.choice(rules), t1, t1 + timedelta(seconds=span)))
    df = spark.createDataFrame(cases, "w string, t1 timestamp_ntz, t2 timestamp_ntz")
    got = [r[0] for r in df.select(schedule.falls_between("w", "t1", "t2")).collect()]
    assert got == [falls_between_model(w, a, b) for w, a, b in cases]


# ------------------------------------------------------------------ urls
def test_absolute_url_matches_urljoin(spark):
    bases = ["http://h.example.com/a/b/c.html", "https://x.org/dir/", "http://h.com", "http://h.com/a?q=1#f"]
    refs = ["/x", "x", "../x", "./x", "../../x/y", "//cdn.com/z", "?q=2", "#top", "http://o.net/p", "", "a/./b/../c",
            "x/..", "."]
    cases = [(r, b) for b in bases for r in refs]
    got = one(spark, cases, "u string, b string", urls.absolute_url(F.col("u"), F.col("b")))
    for (r, b), g in zip(cases, got):
        if r == "" or r.startswith("#"):
            assert g == r
        else:
            assert g == urllib.parse.urljoin(b, r), (r, b, g)


def test_hosts(spark):
    data = [(None, None, []), (None, "x.com", []), ("a.b.com", "c.b.com", []), ("a.co.uk", "b.co.uk", []),
            ("localhost", "localhost", []), ("img.cdn.net", "www.site.com", ["cdn.net"]),
            ("img.cdn.net", "www.site.com", ["other.org"])]
    got = one(spark, data, "a string, b string, alts array<string>", urls.similar_host("a", "b", "alts"))
    assert got == [True, False, True, True, True, True, False]


def test_local_link_and_fragment(spark):
    data = [("",), ("a.html",), ("http://x",), ("#a",), ("/abs",), ("../up",), ("sub/dir/",)]
    got = one(spark, data, "l string", urls.is_local_link("l"))
    assert got == [False, True, False, False, False, False, True]
    got = one(spark, [("http://h/a%20b#x#y",)], "u string", urls.strip_fragment("u"))
    assert got == ["http://h/a%2520b"]


# ---------------------------------------------------------------- crop
def test_crop_list_order_and_no_dotall(spark):
    html = "aaa<h1>T</h1>\nbody<article>x</article><footer>f</footer>"
    data = [(html, ["<h1>", "<article>"], ["<footer>", "</article>"]),
            (html, ["nomatch"], ["nomatch"]),
            ("start\nEND", ["start.END"], []),
            ("a<b>c", ["<b>"], [])]
    got = one(spark, data, "h string, s array<string>, e array<string>", H.crop("h", "s", "e"))
    model = []
    for h, s, e in data:
        for p in s:
            m = re.search(p, h)
            if m:
                h = h[m.end():]
                break
        for p in e:
            m = re.search(p, h)
            if m:
                h = h[:m.start()]
                break
        model.append(h)
    assert got == model


def test_excise_dotall_and_order(spark):
    data = [("a<!--x\ny-->b<s>c</s>d", ["<!--.*?-->", "<s>.*?</s>"])]
    assert one(spark, data, "h string, p array<string>", H.excise("h", "p")) == ["abd"]


# ---------------------------------------------------------------- nodes
def test_delete_nodes_nested_unclosed_classes(spark):
    pages = [
        (1, '<div class="ad x">A<div>in</div>B</div><p>keep</p>'),  # nested same tag, two class tokens
        (2, '<p>keep</p><div class="ad">never closed<p>gone'),  # unclosed: to the end
        (3, '<script>var s="<div class=\\"ad\\">"</script><p>keep</p>'),  # inside a script: not a node
        (4, '<p>no div</p>'),  # guard: not tokenised
        (5, '<DIV CLASS="ad">x</DIV>y<br>z < w'),  # case, stray '<'
    ]
    df = spark.createDataFrame([(i, h, ['div class="ad"', "footer"]) for i, h in pages],
                               "page_id long, html string, skip_nodes array<string>")
    got = dict(rows(TK.delete_nodes(df, "skip_nodes"), ["page_id", "html"]))
    assert got[1] == "<p>keep</p>"
    assert got[2] == "<p>keep</p>"
    assert got[3] == pages[2][1]
    assert got[4] == "<p>no div</p>"
    assert got[5] == "y<br>z < w"


def test_bad_node_spec_reported(spark):
    df = spark.createDataFrame([("f", "nav"), ("f", 'div class="x"')], "feed string, spec string")
    assert [r.reason for r in TK.bad_node_specs(df).collect()] == ["unusable skip_nodes spec: nav"]


def test_keep_container_first_spec(spark):
    df = spark.createDataFrame([(1, '<div class="a">A</div><article>B<p>c</p></article>',
                                 ['section name="articleBody"', "article", 'div class="a"'])],
                               "page_id long, html string, specs array<string>")
    assert rows(TK.keep_container(df, "specs"), ["html"]) == [("<article>B<p>c</p></article>",)]


# --------------------------------------------------------------- srcset
def test_srcset_parse_and_choose(spark):
    data = [
        ("a.jpg 100w, b,c.jpg 300w, d.jpg 900w", 800),  # comma inside URL
        ("a.jpg 1x, b.jpg 2x", 800),  # x only: first x
        ("a.jpg 2x, b.jpg 500w", 800),  # w beats an earlier x
        ("", 800),
        ("one.jpg", 800),  # no descriptor: skipped
        ("a.jpg 900w, b.jpg 1000w", 800),  # all wider than the limit
        ("a.jpg 400w, b.jpg 400w", 800),  # tie: first
    ]
    got = one(spark, data, "s string, m int", I.choose_srcset(I.parse_srcset(F.col("s")), F.col("m")))
    assert got == ["b,c.jpg", "a.jpg", "b.jpg", None, None, None, "a.jpg"]


def test_image_names_and_plan(spark):
    got = one(spark, [("http://h/a b/ç.png",), ("///",)], "s string", I.local_name("s"))
    assert got == ["http__h_ab_ç.png", "___"]
    w, h = I.resize_plan(F.col("w"), F.col("h"), F.lit(1200))
    df = spark.createDataFrame([(2400, 1800), (900, 3000), (100, 100)], "w int, h int")
    assert [tuple(r) for r in df.select(w, h).collect()] == [(1200, 900), (360, 1200), (100, 100)]


def test_sources_of_one_local_name_get_files_of_their_own(spark):
    from feedloom.operators.pages import unique_image_names, with_image_names
    srcs = ["http://h/a/b.png", "http://h/a_b.png", "http://h/a_b!.png", "http://h/c.png", "http://h/x.y/z", "http://h/x.y_z", None]
    refs = spark.createDataFrame([(i % 4, s) for i, s in enumerate(srcs * 2)], "page_id int, abs_src string").withColumn(
        "local_name", I.local_name("abs_src"))
    got = {r["abs_src"]: r for r in unique_image_names(refs).collect()}
    assert set(got) == set(srcs) - {None}
    assert len({r["file_name"] for r in got.values()}) == len(got)
    for name in {r["local_name"] for r in got.values()}:
        first = min(s for s, r in got.items() if r["local_name"] == name)
        assert got[first]["file_name"] == name
    other = got["http://h/a_b.png"]["file_name"]
    assert re.fullmatch(r"http__h_a_b_[0-9a-f]{12}\.png", other)
    assert unique_image_names(refs.limit(0)).collect() == []

    html = '<img src="/a/b.png"><img alt=x src="/a_b.png"> <img src="/c.png">'
    pages = spark.createDataFrame([(1, html), (2, '<img src="/c.png">')],
                                  "page_id int, html string").selectExpr(
        "*", "'h' AS host", "'http://h/' AS base", "800 AS most", "false AS ok", "true AS block", "array('z.h') AS alt")
    of = spark.createDataFrame([(1, srcs[0]), (1, srcs[1]), (1, srcs[3]), (2, srcs[3])], "page_id int, abs_src string").withColumn(
        "local_name", I.local_name("abs_src"))
    named = with_image_names(pages, of).select(
        "page_id", I.rewrite_images("html", "host", "base", "most", "ok", "block", "alt", "renames").alias("html"))
    digest = hashlib.md5(srcs[1].encode()).hexdigest()[:12]
    assert dict(rows(named, ["page_id", "html"])) == {
        1: f'<img src="http__h_a_b.png"><img alt=x src="http__h_a_b_{digest}.png"> <img src="http__h_c.png">',
        2: '<img src="http__h_c.png">'}


# ------------------------------------------------------------- text/bytes
def test_decode_bodies(spark):
    from feedloom.operators.decode import decode_bodies
    data = [(1, "é".encode("utf-8"), "utf-8"), (2, "é".encode("latin-1"), "iso-8859-1"),
            (3, b"\x80\xe9a", "utf-8"), (4, "x".encode("utf-8"), "no-such-charset")]
    df = spark.createDataFrame(data, "k int, body binary, charset string")
    got = dict(rows(decode_bodies(df), ["k", "text"]))
    assert got == {1: "é", 2: "é", 3: "\\x80\\xe9a", 4: "x"}


def test_header_charset(spark):
    data = [("text/html; charset=ISO-8859-1; filename=feed.xml",), ("text/html",), (None,)]
    assert one(spark, data, "c string", urls.header_charset("c")) == ["ISO-8859-1", "", ""]


def test_ascii_text_is_its_own_folding(spark):
    from feedloom.functions.text import fold_ascii, nfkd
    data = [("plain \t text\x7f",), ("",), (None,), ("\u200b",), ("ﬁ",)]
    assert one(spark, data, "t string", fold_ascii("t")) == ["plain \t text\x7f", "", None, "", "fi"]
    assert one(spark, data, "t string", nfkd("t")) == ["plain \t text\x7f", "", None, "\u200b", "fi"]


def test_fold_and_slug(spark):
    from feedloom.functions.text import fold_ascii, slugify
    text = "Café “quoted” — ß 中 ø"
    assert one(spark, [(text,)], "t string", fold_ascii(F.col("t"))) == ["Cafe' \"quoted\" -- ss \\u4e2d o/"]
    model = re.sub(r"[-\s]+", "_", re.sub(r"[^\w\s-]", "",
                   unicodedata.normalize("NFKD", "Épisode -- été!").encode("ascii", "ignore").decode())).strip("-_")
    assert one(spark, [("Épisode -- été!",)], "t string", slugify(F.col("t"))) == [model]


# ----------------------------------------------------------- cache text
def test_cache_lines_parse(spark):
    lines = ["feedloom v. 1.1", "site1|1700000000|a b c", "site2|x y", "", "bad|1|2|3", "site3|notanumber|q"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    got, rej = seen_cache.parse_cache_lines(df)
    assert rows(got, ["site", "item_id", "last_fed_epoch"]) == [
        ("site1", "a", 1700000000), ("site1", "b", 1700000000), ("site1", "c", 1700000000),
        ("site2", "x", 0), ("site2", "y", 0)]
    assert sorted(r.reason.split(":")[0] for r in rej.collect()) == ["confused by 4 parts", "epoch is not a number"]


# ------------------------------------------------------------ age policy
def test_age_status(spark):
    now = datetime(2024, 1, 12)
    data = [(datetime(2024, 1, 1), datetime(2024, 1, 10), 7, False),  # older than save_days: expired
            (datetime(2024, 1, 8), datetime(2024, 1, 10), 7, False),  # older than last run: older
            (datetime(2024, 1, 11), datetime(2024, 1, 10), 7, False),  # normal
            (None, datetime(2024, 1, 10), 7, False), (datetime(2024, 1, 1), None, 7, False),  # first run
            (datetime(2024, 1, 1), datetime(2024, 1, 10), 7, True)]  # nocache
    df = spark.createDataFrame(data, "p timestamp, lf timestamp, d int, nc boolean")
    got = [r[0] for r in df.select(S.age_status("p", "lf", F.lit(now).cast("timestamp"), "d", "nc")).collect()]
    assert got == ["expired", "older", "normal", "normal", "normal", "normal"]


def test_unmapped_report_context(spark):
    from feedloom.operators.decode import unmapped_report
    text = "0123456789abcdefghij中0123456789ABCDEFGHIJ é"
    df = spark.createDataFrame([(1, text), (2, "plain ascii")], "doc_id long, text string")
    got = [tuple(r) for r in unmapped_report(df).select("char", "n", "example").collect()]
    assert got == [("中", 1, "56789abcdefghij中0123456789ABCDE")]
    allc = {r.char: r.mapped for r in unmapped_report(df, only_unmapped=False).collect()}
    assert allc == {"中": False, "́": True}


def test_unmapped_report_normalises_each_text_once(spark):
    from feedloom.operators.decode import unmapped_report
    df = spark.createDataFrame([(1, "caf\u00e9"), (2, None), (3, "x")], "doc_id long, text string")
    report = unmapped_report(df, only_unmapped=False)
    assert report._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in report.select("char", "n", "example").collect()] == [("\u0301", 1, "cafe\u0301")]


def test_texts_of_a_batch_become_python_strings_by_slices(monkeypatch):
    import unicodedata

    import pyarrow as pa

    from feedloom.functions import text as TX
    texts = [None if k % 7 == 0 else f"\ufb01{k}\u00e9" for k in range(200)]
    for rows in (1, 64, 200, 500):
        monkeypatch.setattr(TX, "SLICE_ROWS", rows)
        for part in (texts, []):
            got = TX.by_slices(lambda t: unicodedata.normalize("NFKD", t), pa.array(part, pa.string()))
            assert got.to_pylist() == [t and unicodedata.normalize("NFKD", t) for t in part]


def test_previous_row_and_count_before_across_ranges(spark):
    rnd = random.Random(11)
    data = [(u, t, rnd.random() < 0.3) for u in ("a", "b") for t in rnd.sample(range(0, 500000), 60)]
    df = spark.createDataFrame(data, "u string, t long, flag boolean")
    prev = E.previous_row(df, ["u"], ["t"], ["t", "flag"], bucket_rows=50000)
    got = {(r.u, r.t): (r.prev_t, r.prev_flag) for r in prev.collect()}
    cnt = E.count_before(df, ["u"], ["t"], F.col("flag"), "n", bucket_rows=50000)
    got_n = {(r.u, r.t): r.n for r in cnt.collect()}
    for u in ("a", "b"):
        seq = sorted((t, f) for uu, t, f in data if uu == u)
        for i, (t, _) in enumerate(seq):
            assert got[(u, t)] == ((seq[i - 1][0], seq[i - 1][1]) if i else (None, None))
            assert got_n[(u, t)] == sum(1 for _, f in seq[:i] if f)


def test_two_digit_years(spark):
    got = one(spark, [("Thu, 11 Aug 16 14:46:50 GMT",), ("11 Aug 16 14:46 +0000",)], "t string",
              dates.epoch_seconds(dates.parse_rfc2822(F.col("t"))))
    assert got == [1470926810, 1470926760]


def test_page_structure_steps(spark):
    data = [("<html><body><p>x</p></body></html>", "T", "Ann"),
            ("<p>fragment</p>", "T", None),
            ("<body class='a'><h1>Own</h1>y</body>", "T", ""),
            ("<BODY>up</BODY>", "T", "Bo")]
    df = spark.createDataFrame(data, "h string, t string, a string")
    h1 = [r[0] for r in df.select(H.ensure_h1("h", "t")).collect()]
    assert h1 == ["<html><body><h1>T</h1>\n<p>x</p></body></html>", "<h1>T</h1>\n<p>fragment</p>",
                  "<body class='a'><h1>Own</h1>y</body>", "<BODY><h1>T</h1>\nup</BODY>"]
    by = [r[0] for r in df.select(H.byline("h", "a")).collect()]
    assert by == ["<html>By: Ann\n<p>\n<body><p>x</p></body></html>", "<p>fragment</p>",
                  "<body class='a'><h1>Own</h1>y</body>", "<BODY>up</BODY>"]
    body = [r[0] for r in df.select(H.body_only("h")).collect()]
    assert body == ["<p>x</p>", "<p>fragment</p>", "<h1>Own</h1>y", "up"]


def test_unwrap_drop_links_styles(spark):
    html = ('<form><input name="q"><font style="color:red">F</font></form><script>s</script>'
            '<a href="/x"> </a><a href="/y">Y</a><p style="margin:0">p</p><link rel="x">')
    df = spark.createDataFrame([(html, False), (html, True)], "h string, skip boolean")
    got = [r[0] for r in df.select(H.drop_color_styles(H.links_rule(H.unwrap_tags(H.drop_elements("h")),
                                                                    "skip"))).collect()]
    assert got == ['F<a href="/y">Y</a><p style="margin:0">p</p>', "F Y<p style=\"margin:0\">p</p>"]
