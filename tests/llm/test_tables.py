"""Registered queries against their SQL, vectors, pages, urls, components and the pipeline."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm import langid, minhash_forest, mixing, page_templates, rp_forest, url_templates
from feedloom.llm.common import read
from feedloom.llm.components import connected_components
from feedloom.llm.queries import QUERIES, SQL
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


def norm(row):
    return tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(norm(r[n] for n in names) for r in got.collect()) == sorted(map(norm, want.fetchall()))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, 0) for i, v, k in rows], "vec_id bigint, embedding array<float>, label int, node int")


def test_forest_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        centre = np.random.default_rng(i % 40).standard_normal(24)
        v = centre + rng.standard_normal(24) * (0.1 if i % 3 else 0.4)
        rows.append((i, [float(x) for x in np.float32(v)], i % 2))
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)]  # copies
    odd = [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [math.nan] + [1.0] * 23, 1), (2003, [None] + [1.0] * 23, 1),
           (2004, rows[7][1], None), (2005, [math.inf] * 24, 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, rows[7][1], 1)]
    want = {}
    for label in (0, 1):
        own = [(i, v) for i, v, k in rows if k == label]
        x = np.array([v for _, v in own], np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = x @ x.T >= 0.93
        np.fill_diagonal(s, False)
        ids = [i for i, _ in own]
        comp = helpers.components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(s), strict=True)])
        want.update({i: (int(n), comp[i]) for i, n in zip(ids, s.sum(1), strict=True)})
    want.update({i: (0, i) for i, _, _ in odd})
    want[2006] = want[2007] = (1, 2006)
    for coarse, block in ((4096, 2048), (60, 25)):
        got = {r["id"]: (r["n_links"], r["component_id"])
               for r in rp_forest.near_vectors(vectors(spark, rows + odd), coarse=coarse, block=block).collect()}
        links, found = sum(v[0] for v in want.values()), sum(v[0] for v in got.values())
        assert found <= links and found >= 0.99 * links
        assert sum(got[i] != want[i] for i in want) <= (0 if coarse > 1000 else 0.01 * len(want))
    assert rp_forest.query(vectors(spark, rows).limit(0)).collect() == []


def test_dense_cloud_is_compared_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in 1 + 0.001 * rng.standard_normal(8)], 0) for i in range(300)]
    got = rp_forest.near_vectors(vectors(spark, rows), coarse=64, block=32).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)}


def test_split_groups_move_few_copies(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 200, 2):  # pairs with a cosine of 0.95
        u = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        x[i + 1] = 0.95 * x[i] + math.sqrt(1 - 0.95 ** 2) * u / np.linalg.norm(u)
    moved, compared = [], rp_forest._compared
    monkeypatch.setattr(rp_forest, "_compared", lambda rows, threshold: (moved.append(rows.count()), compared(rows, threshold))[1])
    rows = [(i, [float(v) for v in np.float32(x[i])], 0) for i in range(4000)]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in rp_forest.near_vectors(vectors(spark, rows), coarse=250, block=125).collect()}
    assert got == {i: (1, i - i % 2) if i < 200 else (0, i) for i in range(4000)}
    assert 4000 < sum(moved) <= 8 * 4000


def test_tiles_of_a_dense_group_count_each_pair_once():
    rng = np.random.default_rng(4)
    x = np.float32(np.concatenate([1 + 0.25 * rng.standard_normal((1500, 32)), rng.standard_normal((700, 32))]))
    copies, block = rng.integers(1, 4, len(x)), np.arange(len(x)) % 2
    lower = rng.integers(0, 4, (len(x), 1))
    u = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for met, bits in (((), None), ((block,), None), ((), lower), ((block,), lower)):
        want = u @ u.T >= 0.93
        np.fill_diagonal(want, False)
        if met:
            want &= block[:, None] != block
        if bits is not None:
            want &= (bits & bits.T) == 0
        got = rp_forest.linked(x, copies, 0.93, met, bits)
        assert (got.n == want @ copies).all()
        assert got.root.tolist() == list(helpers.components(range(len(x)), zip(*np.nonzero(want), strict=True)).values())


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((50, 30), (200, 220), (300, 100)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3)]
        got = {r["id"]: r["component"] for r in connected_components(
            spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
        real = [(a, b) for a, b in edges if a is not None and a != b]
        assert got == helpers.components({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


def page_table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows],
                                 "page_id bigint, url string, html string, key string, host string")


def test_site_template_goes_and_article_stays(spark):
    def page(i):
        return (f"<html><body><div class=zone><a href=/>Home</a> <a href=/x>All the news</a></div><div id=story><h2>Title {i}</h2>"
                f"<p>Body of {i} &amp; so<br>on</p><p>Second {i}</div><div>Read this too<ul><li>one<li>two</ul></div></body></html>")

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)]
    rows += [(100, "http://solo.example/", page(100)), (101, None, None), (102, "x", ""), (103, "http://h.example/c", page(1)),
             (104, "http://big.example/", "<p>w" * 50_000), (105, "http://h.example/t", "plain <b>text</b> &lt; 5<foo")]
    got = {r["page_id"]: r for r in page_templates.query(page_table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in (0, 5, 11):
        assert got[i]["text"] == f"Title {i}\nBody of {i} & so on\nSecond {i}"
        assert got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == rows[i][1]
    assert "Home" in got[100]["text"]  # one page shows no template
    assert got[101]["text"] == got[102]["text"] == ""
    assert got[104]["text"].count("\n") == 49_999
    assert got[105]["text"] == "plain text < 5"
    assert page_templates.query(page_table(spark, rows).limit(0)).collect() == []


def recurring(rows, share=page_templates.SHARE, fewest=page_templates.FEWEST):
    """Brute force: {page_id: template keys of the page's host and section}, page by page and subtree by subtree."""
    def scopes(url):
        host, _, path = (url or "").partition("://")[2].partition("/")
        first, more, _ = path.lstrip("/").partition("/")
        return [host.lower()] + [(host.lower(), first)] * bool(first and more)

    seen, whole = {}, {}
    for _, u, h in rows:
        own, top = [], page_templates.parse(h or "")
        page_templates.hashed(top, own)
        for s in scopes(u):
            whole.setdefault(s, set()).add(top.key)
            for k in own:
                seen.setdefault((s, k), set()).add(top.key)
    kept = {}
    for (s, k), pages in seen.items():
        if len(pages) >= fewest and len(pages) >= share * len(whole[s]):
            kept.setdefault(s, set()).add(k)
    return {i: set().union(*(kept.get(s, set()) for s in scopes(u))) for i, u, _ in rows}


def test_boxes_of_one_section_go(spark):
    def page(s, i):
        return (f"<body><div><b>All of it</b></div><div>Notes of part {s}: mind the <i>{s}</i> steps</div>"
                f"<div class=story><h2>Title {s} {i}</h2><p>Body of {s} {i}</p><p>A word that part {i % 7} shares</p></div></body>")

    rows = [(100 * s + i, f"http://Ten.example/part{s}/{i}?q", page(s, i)) for s in range(10) for i in range(12)]
    rows += [(5000 + i, f"http://ten.example/{i}", f"<p>Alone {i}<div>Few</div>" if i < 4 else "<p>Alone") for i in range(6)]
    rows += [(6000 + i, f"http://copies.example/a{i}/x", page(0, 0)) for i in range(8)]
    pages = page_table(spark, rows)
    got = {r["page_id"]: r["text"] for r in page_templates.query(pages).collect()}
    for s in range(10):
        for i in range(12):
            assert got[100 * s + i] == f"Title {s} {i}\nBody of {s} {i}\nA word that part {i % 7} shares"
    assert got[5000] == "Alone 0\nFew" and "Notes of part 0" in got[6003]  # copies of one page show no template
    want = recurring(rows)
    for i, _, h in rows:
        top = page_templates.parse(h)
        page_templates.hashed(top, [])
        assert got[i] == page_templates.text_of(top, want[i])


@pytest.mark.parametrize(("html", "text"), [
    ("<p>a<p>b", "a\nb"),
    ("<article><header><h1>T</h1></header><p>x&amp;y &#233;</article><footer>f", "T\nx&y é"),
    ("<nav><a>m</a></nav><main><p>m1</p><aside>s</aside><form><p>f</p></form></main>", "m1"),
    ("<p class=it's>ok</p><script>var a='</p>'; if(a<b){}</script>z", "ok\nz"),
    ("<table><tr><td>a<td>b<tr><td>c</table><!-- x", "a\nb\nc"),
    ("<div class='cookie-notice'>c</div><section id='comments'><p>c</p></section><p>t</p>", "t"),
    ("<html><head><title>t</title><body><p>b", "b"), ("<head><meta x><p>b", "b"), ("<nav><ul><li>n</ul><article>a", "a"),
    ("<body class='has-sidebar'><div class='with-comments'><p>b</div><div class='left-sidebar'>s</div>", "b"),
    ("<div class='header-layout'><article><h1 class='header-title'>T</h1><p>b</article></div>", "T\nb"),
    ("<p>a</p><div id='disqus_thread'><article class=comment>c</article></div>", "a"),
    ("<p><b>T<br><p>u<p>v</b>w", "T\nu\nvw"), ("a < b &lt c", "a < b < c"), ("<ul><li>x<ul><li>y</ul><li>z</ul>", "x\ny\nz"),
])
def test_parse(html, text):
    top = page_templates.parse(html)
    page_templates.hashed(top, [])
    assert page_templates.text_of(top, set()) == text


def test_article_of_given_pages(spark):
    import html
    import re

    pages = read(spark, SF, "pages")
    got = {r["page_id"]: r["text"] for r in page_templates.query(pages).collect()}
    for r in pages.collect():
        art = re.sub(r"</?b>", "", re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1])
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", y))).strip() for y in re.split(r"</?(?:p|h1)[^>]*>", art))
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_url_rules_and_templates(spark):
    rows = [(1, "http://WWW.Example.COM/en/1", None), (2, "https://a.example.com/en/2?x#y", None), (3, "http://b.net/es/3", None),
            (4, "http://b.net/es", None), (5, None, None), (6, "no url", None), (7, "http://com", None), (8, "http://x.org/a/b", None),
            (9, "http://x.COM#f", None), (10, "http://notcom/en/", None), (11, "http://h.net/" + "/".join("abcdefghijkl"), None)]
    # a host whose labelled urls below /go/ are all blocked
    rules = (*url_templates.RULES, ("block", "bad.test", "/go/1"))
    rows += [(100 + i, f"http://bad.test/go/1{i}", None) for i in range(30)] + [(200, "http://bad.test/go/9", None),
                                                                              (201, "http://bad.test/", None)]
    pages = page_table(spark, rows)
    got = {r["id"]: r for r in url_templates.judged(pages, rules=rules).collect()}
    assert len(got) == len(rows)
    want = {1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/2", "example.com/en/", "block"),
            3: ("b.net", "/es/3", "net/es/", "block"), 4: ("b.net", "/es", None, "allow"), 5: ("", "", None, "allow"),
            6: ("", "", None, "allow"), 7: ("com", "", None, "allow"), 9: ("x.com", "", None, "allow"),
            10: ("notcom", "/en/", None, "allow"), 200: ("bad.test", "/go/9", None, "block"), 201: ("bad.test", "/", None, "allow")}
    for i, w in want.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == w, i
    assert url_templates.query(pages.limit(0)).collect() == []


def test_pipeline_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    ok = {r["doc_id"] for r in langid.query(docs).where("accepted").collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    left = helpers.line_windows([(i, rows[i]["text"]) for i in sorted(ok)])
    left = {i: t for i, t in left.items() if t == rows[i]["text"] or (t or "").strip()}
    _, cls = helpers.near_duplicates(sorted(left.items()))
    left = {i: t for i, t in left.items() if cls[i] == i}
    bench = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    hit = helpers.decontaminated(sorted(left.items()), bench)
    left = {i: t for i, t in left.items() if not hit[i][1]}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= set(left) and all(got[i]["text"] == left[i] for i in got)
    base = spark.createDataFrame([(i, t, rows[i]["lang"], rows[i]["source"]) for i, t in left.items()],
                                 "doc_id bigint, text string, lang string, source string")
    want = {r["doc_id"]: r["copies"] for r in mixing.query(base).collect() if r["copies"]}
    assert {i: r["copies"] for i, r in got.items()} == want


def test_stages_on_empty_documents(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_no_stage_drops_clean_documents(spark):
    docs = spark.createDataFrame([(i, f"A clean text number {i} says what none of the others say, again {i * 7}.", "en", "s", 0)
                                  for i in range(1, 40)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == docs.count()
    assert minhash_forest.representatives(docs.union(docs)).count() == docs.count()


def test_mix_with_dominating_documents_and_clashing_names(spark):
    """A 500-word text among 500 one-word texts: the target of 833 words is met whatever the hashes say."""
    for start in (0, 10_000, 20_000):
        rows = [(start + i, "w", "a") for i in range(500)] + [(start + 999, "w " * 500, "a")]
        # the second source makes 'a' need 833 of its 1,000 words
        rows += [(start + 1000 + i, "w w", "b") for i in range(500)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        sized = docs.select("doc_id", "source", F.expr(mixing.SIZE).alias("size"))
        goals = spark.createDataFrame([("a", 1000, 833.0), ("b", 1000, 1251.0)], "source string, source_size bigint, target double")
        got = mixing.copies(sized, mixing.draw(sized, goals)).groupBy("source").agg(F.sum(F.expr("copies * size")).alias("t")).collect()
        assert {r["source"]: r["t"] for r in got}["a"] == 833
        assert abs({r["source"]: r["t"] for r in got}["b"] - 1251) <= 1
    docs = docs.withColumn("size", F.lit(99)).withColumn("Taken", F.lit("x"))
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "mix_size", "source_size", "target", "copies", "mix_taken"]
    r = out.orderBy("doc_id").first()
    assert r["size"] == 99 and r["Taken"] == "x" and r["mix_size"] == 1


def test_url_sections_do_not_move_each_other(spark):
    """Sixty unlabelled sections beside two blocked ones stay allowed; paths are told apart at any depth."""
    rows = [(10_000 + 40 * k + i, f"http://big.net/{''.join(chr(97 + int(c)) for c in str(k + 10))}/t{i}") for k in range(60) for i in range(40)]
    rows += [(i, f"http://big.net/{'es' if i % 2 else 'fr'}/t{i}") for i in range(80)]
    deep = "/".join("abcdefghijkl")
    rows += [(1000 + i, f"http://deep.net/{deep}/{'on' if i % 2 else 'off'}/{i}") for i in range(40)]
    rows += [(2000, "http://twice.net/es/1"), (2001, "http://twice.net/es/1"), (2002, "http://mix.test/good/x"), (2003, None)]
    rules = (*url_templates.RULES, ("block", "deep.net", f"/{deep}/on/"), ("allow", "deep.net", f"/{deep}/off/"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r["id"]: r for r in url_templates.judged(pages, rules=rules).collect()}
    assert len(got) == len(rows)
    assert {got[i]["verdict"] for i in got if i >= 10_000} == {"allow"}
    assert {got[i]["template"] for i in got if i >= 10_000} == {"/-/*"}
    assert {got[i]["verdict"] for i in range(80)} == {"block"} and {got[i]["template"] for i in range(80)} == {"/+/*"}
    assert got[1001]["template"] == f"/{deep}/on/*" and got[1000]["template"].endswith("/off/*")
    assert got[2000]["template"] == got[2001]["template"] and got[2003]["template"] == ""
