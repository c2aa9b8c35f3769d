"""Element extents on malformed pages, and the tree steps in the row."""

import random

import duckdb
import pytest

from feedloom.functions import tree
from feedloom.operators import tokens as TK
from feedloom.plans.sqlparts import ends_sql, tokens_sql


def without(page, *specs):
    return tree.without(page, tree.Specs(specs))


@pytest.mark.parametrize("page, spec, left", [
    ('<div><p class="ad">buy</div><div>story</div>', 'p class="ad"', "<div></div><div>story</div>"),
    ('<p class="ad"><b>x<p>keep', 'p class="ad"', "<p>keep"),
    ('<ul><li class="ad">x<ul><li>in</ul><li>y</ul>', 'li class="ad"', "<ul><li>y</ul>"),
    ('<table><tr><td class="ad">x<table><tr><td>in</table><td>y<tr><td>z</table>', 'td class="ad"',
     "<table><tr><td>y<tr><td>z</table>"),
    ('<dl><dt class="ad">x<dd>y<dt>z</dl>', 'dt class="ad"', "<dl><dd>y<dt>z</dl>"),
    ('<select><option class="ad">x<option>y</select>', 'option class="ad"', "<select><option>y</select>"),
    ('<b><div class="ad">x</b>y</div>z', 'div class="ad"', "<b>z"),
    ('<p class="ad">x<hr>y', 'p class="ad"', "<hr>y"),
    ('a</div><div class="ad">x', 'div class="ad"', "a</div>"),
    ('<i class=story-ad-12-wrapper>x</i><div CLASS="a story-ad-3-wrapper">q</div>y', '* class="story-ad-[0-9]*-wrapper"', "y"),
    ("<div class='ad' id='k'>x</div><div class='ad'>y</div>", """div class="ad" id='k'""", "<div class='ad'>y</div>"),
    ('<div class="ad">x</div>', "div", '<div class="ad">x</div>'),
    ("", 'p class="ad"', ""),
    (None, 'p class="ad"', None),
])
def test_delete_on_malformed_pages(page, spec, left):
    assert without(page, spec) == left


def test_tokens_spell_the_page_and_extents_equal_the_recursive_sql():
    rng = random.Random(5)
    parts = ["p", "div", "li", "ul", "b", "a", "table", "tr", "td", "dl", "dt", "dd", "span", "h1", "select", "option",
             "hr", "br", "head", "body", "tbody"]
    pages = []
    for _ in range(60):
        pages.append("".join(rng.choice([f"<{t}>", f"<{t}>", f"</{t}>", f"<{t} class='x'/>", "text", "<", "<!-- <p> -->",
                                         "<script>'<p>'</script>", "<!doctype html>"])
                             for t in rng.choices(parts, k=rng.randrange(1, 60))))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES "
                + ", ".join(f"({i}, '{p.replace(chr(39), chr(39) * 2)}')" for i, p in enumerate(pages)) + ") v(page_id, html)")
    got = con.execute(f"WITH t AS ({tokens_sql('pages')}) SELECT page_id, pos, end_pos FROM ({ends_sql('t')}) x").fetchall()
    want = []
    for i, p in enumerate(pages):
        toks = tree.tokens(p)
        assert "".join(toks) == p
        names, kind = tree.kinds(toks)
        end, still = tree.extents(names, kind)
        want += [(i, k, None if k in still else end[k]) for k in range(len(toks)) if kind[k] == "open"]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_steps_on_null_pages_and_null_specs(spark):
    df = spark.createDataFrame([(1, None, ['p class="x"'], 7), (2, '<p class="x">a<p>b', ['p class="x"'], 8),
                                (3, '<p class="x">a', None, 9)], "page_id long, html string, specs array<string>, pos int")
    assert [(r.html, r.pos) for r in TK.delete_nodes(df, "specs").orderBy("page_id").collect()] == [
        (None, 7), ("<p>b", 8), ('<p class="x">a', 9)]
    assert [r.html for r in TK.keep_container(df, "specs").orderBy("page_id").collect()] == [
        None, '<p class="x">a', '<p class="x">a']
    assert [r.html for r in TK.repair_excerpt(df).orderBy("page_id").collect()] == [
        None, '<p class="x">a<p>b ...</p>', '<p class="x">a ...</p>']
    links = spark.createDataFrame([(1, "<nav><a href='/a'>A <i>b</i></a><a href=/u>U</nav><a href='/z'>z</a>", ["nav"]),
                                   (2, None, ["nav"])], "page_id long, html string, specs array<string>")
    assert [tuple(r) for r in TK.container_links(links, "specs").collect()] == [(1, 1, "/a", "A b"), (1, 7, "/u", "U")]


def test_no_shuffle_in_the_tree_steps(spark):
    df = spark.range(3).selectExpr("id AS page_id", "'<p>x' AS html", "array('p class=\"x\"') AS specs")
    for out in (TK.delete_nodes(df, "specs"), TK.keep_container(df, "specs"), TK.first_html_body(df), TK.repair_excerpt(df),
                TK.container_links(df, "specs")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_program_parses_each_page_once(monkeypatch):
    calls = []
    real = tree.tokens
    monkeypatch.setattr(tree, "tokens", lambda page: calls.append(page) or real(page))
    program = [("keep", tree.Specs(["article"], True)), ("delete", tree.Specs(['div class="ad"'])), ("one_body", None),
               ("repair", None)]
    page = "<html><body><nav>n</nav><article><h1>t</h1><div class=ad>x</div><p>one<body><b>two</article>tail</body>"
    assert tree.edited(page, program) == "<article><p>one<body><b>two ...</article>"
    assert calls == [page]
    assert tree.edited(None, program) is None and tree.edited("plain", [("delete", tree.Specs([]))]) == "plain"
    assert calls == [page]


def test_removing_an_element_moves_no_other(spark):
    # the div's start ended the paragraph on the page as given; b is no part of it afterwards either
    page = '<p class="x">a<div class="ad">y</div>b</p>c'
    specs = tree.Specs(['div class="ad"', 'p class="x"'])
    assert tree.without(page, specs) == "b</p>c"
    rows = spark.createDataFrame([(1, page, ['div class="ad"'], ["p"]), (2, None, None, None), (3, "<p>z", None, ["h9"])],
                                 "page_id int, html string, gone array<string>, held array<string>")
    got = TK.edit_pages(rows, [("delete", "gone"), ("keep", "held")])
    assert got.columns == rows.columns
    assert {r["page_id"]: r["html"] for r in got.collect()} == {1: '<p class="x">a', 2: None, 3: "<p>z"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
