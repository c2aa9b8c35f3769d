"""Registered queries of the HTML cleaning chain (H1-H22, S3) with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import html as H
from feedloom.functions.common import steps
from feedloom.functions.urls import absolute_url, url_host
from feedloom.operators import pages as PG
from feedloom.operators import tokens as TK
from feedloom.plans import fixtures as X
from feedloom.plans.sqlparts import covered_sql, crop_sql, ends_sql, excise_sql, reassemble_sql, tokens_sql
from feedloom.sources.rules import attach_rules
from feedloom.sources.tables import read_table

HOST = X.HOST_SQL


#: Twin of html.STYLE_IN_TAG, quoted for SQL.
STYLE_SQL = "(?i)(<[a-z](?:[^<>\"'']|\"[^\"]*\"|''[^'']*'')*?)\\s+style\\s*=\\s*"


def _pages_with_rules(spark, sf_dir, *cols, derived=False):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    if derived:
        pages = X.derived_pages(pages).select("page_id", "url", "html")
    p = pages.withColumn("rule_key", X.rule_key(url_host("url")))
    return attach_rules(p, X.rules_view(spark, *cols), on="rule_key")


def _rules_join_sql(src: str, cols: list[str]) -> str:
    return (f"SELECT s.*, r.* EXCLUDE (rule_key) FROM {src} s "
            f"LEFT JOIN ({X.rules_sql(cols)}) r ON split_part({HOST.replace('url', 's.url')}, '.', -1) = r.rule_key")


# ------------------------------------------------------------ crop_and_strip
def crop_and_strip(spark, sf_dir):
    """H1 crop by page_start/page_end, H2 excise skip_pats, H5 drop script/style/video/source/link."""
    p = _pages_with_rules(spark, sf_dir, "page_start", "page_end", "skip_pats")
    p = steps(p, "html", lambda h: H.crop_start(h, "page_start"), lambda h: H.crop_end(h, "page_end"),
              lambda h: H.excise(h, "skip_pats"), H.drop_elements)
    return p.select("page_id", "html")


def _drop_elements_sql(x: str) -> str:
    for t in H.DROP_WITH_CONTENT:
        x = f"regexp_replace({x}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"
    return f"regexp_replace({x}, '(?i)<(?:{'|'.join(H.DROP_VOID)})\\b[^>]*>', '', 'g')"


SQL_CROP = f"""
WITH p AS ({_rules_join_sql('pages', ['page_start', 'page_end', 'skip_pats'])}),
c AS (SELECT page_id, skip_pats, {crop_sql('html', 'page_start', 'page_end')} AS html FROM p)
SELECT page_id, {_drop_elements_sql(excise_sql('skip_pats', 'html'))} AS html FROM c
"""


# --------------------------------------------------------------- node_delete
def node_delete(spark, sf_dir):
    """H3: delete skip_nodes elements with their subtrees."""
    p = _pages_with_rules(spark, sf_dir, "skip_nodes")
    return TK.delete_nodes(p.select("page_id", "html", "skip_nodes"), "skip_nodes").select("page_id", "html")


NODE_SPEC_SQL = TK.NODE_SPEC_RE.replace("'", "''")


def node_delete_ctes(src: str, pre: str = "") -> str:
    """CTEs from ``src`` (page_id, html, skip_nodes) to ``{pre}kept``, the tokens left on the pages with work."""
    return f"""
{pre}specs AS (SELECT page_id, unnest(skip_nodes) AS spec FROM {src}),
{pre}sp AS (SELECT DISTINCT page_id, lower(regexp_extract(spec, '{NODE_SPEC_SQL}', 1)) AS s_tag,
              lower(regexp_extract(spec, '{NODE_SPEC_SQL}', 2)) AS s_attr,
              regexp_extract(spec, '{NODE_SPEC_SQL}', 3) AS s_rx FROM {pre}specs),
{pre}usable AS (SELECT * FROM {pre}sp WHERE s_tag <> '' AND s_attr <> ''),
{pre}work AS (SELECT page_id, html FROM {src} WHERE page_id IN
           (SELECT u.page_id FROM {pre}usable u JOIN {src} pg USING (page_id)
            WHERE regexp_matches(pg.html, '(?i)<' || u.s_tag || '\\b'))),
{pre}t0 AS ({tokens_sql(pre + 'work')}),
{pre}ok AS (SELECT t.page_id FROM (SELECT page_id, sum(length(tok)) AS n FROM {pre}t0 GROUP BY 1) t
       JOIN {pre}work w USING (page_id) WHERE t.n = length(w.html)),
{pre}t AS (SELECT * FROM {pre}t0 WHERE page_id IN (SELECT page_id FROM {pre}ok)),
{pre}hits AS (SELECT DISTINCT t.page_id, t.pos, t.kind FROM {pre}t t JOIN {pre}usable u USING (page_id)
         WHERE t.kind IN ('open', 'void') AND t.tag = u.s_tag
           AND coalesce(regexp_matches(
                 CASE WHEN regexp_matches(t.tok, '(?i)\\s' || u.s_attr || '\\s*=')
                      THEN CASE WHEN regexp_extract(t.tok, '(?i)\\s' || u.s_attr || '\\s*=\\s*"([^"]*)"', 1) <> ''
                                THEN regexp_extract(t.tok, '(?i)\\s' || u.s_attr || '\\s*=\\s*"([^"]*)"', 1)
                                WHEN regexp_extract(t.tok, '(?i)\\s' || u.s_attr || '\\s*=\\s*''([^'']*)''', 1) <> ''
                                THEN regexp_extract(t.tok, '(?i)\\s' || u.s_attr || '\\s*=\\s*''([^'']*)''', 1)
                                ELSE regexp_extract(t.tok, '(?i)\\s' || u.s_attr || '\\s*=\\s*([^\\s"''>]+)', 1) END
                 END, u.s_rx), false)),
{pre}ends AS ({ends_sql(pre + 't')}),
{pre}iv AS (SELECT h.page_id, h.pos AS start,
              CASE WHEN h.kind = 'void' THEN h.pos ELSE coalesce(e.end_pos, {1 << 30}) END AS stop
       FROM {pre}hits h LEFT JOIN {pre}ends e USING (page_id, pos)),
{pre}cov AS ({covered_sql(pre + 't', pre + 'iv')}),
{pre}kept AS (SELECT * FROM {pre}cov WHERE NOT inside)"""


SQL_NODE_DELETE = f"""
WITH p AS ({_rules_join_sql('pages', ['skip_nodes'])}),
{node_delete_ctes('p')},
clean AS ({reassemble_sql('kept', out='clean')})
SELECT p.page_id, coalesce(c.clean, p.html) AS html FROM pages p LEFT JOIN clean c USING (page_id)
"""


# ---------------------------------------------------------- html_token_stats
def html_token_stats(spark, sf_dir):
    """Token table summary per page: counts by kind, deepest level, lossless flag."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")
    t = TK.html_tokens(pages.select("page_id", "html"))
    agg = t.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count(F.when(F.col("kind") == "open", 1)).alias("n_open"),
        F.count(F.when(F.col("kind") == "close", 1)).alias("n_close"),
        F.count(F.when(F.col("kind") == "text", 1)).alias("n_text"),
        F.count(F.when(F.col("kind").isin("raw", "comment", "decl", "void"), 1)).alias("n_other"),
        F.max("level").cast("long").alias("max_level"),
        F.sum(F.length("tok")).cast("long").alias("n_chars"))
    return (agg.join(pages.select("page_id", F.length("html").cast("long").alias("len")), "page_id")
            .withColumn("lossless", F.col("n_chars") == F.col("len")).drop("len"))


SQL_TOKEN_STATS = f"""
WITH t AS ({tokens_sql('pages')})
SELECT t.page_id, count(*) AS n_tokens, count(*) FILTER (WHERE kind = 'open') AS n_open,
       count(*) FILTER (WHERE kind = 'close') AS n_close, count(*) FILTER (WHERE kind = 'text') AS n_text,
       count(*) FILTER (WHERE kind IN ('raw', 'comment', 'decl', 'void')) AS n_other,
       CAST(max(level) AS BIGINT) AS max_level, CAST(sum(length(tok)) AS BIGINT) AS n_chars,
       CAST(sum(length(tok)) AS BIGINT) = max(length(p.html)) AS lossless
FROM t JOIN pages p USING (page_id) GROUP BY t.page_id
"""


# ------------------------------------------------------------- keep_article
# Article container specs in priority order.
ARTICLE_SPECS = ['section name="articleBody"', 'div class="live-blog-post"', "article"]


def keep_article(spark, sf_dir):
    """Keep the first container of the first matching spec; drop svg/img/video inside."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")
    specs = pages.withColumn("specs", F.array(*[F.lit(s) for s in ARTICLE_SPECS]))
    kept = TK.keep_container(specs, "specs")
    html = H.drop_elements(F.col("html"), ["svg", "video"], ["img"])
    return kept.select("page_id", html.alias("html"))


def _keep_article_sql():
    specs = ", ".join(f"({i}, '{s.replace(chr(39), chr(39) * 2)}')" for i, s in enumerate(ARTICLE_SPECS))
    return f"""
WITH t AS ({tokens_sql('pages')}),
specs AS (SELECT p.page_id, s.spec_no, s.spec FROM pages p, (VALUES {specs}) AS s(spec_no, spec)),
sp AS (SELECT page_id, spec_no, lower(regexp_extract(spec, '^\\s*([A-Za-z][A-Za-z0-9]*)\\s*$', 1)) AS a_tag,
              lower(regexp_extract(spec, '{NODE_SPEC_SQL}', 1)) AS s_tag,
              lower(regexp_extract(spec, '{NODE_SPEC_SQL}', 2)) AS s_attr,
              regexp_extract(spec, '{NODE_SPEC_SQL}', 3) AS s_rx FROM specs),
hits AS (SELECT t.page_id, s.spec_no, t.pos FROM t JOIN sp s USING (page_id)
         WHERE t.kind = 'open' AND ((s.a_tag <> '' AND t.tag = s.a_tag)
           OR (s.s_tag <> '' AND s.s_attr <> '' AND t.tag = s.s_tag AND coalesce(regexp_matches(
                 regexp_extract(t.tok, '(?i)\\s' || s.s_attr || '\\s*=\\s*"([^"]*)"', 1), s.s_rx), false)))),
first AS (SELECT page_id, arg_min(pos, (spec_no, pos)) AS pos FROM hits GROUP BY page_id),
ends AS ({ends_sql('t')}),
iv AS (SELECT f.page_id, f.pos AS start, coalesce(e.end_pos, {1 << 30}) AS stop
       FROM first f LEFT JOIN ends e USING (page_id, pos)),
cov AS ({covered_sql('t', 'iv')}),
kept AS (SELECT * FROM cov WHERE inside),
clean AS ({reassemble_sql('kept', out='clean')})
SELECT p.page_id, {_drop_sql("coalesce(c.clean, p.html)", ["svg", "video"], ["img"])} AS html
FROM pages p LEFT JOIN clean c USING (page_id)
"""


def _drop_sql(x, tags, void):
    for t in tags:
        x = f"regexp_replace({x}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"
    if void:
        x = f"regexp_replace({x}, '(?i)<(?:{'|'.join(void)})\\b[^>]*>', '', 'g')"
    return x


# ------------------------------------------------------- html_index_entries
def html_index_entries(spark, sf_dir):
    """S3 + E8: every link inside the containers that the site's html_index_links names
    becomes an entry (id = link = absolute href, title = link text)."""
    pages = _pages_with_rules(spark, sf_dir, "html_index_links")
    specs = pages.select("page_id", "html", F.array("html_index_links").alias("specs"))
    links = TK.container_links(specs, "specs")
    out = links.join(pages.select("page_id", "url"), "page_id")
    return out.select(url_host("url").alias("feed"), "page_id", F.col("pos").cast("long").alias("pos"),
                      absolute_url(F.col("href"), F.col("url")).alias("link"),
                      F.col("text").alias("title"))


SQL_INDEX_ENTRIES = f"""
WITH t AS ({tokens_sql('pages')}),
ends AS ({ends_sql('t')}),
ruled AS ({_rules_join_sql('pages', ['html_index_links'])}),
navs AS (SELECT t.page_id, t.pos AS start, coalesce(e.end_pos, {1 << 30}) AS stop
         FROM t JOIN ruled r USING (page_id) LEFT JOIN ends e USING (page_id, pos)
         WHERE t.kind = 'open' AND t.tag = r.html_index_links),
inside AS (SELECT * FROM ({covered_sql('t', 'navs')}) c WHERE inside),
links AS (SELECT i.page_id, i.pos AS start, coalesce(e.end_pos, {1 << 30}) AS stop,
                 regexp_extract(i.tok, '(?i)\\shref\\s*=\\s*"([^"]*)"', 1) AS href
          FROM inside i LEFT JOIN ends e USING (page_id, pos)
          WHERE i.tag = 'a' AND i.kind = 'open' AND regexp_matches(i.tok, '(?i)\\shref\\s*=')),
texts AS (SELECT * FROM ({covered_sql("(SELECT * FROM t WHERE kind = 'text')", 'links')}) c WHERE inside),
owned AS (SELECT l.page_id, l.start, tx.pos, tx.tok FROM texts tx
          JOIN links l ON l.page_id = tx.page_id AND tx.pos BETWEEN l.start AND l.stop),
lt AS (SELECT page_id, start, string_agg(tok, '' ORDER BY pos) AS text FROM owned GROUP BY 1, 2)
SELECT {HOST.replace('url', 'p.url')} AS feed, l.page_id, CAST(l.start AS BIGINT) AS pos,
       CASE WHEN l.href = '' OR contains(l.href, '://') OR starts_with(l.href, '#') THEN l.href
            WHEN starts_with(l.href, '/') AND NOT starts_with(l.href, '//')
            THEN regexp_extract(p.url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || l.href
            ELSE NULL END AS link,
       trim(coalesce(lt.text, '')) AS title
FROM links l JOIN pages p USING (page_id) LEFT JOIN lt USING (page_id, start)
"""


# ------------------------------------------------------- unwrap_and_links
def unwrap_and_links(spark, sf_dir):
    """H5 drop, H4 unwrap, H6 images (skip_images), H8 links (skip_links), H11 color styles, H9 base drop."""
    p = _pages_with_rules(spark, sf_dir, "skip_images", "skip_links", derived=True)
    p = steps(p, "html", H.drop_elements, H.unwrap_tags, lambda h: H.drop_images(h, "skip_images"),
              lambda h: H.links_rule(h, "skip_links"), H.drop_color_styles, H.drop_base, H.body_only)
    return p.select("page_id", "html")


def strip_sql(html: str = "html") -> str:
    """H5, H4, H6, H8, H11 and H9's removal, by the row's skip_images and skip_links."""
    x = _drop_elements_sql(html)
    x = f"regexp_replace({x}, '(?i)</?(?:{'|'.join(H.UNWRAP_TAGS)})\\b[^>]*>', '', 'g')"
    img = x
    for t in H.IMAGE_TAGS_WITH_CONTENT:
        img = f"regexp_replace({img}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"
    img = f"regexp_replace({img}, '(?i)<img\\b[^>]*>', '', 'g')"
    x = f"(CASE WHEN coalesce(skip_images, false) THEN {img} ELSE {x} END)"
    x = (f"(CASE WHEN coalesce(skip_links, false) THEN regexp_replace({x}, '(?i)</?a\\b[^>]*>', '', 'g') "
         f"ELSE regexp_replace({x}, '(?is)<a\\b[^>]*>\\s*</a\\s*>', '', 'g') END)")
    x = f"regexp_replace({x}, '{STYLE_SQL}(?:\"[^\"]*(?:color|background)[^\"]*\"|''[^'']*(?:color|background)[^'']*'')', '\\1', 'g')"
    return f"regexp_replace({x}, '(?i)<base\\b[^>]*>', '', 'g')"


def _unwrap_sql():
    x = strip_sql()
    return f"""
WITH p AS ({_rules_join_sql(f'({X.DERIVED_SQL})', ['skip_images', 'skip_links'])}),
h AS (SELECT page_id, {x} AS h FROM p)
SELECT page_id, {_body_only_sql('h')} AS html FROM h
"""


def _body_only_sql(x):
    inner = f"regexp_extract({x}, '(?is)<body[^>]*>(.*?)(?:</body>|\\z)', 1)"
    return f"(CASE WHEN regexp_matches({x}, '(?i)<body[^>]*>') THEN {inner} ELSE {x} END)"


# ------------------------------------------------------------ meta_and_base
def meta_and_base(spark, sf_dir):
    """H13 charset and refresh target; H9 base href (else scheme://host/)."""
    d = X.derived_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", H.meta_charset("html").alias("charset"),
                    H.meta_refresh_url("html").alias("refresh_url"),
                    H.base_href("html", "url").alias("base_href"))


SQL_META = f"""
WITH d AS ({X.DERIVED_SQL})
SELECT page_id,
  lower(regexp_extract(html, '(?i)<meta\\b[^>]*\\bcharset\\s*=\\s*["'']?([A-Za-z0-9_.:-]+)', 1)) AS charset,
  regexp_extract(regexp_extract(html, '(?i)(<meta\\b[^>]*http-equiv\\s*=\\s*["'']?refresh[^>]*>)', 1),
                 '(?i)url\\s*=\\s*([^"''>\\s]+)', 1) AS refresh_url,
  CASE WHEN regexp_extract(html, '(?i)<base\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) <> ''
       THEN regexp_extract(html, '(?i)<base\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)
       ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/' END AS base_href
FROM d
"""


# -------------------------------------------------------------- single_page
def single_page(spark, sf_dir):
    """Prefer the single-page version: the refresh target, else the first
    a[href] that matches a single_page_pats pattern of the site, if it differs
    from the page's own URL; its page replaces the content (one hop)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    d = _pages_with_rules(spark, sf_dir, "single_page_pats", derived=True)
    other = PG.by_url(pages, "page_id", ("html", "page_id")).withColumnRenamed("page_id", "single_id")
    j = PG.with_single_page(d, other, "html", "url", "single_page_pats", carry=["single_id"])
    return j.select("page_id", F.coalesce("single_url", F.lit("")).alias("single_url"),
                    F.coalesce(F.col("single_id"), F.lit(-1)).cast("long").alias("single_id"),
                    F.md5("html").alias("html_md5"))


SQL_SINGLE = f"""
WITH d AS ({_rules_join_sql(f'({X.DERIVED_SQL})', ['single_page_pats'])}),
x AS (SELECT *, regexp_extract(regexp_extract(html, '(?i)(<meta\\b[^>]*http-equiv\\s*=\\s*["'']?refresh[^>]*>)', 1),
                               '(?i)url\\s*=\\s*([^"''>\\s]+)', 1) AS r,
             list_filter(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1), lambda h: h <> url) AS hs,
             coalesce(nullif(regexp_extract(html, '<base href="([^"]*)">', 1), ''), url) AS base FROM d),
s0 AS (SELECT *, CASE WHEN r <> '' AND r <> url THEN r ELSE list_filter(list_transform(single_page_pats,
         lambda p: list_filter(hs, lambda h: regexp_matches(h, p))[1]), lambda h: h IS NOT NULL)[1] END AS t FROM x),
s AS (SELECT *, nullif(CASE WHEN starts_with(t, '/') THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || t
                     ELSE t END, url) AS single_url FROM s0),
o AS (SELECT url, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM pages GROUP BY url)
SELECT s.page_id, coalesce(s.single_url, '') AS single_url, CAST(coalesce(o.page_id, -1) AS BIGINT) AS single_id,
       md5(coalesce(o.html, s.html)) AS html_md5
FROM s LEFT JOIN o ON o.url = s.single_url
"""


# -------------------------------------------------------------- story_pages
def story_pages(spark, sf_dir):
    """H1 crop, H14 h1 insertion and byline, H22 body only, H20 no-content, H21 wrapper."""
    p = _pages_with_rules(spark, sf_dir, "page_start", "page_end")
    p = (p.withColumn("title", F.regexp_extract("html", r"<title>(.*?)</title>", 1))
         .withColumn("author", F.when(F.pmod(F.col("page_id"), F.lit(2)) == 0,
                                      F.concat(F.lit("Writer "), F.col("page_id")))))
    p = steps(p, "html", lambda h: H.byline(h, F.col("author")), lambda h: H.crop_start(h, "page_start"),
              lambda h: H.crop_end(h, "page_end"), lambda h: H.ensure_h1(h, F.col("title")),
              H.body_only, H.no_content, lambda h: H.wrap_page(h, F.col("title"), F.col("url")))
    return p.select("page_id", "html")


def byline_sql(html: str = "html") -> str:
    return (f"(CASE WHEN author IS NULL OR author = '' OR strpos({html}, '<body>') = 0 THEN {html} ELSE "
            f"substr({html}, 1, strpos({html}, '<body>') - 1) || 'By: ' || author || chr(10) || '<p>' || chr(10) "
            f"|| substr({html}, strpos({html}, '<body>')) END)")


def ensure_h1_sql(c: str) -> str:
    hd = f"regexp_extract({c}, '(?is)^(.*?<body\\b[^>]*>)', 1)"
    h1 = "('<h1>' || coalesce(title, '') || '</h1>' || chr(10))"
    return (f"(CASE WHEN regexp_matches({c}, '(?i)<h1') THEN {c} WHEN {hd} <> '' "
            f"THEN {hd} || {h1} || substr({c}, length({hd}) + 1) ELSE {h1} || {c} END)")


def wrap_sql(body: str, url: str) -> str:
    head, foot = H.PAGE_HEAD.split("{charset}"), H.PAGE_FOOT.split("{url}")
    h2 = head[1].split("{title}")

    def lit(s):
        return "'" + s.replace("'", "''") + "'"
    return (f"{lit(head[0])} || 'utf-8' || {lit(h2[0])} || coalesce(title, '') || {lit(h2[1])} || {body} "
            f"|| {lit(foot[0])} || {url} || {lit(foot[1])} || {url} || {lit(foot[2])}")


def _story_sql():
    return f"""
WITH p AS ({_rules_join_sql('pages', ['page_start', 'page_end'])}),
a AS (SELECT page_id, url, page_start, page_end, html,
             regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
             CASE WHEN page_id % 2 = 0 THEN 'Writer ' || CAST(page_id AS VARCHAR) END AS author FROM p),
b AS (SELECT page_id, url, page_start, page_end, title, {byline_sql()} AS b FROM a),
c AS (SELECT page_id, url, title, {crop_sql("b", "page_start", "page_end")} AS c FROM b),
e AS (SELECT page_id, url, title, {ensure_h1_sql('c')} AS e FROM c),
f AS (SELECT page_id, url, title, {_body_only_sql('e')} AS body FROM e),
g AS (SELECT *, CASE WHEN body IS NULL OR trim(body) = '' THEN '[No content]' ELSE body END AS shown FROM f)
SELECT page_id, {wrap_sql('shown', 'url')} AS html FROM g
"""


# ---------------------------------------------------------- index_excerpts
def index_excerpts(spark, sf_dir):
    """Excerpt chain for the index: [No content] (H20), H12 simplify, H6 excerpt
    image removal, H8 excerpt links, H19 index_skip_content_pats, H18 cut."""
    p = _pages_with_rules(spark, sf_dir, "simplify_rss", "skip_images", "skip_links",
                          "index_skip_content_pats", "rss_entry_size", derived=True)
    p = p.withColumn("excerpt", F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1))
    p = steps(p, "excerpt", H.no_content,
              lambda c: F.when(F.col("simplify_rss"), H.simplify(c)).otherwise(c),
              lambda c: F.when(F.col("skip_images"), H.excerpt_drop_images(c)).otherwise(c),
              lambda c: H.links_rule(c, "skip_links"),
              lambda c: H.excise(c, "index_skip_content_pats", flags=""),
              lambda c: H.cut_excerpt(c, F.col("rss_entry_size")))
    return p.select("page_id", "excerpt")


def excerpt_sql(a: str) -> str:
    """H20, H12, H6 and H8 on an excerpt, by the row's rules."""
    c = f"(CASE WHEN trim({a}) = '' THEN '[No content]' ELSE {a} END)"
    c = (f"(CASE WHEN simplify_rss THEN regexp_replace({c}, '{STYLE_SQL}(?:\"[^\"]*\"|''[^'']*'')', '\\1', 'g') || ' ... '"
         f" ELSE {c} END)")
    img = f"regexp_replace(regexp_replace({c}, '<a [^>]*href=[^>]*> *<img [^>]*></a>', '', 'g'), '<img [^>]*>', '', 'g')"
    c = f"(CASE WHEN skip_images THEN {img} ELSE {c} END)"
    return (f"(CASE WHEN coalesce(skip_links, false) THEN regexp_replace({c}, '(?i)</?a\\b[^>]*>', '', 'g') "
            f"ELSE regexp_replace({c}, '(?is)<a\\b[^>]*>\\s*</a\\s*>', '', 'g') END)")


def _excerpts_sql():
    return f"""
WITH p AS ({_rules_join_sql(f'({X.DERIVED_SQL})', ['simplify_rss', 'skip_images', 'skip_links',
                                                    'index_skip_content_pats', 'rss_entry_size'])}),
a AS (SELECT *, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM p),
b AS (SELECT page_id, rss_entry_size, {excise_sql('index_skip_content_pats', excerpt_sql('a'), flags='')} AS x FROM a)
SELECT page_id, CASE WHEN coalesce(rss_entry_size, 0) > 0
                     THEN regexp_replace(substr(x, 1, rss_entry_size), '<[^>]*$', '')
                     ELSE x END AS excerpt
FROM b
"""


# ---------------------------------------------------------- multipage_links
def multipage_links(spark, sf_dir):
    """Hrefs matching the site's multipage pattern, distinct, in page order."""
    p = _pages_with_rules(spark, sf_dir, "multipage_pat", derived=True)
    links = H.multipage_links("html", F.col("multipage_pat"))
    return p.select("page_id", F.array_join(links, " ").alias("pages"),
                    F.size(links).cast("long").alias("n_pages"))


SQL_MULTIPAGE = f"""
WITH p AS ({_rules_join_sql(f'({X.DERIVED_SQL})', ['multipage_pat'])}),
l AS (SELECT page_id, CASE WHEN multipage_pat IS NULL OR multipage_pat = '' THEN CAST([] AS VARCHAR[])
        ELSE list_distinct_ordered END AS links FROM (
        SELECT page_id, multipage_pat,
          list_filter(hs, lambda h, i: regexp_matches(h, multipage_pat)
                      AND NOT list_contains(list_filter(hs[:i - 1], lambda g: regexp_matches(g, multipage_pat)), h))
            AS list_distinct_ordered
        FROM (SELECT page_id, multipage_pat,
                     regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1) AS hs FROM p) x) y)
SELECT page_id, array_to_string(links, ' ') AS pages, CAST(len(links) AS BIGINT) AS n_pages FROM l
"""


# ---------------------------------------------------------------- first_body
def first_body(spark, sf_dir):
    """H7: the first html/body tags stay, later ones are unwrapped."""
    d = X.derived_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return TK.first_html_body(d.select("page_id", "html")).select("page_id", "html")


SQL_FIRST_BODY = f"""
WITH d AS ({X.DERIVED_SQL}),
t AS ({tokens_sql('d')}),
m AS (SELECT *, CASE WHEN tag IN ('html', 'body') AND kind IN ('open', 'close')
                     THEN row_number() OVER (PARTITION BY page_id, tag, kind ORDER BY pos) END AS n FROM t),
kept AS (SELECT * FROM m WHERE n IS NULL OR n = 1),
c AS ({reassemble_sql('kept', out='clean')})
SELECT d.page_id, coalesce(c.clean, d.html) AS html FROM d LEFT JOIN c USING (page_id)
"""


QUERIES = {
    "crop_and_strip": crop_and_strip,
    "node_delete": node_delete,
    "html_token_stats": html_token_stats,
    "keep_article": keep_article,
    "html_index_entries": html_index_entries,
    "unwrap_and_links": unwrap_and_links,
    "meta_and_base": meta_and_base,
    "single_page": single_page,
    "story_pages": story_pages,
    "index_excerpts": index_excerpts,
    "multipage_links": multipage_links,
    "first_body": first_body,
}

SQL = {
    "crop_and_strip": SQL_CROP,
    "node_delete": SQL_NODE_DELETE,
    "html_token_stats": SQL_TOKEN_STATS,
    "keep_article": _keep_article_sql(),
    "html_index_entries": SQL_INDEX_ENTRIES,
    "unwrap_and_links": _unwrap_sql(),
    "meta_and_base": SQL_META,
    "single_page": SQL_SINGLE,
    "story_pages": _story_sql(),
    "index_excerpts": _excerpts_sql(),
    "multipage_links": SQL_MULTIPAGE,
    "first_body": SQL_FIRST_BODY,
}


# ----------------------------------------------------------- excerpt_repair
def excerpt_repair(spark, sf_dir):
    """Excerpt cut to rss_entry_size, dangling tag removed, first h1 dropped,
    ' ...' after the last text, open elements closed, footer navigation cut."""
    p = _pages_with_rules(spark, sf_dir, "rss_entry_size", derived=True)
    p = p.withColumn("excerpt", F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1))
    p = p.withColumn("excerpt", F.concat(F.lit("<h1>T</h1>"), F.col("excerpt"),
                                         F.lit('<center><a href="3.html">&gt;-3-&gt;</a></center>tail')))
    p = p.withColumn("excerpt", H.cut_excerpt(F.col("excerpt"), F.col("rss_entry_size")))
    cut = p.filter(F.col("rss_entry_size") > 0).select("page_id", F.col("excerpt").alias("html"))
    fixed = TK.repair_excerpt(cut).withColumn("html", H.cut_footer("html"))
    rest = p.filter(~(F.col("rss_entry_size") > 0)).select("page_id", F.col("excerpt").alias("html"))
    return fixed.unionByName(rest).select("page_id", F.col("html").alias("excerpt"))


def repair_ctes(src: str, pre: str = "") -> str:
    """CTEs from ``src`` (page_id, html) to ``{pre}fixed`` (page_id, html): H18's repair and the footer's cut."""
    nav = H.FOOTER_NAV.replace("'", "''")
    return f"""
{pre}t0 AS ({tokens_sql(src)}),
{pre}t1 AS (SELECT *, tag = 'h1' AND kind = 'open'
                 AND pos = min(CASE WHEN tag = 'h1' AND kind = 'open' THEN pos END) OVER (PARTITION BY page_id) AS st
       FROM {pre}t0),
{pre}ends AS ({ends_sql(pre + 't1')}),
{pre}iv AS (SELECT t1.page_id, t1.pos AS start, coalesce(e.end_pos, {1 << 30}) AS stop
       FROM {pre}t1 t1 LEFT JOIN {pre}ends e USING (page_id, pos) WHERE t1.st),
{pre}cov AS ({covered_sql(pre + 't1', pre + 'iv')}),
{pre}m AS (SELECT c.*, c.kind = 'open' AND o.end_pos IS NULL AND NOT c.inside AS unclosed,
             max(CASE WHEN c.kind = 'text' AND NOT c.inside THEN c.pos END) OVER (PARTITION BY c.page_id) AS last_t
      FROM {pre}cov c LEFT JOIN {pre}ends o USING (page_id, pos)),
{pre}a AS (SELECT page_id,
        coalesce(string_agg(CASE WHEN pos = last_t THEN tok || ' ...' ELSE tok END, '' ORDER BY pos)
                 FILTER (WHERE NOT inside), '')
        || coalesce(string_agg('</' || tag || '>', '' ORDER BY pos DESC) FILTER (WHERE unclosed), '')
        || CASE WHEN max(last_t) IS NULL THEN ' [...]' ELSE '' END AS html
      FROM {pre}m GROUP BY page_id),
{pre}fixed AS (SELECT page_id, regexp_replace(html, '(?s){nav}.*$', '') AS html FROM {pre}a)"""


def _excerpt_repair_sql():
    return f"""
WITH p AS ({_rules_join_sql(f'({X.DERIVED_SQL})', ['rss_entry_size'])}),
x0 AS (SELECT page_id, rss_entry_size,
              '<h1>T</h1>' || regexp_extract(html, '(?s)<article>(.*?)</article>', 1)
              || '<center><a href="3.html">&gt;-3-&gt;</a></center>tail' AS e FROM p),
x AS (SELECT page_id, rss_entry_size,
             CASE WHEN coalesce(rss_entry_size, 0) > 0 THEN regexp_replace(substr(e, 1, rss_entry_size), '<[^>]*$', '')
                  ELSE e END AS html FROM x0),
cut AS (SELECT page_id, html FROM x WHERE rss_entry_size > 0),
{repair_ctes('cut')}
SELECT page_id, html AS excerpt FROM fixed
UNION ALL SELECT page_id, html FROM x WHERE NOT (rss_entry_size > 0) OR rss_entry_size IS NULL
"""


QUERIES["excerpt_repair"] = excerpt_repair
SQL["excerpt_repair"] = _excerpt_repair_sql()


# ---------------------------------------------------------- multipage_story
#: How often pages of pages are followed in the query, and which links lead on (on all sites but the org ones).
HOPS, ONWARD = 2, "^https?://"


def multipage_story(spark, sf_dir):
    """H16 + A4: every page with the pages that it leads on to, and those that they lead on to, each once, joined in order."""
    d = X.derived_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    d = d.withColumn("pat", F.when(X.rule_key(F.col("host")) != "org", F.lit(ONWARD)))
    walked = PG.multipage_walk(d, PG.by_url(d.select("url", "html")), ["page_id"], "html", "url", "pat", hops=HOPS)
    return walked.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "url"))), lambda s: s["url"]), " ").alias("urls"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "html"))), lambda s: s["html"]), "\n"))
        .alias("text_md5"))


SQL_MULTIPAGE_STORY = f"""
WITH RECURSIVE d AS ({X.DERIVED_SQL}),
f AS (SELECT url, min(html) AS html FROM d GROUP BY url),
w AS (
  SELECT page_id, 0 AS hop, split_part(host, '.', -1) <> 'org' AS on_, url, html, [url] AS visited FROM d
  UNION ALL
  SELECT s.page_id, s.hop + 1, s.on_, f.url, f.html, list_append(s.visited, f.url)
  FROM (SELECT *, list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1),
                              lambda h: regexp_matches(h, '{ONWARD}'))[1] AS link FROM w WHERE hop < {HOPS} AND on_) s
  JOIN f ON f.url = s.link WHERE NOT list_contains(s.visited, s.link))
SELECT page_id, count(*) AS n_pages, string_agg(url, ' ' ORDER BY hop) AS urls, md5(string_agg(html, chr(10) ORDER BY hop)) AS text_md5
FROM w GROUP BY page_id
"""

QUERIES["multipage_story"] = multipage_story
SQL["multipage_story"] = SQL_MULTIPAGE_STORY
