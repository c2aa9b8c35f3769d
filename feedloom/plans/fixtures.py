"""Views derived from the given tables, in Spark and as DuckDB SQL twins.

The given tables are generic (pages, events, documents, conversations,
part).  These views give them the shape of the engine's inputs: feed
entries from pages, site rules keyed by the host suffix, a seen-set and
run state derived from pages.  Every registered query reads them, so its
work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.urls import url_host
from feedloom.sources.rules import rules_from_rows, select_rules

# The run time of every query (2024-01-12 00:00:00 UTC).
RUN_TS_EPOCH = 1705017600
BASE_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC

# Site rules per host suffix (Python regex dialect, which
# equals the Java one for these patterns).
RULES = [
    dict(rule_key="com", levels=2.0, min_width=60, save_days=7, when="mo",
         rss_entry_size=300, max_image_size=600, max_srcset_size=800,
         allow_dup_titles=False, allow_repeats=False, nocache=False,
         skip_images=True, skip_links=False, nonlocal_images=False, simplify_rss=False,
         png_to_jpg=True, continue_on_timeout=False,
         skip_link_pats=["/fr/", "cheap-pills"], skip_title_pats=["^the and"],
         skip_content_pats=["Nicht aulich"], index_skip_content_pats=["&amp;"],
         page_start=["<article>"], page_end=["</article>"],
         skip_pats=["<!--.*?-->"], skip_nodes=['div class="ad"'],
         alt_domains=["example.org"], story_url_rewrite=["\\?.*$", ""],
         multipage_pat="page=[0-9]+", html_index_links="nav",
         single_page_pats=["[?]single=1$", "^https?://"], url_substitute=["^https?://m[.]", "https://www."]),
    dict(rule_key="net", levels=1.5, min_width=25, save_days=3, when="15",
         rss_entry_size=0, max_image_size=1200, max_srcset_size=400,
         allow_dup_titles=True, allow_repeats=True, nocache=False,
         skip_images=False, skip_links=True, nonlocal_images=False, simplify_rss=True,
         png_to_jpg=False, continue_on_timeout=True,
         skip_link_pats=["utm_source"], skip_title_pats=[],
         skip_content_pats=[], index_skip_content_pats=[],
         page_start=["<body>"], page_end=["<footer>"],
         skip_pats=["<nav>.*?</nav>", "<style>.*?</style>"], skip_nodes=["nav"],
         alt_domains=[], story_url_rewrite=["^http:", "https:"],
         multipage_pat="/en/", html_index_links="nav",
         single_page_pats=["^/x[0-9]+$", "^https?://"], url_substitute=[]),
    dict(rule_key="org", levels=1.0, min_width=40, save_days=14, when="",
         rss_entry_size=120, max_image_size=300, max_srcset_size=1000,
         allow_dup_titles=False, allow_repeats=True, nocache=True,
         skip_images=True, skip_links=False, nonlocal_images=True, simplify_rss=False,
         png_to_jpg=True, continue_on_timeout=False,
         skip_link_pats=["spam-farm"], skip_title_pats=["nicht"],
         skip_content_pats=[], index_skip_content_pats=["[0-9]+"],
         page_start=["<h1>", "<article>"], page_end=["<footer>", "</article>"],
         skip_pats=["<script>.*?</script>"], skip_nodes=['div class="ad"', "footer"],
         alt_domains=["example.com", "cdn.example.net"], story_url_rewrite=["one"],
         multipage_pat=None, html_index_links="ul",
         single_page_pats=["^https?://"], url_substitute=["one"]),
]


_RULES_BY_SESSION: dict = {}


def rules_view(spark: SparkSession, *cols: str) -> DataFrame:
    """v_rules: the site rules table keyed by host suffix (built once per session)."""
    key = id(spark)
    if key not in _RULES_BY_SESSION:
        _RULES_BY_SESSION[key] = rules_from_rows(spark, RULES, key="rule_key")
    rules = _RULES_BY_SESSION[key]
    return select_rules(rules, "rule_key", *cols) if cols else rules


def rule_key(host_col) -> F.Column:
    return F.substring_index(host_col, ".", -1)


def entries_view(pages: DataFrame) -> DataFrame:
    """v_entries: one feed entry per page (feed = host, pos = page_id)."""
    host = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"
    stamp = ("date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, page_id, 0, 0), "
             "'EEE, dd MMM yyyy HH:mm:ss')")
    return pages.selectExpr(
        f"{host} AS feed",
        f"substring_index({host}, '.', -1) AS rule_key",
        "page_id AS pos", "url AS id", "CAST(NULL AS STRING) AS guid", "url AS link",
        "regexp_extract(html, '<title>(.*?)</title>', 1) AS title",
        "regexp_extract(html, '<p>(.*?)</p>', 1) AS content",
        f"CASE pmod(page_id, 5) WHEN 4 THEN 'not a date' WHEN 3 THEN concat({stamp}, ' GMT') "
        f"ELSE concat({stamp}, ' +0000') END AS published")


def seen_view(pages: DataFrame) -> DataFrame:
    """v_seen: ids of every third page count as seen on an earlier run."""
    from feedloom.operators.entries import id_encode, split_anchor
    base, _ = split_anchor(id_encode(F.col("url")))
    return (pages.filter(F.pmod("page_id", F.lit(3)) == 0)
            .select(url_host("url").alias("site"), base.alias("item_id")).distinct())


def state_view(pages: DataFrame) -> DataFrame:
    """v_state: last run per host = midpoint of its pages' publish hours (hosts with 2+ pages)."""
    return (pages.groupBy(url_host("url").alias("site"))
            .agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1)
            .select("site", F.timestamp_seconds(
                F.lit(BASE_EPOCH) + F.floor((F.col("lo") + F.col("hi")) / 2) * 3600).alias("last_fed")))


def run_ts():
    return F.timestamp_seconds(F.lit(RUN_TS_EPOCH))


# ----------------------------------------------------------------- SQL twins
def _sql_lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        if not v:
            return "CAST([] AS VARCHAR[])"
        return "[" + ", ".join(_sql_lit(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def rules_sql(cols: list[str]) -> str:
    """VALUES clause of the rules table restricted to ``cols`` (rule_key first)."""
    rows = []
    for r in RULES:
        rows.append("(" + ", ".join(_sql_lit(r.get(c)) for c in ["rule_key", *cols]) + ")")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(rule_key, " + ", ".join(cols) + ")")


HOST_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"

ENTRIES_SQL = f"""
SELECT {HOST_SQL} AS feed,
       split_part({HOST_SQL}, '.', -1) AS rule_key,
       page_id AS pos, url AS id, CAST(NULL AS VARCHAR) AS guid, url AS link,
       regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
       regexp_extract(html, '<p>(.*?)</p>', 1) AS content,
       CASE page_id % 5
         WHEN 4 THEN 'not a date'
         WHEN 3 THEN strftime(TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR, '%a, %d %b %Y %H:%M:%S') || ' GMT'
         ELSE strftime(TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR, '%a, %d %b %Y %H:%M:%S') || ' +0000'
       END AS published
FROM pages
"""

ITEM_ID_SQL = """CASE WHEN contains(replace(url, ' ', '+'), '#')
        THEN regexp_extract(replace(url, ' ', '+'), '^(.*)#[^#]*$', 1)
        ELSE replace(url, ' ', '+') END"""

SEEN_SQL = f"""
SELECT DISTINCT {HOST_SQL} AS site, {ITEM_ID_SQL} AS item_id
FROM pages WHERE page_id % 3 = 0
"""

STATE_SQL = f"""
SELECT site, TIMESTAMP '2024-01-01' + CAST(floor((lo + hi) / 2) AS BIGINT) * INTERVAL 1 HOUR AS last_fed
FROM (SELECT {HOST_SQL} AS site, min(page_id) AS lo, max(page_id) AS hi, count(*) AS n
      FROM pages GROUP BY 1) s
WHERE n > 1
"""

RUN_TS_SQL = "TIMESTAMP '2024-01-12 00:00:00'"


# ------------------------------------------------------------ derived markup
# The given pages have no images, forms, base tags, refreshes or second
# bodies; these are spliced in by rule from page_id and host, and the next
# page's URL serves as each page's "single page" link.
def derived_pages(pages: DataFrame) -> DataFrame:
    """pages with extra markup: (page_id, url, host, next_url, html)."""
    p = pages.select("page_id", "url", "html")
    nxt = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    host = url_host("url")
    pid = F.col("page_id").cast("string")
    width = ((F.pmod(F.col("page_id"), F.lit(7)) + 1) * 100).cast("string")
    inject = F.concat(
        F.lit('<article><form action="/s"><input name="q"></form><img src="http://cdn.'), host,
        F.lit("/p"), pid, F.lit('.png" style="color:red" width="'), width, F.lit('">'),
        F.lit('<img data-src="/i/'), pid, F.lit('.jpg" src="data:image/gif;base64,AAAA">'),
        F.lit('<img src="../img/'), pid, F.lit('.gif" srcset="'),
        F.when(F.pmod(F.col("page_id"), F.lit(5)) == 0,
               F.concat(F.lit("/s/"), pid, F.lit("-2x.jpg 2x, /s/"), pid, F.lit("-3000.jpg 3000w")))
        .otherwise(F.concat(F.lit("/s/"), pid, F.lit("-320.jpg 320w, /s/"), pid, F.lit("-640.jpg 640w, /s/"), pid,
                            F.lit("-1280.jpg 1280w, /s/"), pid, F.lit("-2x.jpg 2x"))),
        F.lit('">'),
        F.lit('<a href="/x'), pid, F.lit('"> </a><font style="background:blue">f</font>'),
        F.lit('<svg><circle r="1"/></svg><a href="'), F.coalesce(F.col("next_url"), F.lit("#")),
        F.lit('">single page</a><a href="?page=2">2</a><a href="?page=3">3</a><a href="?page=2">2</a>'))
    refresh = F.when(F.pmod(F.col("page_id"), F.lit(4)) == 0,
                     F.concat(F.lit('<meta http-equiv="refresh" content="0; url='),
                              F.coalesce(F.col("next_url"), F.col("url")), F.lit('">'))).otherwise(F.lit(""))
    base = F.when(F.pmod(F.col("page_id"), F.lit(2)) == 0,
                  F.concat(F.lit('<base href="https://'), host, F.lit('/b/">'))).otherwise(F.lit(""))
    html = F.concat(base, refresh,
                    F.replace(F.col("html"), F.lit("<article>"), inject),
                    F.lit('<body class="second"><p>tail '), pid, F.lit("</p></body>"))
    return (p.join(nxt, "page_id", "left")
            .select("page_id", "url", host.alias("host"), "next_url", html.alias("html")))


DERIVED_SQL = f"""
SELECT p.page_id, p.url, {HOST_SQL.replace('url', 'p.url')} AS host, n.url AS next_url,
  (CASE WHEN p.page_id % 2 = 0 THEN '<base href="https://' || {HOST_SQL.replace('url', 'p.url')} || '/b/">' ELSE '' END)
  || (CASE WHEN p.page_id % 4 = 0 THEN '<meta http-equiv="refresh" content="0; url=' || coalesce(n.url, p.url) || '">'
           ELSE '' END)
  || replace(p.html, '<article>',
       '<article><form action="/s"><input name="q"></form><img src="http://cdn.' || {HOST_SQL.replace('url', 'p.url')}
       || '/p' || CAST(p.page_id AS VARCHAR) || '.png" style="color:red" width="'
       || CAST((p.page_id % 7 + 1) * 100 AS VARCHAR) || '">'
       || '<img data-src="/i/' || CAST(p.page_id AS VARCHAR) || '.jpg" src="data:image/gif;base64,AAAA">'
       || '<img src="../img/' || CAST(p.page_id AS VARCHAR) || '.gif" srcset="'
       || CASE WHEN p.page_id % 5 = 0
               THEN '/s/' || CAST(p.page_id AS VARCHAR) || '-2x.jpg 2x, /s/' || CAST(p.page_id AS VARCHAR) || '-3000.jpg 3000w'
               ELSE '/s/' || CAST(p.page_id AS VARCHAR) || '-320.jpg 320w, /s/' || CAST(p.page_id AS VARCHAR)
                    || '-640.jpg 640w, /s/' || CAST(p.page_id AS VARCHAR) || '-1280.jpg 1280w, /s/'
                    || CAST(p.page_id AS VARCHAR) || '-2x.jpg 2x' END || '">'
       || '<a href="/x' || CAST(p.page_id AS VARCHAR) || '"> </a><font style="background:blue">f</font>'
       || '<svg><circle r="1"/></svg><a href="' || coalesce(n.url, '#')
       || '">single page</a><a href="?page=2">2</a><a href="?page=3">3</a><a href="?page=2">2</a>')
  || '<body class="second"><p>tail ' || CAST(p.page_id AS VARCHAR) || '</p></body>' AS html
FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1
"""
