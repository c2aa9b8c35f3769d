"""Registered query for the whole daily run (P1), checked on counts and on every text it writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.plans import fixtures as X
from feedloom.plans import q_html as Q
from feedloom.plans.daily import RULE_COLS, run_day
from feedloom.plans.q_docs import TITLE_SQL, _sql_text, index_head_sql, item_block_sql
from feedloom.plans.q_entries import SQL_KEPT, _pages, _rfc2822_sql
from feedloom.plans.sqlparts import crop_sql, excise_sql, first_match_sql, reassemble_sql, tokens_sql
from feedloom.sinks import documents as D

RUN_DAY = "2024-01-12"

#: Some pages are emptied and some are no text, so that stories come to nothing and leave the numbering.
EMPTY = "page_id % 13 = 6"
IMAGE = "page_id % 29 = 3"


def fetched_pages(pages):
    return pages.selectExpr("url", f"IF({EMPTY}, '<html><body> </body></html>', html) AS html",
                            f"IF({IMAGE}, 'image/png', 'text/html; charset=utf-8') AS content_type")


def feed_entries(pages):
    return (X.entries_view(pages)
            .withColumn("author", F.expr("IF(pos % 2 = 0, concat('Writer ', pos, ' & co'), NULL)"))
            .withColumn("feed_title", F.expr("IF(rule_key = 'org', NULL, concat('News of ', feed))")))


def digest(rows, no, text, out):
    """Order-free digest of numbered texts, and their number, per feed: no text is gathered anywhere."""
    part = F.expr(f"CAST(conv(substr(md5(concat({no}, ':', {text})), 1, 15), 16, 10) AS bigint)")
    return rows.groupBy("feed").agg(F.count(F.lit(1)).alias(f"n_{out}"), F.bit_xor(part).alias(f"{out}_digest"))


def daily_run(spark, sf_dir):
    """One job over all feeds; per feed: items kept, story pages and index blocks with digests of their whole
    texts, rejects by stage, ids in the new seen-set, last run in the new state, manifest rows are tested apart."""
    pages = _pages(spark, sf_dir)
    out = run_day(feed_entries(pages), fetched_pages(pages), X.rules_view(spark, *RULE_COLS), X.seen_view(pages),
                  X.state_view(pages), X.run_ts(), RUN_DAY, "Fri", rule_key="rule_key")
    items = out["items"].groupBy("feed").agg(F.count(F.lit(1)).alias("n_items"),
                                             (F.max("item_no") + 1).alias("last_number"))
    rejects = out["rejects"].groupBy("feed").agg(
        F.count(F.lit(1)).alias("n_rejects"), F.count_if(F.col("stage") == "fetch").alias("n_unfetched"),
        F.count_if((F.col("stage") == "content") & (F.col("severity") == "warn")).alias("n_empty"))
    seen = out["seen"].groupBy(F.col("site").alias("feed")).agg(F.count(F.lit(1)).alias("n_seen"))
    state = out["state"].select(F.col("site").alias("feed"), F.unix_timestamp("last_fed").alias("last_fed"))
    parts = [items, digest(out["stories"], "page_no", "html", "pages"), digest(out["index"], "seq", "block", "blocks"),
             rejects, seen, state]
    got = X.entries_view(pages).select("feed").distinct()
    for p in parts:
        got = got.join(p, "feed", "left")
    return got.select("feed", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in got.columns if c != "feed"])


def _digest_sql(rows, no, text, out):
    return (f"SELECT feed, count(*) AS n_{out}, bit_xor(CAST('0x' || substr(md5(CAST({no} AS VARCHAR) || ':' || {text}), 1, 15) "
            f"AS BIGINT)) AS {out}_digest FROM {rows} GROUP BY feed")


def _daily_sql():
    cols = ["allow_repeats", "nocache", "save_days", "levels", "skip_content_pats", "story_url_rewrite", "url_substitute",
            "page_start", "page_end", "skip_pats", "skip_nodes", "skip_images", "skip_links", "min_width",
            "index_skip_content_pats", "rss_entry_size", "simplify_rss"]
    rewritten = "CASE WHEN len({1}) = 2 THEN regexp_replace({0}, {1}[1], {1}[2], 'g') ELSE {0} END"
    refresh = ("regexp_extract(regexp_extract({0}, '(?i)(<meta\\b[^>]*http-equiv\\s*=\\s*[\"'']?refresh[^>]*>)', 1), "
               "'(?i)url\\s*=\\s*([^\"''>\\s]+)', 1)").format("h")
    note = (f"CASE WHEN {refresh} <> '' THEN 'Meta refresh suppressed.<br /><a href=\"' || {refresh} || '\">' || {refresh} "
            "|| '</a>' ELSE '' END")
    absolute = ("regexp_replace(h, '(?i)(<a\\s(?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*?\\bhref=\")(/[^\"]*)\"', "
                "'\\1' || regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '\\2\"', 'g')")
    seen_text = "regexp_replace(regexp_replace(b, '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '(?i)&nbsp;|\\s', '', 'g')"
    tail = D.INDEX_TAIL.split("{n}")
    return f"""
WITH {SQL_KEPT},
seen AS ({X.SEEN_SQL}),
st AS ({X.STATE_SQL}),
r3 AS ({X.rules_sql(cols)}),
x AS (SELECT d2.*, {', '.join('r3.' + c for c in cols)},
             CASE WHEN pos % 2 = 0 THEN 'Writer ' || CAST(pos AS VARCHAR) || ' & co' END AS author,
             epoch({_rfc2822_sql('d2.published')}) AS pub, epoch(st.last_fed) AS lf,
             EXISTS (SELECT 1 FROM seen s WHERE s.site = d2.feed AND s.item_id = d2.item_id) AS was_seen
      FROM d2 LEFT JOIN r3 USING (rule_key) LEFT JOIN st ON st.site = d2.feed),
cand AS (SELECT * FROM x WHERE NOT was_seen OR (coalesce(allow_repeats, false) AND coalesce(pub > lf, false))),
aged AS (SELECT *, CASE WHEN pub IS NULL OR lf IS NULL THEN 'normal'
                        WHEN pub < lf AND NOT coalesce(nocache, false)
                          THEN CASE WHEN pub <= {X.RUN_TS_EPOCH} - save_days * 86400 THEN 'expired' ELSE 'older' END
                        ELSE 'normal' END AS status FROM cand),
c0 AS (SELECT *, CASE WHEN levels >= 2 THEN {rewritten.format('link', 'story_url_rewrite')} ELSE link END AS story_link
       FROM aged WHERE status <> 'expired'),
c1 AS (SELECT *, {rewritten.format('story_link', 'url_substitute')} AS fetch_url FROM c0),
pg0 AS (SELECT url, CASE WHEN {IMAGE} THEN '<p>Contents not text! (image/png) <a href="' || url || '">' || url || '</a></p>'
                         WHEN {EMPTY} THEN '<html><body> </body></html>' ELSE html END AS html FROM pages),
pg AS (SELECT url, min(html) AS html FROM pg0 GROUP BY url),
c2 AS (SELECT c1.*, pos AS page_id, CASE WHEN levels <= 1 THEN NULL WHEN levels >= 2 THEN pg.html
                                         ELSE coalesce(content, '') || chr(10) END AS page_html
       FROM c1 LEFT JOIN pg ON pg.url = c1.fetch_url),
c3 AS (SELECT *, {first_match_sql('skip_content_pats', 'page_html')} AS skipped FROM c2),
s1 AS (SELECT *, {Q.byline_sql('page_html')} AS h FROM c3 WHERE page_html IS NOT NULL AND skipped IS NULL),
s2 AS (SELECT * EXCLUDE (h), {crop_sql('h', 'page_start', 'page_end')} AS h FROM s1),
s3 AS (SELECT * EXCLUDE (h), {excise_sql('skip_pats', 'h')} AS html FROM s2),
{Q.node_delete_ctes('s3', 'd_')},
d_clean AS ({reassemble_sql('d_kept', out='clean')}),
d_there AS (SELECT DISTINCT page_id FROM d_cov),
s4 AS (SELECT s3.* EXCLUDE (html), CASE WHEN o.page_id IS NULL THEN s3.html ELSE coalesce(c.clean, '') END AS html
       FROM s3 LEFT JOIN d_there o USING (page_id) LEFT JOIN d_clean c USING (page_id)),
b_t AS ({tokens_sql('s4')}),
b_m AS (SELECT *, CASE WHEN tag IN ('html', 'body') AND kind IN ('open', 'close')
                       THEN row_number() OVER (PARTITION BY page_id, tag, kind ORDER BY pos) END AS n FROM b_t),
b_kept AS (SELECT * FROM b_m WHERE n IS NULL OR n = 1),
b_clean AS ({reassemble_sql('b_kept', out='clean')}),
s5 AS (SELECT s4.* EXCLUDE (html), coalesce(c.clean, s4.html) AS h FROM s4 LEFT JOIN b_clean c USING (page_id)),
s6 AS (SELECT * EXCLUDE (h), {note} || CASE WHEN contains(h, 'By: ' || author || chr(10) || '<p>' || chr(10) || '<body')
                                             THEN 'By: ' || author || chr(10) || '<p>' || chr(10) ELSE '' END AS note, {Q.strip_sql('h')} AS h FROM s5),
s7 AS (SELECT * EXCLUDE (h), {absolute} AS h FROM s6),
s8 AS (SELECT * EXCLUDE (h), {Q._body_only_sql('h')} AS b FROM s7),
s9 AS (SELECT page_id, note || {Q.ensure_h1_sql('b')} AS html, {seen_text} <> '' OR regexp_matches(b, '(?i)<img\\b') AS shown FROM s8),
told AS (SELECT c3.*, s9.html, levels <= 1 OR coalesce(s9.shown, false) AS ok,
                CASE WHEN levels > 1 AND skipped IS NULL AND page_html IS NULL THEN 'fetch'
                     WHEN levels > 1 AND skipped IS NULL AND NOT s9.shown THEN 'empty'
                     WHEN skipped IS NOT NULL THEN 'content' END AS why
         FROM c3 LEFT JOIN s9 USING (page_id)),
num AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pos) - 1 AS place,
               CAST(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY feed ORDER BY pos) - 1 AS BIGINT) AS item_no,
               CAST(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY feed) AS BIGINT) AS n_items FROM told),
items AS (SELECT * FROM num WHERE ok),
stories AS (SELECT feed, item_no AS page_no, {Q.wrap_sql('html', 'link')} AS html FROM items WHERE levels > 1),
i0 AS (SELECT *, CASE WHEN levels > 1 AND levels < 2 THEN html ELSE coalesce(content, '') END AS a FROM items),
i1 AS (SELECT * EXCLUDE (html), {Q.excerpt_sql('a')} AS html FROM i0),
{Q.node_delete_ctes('i1', 'e_')},
e_clean AS ({reassemble_sql('e_kept', out='clean')}),
e_there AS (SELECT DISTINCT page_id FROM e_cov),
i2 AS (SELECT i1.* EXCLUDE (html), CASE WHEN o.page_id IS NULL THEN i1.html ELSE coalesce(c.clean, '') END AS h
       FROM i1 LEFT JOIN e_there o USING (page_id) LEFT JOIN e_clean c USING (page_id)),
i3 AS (SELECT * EXCLUDE (h), {excise_sql('index_skip_content_pats', 'h', flags='')} AS h FROM i2),
cut AS (SELECT page_id, regexp_replace(substr(h, 1, rss_entry_size), '<[^>]*$', '') AS html FROM i3 WHERE rss_entry_size > 0),
{Q.repair_ctes('cut', 'r_')},
i4 AS (SELECT i3.* EXCLUDE (author), {excise_sql('index_skip_content_pats', 'author', flags='')} AS author, {TITLE_SQL} AS t,
              CASE WHEN rss_entry_size > 0 THEN coalesce(r_fixed.html, ' [...]') ELSE h END AS c
       FROM i3 LEFT JOIN r_fixed USING (page_id)),
docs AS (SELECT feed, max(n_items) AS n, max(place) AS last, max(rule_key) AS rule_key FROM num WHERE n_items > 0 GROUP BY feed),
heads AS (SELECT *, CASE WHEN rule_key = 'org' THEN '[' || feed || ']' ELSE 'News of ' || feed END AS feed_title FROM docs),
blocks AS (
  SELECT feed, place + 1 AS seq, {item_block_sql()} AS block FROM i4
  UNION ALL SELECT feed, place + 1, '<p>No content for <a href="' || story_link || '">' || title || '</a>' || chr(10)
            FROM num WHERE NOT ok AND n_items > 0
  UNION ALL SELECT feed, 0, {index_head_sql('feed_title')} FROM heads
  UNION ALL SELECT feed, last + 2, {_sql_text(tail[0])} || CAST(n AS VARCHAR) || {_sql_text(tail[1])} FROM heads),
reg AS (SELECT DISTINCT x.feed AS site, x.item_id FROM x
        WHERE NOT coalesce(x.nocache, false) AND x.feed IN (SELECT feed FROM items)),
rej AS (SELECT feed, 'entry' AS why FROM j WHERE raw_id IS NULL
          OR coalesce(list_bool_or(list_transform(skip_link_pats, lambda p: regexp_matches(coalesce(link, ''), p))), false)
          OR coalesce(list_bool_or(list_transform(skip_title_pats,
                lambda p: regexp_matches(coalesce(title, ''), '(?i)' || p))), false)
          OR suffix(coalesce(link, ''), 'mp3')
        UNION ALL SELECT feed, 'age' FROM aged WHERE status = 'expired'
        UNION ALL SELECT feed, why FROM told WHERE why IS NOT NULL),
ni AS (SELECT feed, count(*) AS n_items, max(item_no) + 1 AS last_number FROM items GROUP BY feed),
np AS ({_digest_sql('stories', 'page_no', 'html', 'pages')}),
nb AS ({_digest_sql('blocks', 'seq', 'block', 'blocks')}),
nr AS (SELECT feed, count(*) AS n_rejects, count(*) FILTER (WHERE why = 'fetch') AS n_unfetched,
              count(*) FILTER (WHERE why = 'empty') AS n_empty FROM rej GROUP BY feed),
ns AS (SELECT site AS feed, count(*) AS n_seen FROM (SELECT site, item_id FROM seen UNION SELECT site, item_id FROM reg) a
       GROUP BY site),
nl AS (SELECT site AS feed, max(t) AS last_fed FROM (SELECT site, CAST(epoch(last_fed) AS BIGINT) AS t FROM st
       UNION ALL SELECT site, {X.RUN_TS_EPOCH} FROM reg) b GROUP BY site),
f AS (SELECT DISTINCT feed FROM e)
SELECT f.feed, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in (
    'n_items', 'last_number', 'n_pages', 'pages_digest', 'n_blocks', 'blocks_digest', 'n_rejects', 'n_unfetched', 'n_empty',
    'n_seen', 'last_fed'))}
FROM f LEFT JOIN ni USING (feed) LEFT JOIN np USING (feed) LEFT JOIN nb USING (feed) LEFT JOIN nr USING (feed)
  LEFT JOIN ns USING (feed) LEFT JOIN nl USING (feed)
"""


QUERIES = {"daily_run": daily_run}
SQL = {"daily_run": _daily_sql()}
