"""Registered queries producing documents, listings and feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.functions import html as H
from feedloom.functions.common import steps
from feedloom.operators import entries as E
from feedloom.plans import fixtures as X
from feedloom.plans.q_entries import SQL_KEPT, _pages, new_items
from feedloom.plans.sqlparts import excise_sql
from feedloom.session import scratch_path
from feedloom.sinks import documents as D
from feedloom.sources.rules import attach_rules
from feedloom.sources.tables import read_table

# The run day of the fixture and its weekday name.
RUN_DAY = "2024-01-12"
RUN_DAY_NAME = "Fri"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_text(s: str) -> str:
    """SQL expression for a Python text with newlines (chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join(_q(p) for p in parts) if len(parts) > 1 else _q(s)


# -------------------------------------------------------------- index_pages
def index_pages(spark, sf_dir):
    """S10 per-feed index documents: W1 numbering, W2/W3 next links and anchors,
    E12 padded/short titles, H20 no-content, H19 index patterns, H18 cut, byline."""
    n = new_items(spark, sf_dir, with_content=True)
    n = attach_rules(n, X.rules_view(spark, "levels", "skip_links", "min_width", "index_skip_content_pats",
                                     "rss_entry_size"), on="rule_key")
    n = n.withColumn("author", F.when(F.pmod("pos", F.lit(2)) == 0,
                                      F.concat(F.lit("Writer "), F.col("pos").cast("string"), F.lit(" & co"))))
    n = n.withColumn("author", H.excise(F.col("author"), "index_skip_content_pats", flags=""))
    n = steps(n, "content", H.no_content, lambda c: H.excise(c, "index_skip_content_pats", flags=""),
              lambda c: H.cut_excerpt(c, F.col("rss_entry_size")))
    n = n.withColumn("title", E.padded_title(F.col("title"), F.col("min_width")))
    block = D.item_block("item_no", "title", "link", "anchor", "levels", "skip_links", "content", "author",
                         "next_item")
    blocks = n.select("feed", F.lit(RUN_DAY).alias("day"), "item_no", block.alias("block"),
                      F.lit(RUN_DAY_NAME).alias("day_name"), E.feed_title(F.lit(""), F.col("feed")).alias("title"))
    return D.index_documents(blocks).select("feed", "n_items", "index_html")


TITLE_SQL = ("CASE WHEN length(title) < min_width THEN title || repeat('. ', min_width - length(title)) || '__' "
             "ELSE title END")


def item_block_sql() -> str:
    """One item's block from item_no, n_items, t (padded title), anchor, link, levels, skip_links, c (content), author."""
    short = ("CASE WHEN length(t) > 16 THEN regexp_replace(substr(t, 1, 16), '<.*?>', '', 'g') || '...' ELSE t END")
    page_link = "'<a href=\"' || CAST(item_no AS VARCHAR) || '.html' || anchor || '\">'"
    story_link = "'<a href=\"' || link || '\">'"
    itemlink = f"CASE WHEN levels > 1 THEN {page_link} WHEN skip_links THEN NULL ELSE {story_link} END"
    head = (f"CASE WHEN levels > 1 THEN {page_link} || '<b>' || t || '</b></a>' || chr(10) "
            f"WHEN skip_links THEN chr(10) || '<b>' || t || '</b>' || chr(10) "
            f"ELSE chr(10) || {story_link} || t || '</a>' || chr(10) END")
    nxt = (f"CASE WHEN item_no + 1 >= n_items THEN {_sql_text(D.LAST_ITEM)} "
           f"ELSE '<br>' || chr(10) || '<center><i><a href=\"#' || CAST(item_no + 1 AS VARCHAR) "
           f"|| '\">&gt;-&gt;</a></i></center>' || chr(10) || '<br>' || chr(10) END")
    by = ("CASE WHEN author IS NOT NULL AND author <> '' "
          "THEN chr(10) || '<br><i>By: ' || author || '</i><br>' ELSE '' END")
    tail = (f"CASE WHEN ({itemlink}) IS NOT NULL THEN chr(10) || '<br><center>[[' || ({itemlink}) || ({short}) "
            f"|| '</a>]]</center>' || chr(10) || chr(10) ELSE '' END")
    return (f"'<p><a name=\"' || CAST(item_no AS VARCHAR) || '\">&nbsp;</a>' || ({head}) || ({nxt}) || c "
            f"|| {_sql_text(D.CLEAR)} || ({by}) || ({tail})")


def index_head_sql(title: str) -> str:
    head_doc = D.INDEX_HEAD.replace("{day}", "\x01").replace("{feed}", "\x02").replace("{title}", "\x03")
    return _sql_text(head_doc).replace("\x01", f"' || '{RUN_DAY_NAME}' || '").replace(
        "\x02", "' || feed || '").replace("\x03", f"' || {title} || '")


def _index_pages_sql():
    pats = "index_skip_content_pats"
    content = "CASE WHEN content IS NULL OR trim(content) = '' THEN '[No content]' ELSE content END"
    content = excise_sql(pats, content, flags="")
    content = (f"CASE WHEN coalesce(rss_entry_size, 0) > 0 "
               f"THEN regexp_replace(substr({content}, 1, rss_entry_size), '<[^>]*$', '') ELSE {content} END")
    title, block, hd = TITLE_SQL, item_block_sql(), index_head_sql("'[' || feed || ']'")
    tail_doc = D.INDEX_TAIL.split("{n}")
    return f"""
WITH {SQL_KEPT},
seen AS ({X.SEEN_SQL}),
n0 AS (SELECT d2.* FROM d2 WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.site = d2.feed AND s.item_id = d2.item_id)),
n1 AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pos) - 1 AS item_no,
              count(*) OVER (PARTITION BY feed) AS n_items FROM n0),
r2 AS ({X.rules_sql(["levels", "skip_links", "min_width", "index_skip_content_pats", "rss_entry_size"])}),
n2 AS (SELECT n1.*, r2.levels, r2.skip_links, r2.min_width, r2.index_skip_content_pats, r2.rss_entry_size,
              CASE WHEN pos % 2 = 0 THEN 'Writer ' || CAST(pos AS VARCHAR) || ' & co' END AS author0
       FROM n1 LEFT JOIN r2 USING (rule_key)),
n3 AS (SELECT *, {excise_sql(pats, 'author0', flags='')} AS author, {content} AS c, {title} AS t FROM n2),
b AS (SELECT feed, item_no, n_items, {block} AS block FROM n3)
SELECT feed, CAST(count(*) AS BIGINT) AS n_items,
       {hd} || string_agg(block, '' ORDER BY item_no) || {_sql_text(tail_doc[0])} || CAST(count(*) AS VARCHAR)
       || {_sql_text(tail_doc[1])} AS index_html
FROM b GROUP BY feed
"""


# ----------------------------------------------------------- story_assembly
def story_assembly(spark, sf_dir):
    """A4: multi-page stories (conversation = story, turn = page number) joined in page order."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = D.assemble_stories(c.withColumnRenamed("conv_id", "story").withColumnRenamed("turn", "page_no"))
    return out.select("story", "n_pages", F.length("text").cast("long").alias("n_chars"),
                      F.sha2(F.col("text"), 256).alias("digest"))


SQL_STORY = """
SELECT conv_id AS story, CAST(count(*) AS BIGINT) AS n_pages,
       CAST(length(string_agg(text, chr(10) ORDER BY turn)) AS BIGINT) AS n_chars,
       sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest
FROM conversations GROUP BY conv_id
"""


# ---------------------------------------------------------------- manifest
def _written_files(spark, sf_dir):
    """Files a run writes: index and story pages per feed, images per feed (from the new entries)."""
    n = new_items(spark, sf_dir)
    slug = E.slugify_ascii(F.col("feed"))
    paths = F.array(
        F.concat(slug, F.lit("/"), F.col("item_no").cast("string"), F.lit(".html")),
        F.concat(slug, F.lit("/index.html")),
        F.when(F.pmod("pos", F.lit(3)) == 0,
               F.concat(slug, F.lit("/img"), F.col("pos").cast("string"), F.lit(".jpg"))))
    # one pass: every new item names its page, its feed's index and maybe an image
    return (n.select(F.lit(RUN_DAY).alias("day"), F.explode(paths).alias("path"))
            .filter(F.col("path").isNotNull()))


def manifest_rows(spark, sf_dir):
    """Manifest rows: feed directories and html first, other files next, '.EOF.' last."""
    return D.manifest(_written_files(spark, sf_dir)).select("day", F.col("section").cast("long").alias("section"),
                                                              "path")


def _slug_sql(x):
    return (f"regexp_replace(regexp_replace(regexp_replace({x}, '[^\\w\\s-]', '', 'g'), '[-\\s]+', '_', 'g'), "
            f"'^[-_]+|[-_]+$', '', 'g')")


def _files_sql():
    return f"""
WITH {SQL_KEPT},
seen AS ({X.SEEN_SQL}),
n0 AS (SELECT d2.* FROM d2 WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.site = d2.feed AND s.item_id = d2.item_id)),
n1 AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pos) - 1 AS item_no FROM n0),
files AS (SELECT {_slug_sql('feed')} || '/' || CAST(item_no AS VARCHAR) || '.html' AS path FROM n1
          UNION ALL SELECT DISTINCT {_slug_sql('feed')} || '/index.html' FROM n1
          UNION ALL SELECT {_slug_sql('feed')} || '/img' || CAST(pos AS VARCHAR) || '.jpg' FROM n1 WHERE pos % 3 = 0)
"""


SQL_MANIFEST = f"""
{_files_sql()}
SELECT '{RUN_DAY}' AS day, CAST(0 AS BIGINT) AS section, path FROM
  (SELECT DISTINCT split_part(path, '/', 1) || '/' AS path FROM files WHERE split_part(path, '/', 1) <> ''
   UNION ALL SELECT path FROM files WHERE suffix(path, '.html')) a
UNION ALL SELECT '{RUN_DAY}', CAST(1 AS BIGINT), path FROM files WHERE NOT suffix(path, '.html')
UNION ALL SELECT '{RUN_DAY}', CAST(2 AS BIGINT), '.EOF.'
"""


# ------------------------------------------------------------ daily_listing
def daily_listing(spark, sf_dir):
    """Per day, the feeds (users) with an index that day, sorted."""
    ev = read_table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    idx = ev.filter(F.col("event_type") == "view").select(
        F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"),
        F.format_string("u%04d", F.col("user_id")).alias("feed"))
    return D.daily_listing(idx)


SQL_LISTING = """
SELECT day, array_to_string(list_sort(list(DISTINCT feed)), ' ') AS feeds, CAST(count(DISTINCT feed) AS BIGINT) AS n_feeds
FROM (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, printf('u%04d', user_id) AS feed
      FROM events WHERE event_type = 'view') GROUP BY day
"""


# ---------------------------------------------------------------- messages
def messages(spark, sf_dir):
    """A5: all rejects of a run (entry skips, content skips, unusable rules) by severity and stage."""
    return D.message_summary(_run_rejects(spark, sf_dir))


def message_log(spark, sf_dir):
    """A5: every distinct message of a run with its count."""
    return D.message_log(_run_rejects(spark, sf_dir))


def _run_rejects(spark, sf_dir):
    from feedloom.operators.tokens import bad_node_specs
    from feedloom.plans.q_entries import _linked_entries
    e = E.with_item_ids(_linked_entries(spark, sf_dir))
    e = attach_rules(e, X.rules_view(spark, "skip_link_pats", "skip_title_pats", "skip_content_pats",
                                     "skip_nodes"), on="rule_key")
    _, r1 = E.skip_filter(e)
    _, r2 = E.content_skip(e.withColumn("item_id", F.coalesce("item_id", F.lit(""))), "content")
    r3 = bad_node_specs(e.select("feed", F.explode("skip_nodes").alias("spec")))
    return r1.unionByName(r2).unionByName(r3)


def _messages_sql():
    from feedloom.plans.q_entries import SQL_LINKED
    from feedloom.plans.sqlparts import first_match_sql
    from feedloom.operators.tokens import NODE_SPEC_RE
    spec = NODE_SPEC_RE.replace("'", "''")
    return f"""
WITH {SQL_LINKED},
r AS ({X.rules_sql(["skip_link_pats", "skip_title_pats", "skip_content_pats", "skip_nodes"])}),
j AS (SELECT ids.*, r.skip_link_pats, r.skip_title_pats, r.skip_content_pats, r.skip_nodes
      FROM ids LEFT JOIN r USING (rule_key)),
w AS (SELECT *, {first_match_sql('skip_link_pats', "coalesce(link, '')")} AS lp,
                {first_match_sql('skip_title_pats', "coalesce(title, '')", '(?i)')} AS tp,
                {first_match_sql('skip_content_pats', 'content')} AS cp FROM j),
r1 AS (SELECT 'info' AS severity, 'entry' AS stage,
         CASE WHEN raw_id IS NULL THEN 'no id or link' WHEN lp IS NOT NULL THEN 'skip_link_pats: ' || lp
              WHEN tp IS NOT NULL THEN 'skip_title_pats: ' || tp ELSE 'mp3 link' END AS reason
       FROM w WHERE raw_id IS NULL OR lp IS NOT NULL OR tp IS NOT NULL OR suffix(coalesce(link, ''), 'mp3')),
r2 AS (SELECT 'info' AS severity, 'content' AS stage, 'no content: matched ' || cp AS reason FROM w WHERE cp IS NOT NULL),
sp AS (SELECT DISTINCT feed, unnest(skip_nodes) AS spec FROM j),
r3 AS (SELECT 'warn' AS severity, 'rules' AS stage, 'unusable skip_nodes spec: ' || spec AS reason FROM sp
       WHERE regexp_extract(spec, '{spec}', 1) = '' OR regexp_extract(spec, '{spec}', 2) = ''),
a AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)
SELECT severity, stage, CAST(count(*) AS BIGINT) AS n, min(reason) AS first_reason FROM a GROUP BY severity, stage
"""


# ---------------------------------------------------------------- url_feed
def url_feed(spark, sf_dir):
    """Feed items from saved URL lists: request list union line files (every page is in one, some in
    both), trimmed, blank and 'none' dropped; title = description = link (XML-escaped), pubDate = run time."""
    from feedloom.sources.urllists import url_items
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    requests = p.filter("page_id % 2 = 0 OR page_id % 11 = 0").select(
        F.expr("CASE WHEN page_id % 14 = 0 THEN 'none' ELSE url END").alias("value"))
    lines = p.filter("page_id % 2 = 1 OR page_id % 3 = 0 OR page_id % 14 = 0").select(
        F.expr("CASE WHEN page_id % 11 = 0 AND page_id % 14 <> 0 THEN '   ' ELSE concat('  ', url, ' ') END").alias("value"))
    items = url_items(requests, lines, X.run_ts())
    return items.select("link", "title", "description", "pub_date")


SQL_URL_FEED = """
WITH u AS (SELECT CASE WHEN page_id % 14 = 0 THEN 'none' ELSE url END AS link FROM pages
      WHERE page_id % 2 = 0 OR page_id % 11 = 0),
l AS (SELECT trim(CASE WHEN page_id % 11 = 0 AND page_id % 14 <> 0 THEN '   ' ELSE '  ' || url || ' ' END) AS link
      FROM pages WHERE page_id % 2 = 1 OR page_id % 3 = 0 OR page_id % 14 = 0),
t AS (SELECT link FROM u WHERE link <> 'none' UNION ALL SELECT link FROM l WHERE link <> ''),
x AS (SELECT link, replace(replace(replace(link, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS esc FROM t)
SELECT link, esc AS title, esc AS description, 'Fri, 12 Jan 2024 00:00:00 +0000' AS pub_date FROM x
"""


# ---------------------------------------------------------------- new_dirs
def new_dirs(spark, sf_dir):
    """Feed directories present now but not before (set difference)."""
    ev = read_table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    dirs = ev.select(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"),
                     F.format_string("u%04d_%s", F.col("user_id"), F.col("event_type")).alias("feed"))
    before = dirs.filter(F.col("day") < "2024-01-02")
    return dirs.select("feed").distinct().subtract(before.select("feed"))


SQL_NEW_DIRS = """
SELECT printf('u%04d_%s', user_id, event_type) AS feed FROM events
EXCEPT SELECT printf('u%04d_%s', user_id, event_type) FROM events
WHERE strftime(CAST(ts AS DATE), '%Y-%m-%d') < '2024-01-02'
"""


QUERIES = {
    "index_pages": index_pages,
    "story_assembly": story_assembly,
    "manifest_rows": manifest_rows,
    "daily_listing": daily_listing,
    "messages": messages,
    "message_log": message_log,
    "url_feed": url_feed,
    "new_dirs": new_dirs,
}

SQL = {
    "index_pages": _index_pages_sql(),
    "story_assembly": SQL_STORY,
    "manifest_rows": SQL_MANIFEST,
    "daily_listing": SQL_LISTING,
    "messages": _messages_sql(),
    "message_log": _messages_sql().replace(
        "CAST(count(*) AS BIGINT) AS n, min(reason) AS first_reason FROM a GROUP BY severity, stage",
        "reason, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY severity, stage, reason"),
    "url_feed": SQL_URL_FEED,
    "new_dirs": SQL_NEW_DIRS,
}


# ------------------------------------------------------------- complete_days
def complete_days(spark, sf_dir):
    """Only days whose manifest ends with the '.EOF.' sentinel are read (left semi join)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    day = F.date_format(F.to_date("ts"), "yyyy-MM-dd")
    files = ev.select(day.alias("day"), F.format_string("u%04d/%d.html", "user_id", "event_id").alias("path"))
    errors = ev.groupBy(day.alias("day")).agg(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("e"))
    sentinel = errors.filter(F.pmod("e", F.lit(2)) == 0).select("day", F.lit(D.MANIFEST_END).alias("path"))
    manifests = files.unionByName(sentinel)
    ready = manifests.filter(F.col("path") == D.MANIFEST_END).select("day")
    return (files.join(ready, "day", "left_semi").groupBy("day")
            .agg(F.count(F.lit(1)).cast("long").alias("n_files")))


SQL_COMPLETE_DAYS = """
WITH f AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type FROM events),
ready AS (SELECT day FROM f GROUP BY day HAVING sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) % 2 = 0)
SELECT day, CAST(count(*) AS BIGINT) AS n_files FROM f WHERE day IN (SELECT day FROM ready) GROUP BY day
"""


# -------------------------------------------------------------- url_archive
def url_archive(spark, sf_dir):
    """Two runs append their saved URLs to the cumulative archive table."""
    import uuid

    from feedloom.session import scratch_path
    from feedloom.sources.urllists import append_archive
    path = scratch_path(spark, f"archive-{uuid.uuid4().hex}")
    items = url_feed(spark, sf_dir)
    append_archive(items, path)
    append_archive(items, path)
    return spark.read.parquet(path).groupBy("link").agg(F.count(F.lit(1)).cast("long").alias("n"))


SQL_URL_ARCHIVE = f"SELECT link, CAST(2 * count(*) AS BIGINT) AS n FROM ({SQL_URL_FEED}) x GROUP BY link"


# -------------------------------------------------------------- story_files
def story_files(spark, sf_dir):
    """Story pages written partitioned by day and feed; a rewrite replaces
    only the (day, feed) partitions it contains (dynamic partition overwrite)."""
    import uuid

    from feedloom.session import scratch_path
    path = scratch_path(spark, f"stories-{uuid.uuid4().hex}")
    p = _pages(spark, sf_dir)
    feed = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    base = p.select(feed.alias("feed"), F.col("page_id").alias("page_no"), "html")
    D.write_stories(base.withColumn("day", F.lit("2024-01-11")), path)
    second = (base.filter(F.pmod("page_no", F.lit(2)) == 0).withColumn("day", F.lit("2024-01-11"))
              .unionByName(base.withColumn("day", F.lit("2024-01-12"))))
    D.write_stories(second, path)
    return (spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "feed")
            .agg(F.count(F.lit(1)).cast("long").alias("n_pages")))


SQL_STORY_FILES = f"""
WITH b AS (SELECT {X.HOST_SQL} AS feed, page_id FROM pages),
even_feeds AS (SELECT DISTINCT feed FROM b WHERE page_id % 2 = 0)
SELECT '2024-01-11' AS day, feed,
       CAST(CASE WHEN feed IN (SELECT feed FROM even_feeds) THEN count(*) FILTER (WHERE page_id % 2 = 0)
                 ELSE count(*) END AS BIGINT) AS n_pages
FROM b GROUP BY feed
UNION ALL SELECT '2024-01-12', feed, CAST(count(*) AS BIGINT) FROM b GROUP BY feed
"""

QUERIES.update({"complete_days": complete_days, "url_archive": url_archive, "story_files": story_files})
SQL.update({"complete_days": SQL_COMPLETE_DAYS, "url_archive": SQL_URL_ARCHIVE, "story_files": SQL_STORY_FILES})


# ----------------------------------------------- manifest_files, retention_drop
def _host(pages):
    feed = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    return F.coalesce(F.nullif(feed, F.lit("")), F.lit("none"))


def manifest_files(spark, sf_dir):
    """S11 on what S9 wrote: two days published, one of them twice, the tree listed; the part files' own names are cut."""
    path = scratch_path(spark, f"published-{uuid.uuid4().hex}")
    p = _pages(spark, sf_dir)
    base = p.select(_host(p).alias("feed"), F.col("page_id").alias("page_no"), "html")
    D.publish_stories(base, path, "2024-01-11")
    D.publish_stories(base, path, "2024-01-12")
    D.publish_stories(base.filter(F.pmod("page_no", F.lit(2)) == 0), path, "2024-01-11")
    files = D.written_files(spark, path).select("day", F.concat_ws("/", "feed", "file").alias("path"))
    return (D.manifest(files).select("day", F.col("section").cast("long").alias("section"),
                                     F.regexp_replace("path", "/part-.*$", "/part").alias("path")).distinct())


SQL_MANIFEST_FILES = f"""
WITH b AS (SELECT coalesce(nullif({X.HOST_SQL}, ''), 'none') AS feed, page_id FROM pages),
f AS (SELECT DISTINCT '2024-01-11' AS day, feed FROM b WHERE page_id % 2 = 0
      UNION ALL SELECT DISTINCT '2024-01-12', feed FROM b)
SELECT day, CAST(0 AS BIGINT) AS section, feed || '/' AS path FROM f
UNION ALL SELECT day, 1, feed || '/part' FROM f
UNION ALL SELECT DISTINCT day, 2, '.EOF.' FROM f
"""


def retention_drop(spark, sf_dir):
    """T4 and J5 on written output: each event type's rows of a day are a feed's stories; the days that retention
    names are deleted, then the tree is listed: what is gone is to be produced again."""
    from feedloom.operators import state as S
    from feedloom.plans.q_state import KEEP_DAYS, RETENTION_DAYS
    path = scratch_path(spark, f"retained-{uuid.uuid4().hex}")
    ev = read_table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("feed"), F.col("event_id").alias("page_no"),
        F.col("user_id").cast("string").alias("html"))
    D.write_stories(ev, path)
    wanted = ev.groupBy("day", "feed").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    days = D.written_files(spark, path).select(F.to_date("day").alias("day")).distinct()
    keep = spark.createDataFrame([(d,) for d in KEEP_DAYS], "day string").select(F.to_date("day").alias("day"))
    D.drop_days(path, S.retention(days, F.to_date(F.lit(RUN_DAY)), RETENTION_DAYS, keep))
    again = S.already_fed(wanted, D.written_files(spark, path)).select("day", "feed", "n_rows", F.lit("again").alias("state"))
    kept = (spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), F.col("feed").cast("string").alias("feed"))
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows")).withColumn("state", F.lit("kept")))
    return kept.unionByName(again)


SQL_RETENTION_DROP = """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type AS feed, CAST(count(*) AS BIGINT) AS n_rows,
  CASE WHEN CAST(ts AS DATE) < DATE '2024-01-05' AND CAST(ts AS DATE) <> DATE '2024-01-02' THEN 'again' ELSE 'kept' END AS state
FROM events GROUP BY CAST(ts AS DATE), event_type
"""

QUERIES.update({"manifest_files": manifest_files, "retention_drop": retention_drop})
SQL.update({"manifest_files": SQL_MANIFEST_FILES, "retention_drop": SQL_RETENTION_DROP})
