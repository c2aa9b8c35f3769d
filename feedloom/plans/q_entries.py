"""Registered queries over feed entries.

Each query: (spark, sf_dir) -> DataFrame.  ``SQL`` holds the DuckDB twin
over the same parquet tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import dates
from feedloom.operators import entries as E
from feedloom.plans import fixtures as X
from feedloom.plans.sqlparts import first_match_sql
from feedloom.sources.rules import attach_rules
from feedloom.sources.tables import read_table


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def _rules(spark, *cols):
    return X.rules_view(spark, *cols)


def kept_entries(spark, sf_dir, extra_rules=()):
    """Entries after id extraction, J1 rules and the E4-E6 skip filters."""
    pages = _pages(spark, sf_dir)
    e = E.with_item_ids(X.entries_view(pages))
    e = attach_rules(e, _rules(spark, "skip_link_pats", "skip_title_pats", "allow_dup_titles",
                               *extra_rules), on="rule_key")
    kept, _ = E.skip_filter(e)
    return kept


def deduped_entries(spark, sf_dir, extra_rules=()):
    """D1 then D2 over the kept entries."""
    kept = kept_entries(spark, sf_dir, extra_rules).drop("content")
    return E.dedup_titles(E.dedup_ids(kept))


def new_items(spark, sf_dir, extra_rules=(), with_content=False):
    """D1, then the seen flag (J2, sharing D1's partitioning), D2 over all D1
    survivors (a seen entry still claims its title), keep the unseen, then
    W1 numbering with group sizes and W2 next numbers."""
    pages = _pages(spark, sf_dir)
    kept = kept_entries(spark, sf_dir, extra_rules)
    if not with_content:
        kept = kept.drop("content")
    d1 = E.mark_seen(E.dedup_ids(kept), X.seen_view(pages))
    n = E.dedup_titles(d1).filter(~F.col("_seen")).drop("_seen")
    n = E.number_within(n, ["feed"], "pos", size_col="n_items")
    return E.with_next(n, ["feed"], size_col="n_items")


def new_entries(spark, sf_dir):
    """The new items of every feed, numbered."""
    n = new_items(spark, sf_dir)
    return n.select("feed", "pos", "item_id", "anchor", "title", "item_no",
                    E.next_link("next_item").alias("next_link"))


SQL_KEPT = f"""
e AS ({X.ENTRIES_SQL}),
r AS ({X.rules_sql(["skip_link_pats", "skip_title_pats", "allow_dup_titles"])}),
j AS (SELECT e.*, replace(coalesce(e.id, e.guid, e.link), ' ', '+') AS raw_id,
             r.skip_link_pats, r.skip_title_pats, r.allow_dup_titles
      FROM e LEFT JOIN r USING (rule_key)),
k AS (SELECT *,
        CASE WHEN contains(raw_id, '#') THEN regexp_extract(raw_id, '^(.*)#[^#]*$', 1) ELSE raw_id END AS item_id,
        CASE WHEN contains(raw_id, '#') THEN regexp_extract(raw_id, '(#[^#]*)$', 1) ELSE '' END AS anchor
      FROM j
      WHERE raw_id IS NOT NULL
        AND NOT coalesce(list_bool_or(list_transform(skip_link_pats,
                 lambda p: regexp_matches(coalesce(link, ''), p))), false)
        AND NOT coalesce(list_bool_or(list_transform(skip_title_pats,
                 lambda p: regexp_matches(coalesce(title, ''), '(?i)' || p))), false)
        AND NOT suffix(coalesce(link, ''), 'mp3')),
d1 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY feed, item_id ORDER BY pos) = 1),
d2 AS (SELECT * FROM d1
       QUALIFY coalesce(allow_dup_titles, false)
            OR row_number() OVER (PARTITION BY feed, title ORDER BY pos) = 1)
"""

SQL_NEW_ENTRIES = f"""
WITH {SQL_KEPT},
seen AS ({X.SEEN_SQL}),
n AS (SELECT d2.* FROM d2 WHERE NOT EXISTS
        (SELECT 1 FROM seen s WHERE s.site = d2.feed AND s.item_id = d2.item_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pos) - 1 AS item_no,
             count(*) OVER (PARTITION BY feed) AS n_items FROM n)
SELECT feed, pos, item_id, anchor, title, item_no,
       CASE WHEN item_no + 1 < n_items THEN '#' || CAST(item_no + 1 AS VARCHAR) ELSE '[end]' END AS next_link
FROM m
"""

# ------------------------------------------------------------- entry_ids
def _linked_entries(spark, sf_dir):
    """v_entries with links/guid/id varied by position so every E1/E2 branch occurs."""
    e = X.entries_view(_pages(spark, sf_dir))
    pos = F.col("pos")
    alt = F.struct(F.concat(F.col("link"), F.lit("?alt")).alias("href"), F.lit("alternate").alias("rel"),
                   F.lit("text/html").alias("type"))
    amp = F.struct(F.concat(F.col("link"), F.lit("/amp")).alias("href"), F.lit("amphtml").alias("rel"),
                   F.lit("text/html").alias("type"))
    links = (F.when(F.pmod(pos, F.lit(4)) == 0, F.array(amp, alt))
             .when(F.pmod(pos, F.lit(4)) == 1, F.array(amp)))
    return (e.withColumn("links", links)
            .withColumn("id", F.when(F.pmod(pos, F.lit(3)) != 0,
                                     F.concat(F.col("id"), F.when(F.pmod(pos, F.lit(7)) == 0, F.lit(" x#a#b"))
                                              .otherwise(F.lit("")))))
            .withColumn("guid", F.when(F.pmod(pos, F.lit(5)) == 0, F.concat(F.lit("tag:"), F.col("feed"),
                                                                               F.lit(","), pos.cast("string")))))


def entry_ids(spark, sf_dir):
    """E1 alternate links, E2 id chain (id, guid, first alternate), E3 '+' encoding and last-'#' split."""
    e = E.with_item_ids(_linked_entries(spark, sf_dir))
    return e.select("feed", "pos", F.array_join(E.alternate_links("links", "link"), " ").alias("alt_links"),
                    F.coalesce("raw_id", F.lit("")).alias("raw_id"), F.coalesce("item_id", F.lit("")).alias("item_id"),
                    F.coalesce("anchor", F.lit("")).alias("anchor"), F.col("raw_id").isNotNull().alias("has_id"))


SQL_LINKED = f"""
e0 AS ({X.ENTRIES_SQL}),
le AS (SELECT feed, rule_key, pos, link, title, content, published,
         CASE WHEN pos % 3 <> 0 THEN id || CASE WHEN pos % 7 = 0 THEN ' x#a#b' ELSE '' END END AS id,
         CASE WHEN pos % 5 = 0 THEN 'tag:' || feed || ',' || CAST(pos AS VARCHAR) END AS guid,
         CASE WHEN pos % 4 = 0 THEN [{{'href': link || '/amp', 'rel': 'amphtml', 'type': 'text/html'}},
                                     {{'href': link || '?alt', 'rel': 'alternate', 'type': 'text/html'}}]
              WHEN pos % 4 = 1 THEN [{{'href': link || '/amp', 'rel': 'amphtml', 'type': 'text/html'}}] END AS links
       FROM e0),
alt AS (SELECT *, CASE WHEN links IS NOT NULL
                       THEN list_transform(list_filter(links, lambda l: l.rel = 'alternate' AND l.href IS NOT NULL),
                                           lambda l: l.href)
                       WHEN link IS NOT NULL THEN [link] ELSE CAST([] AS VARCHAR[]) END AS alts FROM le),
ids AS (SELECT *, replace(coalesce(id, guid, alts[1]), ' ', '+') AS raw_id FROM alt)
"""

SQL_ENTRY_IDS = f"""
WITH {SQL_LINKED}
SELECT feed, pos, array_to_string(alts, ' ') AS alt_links, coalesce(raw_id, '') AS raw_id,
       coalesce(CASE WHEN contains(raw_id, '#') THEN regexp_extract(raw_id, '^(.*)#[^#]*$', 1) ELSE raw_id END, '')
         AS item_id,
       coalesce(CASE WHEN contains(raw_id, '#') THEN regexp_extract(raw_id, '(#[^#]*)$', 1) ELSE '' END, '') AS anchor,
       raw_id IS NOT NULL AS has_id
FROM ids
"""


# ---------------------------------------------------------- skip_rejects
def skip_rejects(spark, sf_dir):
    """E2 no-id, E4 link patterns, E5 title patterns (any case), E6 mp3: the rejects with reasons."""
    e = E.with_item_ids(_linked_entries(spark, sf_dir))
    e = e.withColumn("link", F.when(F.pmod(F.col("pos"), F.lit(11)) == 0, F.concat(F.col("link"), F.lit(".mp3")))
                     .otherwise(F.col("link")))
    e = attach_rules(e, _rules(spark, "skip_link_pats", "skip_title_pats"), on="rule_key")
    tagged = e.withColumn("reason", E.skip_reason()).filter(F.col("reason").isNotNull())
    return tagged.select("feed", "pos", F.coalesce("raw_id", F.lit("")).alias("item_id"), "reason")


SQL_SKIP_REJECTS = f"""
WITH {SQL_LINKED},
m AS (SELECT ids.* REPLACE (CASE WHEN pos % 11 = 0 THEN link || '.mp3' ELSE link END AS link) FROM ids),
r AS ({X.rules_sql(["skip_link_pats", "skip_title_pats"])}),
j AS (SELECT m.*, r.skip_link_pats, r.skip_title_pats FROM m LEFT JOIN r USING (rule_key)),
w AS (SELECT *, {first_match_sql('skip_link_pats', "coalesce(link, '')")} AS lp,
                {first_match_sql('skip_title_pats', "coalesce(title, '')", '(?i)')} AS tp FROM j)
SELECT feed, pos, coalesce(raw_id, '') AS item_id,
       CASE WHEN raw_id IS NULL THEN 'no id or link'
            WHEN lp IS NOT NULL THEN 'skip_link_pats: ' || lp
            WHEN tp IS NOT NULL THEN 'skip_title_pats: ' || tp
            ELSE 'mp3 link' END AS reason
FROM w
WHERE raw_id IS NULL OR lp IS NOT NULL OR tp IS NOT NULL OR suffix(coalesce(link, ''), 'mp3')
"""


# ----------------------------------------------------------- entry_dates
def entry_dates(spark, sf_dir):
    """E10 RFC 2822 publish times (named zones, no weekday, garbage -> null), E11 fallback chain."""
    e = X.entries_view(_pages(spark, sf_dir))
    e = e.withColumn("updated", F.when(F.pmod(F.col("pos"), F.lit(10)) == 9,
                                       F.concat(F.lit("2 Jan 2024 10:"), F.lpad(F.pmod(F.col("pos"), F.lit(60))
                                                                                .cast("string"), 2, "0"),
                                                F.lit(" +0100"))))
    pub = dates.parse_rfc2822(F.col("published"))
    eff = dates.published_or_now(F.col("published"), F.col("updated"), X.run_ts())
    return e.select("feed", "pos", F.coalesce(dates.epoch_seconds(pub), F.lit(-1)).cast("long").alias("pub_epoch"),
                    dates.epoch_seconds(eff).cast("long").alias("eff_epoch"))


def _rfc2822_sql(x: str) -> str:
    t = f"regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '^[A-Za-z]{{3,9}}, ?', '')"
    zone = f"upper(regexp_extract({t}, ' ([A-Za-z]{{1,3}})$', 1))"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dates.NAMED_ZONES.items())
    mapped = f"(CASE {zone} {cases} END)"
    n = (f"(CASE WHEN {zone} <> '' AND {mapped} IS NOT NULL "
         f"THEN regexp_replace({t}, '[A-Za-z]{{1,3}}$', '') || {mapped} ELSE {t} END)")
    return (f"coalesce(try_strptime({n}, '%d %b %Y %H:%M:%S %z'), try_strptime({n}, '%d %b %Y %H:%M %z'), "
            f"try_strptime({n}, '%d %b %y %H:%M:%S %z'), try_strptime({n}, '%d %b %y %H:%M %z'))")


SQL_ENTRY_DATES = f"""
WITH e AS ({X.ENTRIES_SQL}),
u AS (SELECT *, CASE WHEN pos % 10 = 9 THEN '2 Jan 2024 10:' || lpad(CAST(pos % 60 AS VARCHAR), 2, '0') || ' +0100'
                END AS updated FROM e)
SELECT feed, pos, coalesce(CAST(epoch({_rfc2822_sql('published')}) AS BIGINT), -1) AS pub_epoch,
       CAST(epoch(coalesce({_rfc2822_sql('published')}, {_rfc2822_sql('updated')},
                           TIMESTAMPTZ '2024-01-12 00:00:00+00')) AS BIGINT) AS eff_epoch
FROM u
"""


# ---------------------------------------------------------- index_fields
def index_fields(spark, sf_dir):
    """S2 entry body, E12 padded and short titles, E13 feed slug, E14 feed title default."""
    e = attach_rules(X.entries_view(_pages(spark, sf_dir)), _rules(spark, "min_width"), on="rule_key")
    pos = F.col("pos")
    e = (e.withColumn("content", F.when(F.pmod(pos, F.lit(2)) == 0, F.nullif(F.col("content"), F.lit("")))
                      .otherwise(F.col("content")))
         .withColumn("summary", F.when(F.pmod(pos, F.lit(3)) == 0, F.col("title")))
         .withColumn("summary_detail", F.lit(None).cast("string"))
         .withColumn("description", F.lit("desc")))
    ftitle = F.when(F.pmod(F.length("feed"), F.lit(2)) == 0, F.lit("")).otherwise(F.upper("rule_key"))
    return e.select("feed", "pos", E.entry_body().alias("body"),
                    E.padded_title(F.col("title"), F.col("min_width")).alias("padded_title"),
                    E.short_title(F.col("title")).alias("short_title"),
                    E.slugify_ascii(F.col("feed")).alias("slug"),
                    E.feed_title(ftitle, F.col("feed")).alias("feed_title"))


SQL_INDEX_FIELDS = f"""
WITH e AS ({X.ENTRIES_SQL}),
r AS ({X.rules_sql(["min_width"])}),
j AS (SELECT e.*, r.min_width,
        CASE WHEN pos % 2 = 0 THEN nullif(content, '') ELSE content END AS c2,
        CASE WHEN pos % 3 = 0 THEN title END AS summary
      FROM e LEFT JOIN r USING (rule_key))
SELECT feed, pos, coalesce(c2, summary, 'desc', '') || chr(10) AS body,
       CASE WHEN length(title) < min_width THEN title || repeat('. ', min_width - length(title)) || '__'
            ELSE title END AS padded_title,
       CASE WHEN length(title) > 16 THEN regexp_replace(substr(title, 1, 16), '<.*?>', '', 'g') || '...'
            ELSE title END AS short_title,
       regexp_replace(regexp_replace(regexp_replace(feed, '[^\\w\\s-]', '', 'g'), '[-\\s]+', '_', 'g'),
                      '^[-_]+|[-_]+$', '', 'g') AS slug,
       coalesce(nullif(CASE WHEN length(feed) % 2 = 0 THEN '' ELSE upper(rule_key) END, ''), '[' || feed || ']')
         AS feed_title
FROM j
"""


# ----------------------------------------------------------- link_rewrite
def link_rewrite(spark, sf_dir):
    """story_url_rewrite (from, to) regex pair per site, then url_substitute for the fetch; other list lengths leave the link."""
    e = attach_rules(X.entries_view(_pages(spark, sf_dir)), _rules(spark, "story_url_rewrite", "url_substitute"), on="rule_key")
    e = e.withColumn("new_link", E.rewrite_link(F.col("link"), F.col("story_url_rewrite")))
    return e.select("feed", "pos", "link", "new_link", E.rewrite_link(F.col("new_link"), F.col("url_substitute")).alias("fetch_url"))


SQL_LINK_REWRITE = f"""
WITH e AS ({X.ENTRIES_SQL}), r AS ({X.rules_sql(["story_url_rewrite", "url_substitute"])}),
n AS (SELECT feed, pos, link, url_substitute,
       CASE WHEN len(story_url_rewrite) = 2
            THEN regexp_replace(link, story_url_rewrite[1], story_url_rewrite[2], 'g') ELSE link END AS new_link
FROM e LEFT JOIN r USING (rule_key))
SELECT feed, pos, link, new_link, CASE WHEN len(url_substitute) = 2
       THEN regexp_replace(new_link, url_substitute[1], url_substitute[2], 'g') ELSE new_link END AS fetch_url FROM n
"""


# -------------------------------------------------------- doc_title_dedup
def _doc_entries(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.select(F.col("source").alias("feed"), F.col("doc_id").alias("pos"),
                    F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"))


def doc_title_dedup(spark, sf_dir):
    """D2 at scale: first document per (source, first line) - min_by aggregate, skew-safe."""
    return E.dedup_titles(_doc_entries(spark, sf_dir)).select("feed", "pos", "title")


SQL_DOC_TITLE_DEDUP = """
SELECT feed, pos, title FROM (
  SELECT source AS feed, doc_id AS pos, regexp_extract(text, '^([^\\n]*)', 1) AS title FROM documents)
QUALIFY row_number() OVER (PARTITION BY feed, title ORDER BY pos) = 1
"""


# ------------------------------------------------------------ dedup_greedy
def dedup_greedy(spark, sf_dir):
    """D3: the reference's single greedy pass (exact variant), per feed with applyInPandas."""
    kept = kept_entries(spark, sf_dir).select("feed", "pos", "item_id", "title", "allow_dup_titles")
    return E.dedup_greedy(kept).select("feed", "pos", "item_id", "title")


SQL_DEDUP_GREEDY = f"""
WITH RECURSIVE {SQL_KEPT},
o AS (SELECT feed, pos, item_id, title, coalesce(allow_dup_titles, false) AS allow,
             coalesce(title, chr(0) || 'None') AS tkey,
             row_number() OVER (PARTITION BY feed ORDER BY pos) AS rn FROM k),
g(feed, rn, ids, titles, pos, accepted) AS (
  SELECT DISTINCT feed, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT), false
  FROM o
  UNION ALL
  SELECT g.feed, o.rn,
         CASE WHEN a THEN list_append(g.ids, o.item_id) ELSE g.ids END,
         CASE WHEN a THEN list_append(g.titles, o.tkey) ELSE g.titles END,
         o.pos, a
  FROM g JOIN o ON o.feed = g.feed AND o.rn = g.rn + 1,
       LATERAL (SELECT NOT list_contains(g.ids, o.item_id)
                       AND (o.allow OR NOT list_contains(g.titles, o.tkey)) AS a) x)
SELECT o.feed, o.pos, o.item_id, o.title FROM g JOIN o ON o.feed = g.feed AND o.pos = g.pos WHERE g.accepted
"""


# -------------------------------------------------------------- feed_order
# The user's feed order list for the fixture (O1).
FEED_ORDER = ["blog.tionsh.example.net", "thther.example.org", "www.ththhe.example.com"]


def feed_order(spark, sf_dir):
    """O1 user order (listed first, the rest by name) and W5 two-digit directory prefix."""
    feeds = X.entries_view(_pages(spark, sf_dir)).select("feed").distinct()
    feeds = feeds.withColumn("slug", E.slugify_ascii(F.col("feed")))
    order = spark.createDataFrame([(f, i) for i, f in enumerate(FEED_ORDER)], "feed string, rank int")
    return E.feed_dirs(feeds, order=order).select("feed", "dir")


SQL_FEED_ORDER = f"""
WITH f AS (SELECT DISTINCT {X.HOST_SQL} AS feed FROM pages),
o AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {i})" for i, f in enumerate(FEED_ORDER))}) t(feed, rank))
SELECT feed, printf('%02d_%s', row_number() OVER (ORDER BY coalesce(rank, 1073741824), feed),
  regexp_replace(regexp_replace(regexp_replace(feed, '[^\\w\\s-]', '', 'g'), '[-\\s]+', '_', 'g'),
                 '^[-_]+|[-_]+$', '', 'g')) AS dir
FROM f LEFT JOIN o USING (feed)
"""


QUERIES = {
    "new_entries": new_entries,
    "entry_ids": entry_ids,
    "skip_rejects": skip_rejects,
    "entry_dates": entry_dates,
    "index_fields": index_fields,
    "link_rewrite": link_rewrite,
    "doc_title_dedup": doc_title_dedup,
    "dedup_greedy": dedup_greedy,
    "feed_order": feed_order,
}

SQL = {
    "new_entries": SQL_NEW_ENTRIES,
    "entry_ids": SQL_ENTRY_IDS,
    "skip_rejects": SQL_SKIP_REJECTS,
    "entry_dates": SQL_ENTRY_DATES,
    "index_fields": SQL_INDEX_FIELDS,
    "link_rewrite": SQL_LINK_REWRITE,
    "doc_title_dedup": SQL_DOC_TITLE_DEDUP,
    "dedup_greedy": SQL_DEDUP_GREEDY,
    "feed_order": SQL_FEED_ORDER,
}
