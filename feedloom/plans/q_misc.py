"""Registered queries: graph, plug-ins, text decoding/folding, rule and feed files, the daily run
(G1, U1, C2, C3, C4, E13, S1, S4, S6, P1)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from feedloom.functions import text as TX
from feedloom.operators import decode as DC
from feedloom.operators import graph as G
from feedloom.operators import plugins as PL
from feedloom.operators import tokens as TK
from feedloom.plans import fixtures as X
from feedloom.plans.q_entries import _pages
from feedloom.session import scratch_path
from feedloom.sources import feeds as FD
from feedloom.functions.regex import PYTHON_FLAGS
from feedloom.sources.rules import prepare_rules, read_conf_rules
from feedloom.sources.tables import read_table

HOST = X.HOST_SQL


# ------------------------------------------------------------- reachability
def _graph(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select("page_id")
    n = p.select(F.col("page_id").alias("node"))
    tree = (p.select(F.col("page_id").alias("src"), F.explode(F.array(F.col("page_id") * 2, F.col("page_id") * 2 + 1))
                     .alias("dst")))
    back = p.filter(F.pmod("page_id", F.lit(7)) == 0).select(F.col("page_id").alias("src"),
                                                             F.floor(F.col("page_id") / 4).alias("dst"))
    edges = tree.unionByName(back).join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    expandable = n.filter(F.pmod("node", F.lit(5)) != 4)
    return edges, expandable


def reachability(spark, sf_dir):
    """G1: pages reachable from page 0 over n -> 2n, 2n+1 links plus back links
    (cycles); every fifth page is not expandable (an image, not .html)."""
    edges, expandable = _graph(spark, sf_dir)
    roots = spark.range(1).select(F.lit(0).cast("long").alias("node"))
    return G.reachable(edges, roots, expandable).select("node")


SQL_REACH = """
WITH RECURSIVE n AS (SELECT page_id AS node FROM pages),
e AS (SELECT DISTINCT src, dst FROM (
        SELECT page_id AS src, page_id * 2 AS dst FROM pages
        UNION ALL SELECT page_id, page_id * 2 + 1 FROM pages
        UNION ALL SELECT page_id, page_id // 4 FROM pages WHERE page_id % 7 = 0) x
      WHERE dst IN (SELECT node FROM n) AND src <> dst),
r(node) AS (SELECT CAST(0 AS BIGINT)
            UNION SELECT e.dst FROM r JOIN e ON e.src = r.node WHERE r.node % 5 <> 4)
SELECT node FROM r
"""


# ------------------------------------------------------------- plugin_pages
# The plug-in registry of the fixture (U1): 'com' sites keep only
# their article container, 'org' sites run a Python helper.
def _org_helper(url: str, html: str):
    """Row helper: no content when the page has fewer than three paragraphs; else footer removed."""
    if html.count("<p>") < 3:
        return None
    return re.sub(r"(?s)<footer>.*?</footer>", "", html)


def _com_plugin(df):
    return TK.keep_container(df.withColumn("specs", F.array(F.lit("article"))), "specs").drop("specs")


def plugin_pages(spark, sf_dir):
    """Per-site plug-ins over the story pages; a null result is a reject."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    p = p.withColumn("site", X.rule_key(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)))
    registry = {"com": _com_plugin, "org": PL.row_plugin(_org_helper)}
    ok, rejects = PL.apply_plugins(p, registry)
    return (ok.select("page_id", F.lit("ok").alias("status"), F.length("html").cast("long").alias("n_chars"))
            .unionByName(rejects.select(F.col("item_id").cast("long").alias("page_id"),
                                        F.col("reason").alias("status"), F.lit(0).cast("long").alias("n_chars"))))


def _plugin_sql():
    from feedloom.plans.sqlparts import covered_sql, ends_sql, reassemble_sql, tokens_sql
    return f"""
WITH p AS (SELECT page_id, html, split_part({HOST}, '.', -1) AS site FROM pages),
com AS (SELECT page_id, html FROM p WHERE site = 'com'),
t AS ({tokens_sql('com')}),
first AS (SELECT page_id, min(pos) AS pos FROM t WHERE kind = 'open' AND tag = 'article' GROUP BY page_id),
ends AS ({ends_sql('t')}),
iv AS (SELECT f.page_id, f.pos AS start, coalesce(e.end_pos, {1 << 30}) AS stop
       FROM first f LEFT JOIN ends e USING (page_id, pos)),
cov AS ({covered_sql('t', 'iv')}),
kept AS (SELECT * FROM cov WHERE inside),
art AS ({reassemble_sql('kept', out='clean')})
SELECT p.page_id,
  CASE WHEN p.site = 'org' AND (length(p.html) - length(replace(p.html, '<p>', ''))) // 3 < 3
       THEN 'no content from plug-in' ELSE 'ok' END AS status,
  CAST(CASE WHEN p.site = 'com' THEN length(coalesce(a.clean, p.html))
            WHEN p.site = 'org' AND (length(p.html) - length(replace(p.html, '<p>', ''))) // 3 < 3 THEN 0
            WHEN p.site = 'org' THEN length(regexp_replace(p.html, '(?s)<footer>.*?</footer>', '', 'g'))
            ELSE length(p.html) END AS BIGINT) AS n_chars
FROM p LEFT JOIN art a USING (page_id)
"""


SQL_FEED_SLUGS = r"""
SELECT page_id,
  regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(strip_accents(regexp_extract(html, '<title>(.*?)</title>', 1)), '[^\x00-\x7F]', '', 'g'),
    '[^\w\s-]', '', 'g'), '[-\s]+', '_', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug
FROM pages
"""


# ----------------------------------------------------------------- text
def ascii_fold(spark, sf_dir):
    """ASCII folding of document text (NFKD + substitution table, unknown chars escaped)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    f = d.select("doc_id", TX.fold_ascii(F.col("text")).alias("folded"))
    return f.select("doc_id", F.length("folded").cast("long").alias("n_chars"), F.sha2("folded", 256).alias("digest"))


def unmapped_chars(spark, sf_dir):
    """C4: non-ASCII characters left after NFKD, whether the fold table maps them,
    counts and a +-15 character context example (the unmapped ones are what the
    fold escapes)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return DC.unmapped_report(d, only_unmapped=False).select("char", "code", "mapped", "n", "example")


def charset_decode(spark, sf_dir):
    """Bodies as bytes in several charsets (and broken UTF-8), decoded by the
    configured/header charset; undecodable bytes become \\xNN."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "html")
    k = F.pmod("page_id", F.lit(4))
    latin = F.regexp_replace("html", r"[^\x00-\xFF]", "?")
    body = (F.when(k == 0, F.encode("html", "UTF-8"))
            .when(k == 1, F.encode(latin, "ISO-8859-1"))
            .when(k == 2, F.encode("html", "UTF-16LE"))
            .otherwise(F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("80E961")))))
    ctype = (F.when(k == 1, F.lit("text/html; charset=ISO-8859-1"))
             .when(k == 2, F.lit("text/html; charset=utf-16le; x=y"))
             .otherwise(F.lit("text/html; charset=utf-8")))
    r = p.select("page_id", body.alias("body"), DC.choose_charset(F.lit(None), ctype).alias("charset"))
    out = DC.decode_bodies(r)
    return out.select("page_id", "charset", F.length("text").cast("long").alias("n_chars"),
                      F.sha2("text", 256).alias("digest"))


def feed_slugs(spark, sf_dir):
    """E13 in full: feed directory names from titles with accents (NFKD, non-ASCII dropped)."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "html")
    t = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    return p.select("page_id", TX.slugify(t).alias("slug"))


# ----------------------------------------------------------- plugin_entries
def _link_helper(site):
    """Feed helper: the links of a saved index page whose text is under the site's argument; fails on pages without a nav."""
    start = site["html"].index("<nav>")
    for href, text in re.findall(r'<a href="([^"]*)">([^<]*)</a>', site["html"][start:site["html"].index("</nav>", start)]):
        if href.startswith(site["helper_args"]):
            yield {"id": site["feed"] + href, "link": site["url"] + href, "title": text}


def plugin_entries(spark, sf_dir):
    """Entries made by a feed helper from each page as a site's index, arguments from the rule; failures as rejects."""
    sites = _pages(spark, sf_dir).select(
        F.concat(F.lit("site"), "page_id").alias("feed"), "url",
        F.expr("IF(page_id % 11 = 4, replace(html, '<nav>', '<div>'), html)").alias("html"),
        F.expr("CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'links' END").alias("feed_helper"),
        F.expr("IF(page_id % 2 = 0, '/', '/e')").alias("helper_args"))
    entries, rejects = PL.helped_entries(sites, {"links": _link_helper})
    return entries.select("feed", "pos", "link", "title", F.lit("").alias("reason")).unionByName(rejects.select(
        "feed", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("link"), F.lit("").alias("title"), "reason"))


SQL_PLUGIN_ENTRIES = """
WITH s AS (SELECT 'site' || page_id AS feed, url, html, page_id, CASE WHEN page_id % 2 = 0 THEN '/' ELSE '/e' END AS arg,
                  contains(html, '<nav>') AND page_id % 11 <> 4 AS nav FROM pages WHERE page_id % 7 <> 0),
l AS (SELECT feed, url, arg, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*</a>') AS a
      FROM s WHERE nav AND page_id % 7 <> 1),
x AS (SELECT feed, url, arg, unnest(a) AS t, unnest(generate_series(1, len(a))) AS i FROM l),
e AS (SELECT feed, url, i, regexp_extract(t, 'href="([^"]*)"', 1) AS href, regexp_extract(t, '>([^<]*)<', 1) AS title, arg FROM x)
SELECT feed, row_number() OVER (PARTITION BY feed ORDER BY i) - 1 AS pos, url || href AS link, title, '' AS reason
FROM e WHERE starts_with(href, arg)
UNION ALL SELECT feed, -1, '', '', 'ValueError: substring not found' FROM s WHERE NOT nav AND page_id % 7 <> 1
UNION ALL SELECT feed, -1, '', '', 'LookupError: no helper unknown' FROM s WHERE page_id % 7 = 1
"""


# --------------------------------------------------------------- conf_rules
def _conf_text(spark, sf_dir):
    """One INI section per host (rule text derived from the pages), plus a DEFAULT section."""
    hosts = _pages(spark, sf_dir).select(
        F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1).alias("host")).distinct()
    lvl = F.element_at(F.array(F.lit("1"), F.lit("1.5"), F.lit("2")), (F.pmod(F.length("host"), F.lit(3)) + 1).cast("int"))
    body = F.concat(
        F.lit("["), F.col("host"), F.lit("]\nurl = https://"), F.col("host"), F.lit("/feed\nlevels = "), lvl,
        F.lit("\nskip_link_pats = /fr/\n    utm_source\n\n# a comment\npage_start = <article>\n"),
        F.when(F.col("host").startswith("blog."), F.lit("save_days = 14\nskip_images = false\n")).otherwise(F.lit("")),
        F.when(F.col("host").startswith("m."), F.lit("skip_pats = <b>\n    (unclosed\n")).otherwise(F.lit("")))
    return hosts.select(F.col("host"), body.alias("value"))


def conf_rules(spark, sf_dir):
    """Site rules read from INI text files (sections over DEFAULT over built-ins, continuation lists)."""
    base = scratch_path(spark, f"conf-{uuid.uuid4().hex}")
    conf = _conf_text(spark, sf_dir)
    # the main file, read first: it also sets levels for every host, which the hosts' own files override,
    # and a width, which they do not
    main = conf.select(F.concat(F.lit("["), F.col("host"), F.lit("]\nlevels = 7\nmin_width = 31\n")).alias("v")).agg(
        F.array_join(F.array_sort(F.collect_list("v")), "").alias("v"))
    dflt = main.select(F.lit("zz-main").alias("host"),
                       F.concat(F.lit("[DEFAULT]\nsave_days = 3\nnonlocal_images = true\n"), F.col("v")).alias("value"))
    conf.unionByName(dflt).write.partitionBy("host").text(f"{base}/conf")
    rules, problems = prepare_rules(read_conf_rules(spark, f"{base}/conf"))
    bad = problems.groupBy("feed").agg(F.count(F.lit(1)).alias("n_bad"))
    return (rules.join(bad, "feed", "left")
            .select("feed", "url", "levels", *[
                F.replace(F.array_join(c, "|"), F.lit(PYTHON_FLAGS), F.lit("")).alias(c)  # as written in the file
                for c in ("skip_link_pats", "page_start", "skip_pats")],
                    "save_days", "skip_images", "nonlocal_images", "min_width",
                    F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad")))


SQL_CONF = f"""
SELECT DISTINCT {HOST} AS feed, 'https://' || {HOST} || '/feed' AS url,
       CAST(['1', '1.5', '2'][length({HOST}) % 3 + 1] AS DOUBLE) AS levels,
       '/fr/|utm_source' AS skip_link_pats, '<article>' AS page_start,
       CASE WHEN starts_with({HOST}, 'm.') THEN '<b>' ELSE '' END AS skip_pats,
       CAST(CASE WHEN starts_with({HOST}, 'blog.') THEN 14 ELSE 3 END AS INTEGER) AS save_days,
       NOT starts_with({HOST}, 'blog.') AS skip_images, true AS nonlocal_images, CAST(31 AS INTEGER) AS min_width,
       CAST(CASE WHEN starts_with({HOST}, 'm.') THEN 1 ELSE 0 END AS BIGINT) AS n_bad
FROM pages
"""


# ------------------------------------------------------------- rss_roundtrip
def rss_roundtrip(spark, sf_dir):
    """S4 write + S1 read: entries written as one RSS channel per feed with the XML
    source, read back item by item with from_xml (pos = order in the file)."""
    base = scratch_path(spark, f"rss-{uuid.uuid4().hex}")
    e = X.entries_view(_pages(spark, sf_dir))
    items = e.select("feed", "pos", "title", "link", F.col("published").alias("pubDate"),
                     F.col("id").alias("guid"))
    FD.write_feed_files(items, f"{base}/feeds")
    back = FD.read_feed_files(spark, f"{base}/feeds")
    return back.select(F.regexp_extract("feed_file", r"feed=([^/]*)/", 1).alias("feed"), "title", "link", "guid",
                       F.col("pubDate").alias("published"))


def FEED_OF_FILE():
    return F.regexp_extract("feed_file", r"feed=([^/]*)/", 1)


def write_atom_files(spark, sf_dir) -> str:
    """The pages' entries as Atom markup in files; returns their folder's parent."""
    base = scratch_path(spark, f"atom-{uuid.uuid4().hex}")

    def xml(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                         F.lit('"'), F.lit("&quot;"))

    e = X.entries_view(_pages(spark, sf_dir)).select(
        "feed", "pos", "title", "link", F.col("pos").alias("page_id"))
    # ranges of (feed, pos): a large feed spans files, whose names keep the order
    e.repartitionByRange("feed", "pos").sortWithinPartitions("feed", "pos").select("feed", F.concat(
        F.lit('<entry><id>tag:'), F.col("page_id").cast("string"), F.lit("</id><title>"), xml(F.col("title")),
        F.lit('</title><link rel="self" href="/self"/><link href="'), xml(F.col("link")),
        F.lit('" type="text/html"/><author><name>'), F.col("feed"), F.lit("</name></author><published>"),
        F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(page_id AS INT))"),
                      "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00</published></entry>")).alias("value")) \
        .write.partitionBy("feed").text(f"{base}/feeds")
    return base


def atom_rows(entries):
    from feedloom.functions import dates
    return entries.select("feed", "id", "title", "link", F.size("links").cast("long").alias("n_links"), "author",
                          F.unix_seconds(dates.parse_feed_date(F.col("published"))).alias("published"),
                          F.col("pos").cast("long").alias("pos"))


def atom_entries(spark, sf_dir):
    """S1 for Atom: entries written as Atom markup, read back as ENTRY_SCHEMA rows (links, author, ISO time)."""
    base = write_atom_files(spark, sf_dir)
    return atom_rows(FD.read_entries(spark, f"{base}/feeds", FEED_OF_FILE()))


SQL_ATOM = f"""
SELECT {HOST} AS feed, 'tag:' || page_id AS id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url AS link,
       2::BIGINT AS n_links, {HOST} AS author, 1704067200 + page_id * 3600 AS published,
       row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS pos
FROM pages
"""


SQL_RSS = f"""
SELECT {HOST} AS feed, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url AS link, url AS guid,
       CASE page_id % 5
         WHEN 4 THEN 'not a date'
         WHEN 3 THEN strftime(TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR, '%a, %d %b %Y %H:%M:%S') || ' GMT'
         ELSE strftime(TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR, '%a, %d %b %Y %H:%M:%S') || ' +0000'
       END AS published
FROM pages
"""


QUERIES = {
    "reachability": reachability,
    "plugin_pages": plugin_pages,
    "ascii_fold": ascii_fold,
    "unmapped_chars": unmapped_chars,
    "charset_decode": charset_decode,
    "feed_slugs": feed_slugs,
    "conf_rules": conf_rules,
    "rss_roundtrip": rss_roundtrip,
    "atom_entries": atom_entries,
    "plugin_entries": plugin_entries,
}

def _fold_sql():
    """Twin of the C3 fold for text whose non-ASCII characters lie in Latin-1 and
    Latin Extended-A or in the substitution table: a per-character lookup table
    generated here by the same rule (NFKD, then the table, else an escape)."""
    chars = [chr(c) for c in range(0x80, 0x180)] + list(TX.FOLD_TABLE)
    table = {c: TX.fold_one(c) for c in chars}
    pairs = ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in table.items())
    return f"""
SELECT doc_id, CAST(length(f) AS BIGINT) AS n_chars, sha256(f) AS digest
FROM (SELECT doc_id, array_to_string(list_transform(string_split(text, ''),
                                                    lambda c: coalesce((MAP {{{pairs}}})[c], c)), '') AS f
      FROM documents) x
"""


def _unmapped_sql():
    """Twin of the C4 report for text whose characters lie in Latin-1 / Latin
    Extended-A or the substitution table: NFKD by a per-character table generated
    here, then each non-ASCII character with its left context (up to 15
    characters, not reaching back past the previous match) and 15 after."""
    import unicodedata
    chars = [chr(c) for c in range(0x80, 0x180)] + list(TX.FOLD_TABLE)
    nfkd = {c: unicodedata.normalize("NFKD", c) for c in chars}
    pairs = ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in nfkd.items())
    keys = ", ".join("'" + k.replace("'", "''") + "'" for k in TX.FOLD_TABLE)
    return f"""
WITH n AS (SELECT doc_id, array_to_string(list_transform(string_split(text, ''),
                                lambda c: coalesce((MAP {{{pairs}}})[c], c)), '') AS t FROM documents),
c AS (SELECT doc_id, t, unnest(string_split(t, '')) AS ch, unnest(generate_series(1, length(t))) AS p FROM n),
m AS (SELECT doc_id, t, ch, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i,
             lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev_p
      FROM c WHERE unicode(ch) > 127),
x AS (SELECT *, greatest(p - 15, coalesce(prev_p + 1, 1)) AS s FROM m)
SELECT ch AS char, printf('U+%04X', unicode(ch)) AS code, list_contains([{keys}], ch) AS mapped,
       CAST(count(*) AS BIGINT) AS n, arg_min(substr(t, s, p - s + 16), (doc_id, i)) AS example
FROM x GROUP BY ch
"""


# Decoding must give back the text that was encoded: the page (UTF-8, UTF-16LE),
# the page with non-Latin-1 characters as '?' (ISO-8859-1), or the page plus the
# escaped bad bytes (broken UTF-8).
SQL_CHARSET = r"""
WITH p AS (SELECT page_id, page_id % 4 AS k, html FROM pages),
t AS (SELECT page_id,
        CASE k WHEN 1 THEN 'iso-8859-1' WHEN 2 THEN 'utf-16le' ELSE 'utf-8' END AS charset,
        CASE k WHEN 1 THEN regexp_replace(html, '[^\x00-\xFF]', '?', 'g')
               WHEN 3 THEN html || '\x80\xe9a' ELSE html END AS text
      FROM p)
SELECT page_id, charset, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS digest FROM t
"""


SQL = {
    "plugin_entries": SQL_PLUGIN_ENTRIES,
    "unmapped_chars": _unmapped_sql(),
    "charset_decode": SQL_CHARSET,
    "ascii_fold": _fold_sql(),
    "plugin_pages": _plugin_sql(),
    "feed_slugs": SQL_FEED_SLUGS,
    "reachability": SQL_REACH,
    "conf_rules": SQL_CONF,
    "rss_roundtrip": SQL_RSS,
    "atom_entries": SQL_ATOM,
}
