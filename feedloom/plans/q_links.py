"""Registered queries on URLs, fetch results and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import html as H
from feedloom.functions import images as I
from feedloom.functions.common import materialize
from feedloom.functions.urls import (absolute_url, gate_body, header_charset, is_local_link, similar_host,
                                     strip_fragment, url_host)
from feedloom.operators.tokens import attr_value
from feedloom.plans import fixtures as X
from feedloom.sources.rules import attach_rules
from feedloom.sources.tables import read_table

HOST = X.HOST_SQL

# The relative forms each nav link is rewritten into (E8 fixture).
LINK_FORMS = ["{p}", "{n}", "../{n}", "./{n}", "//cdn.example.com/{n}", "#{n}",
              "https://other.example.org/{n}#frag", "?q={n}"]


def _nav_links(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    nav = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    hrefs = F.regexp_extract_all(nav, F.lit(r"<a href=\"([^\"]*)\""), F.lit(1))
    links = pages.select("page_id", "url", F.posexplode(hrefs).alias("i", "p"))
    name = F.expr("substr(p, 2)")
    forms = F.array(*[F.concat(*_form_parts(f, F.col("p"), name)) for f in LINK_FORMS])
    return links.withColumn("href", F.element_at(forms, (F.pmod(F.col("i"), F.lit(len(LINK_FORMS))) + 1)
                                                 .cast("int")))


def _form_parts(form, p, n):
    parts, rest = [], form
    while rest:
        if rest.startswith("{p}"):
            parts.append(p)
            rest = rest[3:]
        elif rest.startswith("{n}"):
            parts.append(n)
            rest = rest[3:]
        else:
            k = min([x for x in (rest.find("{p}"), rest.find("{n}")) if x >= 0] or [len(rest)])
            parts.append(F.lit(rest[:k]))
            rest = rest[k:]
    return parts


def link_forms(spark, sf_dir):
    """E8/H10 absolute URLs for every reference form, E16 local-link test,
    E17 fragment strip, S13 sub-directory test."""
    l = _nav_links(spark, sf_dir)
    absu = absolute_url(F.col("href"), F.col("url"))
    h = F.col("href")
    subdir = (h != "") & ~h.startswith("?") & ~h.startswith("/")
    return l.select("page_id", F.col("i").cast("long").alias("i"), "href", absu.alias("abs_url"),
                    is_local_link(h).alias("is_local"), strip_fragment(absu).alias("no_fragment"),
                    subdir.alias("is_subdir"))


def _form_sql(form):
    out, rest = [], form
    while rest:
        if rest.startswith("{p}"):
            out.append("p")
            rest = rest[3:]
        elif rest.startswith("{n}"):
            out.append("substr(p, 2)")
            rest = rest[3:]
        else:
            k = min([x for x in (rest.find("{p}"), rest.find("{n}")) if x >= 0] or [len(rest)])
            out.append("'" + rest[:k] + "'")
            rest = rest[k:]
    return " || ".join(out)


def _rds_sql(p):
    """remove_dot_segments twin: fold the segments into a string."""
    segs = f"string_split({p}, '/')"
    fold = (f"list_reduce({segs}[2:], lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') "
            f"WHEN s = '.' THEN acc ELSE acc || '/' || s END, '')")
    last = f"{segs}[-1]"
    res = f"(CASE WHEN {fold} = '' THEN '/' ELSE {fold} || CASE WHEN {last} IN ('.', '..') THEN '/' ELSE '' END END)"
    return (f"(CASE WHEN contains({p}, './') OR suffix({p}, '/.') OR suffix({p}, '/..') THEN {res} ELSE {p} END)")


def _abs_sql(h, base):
    origin = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    scheme = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    bpath = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    bd = f"regexp_extract({bpath}, '^(.*/)', 1)"
    bdir = f"(CASE WHEN {bd} = '' THEN '/' ELSE {bd} END)"
    rp = f"regexp_extract({h}, '^([^?#]*)', 1)"
    rt = f"regexp_extract({h}, '^[^?#]*(.*)$', 1)"
    return (f"(CASE WHEN {h} IS NULL THEN NULL WHEN {h} = '' OR contains({h}, '://') OR starts_with({h}, '#') "
            f"THEN {h} WHEN {base} IS NULL OR {origin} = '' THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {_rds_sql(rp)} || {rt} "
            f"WHEN starts_with({h}, '?') THEN {origin} || {bpath} || {h} "
            f"ELSE {origin} || {_rds_sql(f'({bdir} || {rp})')} || {rt} END)")


def _link_forms_sql():
    forms = "[" + ", ".join(_form_sql(f) for f in LINK_FORMS) + "]"
    return f"""
WITH n AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
                                                   '<a href="([^"]*)"', 1) AS hs FROM pages),
l AS (SELECT page_id, url, unnest(hs) AS p, unnest(generate_series(0, len(hs) - 1)) AS i FROM n),
f AS (SELECT page_id, url, i, {forms}[i % {len(LINK_FORMS)} + 1] AS href FROM l),
a AS (SELECT *, {_abs_sql('href', 'url')} AS abs_url FROM f)
SELECT page_id, CAST(i AS BIGINT) AS i, href, abs_url,
  NOT (href IS NULL OR href = '' OR contains(href, ':') OR starts_with(href, '#') OR starts_with(href, '/')
       OR starts_with(href, '../')) AS is_local,
  replace(split_part(abs_url, '#', 1), '%', '%25') AS no_fragment,
  href <> '' AND NOT starts_with(href, '?') AND NOT starts_with(href, '/') AS is_subdir
FROM a
"""


# --------------------------------------------------------------- redirects
def redirects(spark, sf_dir):
    """A page's final URL from the fetch responses when known, else its own URL."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    responses = (pages.filter(F.pmod("page_id", F.lit(4)) == 1)
                 .select("url", F.concat(F.lit("https://"), url_host("url"), F.lit("/final/"),
                                         F.col("page_id").cast("string")).alias("final_url")))
    j = pages.join(responses, "url", "left")
    return j.select("page_id", F.coalesce("final_url", "url").alias("resolved"))


SQL_REDIRECTS = f"""
WITH r AS (SELECT url, 'https://' || {HOST} || '/final/' || CAST(page_id AS VARCHAR) AS final_url
           FROM pages WHERE page_id % 4 = 1)
SELECT p.page_id, coalesce(r.final_url, p.url) AS resolved FROM pages p LEFT JOIN r USING (url)
"""

# -------------------------------------------------------------- content_gate
# Content types assigned to pages by page_id mod 6 (C1 fixture).
CONTENT_TYPES = ["text/html; charset=utf-8", "application/rss+xml", "application/xml; charset=ISO-8859-1; x=1",
                 "image/png", "", "application/pdf"]


def content_gate(spark, sf_dir):
    """C1 content-type gate (non-text bodies become an explanatory paragraph), C2 header charset."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ct = F.element_at(F.array(*[F.lit(c) for c in CONTENT_TYPES]),
                      (F.pmod("page_id", F.lit(len(CONTENT_TYPES))) + 1).cast("int"))
    p = pages.withColumn("ctype", ct)
    body = gate_body(F.col("html"), F.col("ctype"), F.col("url"))
    return p.select("page_id", "ctype", header_charset(F.col("ctype")).alias("charset"),
                    F.length(body).cast("long").alias("n_chars"),
                    F.sha2(body, 256).alias("digest"))


def _content_gate_sql():
    cts = "[" + ", ".join(f"'{c}'" for c in CONTENT_TYPES) + "]"
    return f"""
WITH p AS (SELECT page_id, url, html, {cts}[page_id % {len(CONTENT_TYPES)} + 1] AS ctype FROM pages),
b AS (SELECT *, CASE WHEN ctype IS NULL OR ctype = '' OR starts_with(ctype, 'text')
                       OR starts_with(ctype, 'application/rss') OR starts_with(ctype, 'application/xml')
                       OR starts_with(ctype, 'application/x-rss+xml') OR starts_with(ctype, 'application/atom+xml')
                     THEN html
                     ELSE '<p>Contents not text! (' || ctype || ') <a href="' || url || '">' || url || '</a></p>'
                END AS body FROM p)
SELECT page_id, ctype,
       CASE WHEN contains(ctype, 'charset=') THEN trim(split_part(string_split(ctype, 'charset=')[-1], ';', 1))
            ELSE '' END AS charset,
       CAST(length(body) AS BIGINT) AS n_chars, sha256(body) AS digest
FROM b
"""


# --------------------------------------------------------------- image_refs
def _image_tags(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    d = X.derived_pages(pages).withColumn("rule_key", X.rule_key(F.col("host")))
    d = attach_rules(d, X.rules_view(spark, "max_srcset_size", "nonlocal_images", "block_nonlocal_images",
                                     "alt_domains"), on="rule_key")
    d = d.withColumn("base", H.base_href(F.col("html"), F.col("url")))
    tags = d.select("page_id", "host", "base", "max_srcset_size", "nonlocal_images", "block_nonlocal_images",
                    "alt_domains",
                    F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<img\b[^>]*>"), F.lit(0)))
                    .alias("img_no", "tag"))
    src0 = F.coalesce(attr_value(F.col("tag"), F.lit("data-src")), attr_value(F.col("tag"), F.lit("src")))
    srcset = F.coalesce(attr_value(F.col("tag"), F.lit("data-lazy-srcset")), attr_value(F.col("tag"), F.lit("srcset")))
    chosen = I.choose_srcset(I.parse_srcset(srcset), F.col("max_srcset_size"))
    return tags.withColumn("src", F.coalesce(chosen, src0))


def image_refs(spark, sf_dir):
    """I1 effective src (data-src, srcset choice, data: kept), E8 absolute, I4 host
    rule with alt domains, I3 local name, I5 blocked/nonlocal rewrite."""
    t = _image_tags(spark, sf_dir).filter(F.col("src").isNotNull() & (F.col("src") != ""))
    absu = absolute_url(F.col("src"), F.col("base"))
    t = materialize(t, abs_src=F.when(F.col("src").startswith("data:"), F.col("src")).otherwise(absu))
    t = materialize(t, img_host=url_host("abs_src"))
    keep = F.col("nonlocal_images") | similar_host(F.col("img_host"), F.col("host"), F.col("alt_domains"))
    action = (F.when(~keep, F.lit("nonlocal")).when(F.col("abs_src").startswith("data:"), F.lit("data"))
              .otherwise(F.lit("local")))
    t = materialize(t, action=action)
    action = F.col("action")
    new_src = (F.when(action == "local", I.local_name(F.col("abs_src")))
               .when(action == "data", F.col("abs_src"))
               .when(F.col("block_nonlocal_images"), F.lit(I.BLOCKED_SRC)).otherwise(F.col("abs_src")))
    extra = F.when(action == "nonlocal", I.nonlocal_link(F.col("abs_src"))).otherwise(F.lit(""))
    return t.select("page_id", F.col("img_no").cast("long").alias("img_no"), "abs_src", action.alias("action"),
                    new_src.alias("new_src"), extra.alias("link"))


def _image_tags_sql():
    def attr(a):
        return (f"(CASE WHEN regexp_matches(tag, '(?i)\\s{a}\\s*=') THEN "
                f"regexp_extract(tag, '(?i)\\s{a}\\s*=\\s*\"([^\"]*)\"', 1) END)")
    return f"""
d0 AS ({X.DERIVED_SQL}),
r AS ({X.rules_sql(["max_srcset_size", "nonlocal_images", "alt_domains"])}),
d AS (SELECT d0.*, r.max_srcset_size, r.nonlocal_images, r.alt_domains, true AS block_nonlocal_images,
             CASE WHEN regexp_extract(html, '(?i)<base\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) <> ''
                  THEN regexp_extract(html, '(?i)<base\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)
                  ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/' END AS base
      FROM d0 LEFT JOIN r ON split_part(d0.host, '.', -1) = r.rule_key),
t0 AS (SELECT page_id, host, base, max_srcset_size, nonlocal_images, block_nonlocal_images, alt_domains,
              unnest(regexp_extract_all(html, '(?i)<img\\b[^>]*>')) AS tag,
              unnest(generate_series(0, len(regexp_extract_all(html, '(?i)<img\\b[^>]*>')) - 1)) AS img_no
       FROM d),
t1 AS (SELECT *, coalesce({attr('data-src')}, {attr('src')}) AS src0,
              coalesce({attr('data-lazy-srcset')}, {attr('srcset')}) AS srcset FROM t0),
t2 AS (SELECT *, list_transform(string_split(trim(srcset), ','), lambda p: {{
                   'u': trim(regexp_replace(p, ' *[0-9]+[wx]$', '')),
                   'd': nullif(trim(regexp_extract(p, '( *[0-9]+[wx])$', 1)), '')}}) AS cands FROM t1),
t3 AS (SELECT *, list_filter(list_transform(list_filter(cands, lambda c: suffix(lower(c.d), 'w')),
                   lambda c: {{'u': c.u, 'w': CAST(substr(c.d, 1, length(c.d) - 1) AS INTEGER)}}),
                   lambda c: c.w <= max_srcset_size AND c.w > 0) AS ws,
              list_filter(cands, lambda c: suffix(lower(c.d), 'x'))[1].u AS first_x FROM t2),
imgs AS (SELECT *, coalesce(CASE WHEN len(ws) > 0 THEN list_reduce(ws, lambda a, b: CASE WHEN b.w > a.w THEN b ELSE a END).u END,
                            first_x, src0) AS src FROM t3)
"""


def _host_tail_sql(h):
    return f"array_to_string(string_split({h}, '.')[-2:], '.')"


def _same_host_sql(a, b):
    return (f"(CASE WHEN coalesce({a}, '') = '' AND coalesce({b}, '') = '' THEN true "
            f"WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN false "
            f"ELSE {_host_tail_sql(a)} = {_host_tail_sql(b)} END)")


def _image_refs_sql():
    ih = f"regexp_extract(abs_src, '{'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)'}', 1)"
    keep = (f"(nonlocal_images OR {_same_host_sql(ih, 'host')} OR "
            f"coalesce(list_bool_or(list_transform(alt_domains, lambda d: {_same_host_sql(ih, 'd')})), false))")
    name = f"regexp_replace(replace(abs_src, '/', '_'), '[^\\pL\\pN_.\\-]', '', 'g')"
    return f"""
WITH {_image_tags_sql()},
a AS (SELECT *, CASE WHEN starts_with(src, 'data:') THEN src ELSE {_abs_sql('src', 'base')} END AS abs_src
      FROM imgs WHERE src IS NOT NULL AND src <> ''),
b AS (SELECT *, CASE WHEN NOT {keep} THEN 'nonlocal' WHEN starts_with(abs_src, 'data:') THEN 'data'
                     ELSE 'local' END AS action FROM a)
SELECT page_id, CAST(img_no AS BIGINT) AS img_no, abs_src, action,
  CASE WHEN action = 'local' THEN CASE WHEN {name} = '' THEN '{I.UNKNOWN_NAME}' ELSE {name} END
       WHEN action = 'data' THEN abs_src
       WHEN block_nonlocal_images THEN '{I.BLOCKED_SRC}' ELSE abs_src END AS new_src,
  CASE WHEN action = 'nonlocal' THEN '<a href="' || abs_src || '"> [nonlocal image]</a>' ELSE '' END AS link
FROM b
"""


# ------------------------------------------------------------ image_fetches
def image_fetches(spark, sf_dir):
    """One local file per distinct source across all stories (a distinct, not a per-story cache)."""
    refs = image_refs(spark, sf_dir).filter(F.col("action") == "local")
    return refs.select("abs_src", F.col("new_src").alias("local_name")).dropDuplicates(["abs_src"])


def _image_fetches_sql():
    return f"SELECT DISTINCT abs_src, new_src AS local_name FROM ({_image_refs_sql()}) r WHERE action = 'local'"


def image_names(spark, sf_dir):
    """The file name of every fetched source and, since names drop the path's slashes and marks, of its variants
    under a folder of that name: sources that share a local name get different files."""
    from feedloom.operators.pages import unique_image_names
    refs = image_refs(spark, sf_dir).filter(F.col("action") == "local").select("abs_src")
    variants = refs.unionByName(refs.select(F.regexp_replace("abs_src", "_", "/").alias("abs_src"))).unionByName(
        refs.select(F.regexp_replace("abs_src", r"\.([a-z]+)$", r"!.$1").alias("abs_src")))
    return unique_image_names(variants.withColumn("local_name", I.local_name("abs_src")))


def _image_names_sql():
    name = "regexp_replace(replace(abs_src, '/', '_'), '[^\\pL\\pN_.\\-]', '', 'g')"
    return f"""
WITH f AS (SELECT abs_src FROM ({_image_refs_sql()}) r WHERE action = 'local'),
v AS (SELECT abs_src FROM f UNION SELECT replace(abs_src, '_', '/') FROM f
      UNION SELECT regexp_replace(abs_src, '\\.([a-z]+)$', '!.\\1') FROM f),
n AS (SELECT abs_src, CASE WHEN {name} = '' THEN '{I.UNKNOWN_NAME}' ELSE {name} END AS local_name FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY local_name ORDER BY abs_src) AS k,
             len(regexp_extract(local_name, '\\.[A-Za-z0-9]{{1,5}}$')) AS ext FROM n)
SELECT abs_src, local_name, CASE WHEN k = 1 THEN local_name
    ELSE left(local_name, len(local_name) - ext) || '_' || left(md5(abs_src), 12) || right(local_name, ext) END AS file_name
FROM k
"""


# -------------------------------------------------------------- image_plan
def _part_images(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    fmt = F.element_at(F.array(*[F.lit(x) for x in ["PNG", "JPEG", "GIF", "WEBP"]]),
                       (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in [".png", ".jpg", ".gif", ".webp"]]),
                       (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return part.select(
        F.col("p_partkey").alias("image_id"),
        F.concat(F.lit("cdn.example.com_img_p"), F.col("p_partkey").cast("string"), F.lit(".v2"), ext).alias("name"),
        fmt.alias("format"),
        (F.col("p_size") * 40 + F.pmod("p_partkey", F.lit(13))).cast("int").alias("width"),
        ((F.pmod("p_partkey", F.lit(50)) + 1) * 30).cast("int").alias("height"),
        (F.pmod("p_partkey", F.lit(3)) == 0).alias("transparent"))


# The size limit and conversion flag of the I6 fixture.
PLAN_MAX_SIZE = 1200


def image_plan(spark, sf_dir):
    """Resize plan (longer side at most max_image_size) and output format/name, no pixels."""
    im = _part_images(spark, sf_dir)
    png_to_jpg = F.pmod(F.col("image_id"), F.lit(2)) == 0
    nw, nh = I.resize_plan(F.col("width"), F.col("height"), F.lit(PLAN_MAX_SIZE))
    resized = (nw != F.col("width")) | (nh != F.col("height"))
    return im.select("image_id", nw.alias("new_width"), nh.alias("new_height"), resized.alias("resized"),
                     I.output_name(F.col("name"), F.col("format"), resized, F.col("transparent"), png_to_jpg)
                     .alias("out_name"))


SQL_IMAGE_PLAN = f"""
WITH im AS (
  SELECT p_partkey AS image_id,
         'cdn.example.com_img_p' || CAST(p_partkey AS VARCHAR) || '.v2' || ['.png', '.jpg', '.gif', '.webp'][p_partkey % 4 + 1] AS name,
         ['PNG', 'JPEG', 'GIF', 'WEBP'][p_partkey % 4 + 1] AS format,
         CAST(p_size * 40 + p_partkey % 13 AS INTEGER) AS width,
         CAST((p_partkey % 50 + 1) * 30 AS INTEGER) AS height,
         p_partkey % 3 = 0 AS transparent, p_partkey % 2 = 0 AS png_to_jpg
  FROM part),
s AS (SELECT *, greatest(width, height) > {PLAN_MAX_SIZE} AS big FROM im),
n AS (SELECT *,
        CAST(CASE WHEN big AND width >= height THEN {PLAN_MAX_SIZE}
                  WHEN big THEN width * {PLAN_MAX_SIZE} // height ELSE width END AS INTEGER) AS new_width,
        CAST(CASE WHEN big AND width >= height THEN height * {PLAN_MAX_SIZE} // width
                  WHEN big THEN {PLAN_MAX_SIZE} ELSE height END AS INTEGER) AS new_height,
        lower(regexp_extract(name, '(\\.[^./]*)$', 1)) AS ext FROM s),
o AS (SELECT *, new_width <> width OR new_height <> height AS resized FROM n)
SELECT image_id, new_width, new_height, resized,
  CASE WHEN resized OR ((upper(format) = 'PNG' OR suffix(lower(name), '.png')) AND (png_to_jpg OR NOT transparent))
            OR ext NOT IN ({", ".join(f"'{e}'" for e in I.KNOWN_EXTENSIONS)})
       THEN replace(CASE WHEN ext <> '' THEN substr(name, 1, length(name) - length(ext)) ELSE name END, '.', '') || '.jpg'
       ELSE name END AS out_name
FROM o
"""


# ----------------------------------------------------------- srcset_choice
def srcset_choice(spark, sf_dir):
    """Parsed srcset candidates and the chosen URL under the site's max width."""
    t = _image_tags(spark, sf_dir)
    srcset = F.coalesce(attr_value(F.col("tag"), F.lit("data-lazy-srcset")), attr_value(F.col("tag"), F.lit("srcset")))
    t = t.filter(srcset.isNotNull())
    cands = I.parse_srcset(srcset)
    return t.select("page_id", F.col("img_no").cast("long").alias("img_no"),
                    F.size(cands).cast("long").alias("n_cands"),
                    F.coalesce(I.choose_srcset(cands, F.col("max_srcset_size")), F.lit("")).alias("chosen"))


def _srcset_sql():
    return f"""
WITH {_image_tags_sql()}
SELECT page_id, CAST(img_no AS BIGINT) AS img_no, CAST(len(cands) AS BIGINT) AS n_cands,
       coalesce(CASE WHEN len(ws) > 0 THEN list_reduce(ws, lambda a, b: CASE WHEN b.w > a.w THEN b ELSE a END).u END,
                first_x, '') AS chosen
FROM imgs WHERE srcset IS NOT NULL
"""


QUERIES = {
    "link_forms": link_forms,
    "redirects": redirects,
    "content_gate": content_gate,
    "image_refs": image_refs,
    "image_fetches": image_fetches,
    "image_names": image_names,
    "image_plan": image_plan,
    "srcset_choice": srcset_choice,
}

SQL = {
    "link_forms": _link_forms_sql(),
    "redirects": SQL_REDIRECTS,
    "content_gate": _content_gate_sql(),
    "image_refs": _image_refs_sql(),
    "image_fetches": _image_fetches_sql(),
    "image_names": _image_names_sql(),
    "image_plan": SQL_IMAGE_PLAN,
    "srcset_choice": _srcset_sql(),
}


# ------------------------------------------------------------ last_modified
def last_modified(spark, sf_dir):
    """Page time from the Last-Modified header (either spelling), else run time - 5 days."""
    from feedloom.functions import dates
    p = read_table(spark, sf_dir, "pages").select("page_id")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, page_id, 0, 0)")
    text = F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    k = F.pmod("page_id", F.lit(4))
    empty = F.create_map().cast("map<string,string>")
    headers = (F.when(k == 0, F.create_map(F.lit("Last-Modified"), text))
               .when(k == 1, F.create_map(F.lit("last-modified"), text))
               .when(k == 2, F.create_map(F.lit("Last-Modified"), F.lit("yesterday")))
               .otherwise(empty))
    lm = dates.last_modified(headers, X.run_ts())
    return p.select("page_id", F.unix_seconds(lm).alias("lm_epoch"))


SQL_LAST_MODIFIED = f"""
SELECT page_id,
  CASE WHEN page_id % 4 IN (0, 1)
       THEN CAST(epoch(TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR) AS BIGINT)
       ELSE {X.RUN_TS_EPOCH} - 5 * 86400 END AS lm_epoch
FROM pages
"""

QUERIES["last_modified"] = last_modified
SQL["last_modified"] = SQL_LAST_MODIFIED


# ------------------------------------------------------------- image_rewrite
def image_rewrite(spark, sf_dir):
    """I5/I7 applied to the page: img src set to the local file, or blocked with a
    link to the image, data: and source-less tags left alone."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    d = X.derived_pages(pages).withColumn("rule_key", X.rule_key(F.col("host")))
    d = attach_rules(d, X.rules_view(spark, "max_srcset_size", "nonlocal_images", "block_nonlocal_images",
                                     "alt_domains"), on="rule_key")
    d = materialize(d, base=H.base_href(F.col("html"), F.col("url")))
    html = I.rewrite_images("html", "host", "base", "max_srcset_size", "nonlocal_images",
                            "block_nonlocal_images", "alt_domains")
    return d.select("page_id", html.alias("html"))


def _image_rewrite_sql():
    ih = "regexp_extract(abs_src, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"
    keep = (f"(nonlocal_images OR {_same_host_sql(ih, 'host')} OR "
            f"coalesce(list_bool_or(list_transform(alt_domains, lambda d: {_same_host_sql(ih, 'd')})), false))")
    name = "regexp_replace(replace(abs_src, '/', '_'), '[^\\pL\\pN_.\\-]', '', 'g')"

    def set_src(v):
        return (f"(CASE WHEN regexp_matches(tag, '(?i)\\ssrc\\s*=') "
                f"THEN regexp_replace(tag, '(?i)(\\ssrc\\s*=\\s*)(\"[^\"]*\"|''[^'']*''|[^\\s>]+)', "
                f"'\\1\"' || {v} || '\"') "
                f"ELSE regexp_replace(tag, '(\\s*/?>)$', ' src=\"' || {v} || '\"\\1') END)")
    return f"""
WITH {_image_tags_sql()},
a AS (SELECT *, CASE WHEN starts_with(src, 'data:') THEN src ELSE {_abs_sql('src', 'base')} END AS abs_src FROM imgs),
b AS (SELECT *, CASE WHEN src IS NULL OR src = '' THEN 'none' WHEN NOT {keep} THEN 'nonlocal'
                     WHEN starts_with(abs_src, 'data:') THEN 'data' ELSE 'local' END AS action FROM a),
c AS (SELECT *, CASE WHEN action = 'local' THEN CASE WHEN {name} = '' THEN '{I.UNKNOWN_NAME}' ELSE {name} END
                     WHEN action = 'nonlocal' THEN CASE WHEN block_nonlocal_images THEN '{I.BLOCKED_SRC}' ELSE abs_src END
                     ELSE src END AS new_src FROM b),
t AS (SELECT DISTINCT page_id, tag,
        CASE WHEN action = 'local' THEN {set_src('new_src')}
             WHEN action = 'nonlocal' THEN {set_src('new_src')} || '<a href="' || abs_src || '"> [nonlocal image]</a>'
             ELSE tag END AS new_tag FROM c),
p AS (SELECT page_id, list({{'old': tag, 'new': new_tag}}) AS pairs FROM t GROUP BY page_id)
SELECT d.page_id, coalesce(list_reduce(p.pairs, lambda acc, x: replace(acc, x.old, x.new), d.html), d.html) AS html
FROM d LEFT JOIN p USING (page_id)
"""


QUERIES["image_rewrite"] = image_rewrite
SQL["image_rewrite"] = _image_rewrite_sql()
