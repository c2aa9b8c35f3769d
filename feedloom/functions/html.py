"""HTML cleaning steps as native column expressions (H1, H2, H4-H6, H8, H9,
H11-H14, H16, H18-H22).

Each function maps a string column to a string column; rule arguments
may be columns (per-site values from the rules table).  Nothing here calls
Python per row, so the whole cleaning chain is one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.common import built_once, col_of, empty_str_array, first_match

# Elements unwrapped (children kept) and dropped with content.
UNWRAP_TAGS = ["head", "form", "input", "textarea", "font", "iframe", "object", "meta"]
DROP_WITH_CONTENT = ["script", "style", "video"]
DROP_VOID = ["source", "link"]
IMAGE_TAGS_WITH_CONTENT = ["svg", "figure"]


def _arr(pats) -> Column:
    return F.coalesce(col_of(pats), empty_str_array())


# ------------------------------------------------------------------ H1 / H2
def crop_start(html, pats) -> Column:
    """H1: drop everything through the end of the first match of the first
    pattern (list order) that matches.  No DOTALL inside the pattern."""
    html = col_of(html)
    p = first_match(pats, html)
    return F.when(p.isNull(), html).otherwise(
        F.regexp_replace(html, F.concat(F.lit(r"\A(?s:.*?)(?:"), p, F.lit(")")), F.lit("")))


def crop_end(html, pats) -> Column:
    """H1: cut from the start of the first match of the first matching pattern."""
    html = col_of(html)
    p = first_match(pats, html)
    return F.when(p.isNull(), html).otherwise(
        F.regexp_replace(html, F.concat(F.lit("(?:"), p, F.lit(r")(?s:.*)\z")), F.lit("")))


def crop(html, start_pats, end_pats) -> Column:
    return crop_end(crop_start(html, start_pats), end_pats)


def excise(html, pats, flags: str = "(?s)") -> Column:
    """H2 (DOTALL) / H19 (no flags): remove every match of each pattern, in order."""
    return F.aggregate(_arr(pats), col_of(html),
                       lambda acc, p: F.regexp_replace(acc, F.concat(F.lit(flags), p), F.lit("")))


# -------------------------------------------------------------- H4 H5 H6 H8
def drop_elements(html, tags=DROP_WITH_CONTENT, void=DROP_VOID) -> Column:
    """H5: remove listed elements with their content; void ones as single tags."""
    out = col_of(html)
    for t in tags:
        out = F.regexp_replace(out, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "")
    if void:
        out = F.regexp_replace(out, r"(?i)<(?:" + "|".join(void) + r")\b[^>]*>", "")
    return out


def unwrap_tags(html, tags=UNWRAP_TAGS) -> Column:
    """H4: remove the tags themselves, keep their children."""
    return F.regexp_replace(col_of(html), r"(?i)</?(?:" + "|".join(tags) + r")\b[^>]*>", "")


def drop_images(html, skip_images) -> Column:
    """H6: when skip_images, remove img tags and svg/figure elements."""
    html = col_of(html)
    out = html
    for t in IMAGE_TAGS_WITH_CONTENT:
        out = F.regexp_replace(out, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "")
    out = F.regexp_replace(out, r"(?i)<img\b[^>]*>", "")
    return F.when(F.coalesce(col_of(skip_images), F.lit(False)), out).otherwise(html)


def excerpt_drop_images(html) -> Column:
    """H6 excerpt form: a link holding only an image, then any img tag."""
    out = F.regexp_replace(col_of(html), r"<a [^>]*href=[^>]*> *<img [^>]*></a>", "")
    return F.regexp_replace(out, r"<img [^>]*>", "")


def links_rule(html, skip_links) -> Column:
    """H8: skip_links unwraps every <a>; otherwise empty links are removed."""
    html = col_of(html)
    unwrapped = F.regexp_replace(html, r"(?i)</?a\b[^>]*>", "")
    no_empty = F.regexp_replace(html, r"(?is)<a\b[^>]*>\s*</a\s*>", "")
    return F.when(F.coalesce(col_of(skip_links), F.lit(False)), unwrapped).otherwise(no_empty)


# -------------------------------------------------------------- H9 H11 H12
def base_href(html, url) -> Column:
    """H9: the page's <base href>, else scheme://host/ of the page URL."""
    b = F.regexp_extract(col_of(html), r"(?i)<base\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)
    dflt = F.concat(F.regexp_extract(col_of(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"))
    return F.when(b != "", b).otherwise(dflt)


def drop_base(html) -> Column:
    return F.regexp_replace(col_of(html), r"(?i)<base\b[^>]*>", "")


#: A tag up to its style attribute, and that attribute in double or single quotes (visible text is no tag).
STYLE_IN_TAG = r"(?i)(<[a-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)\s+style\s*=\s*(?:{}|{})"


def drop_color_styles(html) -> Column:
    """Style attributes that mention color or background are removed."""
    return F.regexp_replace(col_of(html), STYLE_IN_TAG.format(r"\"[^\"]*(?:color|background)[^\"]*\"",
                                                              r"'[^']*(?:color|background)[^']*'"), "$1")


def simplify(html) -> Column:
    """Remove every style attribute; append ' ... '."""
    return F.concat(F.regexp_replace(col_of(html), STYLE_IN_TAG.format(r"\"[^\"]*\"", r"'[^']*'"), "$1"), F.lit(" ... "))


# --------------------------------------------------------------------- H13
def meta_charset(html) -> Column:
    """Charset named by a <meta> tag ('' if none)."""
    return F.lower(F.regexp_extract(col_of(html), r"(?i)<meta\b[^>]*\bcharset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1))


def meta_refresh_url(html) -> Column:
    """Target of a meta refresh ('' if none)."""
    tag = F.regexp_extract(col_of(html), r"(?i)(<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>)", 1)
    return F.regexp_extract(tag, r"(?i)url\s*=\s*([^\"'>\s]+)", 1)


def refresh_note(html) -> Column:
    """What the story shows instead of a meta refresh ('' without one)."""
    url = meta_refresh_url(html)
    return F.when(url != "", F.concat(F.lit('Meta refresh suppressed.<br /><a href="'), url, F.lit('">'), url,
                                      F.lit("</a>"))).otherwise(F.lit(""))


# ------------------------------------------------------------- H14 H21 H22
def ensure_h1(html, title) -> Column:
    """Insert <h1>title</h1> at the start of the body when the page has no h1."""
    html = col_of(html)
    h1 = F.concat(F.lit("<h1>"), F.coalesce(col_of(title), F.lit("")), F.lit("</h1>\n"))
    head = F.regexp_extract(html, r"(?is)^(.*?<body\b[^>]*>)", 1)
    rest = F.substring(html, F.length(head) + 1, F.length(html))
    return (F.when(html.rlike("(?i)<h1"), html)
            .when(head != "", F.concat(head, h1, rest))
            .otherwise(F.concat(h1, html)))


def byline(html, author) -> Column:
    """H14: 'By: author' before the first '<body>' (nothing without an author)."""
    html, a = col_of(html), col_of(author)
    pos = F.instr(html, "<body>")
    ins = F.concat(F.substring(html, F.lit(1), pos - 1), F.lit("By: "), a, F.lit("\n<p>\n"),
                   F.substring(html, pos, F.length(html)))
    return F.when(a.isNull() | (a == "") | (pos == 0), html).otherwise(ins)


def lead_line(html, author) -> Column:
    """The byline where it stands right before the body's tag ('' elsewhere): the body shows it."""
    html, line = col_of(html), F.concat(F.lit("By: "), col_of(author), F.lit("\n<p>\n"))
    return F.when(F.contains(html, F.concat(line, F.lit("<body"))), line).otherwise(F.lit(""))


def body_only(html) -> Column:
    """The body's content; a fragment without <body> is all body."""
    html = col_of(html)
    inner = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)(?:</body>|\z)", 1)
    return F.when(html.rlike(r"(?i)<body[^>]*>"), inner).otherwise(html)


def has_content(html) -> Column:
    """Whether anything would be seen: text outside of tags and comments, or an image."""
    html = col_of(html)
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", ""), r"(?i)&nbsp;|\s", "")
    return (text != "") | html.rlike(r"(?i)<img\b")


# Story page wrapper.
PAGE_HEAD = ('<html>\n<head>\n<meta http-equiv="Content-Type" content="text/html; charset={charset}">\n'
             '<meta name="viewport" content="width=device-width, initial-scale=1">\n'
             '<link rel="stylesheet" type="text/css" title="Feeds" href="../../feeds.css"/>\n'
             '<title>{title}</title>\n</head>\n\n')
PAGE_FOOT = '\n<br>\n<a href="{url}">{url}</a>\n</body>\n</html>\n'


def wrap_page(body, title, url, charset="utf-8") -> Column:
    """Header with charset, viewport, title; footer with the source link."""
    head = PAGE_HEAD.split("{charset}")
    h2 = head[1].split("{title}")
    foot = PAGE_FOOT.split("{url}")
    cs = col_of(charset) if not isinstance(charset, str) else F.lit(charset)
    return F.concat(F.lit(head[0]), cs, F.lit(h2[0]), F.coalesce(col_of(title), F.lit("")), F.lit(h2[1]),
                    col_of(body),
                    F.lit(foot[0]), col_of(url), F.lit(foot[1]), col_of(url), F.lit(foot[2]))


# ------------------------------------------------------------------- H16
#: An a tag with its attributes; an href attribute with double, single or no quotes.
A_TAG = r"(?i)<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
HREF_IN_TAG = r"(?is)^(<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?<=\s))href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)(.*)$"


def _a_tags(html) -> Column:
    return F.regexp_extract_all(col_of(html), F.lit(A_TAG), F.lit(0))


def _href(tag) -> Column:
    """An a tag's href without its quotes; null when it has none."""
    v = F.regexp_extract(tag, HREF_IN_TAG, 2)
    return F.when(v != "", F.regexp_replace(v, r"^[\"']|[\"']$", ""))


def hrefs(html) -> Column:
    """All a[href] values in document order."""
    return F.filter(F.transform(_a_tags(html), _href), lambda h: h.isNotNull())


def multipage_links(html, pat) -> Column:
    """Hrefs matching the multi-page pattern, distinct, in order."""
    p = col_of(pat)
    return F.when(p.isNull() | (p == ""), empty_str_array()).otherwise(
        F.array_distinct(F.filter(hrefs(html), lambda h: F.regexp_like(h, p))))


# ------------------------------------------------------------------- H15
def single_page_link(html, url, pats) -> Column:
    """The page's reference to its single-page version, as written; null without one.

    The refresh target, else the first link of the first pattern (in list
    order) that matches any; the page's own URL is none.
    """
    html, url = col_of(html), col_of(url)
    refresh = F.nullif(meta_refresh_url(html), F.lit(""))
    found = F.flatten(F.transform(F.coalesce(col_of(pats), empty_str_array()), lambda p: F.slice(
        F.filter(hrefs(html), lambda h: F.regexp_like(h, p) & (h != url)), 1, 1)))
    return F.coalesce(F.when(refresh != url, refresh), F.try_element_at(found, F.lit(1)))


# ------------------------------------------------------------- H18 H20
def cut_excerpt(html, size) -> Column:
    """H18 (plain-text part): first ``size`` characters when size > 0, a dangling
    partial tag removed."""
    html, n = col_of(html), col_of(size)
    cut = F.regexp_replace(F.substring(html, F.lit(1), n), r"<[^>]*$", "")
    return F.when(F.coalesce(n, F.lit(0)) > 0, cut).otherwise(html)


# The index footer a 1.5-level excerpt may carry (cut away, H18).
FOOTER_NAV = r'<center><a href="[0-9]+.html">&gt;-[0-9]+-&gt;</a></center>'


def cut_footer(html) -> Column:
    """The footer navigation and what follows it go."""
    return F.regexp_replace(col_of(html), "(?s)" + FOOTER_NAV + ".*$", "")


def no_content(text) -> Column:
    """Empty (after trim) → '[No content]'."""
    t = col_of(text)
    return F.when(t.isNull() | (F.trim(t) == ""), F.lit("[No content]")).otherwise(t)


@built_once
def absolute_links(html, base) -> Column:
    """Every a[href] made absolute against the page's base.

    The page is split at its a tags once, each tag is rewritten by itself and
    the pieces are joined: no other tag or text can change, and the work is
    linear in the page however many links it has.
    """
    from feedloom.functions.urls import absolute_url
    html = col_of(html)

    def rewritten(tag):
        url = F.replace(absolute_url(_href(tag), col_of(base)), F.lit('"'), F.lit("&quot;"))
        return F.when(_href(tag).isNull(), tag).otherwise(F.concat(
            F.regexp_extract(tag, HREF_IN_TAG, 1), F.lit('href="'), url, F.lit('"'), F.regexp_extract(tag, HREF_IN_TAG, 3)))

    joined = F.array_join(F.zip_with(
        F.split(html, A_TAG, -1), F.concat(F.transform(_a_tags(html), rewritten), F.array(F.lit(""))),
        lambda text, tag: F.concat(text, tag)), "")
    return F.when(html.rlike(A_TAG), joined).otherwise(html)
