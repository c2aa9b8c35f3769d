"""URL column expressions (E8, E16, E17, I4 host rules).

All functions take and return Columns, so they stay inside whole-stage
codegen; nothing here calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.common import col_of

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):"
ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"
PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_host(url) -> Column:
    """Host part of an absolute URL ('' when there is none)."""
    return F.regexp_extract(col_of(url), HOST_RE, 1)


def url_scheme(url) -> Column:
    return F.regexp_extract(col_of(url), SCHEME_RE, 1)


def url_origin(url) -> Column:
    """scheme://host[:port] of an absolute URL."""
    return F.regexp_extract(col_of(url), ORIGIN_RE, 1)


def url_path(url) -> Column:
    return F.regexp_extract(col_of(url), PATH_RE, 1)


def host_tail(host) -> Column:
    """Last two labels of a host: the (simplistic) registrable domain."""
    return F.substring_index(col_of(host), ".", -2)


def same_host(a, b) -> Column:
    """Two hosts are the same site when their last two labels agree.

    Two missing hosts are equal; one missing host never equals a present one.
    """
    a, b = col_of(a), col_of(b)
    a_missing = a.isNull() | (a == "")
    b_missing = b.isNull() | (b == "")
    return (F.when(a_missing & b_missing, F.lit(True))
            .when(a_missing | b_missing, F.lit(False))
            .otherwise(host_tail(a) == host_tail(b)))


def similar_host(a, b, alt_domains) -> Column:
    """same_host(a, b) or a is the same site as any alternate domain."""
    a = col_of(a)
    alts = F.coalesce(col_of(alt_domains), F.array().cast("array<string>"))
    return same_host(a, b) | F.exists(alts, lambda d: same_host(a, d))


def remove_dot_segments(path) -> Column:
    """RFC 3986 dot-segment removal on a path column, with a native fold."""
    path = col_of(path)
    segs = F.split(path, "/")
    last = F.element_at(segs, -1)
    folded = F.aggregate(
        F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    # a trailing '.' or '..' names a directory: keep the slash
    trail = F.when(last.isin(".", "..") & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit(""))
    cleaned = F.concat(F.lit("/"), F.array_join(folded, "/"), trail)
    return F.when(path.contains("./") | path.endswith("/.") | path.endswith("/.."), cleaned).otherwise(path)


def absolute_url(url, base) -> Column:
    """Resolve ``url`` against ``base``.

    Empty, already absolute ('://') and fragment-only ('#...') URLs are
    returned unchanged.  Otherwise resolution follows RFC 3986: '//h/x' takes
    the base scheme, '/x' the base origin, '?q' the base path, and relative
    paths the base directory, with dot segments removed.
    """
    url, base = col_of(url), col_of(base)
    origin = url_origin(base)
    bpath = url_path(base)
    bdir = F.regexp_extract(bpath, r"^(.*/)", 1)
    bdir = F.when(bdir == "", F.lit("/")).otherwise(bdir)
    # split the relative reference into path and query/fragment tail
    rel_path = F.regexp_extract(url, r"^([^?#]*)", 1)
    rel_tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return (
        F.when(url.isNull(), F.lit(None).cast("string"))
        .when((url == "") | url.contains("://") | url.startswith("#"), url)
        .when(base.isNull() | (origin == ""), url)
        .when(url.startswith("//"), F.concat(url_scheme(base), F.lit(":"), url))
        .when(url.startswith("/"),
              F.concat(origin, remove_dot_segments(rel_path), rel_tail))
        .when(url.startswith("?"), F.concat(origin, bpath, url))
        .otherwise(F.concat(origin, remove_dot_segments(F.concat(bdir, rel_path)), rel_tail))
    )


def is_local_link(link) -> Column:
    """A link that names a file next to the page.

    Not local: empty, has a ':' (scheme), starts with '#', '/' or '../'.
    """
    link = col_of(link)
    return ~(link.isNull() | (link == "") | link.contains(":") | link.startswith("#")
             | link.startswith("/") | link.startswith("../"))


def strip_fragment(url) -> Column:
    """Cut at the first '#', then protect '%' as '%25' (E17)."""
    return F.replace(F.substring_index(col_of(url), "#", 1), F.lit("%"), F.lit("%25"))


def url_dirname(url) -> Column:
    """Everything up to and including the last '/'."""
    return F.regexp_extract(col_of(url), r"^(.*/)", 1)


def content_type_ok(ctype) -> Column:
    """empty/missing, text*, or an RSS/XML/Atom application type."""
    c = col_of(ctype)
    return (c.isNull() | (c == "") | c.startswith("text") | c.startswith("application/rss")
            | c.startswith("application/xml") | c.startswith("application/x-rss+xml")
            | c.startswith("application/atom+xml"))


# Body that replaces a non-text download.
NOT_TEXT_BODY = '<p>Contents not text! ({ctype}) <a href="{url}">{url}</a></p>'


def gate_body(body, ctype, url) -> Column:
    """Non-text content is replaced by an explanatory paragraph."""
    parts = NOT_TEXT_BODY.split("{ctype}")
    tail = parts[1].split("{url}")
    msg = F.concat(F.lit(parts[0]), col_of(ctype), F.lit(tail[0]), col_of(url), F.lit(tail[1]), col_of(url),
                   F.lit(tail[2]))
    return F.when(content_type_ok(ctype), col_of(body)).otherwise(msg)


def header_charset(ctype) -> Column:
    """Last 'charset=' value of a content type, cut at ';' ('' if none)."""
    c = F.coalesce(col_of(ctype), F.lit(""))
    last = F.element_at(F.split(c, "charset="), -1)
    return F.when(c.contains("charset="), F.trim(F.substring_index(last, ";", 1))).otherwise(F.lit(""))
