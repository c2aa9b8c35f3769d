"""Image reference rules (I1-I7), without any pixel work: native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.common import built_once, col_of

# Image file extensions kept as they are; the replacement
# source of a blocked image; the text of the link that replaces it.
KNOWN_EXTENSIONS = [".jpeg", ".png", ".gif", ".svg"]
BLOCKED_SRC = "file:///nonexistant"
NONLOCAL_LINK = '<a href="{src}"> [nonlocal image]</a>'
UNKNOWN_NAME = "_unknown.img"

DESC_RE = r"( *[0-9]+[wx])$"


def parse_srcset(attr) -> Column:
    """Srcset text -> ARRAY<STRUCT<u, d>> (url, descriptor or null).

    Split at commas; a part that does not start with a blank continues the
    previous candidate's URL when that candidate has no descriptor (commas
    inside URLs).  The descriptor is a trailing ``<digits>w`` or ``<digits>x``.
    """
    s = F.trim(col_of(attr))
    empty = F.array().cast("array<struct<u:string,d:string>>")

    def step(acc, part):
        last = F.element_at(acc, -1)
        join = (~part.startswith(" ")) & (F.size(acc) > 0) & last["d"].isNull()
        p = F.when(join, F.concat(last["u"], F.lit(","), part)).otherwise(part)
        base = F.when(join, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        matched = F.regexp_extract(p, DESC_RE, 1)
        u = F.when(matched != "", F.trim(F.substring(p, F.lit(1), F.length(p) - F.length(matched)))) \
            .otherwise(F.trim(p))
        d = F.when(matched != "", F.trim(matched))
        return F.concat(base, F.array(F.struct(u.alias("u"), d.alias("d"))))

    return F.when(s.isNull() | (s == ""), empty).otherwise(F.aggregate(F.split(s, ","), empty, step))


def choose_srcset(cands, max_width) -> Column:
    """URL of the widest 'w' candidate not wider than max_width (first on
    ties); if none, the first 'x' candidate; else null.  Candidates without a
    descriptor are skipped."""
    c = F.filter(col_of(cands), lambda x: x["d"].isNotNull())
    m = col_of(max_width)
    widths = F.transform(F.filter(c, lambda x: F.lower(x["d"]).endswith("w")),
                         lambda x: F.struct(x["u"].alias("u"),
                                            F.substring(F.lower(x["d"]), F.lit(1), F.length(x["d"]) - 1)
                                            .cast("int").alias("w")))
    ok = F.filter(widths, lambda x: (x["w"] <= m) & (x["w"] > 0))
    best = F.aggregate(ok, F.struct(F.lit(None).cast("string").alias("u"), F.lit(0).alias("w")),
                       lambda acc, x: F.when(x["w"] > acc["w"], x).otherwise(acc))
    first_x = F.try_element_at(F.filter(c, lambda x: F.lower(x["d"]).endswith("x")), F.lit(1))
    return F.coalesce(best["u"], first_x["u"])


def local_name(src) -> Column:
    """I3: '/' -> '_', keep letters, digits and '-_.'; empty -> '_unknown.img'."""
    n = F.regexp_replace(F.replace(col_of(src), F.lit("/"), F.lit("_")), r"[^\p{L}\p{Nd}_.\-]", "")
    return F.when(n == "", F.lit(UNKNOWN_NAME)).otherwise(n)


def split_name(name, src) -> Column:
    """The file name of a source whose local name is another source's too: a digest before the extension."""
    n, parts = col_of(name), r"^(.*?)(\.[A-Za-z0-9]{1,5})?$"
    return F.concat(F.regexp_extract(n, parts, 1), F.lit("_"), F.substring(F.md5(col_of(src)), 1, 12),
                    F.regexp_extract(n, parts, 2))


def nonlocal_link(src) -> Column:
    """The link appended to a rejected image."""
    a, b = NONLOCAL_LINK.split("{src}")
    return F.concat(F.lit(a), col_of(src), F.lit(b))


def resize_plan(width, height, max_size) -> tuple[Column, Column]:
    """Target size with the longer side at most max_size (integer division, aspect kept)."""
    w, h, m = col_of(width), col_of(height), col_of(max_size)
    big = (m > 0) & (F.greatest(w, h) > m)
    land = w >= h
    nw = F.when(big & land, m).when(big, F.floor(w * m / h).cast("int")).otherwise(w)
    nh = F.when(big & land, F.floor(h * m / w).cast("int")).when(big, m).otherwise(h)
    return nw.cast("int"), nh.cast("int")


def output_name(name, fmt, resized, transparent, png_to_jpg) -> Column:
    """File name after conversion: JPEG when resized, when PNG and (png_to_jpg
    or opaque), or when the extension is unknown; a converted name drops the
    dots of its base and ends in '.jpg'."""
    n = col_of(name)
    ext = F.lower(F.regexp_extract(n, r"(\.[^./]*)$", 1))
    base = F.when(ext != "", F.substring(n, F.lit(1), F.length(n) - F.length(ext))).otherwise(n)
    is_png = (F.upper(col_of(fmt)) == "PNG") | F.lower(n).endswith(".png")
    convert = (col_of(resized) | (is_png & (col_of(png_to_jpg) | ~col_of(transparent)))
               | ~ext.isin(*KNOWN_EXTENSIONS))
    return F.when(convert, F.concat(F.replace(base, F.lit("."), F.lit("")), F.lit(".jpg"))).otherwise(n)


def set_attr(tag, attr: str, value) -> Column:
    """Set an attribute of a tag token (replace its value, or add it before '>')."""
    tag = col_of(tag)
    esc = F.regexp_replace(col_of(value), r"([\\$])", r"\\$1")
    has = tag.rlike(rf"(?i)\s{attr}\s*=")
    replaced = F.regexp_replace(tag, rf"(?i)(\s{attr}\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s>]+)",
                                F.concat(F.lit("$1\""), esc, F.lit("\"")))
    added = F.regexp_replace(tag, r"(\s*/?>)$", F.concat(F.lit(f' {attr}="'), esc, F.lit("\"$1")))
    return F.when(has, replaced).otherwise(added)


def image_decision(tag, page_host, base, max_srcset, nonlocal_ok, block_nonlocal, alt_domains, renames=None) -> Column:
    """I1-I5 for one img tag: struct(abs_src, action, new_src, new_tag).

    action: 'none' (no source), 'data' (a data: URL, left alone), 'local'
    (fetched: src becomes the local file name) or 'nonlocal' (src becomes
    the blocked marker, or stays, and a link to the image follows the tag).
    ``renames`` maps sources to file names other than their local name.
    Values used several times are bound once (``let``), so the expression
    stays linear when used inside ``transform``.
    """
    from feedloom.functions.common import let
    from feedloom.functions.urls import absolute_url, similar_host, url_host
    from feedloom.operators.tokens import attr_value

    tag = col_of(tag)
    src0 = F.coalesce(attr_value(tag, F.lit("data-src")), attr_value(tag, F.lit("src")))
    srcset = F.coalesce(attr_value(tag, F.lit("data-lazy-srcset")), attr_value(tag, F.lit("srcset")))
    src = F.coalesce(choose_srcset(parse_srcset(srcset), col_of(max_srcset)), src0)

    def decide(s):
        def with_abs(a):
            keep = F.coalesce(col_of(nonlocal_ok), F.lit(False)) | similar_host(url_host(a), col_of(page_host),
                                                                                 col_of(alt_domains))
            action = (F.when(s.isNull() | (s == ""), F.lit("none")).when(~keep, F.lit("nonlocal"))
                      .when(a.startswith("data:"), F.lit("data")).otherwise(F.lit("local")))

            def finish(act):
                name = local_name(a)
                if renames is not None:
                    name = F.coalesce(F.try_element_at(col_of(renames), a), name)
                new_src = (F.when(act == "local", name)
                           .when(act == "nonlocal", F.when(F.coalesce(col_of(block_nonlocal), F.lit(True)),
                                                           F.lit(BLOCKED_SRC)).otherwise(a))
                           .otherwise(s))
                new_tag = (F.when(act == "local", set_attr(tag, "src", new_src))
                           .when(act == "nonlocal", F.concat(set_attr(tag, "src", new_src), nonlocal_link(a)))
                           .otherwise(tag))
                return F.struct(a.alias("abs_src"), act.alias("action"), new_src.alias("new_src"),
                                new_tag.alias("new_tag"))
            return let(action, finish)
        return let(F.when(s.startswith("data:"), s).otherwise(absolute_url(s, col_of(base))), with_abs)

    return let(src, decide)


IMG_TAG_RE = r"(?i)<img\b[^>]*>"


@built_once
def rewrite_images(html, page_host, base, max_srcset, nonlocal_ok, block_nonlocal, alt_domains, renames=None) -> Column:
    """I5/I7 in the page: every img tag replaced by its rewritten form.

    The page is split at its img tags once, each tag is rewritten by itself and
    the pieces are joined: work is linear in the page, and no rewritten tag is
    met a second time.
    """
    html = col_of(html)
    tags = F.regexp_extract_all(html, F.lit(IMG_TAG_RE), F.lit(0))

    def new(tag):
        return image_decision(tag, page_host, base, max_srcset, nonlocal_ok, block_nonlocal, alt_domains, renames)["new_tag"]

    rewritten = F.array_join(F.zip_with(
        F.split(html, IMG_TAG_RE, -1), F.concat(F.transform(tags, new), F.array(F.lit(""))),
        lambda text, tag: F.concat(text, tag)), "")
    # pages without an img tag skip the (interpreted) per-tag lambdas
    return F.when(html.rlike(r"(?i)<img\b"), rewritten).otherwise(html)
