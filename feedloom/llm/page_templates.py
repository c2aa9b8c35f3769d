"""HTML extraction by site template removal.

1. Every page is parsed once; each element subtree gets a hash of its tags and
   text.  Spark counts on how many different pages of its host a subtree occurs
   (copies of a page count once; sums are taken map-side, so a hot host is no
   hot task).
2. Subtrees on many pages of a scope (at least FEWEST, and SHARE of its pages)
   are its template.  A page has two scopes: its host, and its section, which
   is the first directory of its path, so that a box which only one of many
   sections shows is found too.  A scope has at most 1 / SHARE times as many
   of them as its pages have subtrees on average, so its list is bounded.
3. Each page meets the lists of its scopes and is parsed again; template
   subtrees go.
   So do the elements that are no article text by what HTML says of them
   (scripts, styles, forms, menus, headers and footers of the page, sidebars,
   and boxes whose class or id names an advert, notice, menu or comments),
   for hosts with too few pages to show a template.

If the page has an ``article`` (or ``main``), the text is taken from it, else
from the body.  Within it plain text elements (PROSE) stay even if they recur:
a passage that articles share is no template.  Text is cut into blocks at block elements; white space within
a block becomes one space; blocks are joined by line feeds.

Defined cases: a null or empty html gives the empty text; a null url or one
without host belongs to the empty host; unclosed elements end with their
parent; text outside any element counts; nothing is cut from long pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import broadcast_if_small, map_arrow, table
from feedloom.llm.url_templates import parsed

SHARE, FEWEST = 0.2, 5

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td
    tfoot th thead title tr ul""".split())
NO_TEXT = frozenset("""aside audio button canvas dialog embed footer form head iframe input math menu nav noembed noframes
    noscript object script select style svg template textarea title video""".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong a span td th tr li code q u s small sub sup".split())
#: An element of the key kind is closed by the start of one of these.
CLOSED_BY = {"p": BLOCK - {"body", "html", "title"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
             "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
             "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"},
             "head": BLOCK - {"head", "html", "title"}, "nav": {"article", "main"}}
CLOSERS = frozenset().union(*CLOSED_BY.values())
#: Elements past which an implied close does not reach.
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "p": {"table", "td", "th", "button"}, "option": {"select"}}
#: Words of class, id or role that name what is not the article.
BOX_WORDS = frozenset("""ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment
    comments consent contentinfo cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter
    notice notification notifications pagination pager popup promo promoted recommended related replies share sharing sidebar
    signup social sponsor sponsored subscribe subscription toolbar widget widgets complementary search skip""".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)
    |(/?)([A-Za-z][^\s/>]*)((?:\s++|=|[^\s=>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>
    |[!?/][^>]*>)""", re.S | re.X)
#: A tag that the end of the page cuts off.
_CUT = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "box", "kids", "key")

    def __init__(self, tag: str, box: bool = False):
        self.tag, self.box, self.kids, self.key = tag, box, [], 0


#: A hyphenated name that begins so tells of the page's layout, not of the element.
LAYOUT_WORDS = frozenset("has is no not with without".split())


def _names_box(word: str, prose: bool) -> bool:
    """Whether a class, id or role names a box; text elements only by the whole word."""
    if word in BOX_WORDS or prose:
        return word in BOX_WORDS
    parts = word.replace("_", "-").split("-")
    return parts[0] not in LAYOUT_WORDS and (parts[0] in BOX_WORDS or parts[-1] in BOX_WORDS)


def _is_box(tag: str, attrs: str) -> bool:
    """Whether class, id or role of an element (never the page's or article's own) names what is no article text."""
    low = attrs.lower()
    if tag in ("html", "body", "main"):
        return False
    if "class" not in low and "id" not in low and "role" not in low and "hidden" not in low:
        return False
    for name, a, b, c in _ATTR.findall(low):
        if name in ("class", "id", "role"):
            if any(_names_box(w, tag in PROSE) for w in (a or b or c).split()):
                return True
        if name == "aria-hidden" and (a or b or c) == "true":
            return True
    return False


def parse(page: str) -> Element:
    """The element tree; kids are elements and pieces of text (still with character references)."""
    top = Element("#")
    stack, at, n = [top], 0, len(page)
    opened: Counter[str] = Counter()
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].kids.append(_CUT.sub("", page[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                while True:
                    gone = stack.pop().tag
                    opened[gone] -= 1
                    if gone == tag:
                        break
            elif tag == "br":
                stack[-1].kids.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                stack[-1].kids.append(Element(tag))
            elif tag == "br":
                stack[-1].kids.append(" ")
            continue
        for k in range(len(stack) - 1, 0, -1) if tag in CLOSERS else ():  # implied closes
            open_tag = stack[k].tag
            if tag in CLOSED_BY.get(open_tag, ()):
                opened.subtract(e.tag for e in stack[k:])
                del stack[k:]
            elif open_tag in BLOCK and open_tag not in CLOSED_BY or open_tag in HOLDS.get(tag, ()):
                break
        own = Element(tag, _is_box(tag, m[3]))
        stack[-1].kids.append(own)
        if m[3].endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            own.kids.append(page[at:end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(own)
        opened[tag] += 1
    return top


def hashed(e: Element, out: list[int]) -> None:
    """Give every element the hash of its subtree (0: no text); those of subtrees with text go to ``out``."""
    todo, order = [e], []
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if not isinstance(k, str)]
    for x in reversed(order):
        h = xxhash.xxh64(x.tag)
        some = False
        for k in x.kids:
            if isinstance(k, str):
                t = _SPACE.sub(" ", k).strip()
                if t:
                    h.update("\0" + t)
                    some = True
            else:
                h.update(k.key.to_bytes(8, "little"))
                some = some or k.key != 0
        x.key = h.intdigest() if some else 0
        if some and x.tag not in ("#", "html", "body"):
            out.append(x.key)


def _first(top: Element, tag: str, boxes: bool = False) -> list[Element]:
    """The outermost elements of a kind, in page order; with ``boxes`` also within boxes."""
    out, todo = [], [top]
    while todo:
        x = todo.pop()
        if x.tag == tag and not x.box:
            out.append(x)
        else:
            todo += [k for k in reversed(x.kids) if not isinstance(k, str) and k.tag not in NO_TEXT and (boxes or not k.box)]
    return out


def text_of(top: Element, template: set[int]) -> str:
    """The article's blocks, without template subtrees and what is no article text."""
    # a page whose only article lies in what looks like a box still has that article
    roots = (_first(top, "article") or _first(top, "main") or _first(top, "article", True) or _first(top, "main", True) or [top])
    blocks, piece = [], []

    def close():
        t = _SPACE.sub(" ", entities.unescape("".join(piece))).strip()
        if t:
            blocks.append(t)
        piece.clear()

    inside = roots[0] is not top
    for root in roots:
        todo: list = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                piece.append(x)
                continue
            if x is None:
                close()
                continue
            if x is not root and (x.tag in NO_TEXT or x.box or x.tag == "header" and not inside
                                  or x.key in template and not (inside and x.tag in PROSE)):
                piece.append(" ")
                if x.tag in BLOCK:
                    close()
                continue
            if x.tag in BLOCK:
                close()
                todo.append(None)
            todo += reversed(x.kids)
        close()
    return "\n".join(blocks)


#: Scopes of a page with ``host`` and ``path``: hashes of its host, and of host and first directory (null: none).
HOST_SCOPE = "xxhash64(host)"
SECTION_SCOPE = "IF(path RLIKE '^/+[^/]+/', xxhash64(host, regexp_extract(path, '^/+([^/]+)/', 1)), NULL)"


def subtrees(pages: DataFrame) -> DataFrame:
    """(scope, page, key): the subtrees of each page of (host, path, html) for each of its scopes, and key 0 for the page."""
    def run(batches):
        for b in batches:
            at, pages, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, page in enumerate(b.column(2).to_pylist()):
                own: list[int] = [0]
                top = parse(page or "")
                hashed(top, own)
                keys.append(np.unique(np.array(own, np.uint64)).view(np.int64))
                at.append(np.full(len(keys[-1]), i))
                pages.append(np.full(len(keys[-1]), top.key, np.uint64).view(np.int64))
            at, pages, keys = pa.array(np.concatenate(at)), pa.array(np.concatenate(pages)), pa.array(np.concatenate(keys))
            for scope in b.column(0), b.column(1):
                rows = pa.RecordBatch.from_arrays([scope.take(at), pages, keys], names=["scope", "page", "key"])
                yield rows.filter(rows.column(0).is_valid())

    return map_arrow(pages.selectExpr(f"{HOST_SCOPE} AS host", f"{SECTION_SCOPE} AS section", "html"), run,
                     "scope bigint, page bigint, key bigint")


def site_templates(pages: DataFrame, share: float = SHARE, fewest: int = FEWEST) -> DataFrame:
    """(scope, keys): the subtrees that recur on many different pages of each scope."""
    n = table(subtrees(pages).distinct().groupBy("scope", "key").agg(F.count(F.lit(1)).alias("n"))
              .where(f"key = 0 OR n >= {fewest}"))
    whole = n.where("key = 0").select("scope", F.col("n").alias("pages"))
    return (n.where("key <> 0").join(whole, "scope").where(f"n >= {share} * pages").groupBy("scope")
            .agg(F.sort_array(F.collect_list("key")).alias("keys")))


def page_lists(pages: DataFrame) -> DataFrame:
    """(scope, keys): for each section and each host the template keys that its pages meet, its host's included."""
    known = table(site_templates(pages))
    pairs = pages.selectExpr(f"{HOST_SCOPE} AS host_scope", f"coalesce({SECTION_SCOPE}, {HOST_SCOPE}) AS scope").distinct()
    return (pairs.join(known.withColumnsRenamed({"scope": "host_scope", "keys": "host_keys"}), "host_scope", "left")
            .join(known, "scope", "left").where("host_keys IS NOT NULL OR keys IS NOT NULL")
            .selectExpr("scope", "array_union(coalesce(host_keys, array()), coalesce(keys, array())) AS keys"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per page."""
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("k"),
                        F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = parsed(rows.withColumn("kk", F.struct("k", "html")), "kk", "url").select(
        "id.k.id", "id.k.url", "host", "path", "id.html")
    keys = broadcast_if_small(table(page_lists(rows)))
    j = (rows.withColumn("scope", F.expr(f"coalesce({SECTION_SCOPE}, {HOST_SCOPE})")).join(keys, "scope", "left")
         .select("id", "url", "html", "keys"))

    def run(batches):
        for b in batches:
            out = []
            for page, known in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                top = parse(page or "")
                hashed(top, [])
                out.append(text_of(top, {k % (1 << 64) for k in known or ()}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()),
                                              pa.array([len(t) for t in out], pa.int64())],
                                             names=["id", "url", "text", "n_chars"])

    return map_arrow(j, run, f"id {id_type}, url string, text string, n_chars bigint")


def query(pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumnRenamed("id", "page_id")
