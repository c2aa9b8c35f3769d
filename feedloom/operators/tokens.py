"""HTML as tokens, and the tree operators built on them.

The tree operators work on one page per row: its tokens and the extents of its
elements are found by ``functions.tree`` inside Arrow batches, so no page is
exploded, shuffled or sorted, and pages that a step cannot touch reach Python
as nulls.  ``html_tokens`` is the token table itself, for analysis.

Contract for malformed HTML: see ``functions.tree``.  An element that is never
closed ends with its parent, or where the start of another element implies its
end (``p``, ``li``, ``td``, ``option``, ...); nothing is re-serialised or
pretty-printed.  A null page stays null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import tree
from feedloom.functions.common import col_of, empty_str_array, rx_extract
from feedloom.functions.tree import VOID_TAGS
from feedloom.session import ship_package

# Token pattern.
TOKEN_RE = r"(?is:<script\b.*?</script\s*>|<style\b.*?</style\s*>)|<!--(?s:.*?)-->|<[^>]*>|[^<]+|<"

# Node spec: a tag and an attribute with a quoted value (for the check that it has one).
NODE_SPEC_RE = r"""^\s*([A-Za-z][A-Za-z0-9]*|[*])\s+([A-Za-z][-A-Za-z0-9_:]*)\s*=\s*(?:"([^"]*)"|'[^']*')"""

# Tag name and token kind (text, comment, decl, close, raw, void, open), as SQL.
TAG_RE = "^</?([A-Za-z][A-Za-z0-9]*)"
KIND_SQL = ("CASE WHEN NOT startswith(tok, '<') THEN 'text' "
            "WHEN startswith(tok, '<!--') THEN 'comment' "
            "WHEN startswith(tok, '<!') OR startswith(tok, '<?') THEN 'decl' "
            "WHEN tag = '' THEN 'text' "
            "WHEN startswith(tok, '</') THEN 'close' "
            "WHEN tag IN ('script', 'style') THEN 'raw' "
            "WHEN tag IN ({void}) OR endswith(tok, '/>') THEN 'void' "
            "ELSE 'open' END")


def html_tokens(pages: DataFrame, html_col: str = "html", key: str = "page_id",
                keep=()) -> DataFrame:
    """Explode pages into tokens with tag, kind and same-tag nesting level (one shuffle, by page).

    kind: text, comment, decl, raw (script/style), void, open, close.
    ``level`` of an open tag is the depth after it opens; of a close tag the
    depth before it closes; so an element's open and close share a level.
    ``keep`` names page columns copied onto every token (e.g. rule arrays).
    """
    parted = pages.repartition(key)
    toks = parted.select(key, *keep, F.posexplode(
        F.regexp_extract_all(F.col(html_col), F.lit(TOKEN_RE), F.lit(0))).alias("pos", "tok"))
    toks = toks.selectExpr("*", f"lower(regexp_extract(tok, '{TAG_RE}', 1)) AS tag")
    toks = toks.selectExpr("*", KIND_SQL.format(void=", ".join(f"'{t}'" for t in VOID_TAGS)) + " AS kind")
    depth = (f"sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY `{key}`, tag "
             "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return toks.selectExpr("*", f"CAST(CASE WHEN kind = 'close' THEN {depth} + 1 ELSE {depth} END AS INT) AS level")


def parse_node_spec(spec) -> tuple[Column, Column, Column]:
    """(tag, attr, double-quoted value) of a 'tag attr="regex"' spec; '' parts when it does not parse."""
    s = col_of(spec)
    return (F.lower(F.regexp_extract(s, NODE_SPEC_RE, 1)),
            F.lower(F.regexp_extract(s, NODE_SPEC_RE, 2)),
            F.regexp_extract(s, NODE_SPEC_RE, 3))


def attr_value(tok, attr) -> Column:
    """Value of attribute ``attr`` (a column) in a tag token; null when absent."""
    tok = col_of(tok)
    dq = rx_extract(tok, F.concat(F.lit(r"(?i)\s"), attr, F.lit(r"\s*=\s*\"([^\"]*)\"")), 1)
    sq = rx_extract(tok, F.concat(F.lit(r"(?i)\s"), attr, F.lit(r"\s*=\s*'([^']*)'")), 1)
    bare = rx_extract(tok, F.concat(F.lit(r"(?i)\s"), attr, F.lit(r"\s*=\s*([^\s\"'>]+)")), 1)
    has = F.regexp_like(tok, F.concat(F.lit(r"(?i)\s"), attr, F.lit(r"\s*=")))
    return F.when(has, F.when(dq != "", dq).when(sq != "", sq).otherwise(bare))


def _in_row(fn, returns):
    """A step on one page (and its lists of specs) as a Column function."""
    @F.pandas_udf(returns)
    def step(html: pd.Series, specs: pd.Series) -> pd.Series:
        return pd.Series([fn(page, given) for page, given in zip(html, specs)], dtype=object)

    # never evaluated twice: a later filter is not pushed below it
    return step.asNondeterministic()


class _Program:
    """Edit steps of ``functions.tree`` on a page; each task parses each list of specs once."""

    def __init__(self, names: list[str]):
        self.names, self.known = names, {}

    def __call__(self, page, lists):
        steps = []
        for name, given in zip(self.names, lists):
            containers = tree.EDITS[name][1]
            key = (containers, tuple(given))
            if containers is not None and key not in self.known:
                self.known[key] = tree.Specs(key[1], containers)
            steps.append((name, None if containers is None else self.known[key]))
        return tree.edited(page, steps)


class _Links:
    """S3 on a page."""

    def __init__(self):
        self.known = {}

    def __call__(self, page, specs):
        key = tuple(specs) if specs is not None else ()
        if key not in self.known:
            self.known[key] = tree.Specs(key, True)
        return tree.links_in(page, self.known[key])


LINKS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("href", T.StringType()),
                                  T.StructField("text", T.StringType())]))


def _applied(pages: DataFrame, html_col: str, value: Column) -> DataFrame:
    """``pages`` with a new html column, the columns in their order."""
    ship_package(pages.sparkSession)
    return pages.select(*[value.alias(html_col) if c == html_col else F.col(f"`{c}`") for c in pages.columns])


def _has_work(name: str, html: Column, specs: Column) -> Column:
    """Whether an edit step can change the page; pages without work do not go to Python."""
    if name == "delete":
        tags = F.transform(F.coalesce(specs, empty_str_array()), lambda s: F.regexp_extract(s, NODE_SPEC_RE, 1))
        return F.coalesce(F.exists(tags, lambda t: (t == "*") | (t != "") & F.regexp_like(
            html, F.concat(F.lit("(?i)<"), F.replace(t, F.lit("*"), F.lit("")), F.lit(r"\b")))), F.lit(False))
    if name == "keep":
        return F.coalesce(F.size(specs) > 0, F.lit(False))
    if name == "one_body":  # two starts or two ends of html or body
        return F.coalesce(html.rlike(r"(?is)<(/?(?:html|body))\b.*<\1\b"), F.lit(False))
    return F.lit(True)


def edit_pages(pages: DataFrame, program: list[tuple[str, str | None]], html_col: str = "html") -> DataFrame:
    """The tree program: edit steps applied to one token array per page.

    ``program`` lists (step, specs column): ``delete`` (H3), ``keep`` (H17),
    ``one_body`` and ``repair`` (H7, H18; no specs).  A page is parsed once and
    joined once whatever the number of steps, inside one Arrow step and without
    a shuffle; elements keep the extents they have on the page as given.
    """
    html = F.col(f"`{html_col}`")
    lists = [F.col(f"`{c}`") if c else empty_str_array() for _, c in program]
    work = F.lit(False)
    for (name, _), specs in zip(program, lists):
        work = work | _has_work(name, html, specs)
    fixed = _in_row(_Program([name for name, _ in program]), T.StringType())(
        F.when(work, html), F.array(*[F.coalesce(c, empty_str_array()) for c in lists]))
    return _applied(pages, html_col, F.coalesce(fixed, html))


def delete_nodes(pages: DataFrame, specs_col: str = "skip_nodes", html_col: str = "html") -> DataFrame:
    """H3: remove every element matching a node spec of the page's site, with its subtree.

    ``specs_col`` is an ARRAY<STRING> column on the pages (the site's
    skip_nodes): 'tag attr="regex" ...', the tag ``*`` naming any.  Only pages
    whose html names a spec's tag go to Python; specs without an attribute
    match nothing (see ``bad_node_specs``).
    """
    return edit_pages(pages, [("delete", specs_col)], html_col)


def bad_node_specs(specs: DataFrame, name: str = "feed") -> DataFrame:
    """Rejects for node specs that cannot be used (no 'attr="value"' part)."""
    tag, attr, _ = parse_node_spec(F.col("spec"))
    return (specs.filter((tag == "") | (attr == "")).select(name, "spec").distinct()
            .select(name, F.lit(None).cast("string").alias("item_id"), F.lit("rules").alias("stage"),
                    F.lit("warn").alias("severity"),
                    F.concat(F.lit("unusable skip_nodes spec: "), F.col("spec")).alias("reason")))


def keep_container(pages: DataFrame, specs_col: str, html_col: str = "html") -> DataFrame:
    """Keep only the first element of the first spec (list order) that
    matches anything on the page; pages with no match keep everything.

    ``specs_col`` is an ARRAY<STRING>: 'tag attr="value"' (the value, or one of
    its words; the tag ``*`` names any) or a bare tag.
    """
    return edit_pages(pages, [("keep", specs_col)], html_col)


def first_html_body(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """H7: keep the first html and body tags; later html/body tags are unwrapped.

    Pages with one start and one end tag of each at most do not go to Python.
    """
    return edit_pages(pages, [("one_body", None)], html_col)


def container_links(pages: DataFrame, specs_col: str, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """S3: every a[href] inside any container matching a spec, with its text.

    Returns (key, pos, href, text): one entry per link (Q11 intended); pos is
    the number of the link's token on the page.
    """
    ship_package(pages.sparkSession)
    links = _in_row(_Links(), LINKS)(F.col(f"`{html_col}`"), F.col(f"`{specs_col}`"))
    return pages.select(F.col(f"`{key}`"), links.alias("_links")).select(f"`{key}`", F.inline("_links"))


def repair_excerpt(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """H18 tag repair of a cut excerpt: drop the first h1 element, append ' ...'
    to the last text (or ' [...]' when there is none) and close every element
    left open, innermost first, at the end."""
    return edit_pages(pages, [("repair", None)], html_col)
