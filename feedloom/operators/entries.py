"""Entry operators: ids, skip filters, dedup, numbering, ordering.

Covers E1-E7, E9, E11-E14, D1-D3, W1-W5, O1.  Every function maps a
DataFrame of entries (see ``ENTRY_SCHEMA``) to a DataFrame.  Rule columns
(``skip_link_pats`` ...) are expected on the rows, attached by
``feedloom.sources.rules.attach_rules``.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.common import col_of, first_match

LINK_T = T.StructType([T.StructField("href", T.StringType()),
                       T.StructField("rel", T.StringType()),
                       T.StructField("type", T.StringType())])

ENTRY_SCHEMA = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("feed_url", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("guid", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("links", T.ArrayType(LINK_T)),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("summary_detail", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
])

# Index page texts.
END_MARKER = "[end]"
NO_CONTENT = "[No content]"


# ---------------------------------------------------------------- E1 / E2 / E3
def alternate_links(links="links", link="link") -> Column:
    """Hrefs of rel='alternate' links; else [link]; else []."""
    links, link = col_of(links), col_of(link)
    alts = F.transform(F.filter(links, lambda l: (l["rel"] == "alternate") & l["href"].isNotNull()),
                       lambda l: l["href"])
    return (F.when(links.isNotNull(), alts)
            .when(link.isNotNull(), F.array(link))
            .otherwise(F.array().cast("array<string>")))


def raw_item_id(id_="id", guid="guid", alt=None) -> Column:
    """Id, else guid, else the first alternate link (null: no id)."""
    alt = alt if alt is not None else alternate_links()
    return F.coalesce(col_of(id_), col_of(guid), F.try_element_at(alt, F.lit(1)))


def id_encode(s) -> Column:
    """Spaces become '+' (the seen-set's encoding)."""
    return F.replace(col_of(s), F.lit(" "), F.lit("+"))


def split_anchor(item_id) -> tuple[Column, Column]:
    """Split at the LAST '#': (id without anchor, '#anchor' or '')."""
    s = col_of(item_id)
    has = s.contains("#")
    base = F.when(has, F.regexp_extract(s, r"^(.*)#[^#]*$", 1)).otherwise(s)
    anchor = F.when(has, F.regexp_extract(s, r"(#[^#]*)$", 1)).otherwise(F.lit(""))
    return base, anchor


def with_item_ids(entries: DataFrame) -> DataFrame:
    """Adds ``item_id`` (encoded, anchor removed), ``anchor`` and ``raw_id``."""
    links = F.col("links") if "links" in entries.columns else F.lit(None).cast(T.ArrayType(LINK_T))
    guid = F.col("guid") if "guid" in entries.columns else F.lit(None).cast("string")
    raw = id_encode(raw_item_id("id", guid, alternate_links(links, "link")))
    base, anchor = split_anchor(raw)
    return entries.withColumn("raw_id", raw).withColumn("item_id", base).withColumn("anchor", anchor)


# ------------------------------------------------------------- E4 - E7 skips
def skip_reason() -> Column:
    """First reason an entry is skipped before dedup, in the reference's order."""
    link = F.coalesce(F.col("link"), F.lit(""))
    title = F.coalesce(F.col("title"), F.lit(""))
    link_pat = first_match("skip_link_pats", link)
    title_pat = first_match("skip_title_pats", title, "(?iu)")
    return (F.when(F.col("raw_id").isNull(), F.lit("no id or link"))
            .when(link_pat.isNotNull(), F.concat(F.lit("skip_link_pats: "), link_pat))
            .when(title_pat.isNotNull(), F.concat(F.lit("skip_title_pats: "), title_pat))
            .when(link.endswith("mp3"), F.lit("mp3 link")))


def skip_filter(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E2 (no id), E4 link patterns, E5 title patterns (ignore case), E6 mp3.

    Returns (kept, rejects).  Needs ``with_item_ids`` and the rule columns.
    """
    tagged = entries.withColumn("_reason", skip_reason())
    kept = tagged.filter(F.col("_reason").isNull()).drop("_reason")
    rejects = tagged.filter(F.col("_reason").isNotNull()).select(
        "feed", F.col("raw_id").alias("item_id"), F.lit("entry").alias("stage"),
        F.lit("info").alias("severity"), F.col("_reason").alias("reason"))
    return kept, rejects


def content_skip(pages: DataFrame, text_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """A story whose body matches a ``skip_content_pats`` pattern is dropped."""
    pat = first_match("skip_content_pats", F.col(text_col))
    tagged = pages.withColumn("_pat", pat)
    return (tagged.filter(F.col("_pat").isNull()).drop("_pat"),
            tagged.filter(F.col("_pat").isNotNull()).select(
                "feed", "item_id", F.lit("content").alias("stage"), F.lit("info").alias("severity"),
                F.concat(F.lit("no content: matched "), F.col("_pat")).alias("reason")))


# ------------------------------------------------------------------ E9 rewrite
def rewrite_link(link, pair) -> Column:
    """Apply a (from, to) regex pair; anything but two items leaves the link unchanged.

    ``pair`` holds Java-dialect text (translated when the rules are loaded).
    """
    link, pair = col_of(link), col_of(pair)
    return F.when(F.size(pair) == 2,
                  F.regexp_replace(link, F.element_at(pair, 1), F.element_at(pair, 2))) \
        .otherwise(link)


# ------------------------------------------------------------ body, titles
def entry_body() -> Column:
    """First present of content, summary_detail, summary, description, else ''; plus newline."""
    return F.concat(F.coalesce(F.col("content"), F.col("summary_detail"), F.col("summary"),
                               F.col("description"), F.lit("")), F.lit("\n"))


def padded_title(title, min_width) -> Column:
    """Titles shorter than min_width are padded with '. ' pairs, then '__'."""
    title, w = col_of(title), col_of(min_width)
    pad = F.concat(title, F.repeat(F.lit(". "), w - F.length(title)), F.lit("__"))
    return F.when(F.length(title) < w, pad).otherwise(title)


def short_title(title) -> Column:
    """Titles over 16 characters: first 16, tags removed, then '...'."""
    t = col_of(title)
    return F.when(F.length(t) > 16,
                  F.concat(F.regexp_replace(F.substring(t, 1, 16), r"<.*?>", ""), F.lit("..."))).otherwise(t)


def feed_title(title, feed) -> Column:
    """The feed's title, else '[feed name]'."""
    return F.coalesce(F.nullif(col_of(title), F.lit("")), F.concat(F.lit("["), col_of(feed), F.lit("]")))


def slugify_ascii(text) -> Column:
    """E13 on ASCII-folded text: drop chars other than word, blank, '-';
    runs of '-' and blanks become '_'; trim '-' and '_' at both ends."""
    t = F.regexp_replace(col_of(text), r"[^\w\s-]", "")
    t = F.regexp_replace(t, r"[-\s]+", "_")
    return F.regexp_replace(t, r"^[-_]+|[-_]+$", "")


# ------------------------------------------------------------------- D1 / D2
def first_per_key(df: DataFrame, keys: list[str], order_col: str = "pos") -> DataFrame:
    """Keep the row with the smallest ``order_col`` per key.

    An aggregate (``min_by``) rather than a window: the shuffle carries one
    partial winner per key and map partition, so a hot key never lands
    whole in one task.
    """
    cols = df.columns
    others = [c for c in cols if c not in keys]
    best = F.expr(f"min_by(struct({', '.join(_q(c) for c in others)}), {_q(order_col)})").alias("_b")
    return df.groupBy(*keys).agg(best).selectExpr(
        *[_q(c) if c in keys else f"_b.{_q(c)} AS {_q(c)}" for c in cols])


def _q(name: str) -> str:
    """A column name quoted for a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def dedup_ids(entries: DataFrame) -> DataFrame:
    """First entry (feed order) per item id within a feed."""
    return first_per_key(entries, ["feed", "item_id"])


def dedup_titles(entries: DataFrame, allow_col: str = "allow_dup_titles") -> DataFrame:
    """First entry per exact title within a feed, unless the site allows repeats."""
    allow = F.coalesce(F.col(allow_col), F.lit(False)) if allow_col in entries.columns else F.lit(False)
    # one aggregate for all rows: an allowed row gets a key of its own (its
    # position), so it is its own group; null titles compare equal in the
    # reference (str(None) == 'None')
    tkey = F.when(allow, F.concat(F.lit("\u0001"), F.col("pos").cast("string"))) \
        .otherwise(F.concat(F.lit("\u0002"), F.coalesce(F.col("title"), F.lit("None"))))
    return first_per_key(entries.withColumn("_tkey", tkey), ["feed", "_tkey"]).drop("_tkey")


def dedup_greedy(entries: DataFrame, allow_col: str = "allow_dup_titles", max_rounds: int | None = None) -> DataFrame:
    """D3: the reference's greedy single pass, exactly, as a distributed fixpoint.

    Greedy: in feed order an entry is kept unless an earlier KEPT entry has
    its id, or (unless the site allows duplicate titles) its title; a
    dropped entry registers neither.  Two-stage D1+D2 differs on chains
    such as A(id1,t1) B(id2,t1) C(id2,t2): greedy keeps A and C.

    Each round decides, per id key and title key, with partial aggregates:
    an undecided entry is kept when it is the earliest live (undecided or
    kept) entry of both its keys, dropped when a kept entry precedes it on
    either key.  The earliest undecided entry of every feed is decided in
    every round, and rounds stop when nothing is undecided (a caller's
    ``max_rounds`` raises, it drops nothing).  Each round's
    state is checkpointed to the session's checkpoint folder, so lineage
    stays one round deep and lost executors recompute one round at most.
    No feed or key is ever gathered into one task.
    """
    from feedloom.session import cut_lineage

    allow = F.coalesce(F.col(allow_col), F.lit(False)) if allow_col in entries.columns else F.lit(False)
    cols = entries.columns
    state = (entries.withColumn("_tkey", F.when(~allow, F.coalesce(F.col("title"), F.lit("\u0000None"))))
             .withColumn("_st", F.lit("U")))
    state = cut_lineage(state)
    for n in count(1):
        live = state.filter(F.col("_st") != "R")
        by_id = live.groupBy("feed", "item_id").agg(
            F.min("pos").alias("_id_first"), F.min(F.when(F.col("_st") == "A", F.col("pos"))).alias("_id_acc"))
        by_t = live.filter(F.col("_tkey").isNotNull()).groupBy("feed", "_tkey").agg(
            F.min("pos").alias("_t_first"), F.min(F.when(F.col("_st") == "A", F.col("pos"))).alias("_t_acc"))
        j = state.join(by_id, ["feed", "item_id"], "left").join(by_t, ["feed", "_tkey"], "left")
        pos = F.col("pos")
        st = (F.when(F.col("_st") != "U", F.col("_st"))
              .when(F.coalesce(F.col("_id_acc") < pos, F.lit(False))
                    | F.coalesce(F.col("_t_acc") < pos, F.lit(False)), F.lit("R"))
              .when((F.col("_id_first") == pos) & (F.coalesce(F.col("_t_first"), pos) == pos), F.lit("A"))
              .otherwise(F.lit("U")))
        state = cut_lineage(j.select(*cols, "_tkey", st.alias("_st")))
        if state.filter(F.col("_st") == "U").limit(1).count() == 0:
            break
        if max_rounds is not None and n >= max_rounds:
            raise RuntimeError(f"entries still undecided after {max_rounds} rounds")
    return state.filter(F.col("_st") == "A").select(*cols)


# ---------------------------------------------------------------- W1 / W2
def number_within(df: DataFrame, part: list[str], order_col, out: str = "item_no",
                  bucket_rows: int = 1 << 16, bucket=None, size_col: str | None = None) -> DataFrame:
    """0-based position of each row within its ``part`` group, by ``order_col``.

    ``order_col`` is a column name or a list of them (ties broken left to
    right).  Skew-safe: rows are cut into ordered ranges (``bucket``, by
    default ``order_col // bucket_rows`` for a numeric first order column),
    ranges are counted with a partial aggregate, a running sum over the small
    count table gives each range its offset, and rows are numbered inside
    their range only.  No task ever sorts a whole group.  The rows are
    shuffled once (by group and range); the count table is small and AQE
    broadcasts it when it is.  ``size_col`` adds the group's row count.
    """
    return count_before(df, part, order_col, F.lit(True), out, bucket_rows=bucket_rows, bucket=bucket,
                        size_col=size_col)


def _ranges(df: DataFrame, order: list[str], bucket, bucket_rows: int) -> DataFrame:
    b = bucket if bucket is not None else F.floor(F.col(order[0]) / F.lit(bucket_rows)).cast("long")
    return df.withColumn("_bk", b)


def count_before(df: DataFrame, part: list[str], order_col, flag, out: str, bucket_rows: int = 1 << 16,
                 bucket=None, size_col: str | None = None) -> DataFrame:
    """Number of rows with ``flag`` set strictly before each row of its
    ``part`` group in ``order_col`` order (with a true flag: the 0-based
    position, W1; with a timeout flag: timeouts so far, W4).

    Skew-safe: rows are cut into ordered ranges (``bucket``, by default
    ``order_col // bucket_rows``); a running count inside each range, plus
    the flagged totals of all earlier ranges (a running sum over the small
    per-range table).  The rows are shuffled once, by group and range; the
    per-range table comes from the already partitioned rows and is small, so
    AQE broadcasts it back.  No task ever sorts a whole group.
    ``size_col`` adds the group's flagged total.
    """
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    cols = df.columns
    tagged = _ranges(df, order, bucket, bucket_rows).withColumn("_f", F.coalesce(flag, F.lit(False)).cast("long"))
    grp = ", ".join(_q(c) for c in [*part, "_bk"])
    by_part = f"PARTITION BY {', '.join(_q(c) for c in part)}" if part else ""
    local = tagged.selectExpr("*", f"coalesce(sum(_f) OVER (PARTITION BY {grp} ORDER BY "
                                   f"{', '.join(_q(c) for c in order)} ROWS BETWEEN UNBOUNDED PRECEDING AND "
                                   f"1 PRECEDING), 0) AS _loc")
    totals = local.groupBy(*part, "_bk").agg(F.sum("_f").alias("_n"))
    extra = [f"CAST(sum(_n) OVER ({by_part}) AS BIGINT) AS {_q(size_col)}"] if size_col else []
    offsets = totals.selectExpr(*[_q(c) for c in part], "_bk",
                                f"coalesce(sum(_n) OVER ({by_part} ORDER BY _bk ROWS BETWEEN UNBOUNDED PRECEDING "
                                f"AND 1 PRECEDING), 0) AS _off", *extra)
    return local.join(offsets, [*part, "_bk"], "inner").selectExpr(
        *[_q(c) for c in cols], f"CAST(_loc + _off AS BIGINT) AS {_q(out)}", *([_q(size_col)] if size_col else []))


def previous_row(df: DataFrame, part: list[str], order_cols, cols: list[str], bucket=None,
                 bucket_rows: int = 1 << 16, prefix: str = "prev_") -> DataFrame:
    """``lag`` of ``cols`` without an ordered window over whole groups.

    Inside an ordered range ``lag`` is a window over (group, range); the
    first row of a range takes the last row of the group's previous
    non-empty range from a small per-range table (``max_by`` per range, then
    ``lag`` over the ranges).  One shuffle of the rows, by group and range.
    """
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    tagged = _ranges(df, order, bucket, bucket_rows)
    w = Window.partitionBy(*part, "_bk").orderBy(*order)
    local = tagged.select("*", F.row_number().over(w).alias("_rn"),
                          *[F.lag(c).over(w).alias(f"_lag_{c}") for c in cols])
    lasts = local.groupBy(*part, "_bk").agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order])).alias("_last"))
    wb = Window.partitionBy(*part).orderBy("_bk")
    prev = lasts.select(*part, "_bk", F.lag("_last").over(wb).alias("_prev"))
    joined = local.join(prev, [*part, "_bk"], "left")
    return joined.select(
        *[c for c in df.columns],
        *[F.when(F.col("_rn") == 1, F.col(f"_prev.{c}")).otherwise(F.col(f"_lag_{c}")).alias(prefix + c)
          for c in cols])


def group_sizes(df: DataFrame, part: list[str], out: str = "n_items") -> DataFrame:
    return df.groupBy(*part).agg(F.count(F.lit(1)).alias(out))


def with_next(df: DataFrame, part: list[str], item_col: str = "item_no", size_col: str | None = None) -> DataFrame:
    """Number of the next item, null on the last (then the end marker applies).

    With dense numbers the next item is ``item_no + 1`` when it exists, so no
    ordered window over the whole group is needed; the group size comes from
    ``size_col`` when ``number_within`` already produced it.
    """
    if size_col and size_col in df.columns:
        sized, n = df, F.col(size_col)
    else:
        sized, n = df.join(group_sizes(df, part, "_n"), part, "inner"), F.col("_n")
    out = sized.withColumn("next_item", F.when(F.col(item_col) + 1 < n, (F.col(item_col) + 1).cast("long")))
    return out.drop("_n")


def mark_seen(entries: DataFrame, seen: DataFrame, site_col: str = "feed") -> DataFrame:
    """Adds ``_seen``: the (site, item_id) pair is in the seen-set.

    A left join on the item key with the seen-set made distinct; placed right
    after ``dedup_ids`` it shares that step's partitioning, so only the
    seen-set side moves.
    """
    s = (seen.select(F.col("site").alias(site_col), "item_id").distinct()
         .withColumn("_seen", F.lit(True)))
    return entries.join(s, [site_col, "item_id"], "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))


def next_link(next_item) -> Column:
    """Anchor of the next story, or the end marker."""
    n = col_of(next_item)
    return F.when(n.isNull(), F.lit(END_MARKER)).otherwise(F.concat(F.lit("#"), n.cast("string")))


# ---------------------------------------------------------------- O1 / W5
def user_sort(feeds: DataFrame, order: DataFrame, name: str = "feed") -> DataFrame:
    """O1: listed feeds first in list order, then the rest by name; adds ``feed_rank``.

    ``order`` is (feed, rank).  The feed table is small (one row per site),
    the ordering is a global sort with range partitioning.
    """
    return (feeds.join(order, name, "left")
            .withColumn("_r", F.coalesce(F.col("rank"), F.lit(1 << 30)))
            .orderBy("_r", name).drop("_r"))


def feed_dirs(feeds: DataFrame, name: str = "feed", slug_col: str = "slug",
              order: DataFrame | None = None) -> DataFrame:
    """Two-digit ordinal prefix in user order (O1: listed feeds first, then by name).

    The ordinal is a global rank, computed with the range numbering of
    ``number_within`` (ranges = list rank, then the name's first two
    characters), so no single task ranks the whole feed table.
    """
    base = feeds.join(order, name, "left") if order is not None else feeds.withColumn("rank", F.lit(None))
    base = base.withColumn("_r", F.coalesce(F.col("rank"), F.lit(1 << 30)))
    ranges = F.struct(F.col("_r"), F.substring(F.col(name), 1, 2))
    ranked = number_within(base, [], ["_r", name], "_ord", bucket=ranges)
    return ranked.withColumn("dir", F.format_string("%02d_%s", F.col("_ord") + 1, F.col(slug_col))).drop("_r", "_ord")
