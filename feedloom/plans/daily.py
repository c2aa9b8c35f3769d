"""The whole daily run as one Spark job.

``run_day`` composes the operators over all feeds at once - there is no
per-feed loop:

    sites (J3), due feeds (T5), feeds done already (J5)
    -> entries -> ids (E1-E3) -> rules (J1) -> skips (E4-E6) -> D1 -> seen flag (J2)
    -> D2 -> registered ids (A1/A2) -> unseen or repeated (T3) -> age (T2)
    -> story pages by level (J4, E9 link rewrite, E18 redirects, C1/C2, W4, H15, plug-ins)
    -> cleaning chain (E7, H14, H9, H1, H2, tree program (H17, H3, H7), H13, H5, H4, H6, H8,
       H11, H10, I1-I7, H22, H20)
    -> numbering of the items that have something to show (W1/W2)
    -> index documents (S10, in rows), feed folders (W5), manifest (S11)

and returns the output relations.  A story that was not fetched, or of which
nothing is left, is rejected with its reason and leaves the numbering; its id
stays registered and the index holds a note in its place.  Cheap tests run on
narrow entry rows first; the wide ``html`` column is joined in only for the
entries that survive.  Relations that several outputs read are written once to
the checkpoint folder and read back (lineage cut, executor-loss safe).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import dates, schedule
from feedloom.functions import html as H
from feedloom.functions import images as I
from feedloom.functions.common import first_match, materialize, steps
from feedloom.functions.regex import PYTHON_FLAGS
from feedloom.functions.urls import gate_body, url_host
from feedloom.operators import decode
from feedloom.operators import entries as E
from feedloom.operators import pages as PG
from feedloom.operators import plugins as PL
from feedloom.operators import state as S
from feedloom.operators import tokens as TK
from feedloom.session import cut_lineage
from feedloom.sinks import documents as D
from feedloom.sources.rules import attach_rules, prepare_rules, select_rules

RULE_COLS = ("skip_link_pats", "skip_title_pats", "allow_dup_titles", "allow_repeats", "nocache", "save_days",
             "levels", "skip_content_pats", "page_start", "page_end", "skip_pats", "skip_nodes", "skip_links",
             "min_width", "index_skip_content_pats", "rss_entry_size", "story_url_rewrite", "url_substitute",
             "single_page_pats", "skip_images", "max_srcset_size", "nonlocal_images", "block_nonlocal_images",
             "alt_domains", "simplify_rss", "when", "continue_on_timeout", "multipage_pat")
ENTRY_TEXTS = ("content", "summary_detail", "summary", "description", "author", "feed_title")


def _null():
    return F.lit(None).cast("string")


def rejects_of(rows: DataFrame, stage: str, severity: str, reason) -> DataFrame:
    return rows.select("feed", "item_id", F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), reason.alias("reason"))


def due_entries(entries: DataFrame, state: DataFrame, run_ts) -> tuple[DataFrame, DataFrame]:
    """T5: the entries of feeds that are due (never fed counts as due), and one message per feed that is not."""
    e = S.with_last_fed(entries, state)
    why = schedule.schedule_error("when", "last_fed", run_ts)
    due = F.col("last_fed").isNull() | F.coalesce(schedule.falls_between("when", "last_fed", run_ts), F.lit(False))
    e = e.withColumn("_due", due).withColumn("_why", F.coalesce(why, F.concat(F.lit("not due: "), F.col("when"))))
    wrong = why.isNotNull()
    late = e.filter(~F.col("_due")).select("feed", _null().alias("item_id"), F.lit("schedule").alias("stage"),
                                           F.when(wrong, F.lit("error")).otherwise(F.lit("info")).alias("severity"),
                                           F.col("_why").alias("reason")).distinct()
    return e.filter("_due").drop("_due", "_why", "last_fed"), late


def page_texts(pages: DataFrame) -> DataFrame:
    """Fetched pages as (url, html, timed_out); ``body`` (bytes) and ``content_type`` are optional columns."""
    p = pages
    ctype = F.col("content_type") if "content_type" in p.columns else F.lit("")
    if "body" in p.columns:
        enc = F.col("encoding") if "encoding" in p.columns else F.lit("")
        p = decode.decode_bodies(p.withColumn("_cs", decode.choose_charset(enc, ctype, F.col("body"))), "body", "_cs", "html")
    if "content_type" in p.columns:
        p = p.withColumn("html", gate_body("html", "content_type", "url"))
    late = F.col("timed_out") if "timed_out" in p.columns else F.lit(False)
    return p.select("url", "html", F.coalesce(late, F.lit(False)).alias("timed_out"))


def clean_stories(rows: DataFrame, containers: str | None = None) -> DataFrame:
    """The cleaning chain on ``page_html`` (null stays null): ``html``, the body that is left (with a headline on
    a story's first page, H14), and ``shown``, whether anything of it would be seen.  All rule columns are
    taken from the rows."""
    # H9: the base for links and images comes from the page before cropping; H14: so does the byline's place
    rows = materialize(rows, base=H.base_href(F.col("page_html"), F.col("link")), host=url_host(F.col("link")))
    rows = steps(rows, "page_html", lambda h: H.byline(h, "author"), lambda h: H.crop_start(h, "page_start"),
                 lambda h: H.crop_end(h, "page_end"), lambda h: H.excise(h, "skip_pats"))
    # every step that needs the tree, in one Arrow step: H17, H3, H7
    program = ([("keep", containers)] if containers else []) + [("delete", "skip_nodes"), ("one_body", None)]
    rows = TK.edit_pages(rows, program, "page_html")
    rows = rows.withColumn("refresh", H.refresh_note("page_html"))
    rows = rows.withColumn("lead", H.lead_line("page_html", "author"))
    rows = steps(rows, "page_html", H.drop_elements, H.drop_base, H.unwrap_tags, lambda h: H.drop_images(h, "skip_images"),
                 lambda h: H.links_rule(h, "skip_links"), H.drop_color_styles,
                 lambda h: H.absolute_links("page_html", "base"),
                 lambda h: F.when(F.col("skip_images"), h).otherwise(I.rewrite_images(
                     "page_html", "host", "base", "max_srcset_size", "nonlocal_images", "block_nonlocal_images", "alt_domains")),
                 H.body_only)
    body = F.when(F.col("page_no") == 1, H.ensure_h1("page_html", "title")).otherwise(F.col("page_html"))
    return materialize(rows, html=F.concat("refresh", "lead", body),
                       shown=H.has_content("page_html")).drop("refresh", "lead", "page_html")


def excerpts(items: DataFrame) -> DataFrame:
    """The index text of each item in ``content``: H20, H12, H6, H8, H3, H19 and, where the rule sets a size, H18."""
    rows = materialize(items, base=H.base_href(F.lit(""), F.col("link")), host=url_host("link"))
    rows = steps(rows, "content", H.no_content,
                 lambda c: F.when(F.col("simplify_rss"), H.simplify(c)).otherwise(c),
                 lambda c: F.when(F.col("skip_images"), H.excerpt_drop_images(c)).when(F.col("levels") == 1.5, c)
                 .otherwise(I.rewrite_images("content", "host", "base", "max_srcset_size", "nonlocal_images", "block_nonlocal_images",
                                             "alt_domains")),
                 lambda c: H.links_rule(c, "skip_links"))
    rows = TK.edit_pages(rows, [("delete", "skip_nodes")], "content")
    rows = steps(rows, "content", lambda c: H.excise(c, "index_skip_content_pats", flags=""),
                 lambda c: H.cut_excerpt(c, F.col("rss_entry_size")))
    cut = F.coalesce(F.col("rss_entry_size") > 0, F.lit(False))
    rows = rows.withColumn("_cut", F.when(cut, F.col("content")))
    rows = TK.edit_pages(rows, [("repair", None)], "_cut")
    return rows.withColumn("content", F.coalesce(H.cut_footer("_cut"), F.col("content"))).drop("_cut", "base", "host")


def run_day(entries: DataFrame, pages: DataFrame, rules: DataFrame, seen: DataFrame, state: DataFrame,
            run_ts, day: str, day_name: str, rule_key: str = "feed", *, sites: DataFrame | None = None,
            fed: DataFrame | None = None, gate: bool = False, order: DataFrame | None = None,
            redirects: DataFrame | None = None, plugins: dict[str, PL.Plugin] | None = None,
            containers: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """entries (ENTRY_SCHEMA + rule key), pages (url, html or body, ...), rules, seen, state -> outputs.

    ``sites`` (feed) are the configured sites (J3), ``fed`` (day, feed) those with
    an index (J5), ``gate`` asks each feed's ``when`` (T5), ``order`` (feed, rank)
    orders the feeds (O1), ``redirects`` (url, final_url) resolves links (E18),
    ``plugins`` maps feeds to page plug-ins, ``containers`` maps rule keys to the
    elements that hold a story (H17).
    """
    for c in ENTRY_TEXTS:
        if c not in entries.columns:
            entries = entries.withColumn(c, _null())
    if sites is not None:
        seen = S.prune_sites(seen, sites)
    # patterns checked and in Spark's dialect; a small table, read by several outputs
    checked, rejects = prepare_rules(rules, rule_key)
    rules = cut_lineage(checked)
    e = attach_rules(E.with_item_ids(entries), select_rules(rules, rule_key, *[c for c in RULE_COLS if c in rules.columns]),
                     on=rule_key)
    if gate:
        e, late = due_entries(e, state, run_ts)
        rejects = rejects.unionByName(late)
    if fed is not None:
        e = S.already_fed(e.withColumn("day", F.lit(day)), fed.select(F.col("day").cast("string").alias("day"), "feed")).drop("day")
    kept, rej_entry = E.skip_filter(e)
    kept = kept.withColumn("pub_ts", dates.parse_feed_date(F.col("published")))
    d1 = E.mark_seen(E.dedup_ids(kept), seen)
    # d2 feeds the seen-set, the run state and the new items: materialise it once
    # (a table in the checkpoint folder) instead of recomputing the dedup per output
    d2 = cut_lineage(E.dedup_titles(d1))
    fresh = d2.filter(~F.col("_seen")).withColumn("is_repeat", F.lit(False))
    again = (S.with_last_fed(d2.filter(F.col("_seen") & F.col("allow_repeats")), state)
             .filter(F.coalesce(F.col("pub_ts") > F.col("last_fed"), F.lit(False))).drop("last_fed")
             .withColumn("is_repeat", F.lit(True)))
    cand = S.with_last_fed(fresh.unionByName(again).drop("_seen"), state)
    cand = cand.withColumn("age", S.age_status(F.col("pub_ts"), F.col("last_fed"), run_ts, F.col("save_days"),
                                               F.col("nocache")))
    rej_age = rejects_of(cand.filter(F.col("age") == "expired"), "age", "warn", F.lit("expired from the cache"))

    # Level 2 fetches the page (at the E9-rewritten link; a URL that is listed
    # several times is one page, the smallest) or its single-page version (H15),
    # 1.5 uses the entry body, 1 writes no story page
    fetched = PG.by_url(page_texts(pages), carry=("html", "timed_out"))
    two, body = F.col("levels") >= 2, (F.col("levels") > 1) & (F.col("levels") < 2)
    stories = cand.filter(F.col("age") != "expired").withColumn(
        "story_link", F.when(two, E.rewrite_link("link", "story_url_rewrite")).otherwise(F.col("link")))
    stories = stories.withColumn("fetch_url", F.when(two, E.rewrite_link("story_link", "url_substitute")))
    # items that fetch nothing get a key that is no URL, each its own, so they do not meet in one task
    none = F.concat(F.lit("#"), "feed", F.lit("#"), F.col("pos").cast("string"))
    stories = stories.withColumn("fetch_url", F.coalesce("fetch_url", none))
    if redirects is not None:
        stories = PG.resolved(stories, redirects, "fetch_url")
    stories = stories.join(fetched.select(F.col("url").alias("fetch_url"), F.col("html").alias("page_html"), "timed_out"),
                           "fetch_url", "left").withColumn("timed_out", F.coalesce("timed_out", F.lit(False)))
    stopped = None
    if "timed_out" in pages.columns:
        # A feed stops at its first timeout unless the rule says to go on
        stories = cut_lineage(E.count_before(stories, ["feed"], "pos", F.col("timed_out"), "n_before"))
        stop = (F.col("n_before") > 0) & ~F.coalesce(F.col("continue_on_timeout"), F.lit(False))
        stopped = stories.filter(stop).select("feed", "item_id")
        stories = stories.filter(~stop).drop("n_before")
    stories = PG.with_single_page(stories, fetched.select("url", "html"), "page_html", "fetch_url", "single_page_pats")
    stories = stories.withColumn("page_no", F.lit(1))
    if "multipage_pat" in rules.columns and rules.filter("multipage_pat <> ''").limit(1).count():
        # The further pages of stories without a single-page version
        stories = cut_lineage(stories)
        first = stories.filter(F.col("single_url").isNull())
        walked = PG.multipage_walk(first, fetched, ["feed", "item_id"], "page_html", "fetch_url", "multipage_pat")
        more = (walked.filter("page_no > 1").select("feed", "item_id", "page_no", F.col("html").alias("page_html"))
                .join(first.drop("page_no", "page_html"), ["feed", "item_id"]).withColumn("author", _null()))
        stories = stories.unionByName(more)
    stories = stories.withColumn("page_html", F.when(body, E.entry_body()).otherwise(F.col("page_html")))
    stories = stories.drop("fetch_url", "single_url")
    if plugins:
        stories, rej_plugin = _plugged(stories, plugins)
        rejects = rejects.unionByName(rej_plugin)
    stories = materialize(stories, skipped=F.when(F.col("levels") > 1, first_match("skip_content_pats", F.col("page_html"))))
    stories = stories.withColumn("page_html", F.when(F.col("skipped").isNull() & ~F.col("timed_out"), F.col("page_html")))
    stories = stories.withColumn("found", F.col("page_html").isNotNull())
    cleaned = clean_stories(_with_containers(stories, containers, rule_key), "containers" if containers else None)
    why = (F.when(F.col("levels") <= 1, _null())
           .when(F.col("skipped").isNotNull(), F.concat(F.lit("no content: matched "), F.replace("skipped", F.lit(PYTHON_FLAGS), F.lit(""))))
           .when(F.col("timed_out"), F.concat(F.lit("Socket timeout for "), F.col("link")))
           .when(~F.col("found"), F.concat(F.lit("No content for "), F.col("link")))
           .when(~F.col("shown"), F.lit("No real content")))
    # told holds every candidate with its story, or with the reason why it has none
    told = cut_lineage(cleaned.withColumn("why", why).withColumn("html", F.when(F.col("why").isNull(), F.col("html")))
                       .drop("base", "host", "shown", "containers"))
    if "multipage_pat" in rules.columns:
        told = _assembled(told)

    # two-phase numbering: the places of all candidates, then the numbers of those that are shown
    place = E.number_within(told.select("feed", "pos", F.col("why").isNull().alias("ok")), ["feed"], "pos", "place")
    place = E.count_before(place, ["feed"], "pos", F.col("ok"), "item_no", size_col="n_items")
    items = E.with_next(told.join(place.drop("ok"), ["feed", "pos"]), ["feed"], size_col="n_items")
    items = cut_lineage(items)
    shown = items.filter("why IS NULL")
    failed = items.filter("why IS NOT NULL")
    lost = failed.filter(~F.col("found") & F.col("skipped").isNull())
    rejects = (rejects.unionByName(rej_entry).unionByName(rej_age)
               .unionByName(rejects_of(lost, "fetch", "error", F.col("why")))
               .unionByName(rejects_of(failed.filter(F.col("skipped").isNotNull()), "content", "info", F.col("why")))
               .unionByName(rejects_of(failed.filter("found"), "content", "warn", F.col("why"))))

    # ids are registered before any fetch (so failed stories are not retried),
    # but a site's cache is only rewritten when it showed at least one item
    registered = d2.filter(~F.col("nocache"))
    if stopped is not None:
        registered = registered.join(stopped, ["feed", "item_id"], "left_anti")
        rejects = rejects.unionByName(rejects_of(stopped, "fetch", "info", F.lit("not tried after a timeout")))
    registered = (registered.select(F.col("feed").alias("site"), "item_id")
                  .join(shown.select(F.col("feed").alias("site")).distinct(), "site", "left_semi"))

    story_pages = shown.filter(F.col("levels") > 1).select(
        F.lit(day).alias("day"), "feed", F.col("item_no").alias("page_no"),
        H.wrap_page(F.col("html"), F.col("title"), F.col("link")).alias("html"))
    index = D.index_rows(index_blocks(items, day, day_name))
    feeds = shown.select("feed").distinct().withColumn("slug", E.slugify_ascii(F.col("feed")))
    feeds = E.feed_dirs(feeds, order=order)
    files = D.output_files(story_pages, index, feeds)
    return {"items": shown, "stories": story_pages, "index": index, "seen": S.merge_seen(seen, registered),
            "state": S.merge_state(state, registered, run_ts), "rejects": rejects, "feeds": feeds,
            "manifest": D.manifest(files)}


def index_blocks(items: DataFrame, day: str, day_name: str) -> DataFrame:
    """One block per place of a feed's index: the item's, or the note of a story that came to nothing."""
    # a 1.5-level story's cleaned body is what the index shows of it
    idx = items.withColumn("content", F.when((F.col("levels") > 1) & (F.col("levels") < 2), F.col("html"))
                           .otherwise(F.coalesce("content", F.lit(""))))
    idx = excerpts(idx).withColumn("author", H.excise(F.col("author"), "index_skip_content_pats", flags=""))
    idx = idx.withColumn("padded", E.padded_title(F.col("title"), F.col("min_width")))
    block = D.item_block("item_no", "padded", "link", "anchor", "levels", "skip_links", "content", "author", "next_item")
    note = D.no_content_note("story_link", "title")
    return idx.select("feed", F.lit(day).alias("day"), F.col("place").alias("item_no"),
                      F.when(F.col("why").isNull(), block).otherwise(note).alias("block"),
                      F.lit(day_name).alias("day_name"), E.feed_title(F.col("feed_title"), F.col("feed")).alias("title"),
                      F.col("why").isNull().alias("numbered"))


def _with_containers(rows: DataFrame, containers: dict[str, list[str]] | None, rule_key: str) -> DataFrame:
    if not containers:
        return rows
    known = F.create_map(*[x for k, v in containers.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return rows.withColumn("containers", F.try_element_at(known, F.col(rule_key)))


def _assembled(told: DataFrame) -> DataFrame:
    """A4: a story's cleaned further pages follow its first page, in order; a story without content shows none."""
    page = F.struct("page_no", "html")
    more = told.filter("page_no > 1 AND html IS NOT NULL").groupBy("feed", "item_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(page)), lambda s: s["html"]), "\n").alias("more"))
    return (told.filter("page_no = 1").join(more, ["feed", "item_id"], "left")
            .withColumn("html", F.when(F.col("more").isNull(), F.col("html")).otherwise(F.concat_ws("\n", "html", "more")))
            .withColumn("html", F.when(F.col("why").isNull(), F.col("html"))).drop("more"))


def _plugged(stories: DataFrame, plugins: dict[str, PL.Plugin]) -> tuple[DataFrame, DataFrame]:
    """Page plug-ins of the feeds that have one; a story without a result is rejected there and left without a page."""
    mine = cut_lineage(stories)
    own = mine.filter(F.col("feed").isin(*plugins))
    done, rejects = PL.apply_plugins(own.select("item_id", F.col("feed").alias("site"), F.col("story_link").alias("url"),
                                                F.col("page_html").alias("html")), plugins, key="item_id")
    done = done.select("item_id", F.col("site").alias("feed"), F.col("html").alias("plugged"))
    joined = own.join(done, ["feed", "item_id"], "left").withColumn("page_html", F.col("plugged")).drop("plugged")
    return mine.filter(~F.coalesce(F.col("feed").isin(*plugins), F.lit(False))).unionByName(joined), rejects
