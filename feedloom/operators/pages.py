"""Pages by URL (J4, J6) and the single-page version of a story."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import html as H
from feedloom.functions.common import materialize
from feedloom.functions.urls import absolute_url
from feedloom.session import cut_lineage


def by_url(pages: DataFrame, order_col: str = "html", carry=("html",)) -> DataFrame:
    """One row per URL: the smallest by ``order_col``, then by ``carry`` (an aggregate that is combined map-side)."""
    first = F.min_by(F.struct(*carry), F.struct(F.col(order_col).alias("_o"), *carry)).alias("_page")
    return pages.groupBy("url").agg(first).select("url", "_page.*")


def with_single_page(stories: DataFrame, pages: DataFrame, html_col: str, url_col: str, pats_col: str,
                     carry=()) -> DataFrame:
    """Where a story's page names a single-page version that was fetched, that page replaces it (one hop).

    ``pages`` holds one row per URL (``by_url``).  Adds ``single_url`` (null
    without one) and the ``carry`` columns of the other page.  A version that
    was not fetched leaves the story's own page.
    """
    html, url = F.col(html_col), F.col(url_col)
    named = materialize(stories, _ref=H.single_page_link(html, url, pats_col), _base=H.base_href(html, url))
    named = materialize(named, single_url=absolute_url(F.col("_ref"), F.col("_base"))).drop("_ref", "_base")
    named = named.withColumn("single_url", F.nullif(F.col("single_url"), url))
    other = pages.select(F.col("url").alias("single_url"), F.col("html").alias("_single"), *carry)
    return (named.join(other, "single_url", "left")
            .withColumn(html_col, F.coalesce("_single", html_col)).drop("_single"))


def resolved(stories: DataFrame, redirects: DataFrame, url_col: str) -> DataFrame:
    """The link's final URL where one is known (``redirects``: url, final_url; the smallest when several)."""
    final = redirects.groupBy(F.col("url").alias(url_col)).agg(F.min("final_url").alias("_final"))
    return stories.join(final, url_col, "left").withColumn(url_col, F.coalesce("_final", url_col)).drop("_final")


def multipage_walk(stories: DataFrame, pages: DataFrame, key: list[str], html_col: str, url_col: str, pat_col: str,
                   hops: int | None = 1) -> DataFrame:
    """H16 + A4: every story's pages: (key..., page_no, url, html), its own page first.

    A page's further pages are its links that match ``pat_col``, made absolute,
    in their order.  ``hops`` is how often pages of pages are followed (1: only
    the links of the first page; None: until nothing new is found).  A URL
    belongs to a story once, at the first place that names it, so cycles end;
    URLs that were not fetched (``pages``: url, html, one row per URL) are left
    out.  A round joins the frontier's links with the pages; the frontier is
    written each round, and only URLs are kept of what was visited.
    """
    narrow = [*key, "pat", "url", "path"]
    front = stories.select(*key, F.coalesce(F.col(pat_col), F.lit("")).alias("pat"), F.col(url_col).alias("url"),
                           F.array().cast("array<int>").alias("path"), F.col(html_col).alias("html"))
    front = front.filter("html IS NOT NULL")
    found, visited = front, front.select(*key, "url")
    n = 0
    while hops is None or n < hops:
        n += 1
        links = materialize(front.filter("pat <> ''"), refs=H.multipage_links("html", "pat")).filter("size(refs) > 0")
        links = materialize(links, base=H.base_href(F.col("html"), F.col("url"))).select(
            *key, "pat", "base", "path", F.posexplode("refs").alias("i", "ref"))
        links = links.select(*key, "pat", F.array_append("path", F.col("i")).alias("path"),
                             absolute_url(F.col("ref"), F.col("base")).alias("url"))
        first = F.min_by(F.struct("pat", "path"), "path").alias("s")
        new = links.join(visited, [*key, "url"], "left_anti").groupBy(*key, "url").agg(first).select(*key, "url", "s.*")
        front = new.select(*narrow).join(pages.select("url", "html"), "url").select(*narrow, "html")
        if hops is None or n < hops:
            front = cut_lineage(front)
            if front.limit(1).count() == 0:
                break
            visited = visited.unionByName(front.select(*key, "url"))
        found = found.unionByName(front)
    # breadth first: by the number of hops, then by the links' places along the way
    by_place = Window.partitionBy(*key).orderBy(F.size("path"), "path")
    return found.select(*key, F.row_number().over(by_place).alias("page_no"), "url", "html")


def unique_image_names(refs: DataFrame) -> DataFrame:
    """(abs_src, local_name, file_name) per distinct source of (abs_src, local_name).

    Of the sources that share a local name the smallest keeps it, the others
    get a digest of their own, so that no image is written over another.
    Names are counted with partial aggregates: a name that very many sources
    share costs no more than its rows.  Null sources are left out.
    """
    from feedloom.functions.images import split_name
    distinct = refs.where("abs_src IS NOT NULL").groupBy("abs_src").agg(F.min("local_name").alias("local_name"))
    shared = (distinct.groupBy("local_name").agg(F.count(F.lit(1)).alias("n"), F.min("abs_src").alias("first"))
              .where("n > 1").drop("n"))
    return distinct.join(shared, "local_name", "left").select(
        "abs_src", "local_name", F.when(F.col("abs_src") != F.col("first"), split_name("local_name", "abs_src"))
        .otherwise(F.col("local_name")).alias("file_name"))


def with_image_names(pages: DataFrame, refs: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages with ``renames``, the map from image source to file name that ``images.rewrite_images`` takes, null
    where every image of the page keeps its local name; ``refs`` is (key, abs_src, local_name)."""
    new = unique_image_names(refs).where("file_name <> local_name").select("abs_src", "file_name")
    of_page = (refs.select(key, "abs_src").distinct().join(new, "abs_src").groupBy(key)
               .agg(F.map_from_entries(F.collect_list(F.struct("abs_src", "file_name"))).alias("renames")))
    return pages.join(of_page, key, "left")
