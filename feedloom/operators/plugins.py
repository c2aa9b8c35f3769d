"""Per-site plug-ins.

A registry maps a site (or rule key) to a function DataFrame -> DataFrame
that takes that site's story rows (key, url, html) and returns
(key, html).  Sites without a plug-in pass through.  A plug-in result of
null rejects the story ("no content").  Row-level plug-ins written in Python are wrapped as pandas UDFs
(``row_plugin``); an exception inside one rejects only that row.

A feed helper makes the entries of a site: a Python function from the site's
row (its columns as a dict, the rule's arguments among them) to entries.  Sites
are dealt over the tasks and run inside them; a helper that fails, or that is
not known, rejects its site.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.session import cut_lineage, ship_package

Plugin = Callable[[DataFrame], DataFrame]

ERROR_MARK = "\u0000plugin error: "


def row_plugin(fn: Callable[[str, str], str | None]) -> Plugin:
    """Wrap a per-story Python function (url, html) -> html | None as a plug-in."""

    def safe(url, html):
        try:
            return fn(url, html)
        except Exception as exc:  # noqa: BLE001 - a failing story is rejected, not the job
            return ERROR_MARK + type(exc).__name__

    @F.pandas_udf(StringType())
    def run(url: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([safe(u, h) for u, h in zip(url, html)], dtype=object)

    def plugin(df: DataFrame) -> DataFrame:
        return df.withColumn("html", run(F.col("url"), F.col("html")))

    return plugin


def apply_plugins(stories: DataFrame, registry: dict[str, Plugin], site_col: str = "site",
                  key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Returns (stories with plug-in output, rejects).  One filtered branch per
    distinct plug-in (however many sites share it) plus one for the rest;
    branches are unioned, no join."""
    sites = list(registry)
    by_fn: dict = {}
    for site, fn in registry.items():
        by_fn.setdefault(id(fn), (fn, []))[1].append(site)
    # a row without a site has no plug-in; it must not fall between the branches
    rest = stories.filter(~F.coalesce(F.col(site_col).isin(*sites), F.lit(False))) if sites else stories
    parts = [rest.select(key, site_col, "html")]
    for fn, fn_sites in by_fn.values():
        mine = stories.filter(F.col(site_col).isin(*fn_sites))
        parts.append(fn(mine).select(key, site_col, "html"))
    out = cut_lineage(reduce(DataFrame.unionByName, parts))  # read twice below: plug-ins run once
    bad = out.filter(F.col("html").isNull() | F.col("html").startswith(ERROR_MARK))
    rejects = bad.select(F.col(site_col).alias("feed"), F.col(key).cast("string").alias("item_id"),
                         F.lit("plugin").alias("stage"), F.lit("error").alias("severity"),
                         F.when(F.col("html").isNull(), F.lit("no content from plug-in"))
                         .otherwise(F.expr("substr(html, 2)")).alias("reason"))
    ok = out.filter(F.col("html").isNotNull() & ~F.col("html").startswith(ERROR_MARK))
    return ok, rejects


Helper = Callable[[dict], Iterable[dict]]
HELPED = "feed string, pos bigint, id string, link string, title string, content string, problem string"


def helped_entries(sites: DataFrame, registry: dict[str, Helper], helper_col: str = "feed_helper") -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of the sites (feed, ``helper_col``, further columns) that name a feed helper.

    A helper yields entries as dicts with any of id, link, title, content; ``pos``
    is their order.  A site whose helper raises gives no entries but a reject.
    """
    ship_package(sites.sparkSession)
    fields = ("id", "link", "title", "content")

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    if row[helper_col] not in registry:
                        raise LookupError(f"no helper {row[helper_col]}")
                    found = [{k: e.get(k) for k in fields} for e in registry[row[helper_col]](row)]
                    out += [{"feed": row["feed"], "pos": i, **e, "problem": None} for i, e in enumerate(found)]
                except Exception as exc:  # noqa: BLE001 - a failing site is rejected, not the job
                    out.append({"feed": row["feed"], "pos": -1, **dict.fromkeys(fields), "problem": f"{type(exc).__name__}: {exc}"})
            yield pd.DataFrame(out, columns=["feed", "pos", *fields, "problem"])

    mine = sites.filter(F.coalesce(F.col(helper_col), F.lit("")) != "")
    made = cut_lineage(mine.mapInPandas(run, HELPED))  # read twice below: helpers run once
    rejects = made.filter("problem IS NOT NULL").select(
        "feed", F.lit(None).cast("string").alias("item_id"), F.lit("helper").alias("stage"), F.lit("error").alias("severity"),
        F.col("problem").alias("reason"))
    return made.filter("problem IS NULL").drop("problem"), rejects
