"""Seen-set and run-state operators.

State is plain tables: ``seen(site, item_id)`` and
``site_state(site, last_fed TIMESTAMP)``.  Every merge is a set operation
(anti/semi join, distinct, grouped max), so a re-run of the same batch is
idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.common import col_of

SEEN_KEYS = ["site", "item_id"]


def as_site_keys(entries: DataFrame, site_col: str = "feed") -> DataFrame:
    return entries.withColumn("site", F.col(site_col))


def unseen(entries: DataFrame, seen: DataFrame, site_col: str = "feed") -> DataFrame:
    """Entries whose (site, item_id) is not in the seen-set (left anti join)."""
    keyed = entries.withColumn("_site", F.col(site_col))
    s = seen.select(F.col("site").alias("_site"), "item_id")
    return keyed.join(s, ["_site", "item_id"], "left_anti").drop("_site")


def new_or_repeated(entries: DataFrame, seen: DataFrame, state: DataFrame,
                    pub_col: str = "pub_ts", site_col: str = "feed") -> DataFrame:
    """J2 + T3: unseen entries, plus seen ones re-published after the site's
    last run when the site allows repeats.  Adds ``is_repeat``.

    Semi and anti joins never multiply rows, whatever the seen-set holds.
    """
    keyed = entries.withColumn("_site", F.col(site_col))
    s = seen.select(F.col("site").alias("_site"), "item_id")
    fresh = keyed.join(s, ["_site", "item_id"], "left_anti").withColumn("is_repeat", F.lit(False))
    again = keyed.join(s, ["_site", "item_id"], "left_semi")
    st = state.select(F.col("site").alias("_site"), F.col("last_fed").alias("_lf"))
    allow = F.coalesce(F.col("allow_repeats"), F.lit(False)) if "allow_repeats" in entries.columns \
        else F.lit(False)
    again = (again.filter(allow)
             .join(st, "_site", "left")
             .filter(F.coalesce(F.col(pub_col) > F.col("_lf"), F.lit(False)))
             .drop("_lf").withColumn("is_repeat", F.lit(True)))
    return fresh.unionByName(again).drop("_site")


def prune_sites(seen: DataFrame, sites: DataFrame, site_col: str = "feed") -> DataFrame:
    """Drop seen rows of sites that are no longer configured."""
    return seen.join(sites.select(F.col(site_col).alias("site")).distinct(), "site", "left_semi")


def merge_seen(seen: DataFrame, registered: DataFrame) -> DataFrame:
    """A1: old ids plus the ids registered this run, as a set."""
    return seen.select(*SEEN_KEYS).unionByName(registered.select(*SEEN_KEYS)).distinct()


def merge_state(state: DataFrame, registered: DataFrame, run_ts) -> DataFrame:
    """A1/A2: sites that registered at least one id get last_fed = run time."""
    fed = registered.select("site").distinct().withColumn("last_fed", col_of(run_ts))
    return (state.select("site", "last_fed").unionByName(fed)
            .groupBy("site").agg(F.max("last_fed").alias("last_fed")))


def with_last_fed(entries: DataFrame, state: DataFrame, site_col: str = "feed") -> DataFrame:
    """A2: attach the site's last run time (null if never fed)."""
    st = state.select(F.col("site").alias("_site"), F.col("last_fed"))
    return entries.withColumn("_site", F.col(site_col)).join(st, "_site", "left").drop("_site")


def age_status(pub, last_fed, run_ts, save_days, nocache) -> Column:
    """T2: 'expired' (drop), 'older' (keep with a warning) or 'normal'.

    Only when both times are known and the entry predates the last run:
    older than save_days before the run -> expired (unless caching is off),
    else older.  A first run (no last_fed) keeps everything.
    """
    pub, lf, now = col_of(pub), col_of(last_fed), col_of(run_ts)
    nc = F.coalesce(col_of(nocache), F.lit(False))
    too_old = now - F.make_dt_interval(col_of(save_days))
    return (F.when(pub.isNull() | lf.isNull(), F.lit("normal"))
            .when((pub < lf) & ~nc,
                  F.when(pub <= too_old, F.lit("expired")).otherwise(F.lit("older")))
            .otherwise(F.lit("normal")))


def retention(days: DataFrame, run_day, save_days: int, keep: DataFrame | None = None,
              day_col: str = "day") -> DataFrame:
    """T4: day partitions (or cache files) older than save_days, minus a keep-list.

    Returns what to delete; deleting is the caller's (dropping partitions).
    """
    old = days.filter(F.col(day_col) < F.date_sub(col_of(run_day), save_days))
    if keep is not None:
        old = old.join(keep.select(day_col), day_col, "left_anti")
    return old


def feeds_without_news(feeds: DataFrame, kept: DataFrame, name: str = "feed") -> DataFrame:
    """A3: per feed, number of new items; feeds with zero are reported."""
    counts = kept.groupBy(name).agg(F.count(F.lit(1)).alias("n_new"))
    return (feeds.select(name).distinct().join(counts, name, "left")
            .select(name, F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new")))


def already_fed(candidates: DataFrame, written: DataFrame, nocache_col: str = "nocache") -> DataFrame:
    """Skip (day, feed) pairs that already have an index, unless nocache."""
    nc = F.coalesce(F.col(nocache_col), F.lit(False)) if nocache_col in candidates.columns else F.lit(False)
    redo = candidates.filter(nc)
    fresh = candidates.filter(~nc).join(written.select("day", "feed").distinct(), ["day", "feed"], "left_anti")
    return fresh.unionByName(redo)
