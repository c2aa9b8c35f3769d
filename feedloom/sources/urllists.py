"""Saved-URL feeds (S4, S5, U1): URL lists become feed items.

Two kinds of input: a request list (one URL per value; the literal value
'none' stands for an empty request) and line files (lines trimmed, blank
lines skipped).  Items keep title = description = link, XML-escaped, and
the run time as pubDate.  Writing uses Spark's XML source (S4) and an
appending archive table (S5).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.common import col_of
from feedloom.functions.dates import utc_text

# The request-list placeholder and the pubDate layout.
NO_URLS = "none"
PUBDATE_FORMAT = "EEE, dd MMM yyyy HH:mm:ss"


def xml_escape(c) -> Column:
    """'&', '<', '>' as entities (the three characters a text node needs)."""
    c = col_of(c)
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def request_urls(values: DataFrame, col: str = "value") -> DataFrame:
    """U1 part 1: a request list; the placeholder value is dropped."""
    return values.select(F.col(col).alias("link")).filter(F.col("link") != NO_URLS)


def line_urls(lines: DataFrame, col: str = "value") -> DataFrame:
    """U1 part 2: lines of URL files, trimmed, blank lines dropped."""
    return lines.select(F.trim(F.col(col)).alias("link")).filter(F.col("link") != "")


def url_items(requests: DataFrame, lines: DataFrame, run_ts, resolved: DataFrame | None = None) -> DataFrame:
    """Items from the union of both lists; E18 final URLs when ``resolved(url, final_url)`` is given."""
    u = reduce(DataFrame.unionByName, [request_urls(requests), line_urls(lines)])
    if resolved is not None:
        u = (u.join(resolved.select(F.col("url").alias("link"), "final_url"), "link", "left")
             .select(F.coalesce("final_url", "link").alias("link")))
    esc = xml_escape(F.col("link"))
    return u.select("link", esc.alias("title"), esc.alias("description"),
                    F.concat(utc_text(run_ts, PUBDATE_FORMAT), F.lit(" +0000")).alias("pub_date"))


def write_rss(items: DataFrame, path: str) -> None:
    """Write items as an RSS channel with Spark's XML source."""
    (items.select(F.col("title"), F.col("description"), F.col("link"), F.col("pub_date").alias("pubDate"))
     .write.mode("overwrite").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path))


def append_archive(items: DataFrame, path: str) -> None:
    """Append this run's URLs to the cumulative archive (a table, one row per URL)."""
    items.select("link", "pub_date").write.mode("append").parquet(path)
