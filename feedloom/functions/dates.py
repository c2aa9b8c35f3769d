"""Date text parsing (E10, E11, E15) as native expressions.

Results are TIMESTAMP instants; ``epoch_seconds`` renders them without any
dependence on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.common import col_of

# RFC 2822 obsolete zone names and their offsets.
NAMED_ZONES = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}

# Accepted layouts after the optional weekday is removed.
RFC2822_FORMATS = (
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm Z",
    "d MMM yy HH:mm:ss Z",
    "d MMM yy HH:mm Z",
)


def normalize_rfc2822(text) -> Column:
    """Drop a leading weekday, squeeze blanks, map zone names to offsets."""
    t = F.trim(F.regexp_replace(col_of(text), r"\s+", " "))
    t = F.regexp_replace(t, r"^[A-Za-z]{3,9}, ?", "")
    zone = F.regexp_extract(t, r" ([A-Za-z]{1,3})$", 1)
    mapping = F.create_map(*[x for k, v in NAMED_ZONES.items() for x in (F.lit(k), F.lit(v))])
    mapped = F.try_element_at(mapping, F.upper(zone))
    return F.when((zone != "") & mapped.isNotNull(),
                  F.concat(F.regexp_replace(t, r"[A-Za-z]{1,3}$", ""), mapped)).otherwise(t)


def parse_rfc2822(text) -> Column:
    """Publish time of an entry; unparseable or missing text gives null."""
    t = normalize_rfc2822(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(fmt)) for fmt in RFC2822_FORMATS])


# ISO 8601 layouts of Atom and Dublin Core times.
ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mmXXX")


def parse_feed_date(text) -> Column:
    """Publish time as RFC 2822 (RSS) or ISO 8601 (Atom, dc:date); else null."""
    t = F.trim(col_of(text))
    return F.coalesce(parse_rfc2822(t), *[F.try_to_timestamp(t, F.lit(fmt)) for fmt in ISO_FORMATS])


def epoch_seconds(ts) -> Column:
    return F.unix_seconds(col_of(ts))


def utc_text(ts, fmt: str) -> Column:
    """Render an instant as UTC wall time, whatever the session time zone."""
    ntz = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(col_of(ts)).cast("decimal(18,6)"))
    return F.date_format(ntz, fmt)


def published_or_now(published, updated, run_ts) -> Column:
    """Published, else updated, else the run time (a parameter)."""
    return F.coalesce(parse_feed_date(published), parse_feed_date(updated), col_of(run_ts))


def last_modified(headers, run_ts) -> Column:
    """Last-Modified (or its lowercase twin) parsed, else run time - 5 days."""
    h = col_of(headers)
    text = F.coalesce(F.try_element_at(h, F.lit("Last-Modified")),
                      F.try_element_at(h, F.lit("last-modified")))
    return F.coalesce(parse_rfc2822(text), col_of(run_ts) - F.expr("INTERVAL 5 DAYS"))
