"""Registered queries over seen-set and run state."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import dates
from feedloom.functions.schedule import falls_between, schedule_error
from feedloom.operators import entries as E
from feedloom.operators import state as S
from feedloom.plans import fixtures as X
from feedloom.plans.q_entries import SQL_KEPT, _pages, _rfc2822_sql, _rules, deduped_entries
from feedloom.sinks import seen_cache
from feedloom.sources.rules import attach_rules
from feedloom.sources.tables import read_table

RUN_EPOCH = X.RUN_TS_EPOCH


def hour_range():
    """Ordered ranges for numbering a user's events: hours of the (zone-free) timestamp."""
    return F.date_format("ts", "yyyyMMddHH").cast("long")


# ------------------------------------------------------------ age_policy
def age_policy(spark, sf_dir):
    """T2 with A2: expired / older / normal per entry from publish time, the site's last run and save_days."""
    pages = _pages(spark, sf_dir)
    e = attach_rules(X.entries_view(pages), _rules(spark, "save_days", "nocache"), on="rule_key")
    e = S.with_last_fed(e, X.state_view(pages))
    pub = dates.parse_rfc2822(F.col("published"))
    status = S.age_status(pub, F.col("last_fed"), X.run_ts(), F.col("save_days"), F.col("nocache"))
    return e.select("feed", "pos", status.alias("status"))


SQL_AGE = f"""
WITH e AS ({X.ENTRIES_SQL}),
r AS ({X.rules_sql(["save_days", "nocache"])}),
st AS ({X.STATE_SQL}),
j AS (SELECT e.feed, e.pos, r.save_days, r.nocache, epoch({_rfc2822_sql('e.published')}) AS pub,
             epoch(st.last_fed) AS lf
      FROM e LEFT JOIN r USING (rule_key) LEFT JOIN st ON st.site = e.feed)
SELECT feed, pos,
  CASE WHEN pub IS NULL OR lf IS NULL THEN 'normal'
       WHEN pub < lf AND NOT coalesce(nocache, false)
         THEN CASE WHEN pub <= {RUN_EPOCH} - save_days * 86400 THEN 'expired' ELSE 'older' END
       ELSE 'normal' END AS status
FROM j
"""


# --------------------------------------------------------------- repeats
def repeats(spark, sf_dir):
    """J2 + T3: unseen entries, plus seen ones republished after the last run where repeats are allowed."""
    pages = _pages(spark, sf_dir)
    d = deduped_entries(spark, sf_dir, extra_rules=("allow_repeats",))
    d = d.withColumn("pub_ts", dates.parse_rfc2822(F.col("published")))
    out = S.new_or_repeated(d, X.seen_view(pages), X.state_view(pages))
    return out.select("feed", "pos", "item_id", "is_repeat")


SQL_REPEATS = f"""
WITH {SQL_KEPT},
seen AS ({X.SEEN_SQL}),
st AS ({X.STATE_SQL}),
ar AS ({X.rules_sql(["allow_repeats"])}),
x AS (SELECT d2.*, ar.allow_repeats, epoch({_rfc2822_sql('d2.published')}) AS pub, epoch(st.last_fed) AS lf,
             EXISTS (SELECT 1 FROM seen s WHERE s.site = d2.feed AND s.item_id = d2.item_id) AS was_seen
      FROM d2 LEFT JOIN ar USING (rule_key) LEFT JOIN st ON st.site = d2.feed)
SELECT feed, pos, item_id, was_seen AS is_repeat FROM x
WHERE NOT was_seen OR (coalesce(allow_repeats, false) AND coalesce(pub > lf, false))
"""


# ------------------------------------------------------------ seen_merge
# Hosts whose sites are no longer configured (J3 fixture).
DROPPED_SITE_PAT = "spam-farm|cheap-pills"


def _registered(spark, sf_dir):
    """Ids this run registers: every deduped entry of a site that keeps a cache."""
    d = deduped_entries(spark, sf_dir, extra_rules=("nocache",))
    return d.filter(~F.col("nocache")).select(F.col("feed").alias("site"), "item_id")


def seen_merge(spark, sf_dir):
    """A1 merge of registered ids into the seen-set, A2 last_fed update, J3 pruning of dropped sites."""
    pages = _pages(spark, sf_dir)
    reg = _registered(spark, sf_dir)
    seen = S.merge_seen(X.seen_view(pages), reg)
    sites = X.entries_view(pages).select("feed").filter(~F.col("feed").rlike(DROPPED_SITE_PAT)).distinct()
    seen = S.prune_sites(seen, sites)
    state = S.merge_state(X.state_view(pages), reg, X.run_ts())
    per_site = seen.groupBy("site").agg(F.count(F.lit(1)).alias("n_ids"))
    return (per_site.join(state, "site", "left")
            .select("site", "n_ids", F.coalesce(F.unix_seconds("last_fed"), F.lit(-1)).cast("long")
                    .alias("last_fed_epoch")))


SQL_REGISTERED = f"""
nr AS ({X.rules_sql(["nocache"])}),
reg AS (SELECT d2.feed AS site, d2.item_id FROM d2 LEFT JOIN nr USING (rule_key) WHERE NOT nr.nocache)
"""

SQL_SEEN_MERGE = f"""
WITH {SQL_KEPT}, {SQL_REGISTERED},
seen AS ({X.SEEN_SQL}),
st AS ({X.STATE_SQL}),
merged AS (SELECT site, item_id FROM seen UNION SELECT site, item_id FROM reg),
sites AS (SELECT DISTINCT {X.HOST_SQL} AS site FROM pages
          WHERE NOT regexp_matches({X.HOST_SQL}, '{DROPPED_SITE_PAT}')),
pruned AS (SELECT * FROM merged WHERE site IN (SELECT site FROM sites)),
state AS (SELECT site, max(lf) AS lf FROM (
            SELECT site, epoch(last_fed) AS lf FROM st
            UNION ALL SELECT DISTINCT site, {RUN_EPOCH} FROM reg) u GROUP BY site)
SELECT p.site, count(*) AS n_ids, CAST(coalesce(max(s.lf), -1) AS BIGINT) AS last_fed_epoch
FROM pruned p LEFT JOIN state s USING (site) GROUP BY p.site
"""


# --------------------------------------------------------------- no_news
def no_news(spark, sf_dir):
    """A3: new-item count per feed; feeds with none stay in the result with 0."""
    pages = _pages(spark, sf_dir)
    new = S.unseen(deduped_entries(spark, sf_dir), X.seen_view(pages))
    return S.feeds_without_news(X.entries_view(pages).select("feed"), new)


SQL_NO_NEWS = f"""
WITH {SQL_KEPT},
seen AS ({X.SEEN_SQL}),
n AS (SELECT d2.feed FROM d2 WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.site = d2.feed AND s.item_id = d2.item_id)),
f AS (SELECT DISTINCT feed FROM e)
SELECT f.feed, CAST(count(n.feed) AS BIGINT) AS n_new FROM f LEFT JOIN n USING (feed) GROUP BY f.feed
"""


# --------------------------------------------------------- schedule_gate
# Schedule rules assigned to users by user_id mod 12 (T5 fixture).
WHEN_RULES = ["", "mo", "Tuesday", "we", "15", "1", "31", "x", "fr", "sa", "su", "28"]


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")


def schedule_gate(spark, sf_dir):
    """T5: for each run (previous event -> this event of a user) did the user's
    weekday / day-of-month rule fall in between?  Previous run found without an
    ordered window over whole users."""
    ev = _events(spark, sf_dir)
    ev = E.previous_row(ev, ["user_id"], ["ts", "event_id"], ["ts"], bucket=hour_range())
    rule = F.element_at(F.array(*[F.lit(w) for w in WHEN_RULES]), (F.pmod(F.col("user_id"), F.lit(12)) + 1).cast("int"))
    ev = ev.filter(F.col("prev_ts").isNotNull()).withColumn("rule", rule)
    err = schedule_error(F.col("rule"), F.col("prev_ts"), F.col("ts"))
    gate = F.when(err.isNotNull(), F.concat(F.lit("error: "), err)) \
        .when(falls_between(F.col("rule"), F.col("prev_ts"), F.col("ts")), F.lit("yes")).otherwise(F.lit("no"))
    return ev.select("event_id", "user_id", "rule", gate.alias("gate"))


def _schedule_sql():
    rules = ", ".join(f"'{w}'" for w in WHEN_RULES)
    return f"""
WITH ev AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t1 FROM events),
r AS (SELECT event_id, user_id, t1, ts AS t2, [{rules}][user_id % 12 + 1] AS w,
             (epoch_us(ts) - epoch_us(lag_ts)) / 86400000000.0 AS dd
      FROM (SELECT *, t1 AS lag_ts FROM ev) x WHERE t1 IS NOT NULL),
p AS (SELECT *, regexp_matches(w, '^\\s*[+-]?[0-9]+\\s*$') AS is_dom,
             CASE WHEN regexp_matches(w, '^\\s*[+-]?[0-9]+\\s*$') THEN CAST(trim(w) AS INTEGER) END AS dom,
             list_position(['mo', 'tu', 'we', 'th', 'fr', 'sa', 'su'], lower(substr(w, 1, 2))) - 1 AS dow
      FROM r),
e AS (SELECT *, CASE WHEN w = '' THEN NULL WHEN dd < 0 THEN 'negative span' WHEN is_dom THEN NULL
                     WHEN length(w) < 2 THEN 'rule too short' WHEN dow IS NULL OR dow < 0 THEN 'not a day' END AS err
      FROM p)
SELECT event_id, user_id, w AS rule,
  CASE WHEN err IS NOT NULL THEN 'error: ' || err
       WHEN w = '' THEN 'yes'
       WHEN CASE WHEN is_dom THEN
              CASE WHEN dd > 31 THEN true
                   WHEN month(t1) = month(t2) THEN day(t1) <= dom AND day(t2) >= dom
                   ELSE day(t1) < dom OR dom <= day(t2) END
            ELSE CASE WHEN dd > 7 THEN true ELSE (((isodow(t2) - 1 - dow) % 7) + 7) % 7 < dd END END
       THEN 'yes' ELSE 'no' END AS gate
FROM e
"""


# -------------------------------------------------------- timeout_cutoff
# A helper gives up after this many timeouts.
MAX_TIMEOUTS = 3


def timeout_cutoff(spark, sf_dir):
    """Fetches per feed (user) in order; a feed stops at its first timeout
    (error) unless continue_on_timeout; the helper variant serves pages until
    its third timeout and placeholders after.  The count of earlier timeouts
    is a skew-safe running count (ordered ranges, one shuffle)."""
    ev = _events(spark, sf_dir)
    ev = ev.withColumn("rule_key", F.element_at(F.array(*[F.lit(r["rule_key"]) for r in X.RULES]),
                                                (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int")))
    ev = attach_rules(ev, _rules(spark, "continue_on_timeout"), on="rule_key")
    ev = E.count_before(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "before",
                        bucket=hour_range())
    fed = F.col("continue_on_timeout") | (F.col("before") < 1)
    helper = F.when(F.col("before") < MAX_TIMEOUTS, F.lit("page")).otherwise(F.lit("placeholder"))
    return ev.select("event_id", "user_id", fed.alias("fetched"), helper.alias("helper"))


SQL_TIMEOUT = f"""
WITH ev AS (SELECT event_id, user_id, ts, event_type,
                   ['com', 'net', 'org'][user_id % 3 + 1] AS rule_key FROM events),
r AS ({X.rules_sql(["continue_on_timeout"])}),
n AS (SELECT ev.*, r.continue_on_timeout,
             coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
               PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM ev LEFT JOIN r USING (rule_key))
SELECT event_id, user_id, continue_on_timeout OR before < 1 AS fetched,
       CASE WHEN before < {MAX_TIMEOUTS} THEN 'page' ELSE 'placeholder' END AS helper
FROM n
"""


# -------------------------------------------------------------- retention
# Days kept whatever their age (T4 keep-list).
KEEP_DAYS = ["2024-01-02"]
RETENTION_DAYS = 7


def retention(spark, sf_dir):
    """T4: day partitions older than save_days before the run day, minus the keep-list."""
    days = _events(spark, sf_dir).select(F.to_date("ts").alias("day")).distinct()
    keep = spark.createDataFrame([(d,) for d in KEEP_DAYS], "day string").select(F.to_date("day").alias("day"))
    run_day = F.to_date(F.lit("2024-01-12"))
    old = S.retention(days, run_day, RETENTION_DAYS, keep)
    return old.select(F.date_format("day", "yyyy-MM-dd").alias("day"))


SQL_RETENTION = f"""
SELECT DISTINCT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events
WHERE CAST(ts AS DATE) < DATE '2024-01-12' - INTERVAL {RETENTION_DAYS} DAY
  AND strftime(CAST(ts AS DATE), '%Y-%m-%d') NOT IN ({", ".join(f"'{d}'" for d in KEEP_DAYS)})
"""


# ------------------------------------------------------------ already_fed
def already_fed(spark, sf_dir):
    """(day, feed) pairs still to produce: those without an index, plus all of nocache sites."""
    ev = _events(spark, sf_dir)
    cand = ev.select(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"),
                     F.col("user_id").cast("string").alias("feed"),
                     F.element_at(F.array(*[F.lit(r["rule_key"]) for r in X.RULES]),
                                  (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int")).alias("rule_key")).distinct()
    cand = attach_rules(cand, _rules(spark, "nocache"), on="rule_key")
    written = cand.filter(F.pmod(F.col("feed").cast("long"), F.lit(4)) == 0).select("day", "feed")
    return S.already_fed(cand, written).select("day", "feed")


SQL_ALREADY_FED = f"""
WITH c AS (SELECT DISTINCT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS feed,
                  ['com', 'net', 'org'][user_id % 3 + 1] AS rule_key FROM events),
r AS ({X.rules_sql(["nocache"])}),
j AS (SELECT c.*, r.nocache FROM c LEFT JOIN r USING (rule_key))
SELECT day, feed FROM j WHERE nocache OR CAST(feed AS BIGINT) % 4 <> 0
"""


# ------------------------------------------------------- seen cache text
def _cache_tables(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return X.seen_view(pages), X.state_view(pages)


def seen_cache_write(spark, sf_dir):
    """One text line per site, 'site|last_fed|id id ...' (v1.1), ids '+'-encoded."""
    seen, state = _cache_tables(spark, sf_dir)
    return seen_cache.cache_lines(seen, state).select("site", "line")


SQL_CACHE_WRITE = f"""
WITH seen AS ({X.SEEN_SQL}), st AS ({X.STATE_SQL})
SELECT s.site, replace(s.site, ' ', '+') || '|' || CAST(coalesce(CAST(epoch(st.last_fed) AS BIGINT), 0) AS VARCHAR)
       || '|' || array_to_string(list_sort(list(replace(s.item_id, ' ', '+'))), ' ') AS line
FROM seen s LEFT JOIN st USING (site) GROUP BY s.site, st.last_fed
"""


def seen_cache_read(spark, sf_dir):
    """Parse cache text (v1 'site|ids' for never-fed sites, v1.1 otherwise) back into rows;
    lines of other shapes are rejected."""
    seen, state = _cache_tables(spark, sf_dir)
    lines = seen_cache.cache_lines(seen, state)
    # sites never fed are written in the older two-field form
    lines = lines.withColumn("line", F.when(F.col("last_fed").isNull(),
                                            F.regexp_replace("line", r"^([^|]*)\|[^|]*\|", "$1|"))
                             .otherwise(F.col("line"))).select(F.col("line").alias("value"))
    rows, _ = seen_cache.parse_cache_lines(lines)
    return rows.select("site", "item_id", "last_fed_epoch", "version")


SQL_CACHE_READ = f"""
WITH seen AS ({X.SEEN_SQL}), st AS ({X.STATE_SQL}),
l AS (SELECT s.site, st.last_fed IS NULL AS v1,
             CAST(coalesce(CAST(epoch(st.last_fed) AS BIGINT), 0) AS VARCHAR) AS lf,
             array_to_string(list_sort(list(replace(s.item_id, ' ', '+'))), ' ') AS ids
      FROM seen s LEFT JOIN st USING (site) GROUP BY s.site, st.last_fed)
SELECT site, unnest(string_split_regex(trim(ids), '\\s+')) AS item_id,
       CAST(CASE WHEN v1 THEN 0 ELSE CAST(lf AS BIGINT) END AS BIGINT) AS last_fed_epoch,
       CASE WHEN v1 THEN '1' ELSE '1.1' END AS version
FROM l
"""


QUERIES = {
    "age_policy": age_policy,
    "repeats": repeats,
    "seen_merge": seen_merge,
    "no_news": no_news,
    "schedule_gate": schedule_gate,
    "timeout_cutoff": timeout_cutoff,
    "retention": retention,
    "already_fed": already_fed,
    "seen_cache_write": seen_cache_write,
    "seen_cache_read": seen_cache_read,
}

SQL = {
    "age_policy": SQL_AGE,
    "repeats": SQL_REPEATS,
    "seen_merge": SQL_SEEN_MERGE,
    "no_news": SQL_NO_NEWS,
    "schedule_gate": _schedule_sql(),
    "timeout_cutoff": SQL_TIMEOUT,
    "retention": SQL_RETENTION,
    "already_fed": SQL_ALREADY_FED,
    "seen_cache_write": SQL_CACHE_WRITE,
    "seen_cache_read": SQL_CACHE_READ,
}
