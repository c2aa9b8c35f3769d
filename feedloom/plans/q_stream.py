"""Registered streaming queries (T1 both forms, T3) over arriving entry files.

Each call lays the entries derived from ``events`` down as files in a fresh
folder under the session's checkpoint directory, runs the streaming query
with ``availableNow`` to completion, and returns the sink folder as a
DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.plans.q_docs import SQL_COMPLETE_DAYS
from feedloom.plans.q_misc import SQL_ATOM
from feedloom.session import scratch_path, stamp_in_order
from feedloom.sources.tables import read_table
from feedloom.streaming import incremental as INC

# Watermark delay of the expiring form (ids live this long).
ID_TTL = "3650 days"
N_FILES = 4


def _entry_files(spark, sf_dir, tag, files_per_trigger=1):
    """Entries re-published over time: site and item id from user and props.k."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "props")
    e = ev.select(F.format_string("s%02d", F.pmod("user_id", F.lit(16))).alias("site"),
                  F.concat(F.col("user_id").cast("string"), F.lit(":"),
                           F.get_json_object("props", "$.k")).alias("item_id"),
                  F.col("ts").cast("timestamp").alias("ts"),
                  (F.pmod("user_id", F.lit(2)) == 0).alias("allow_repeats"))
    base = scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")
    src = f"{base}/source"
    e.repartitionByRange(N_FILES, "ts").write.parquet(src)
    stamp_in_order(spark, src)
    reader = spark.readStream.schema(e.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(src)
    return stream, base


def stream_new_entries(spark, sf_dir):
    """T1 (expiring ids): streaming dropDuplicatesWithinWatermark over (site, item_id)."""
    stream, base = _entry_files(spark, sf_dir, "t1")
    out = INC.dedup_within_watermark(stream, ["site", "item_id"], "ts", ID_TTL)
    q = (out.writeStream.format("parquet").option("path", f"{base}/sink")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/sink").select("site", "item_id")


def stream_seen_ids(spark, sf_dir):
    """T1 (ids never expire): each batch against the buckets of the seen-set that it touches."""
    stream, base = _entry_files(spark, sf_dir, "t1s")
    seen = INC.SeenTable(f"{base}/seen", ["site", "item_id"], buckets=16)
    q = (stream.writeStream.foreachBatch(INC.seen_table_batch_writer(seen, f"{base}/new"))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/new").select("site", "item_id")


SQL_DISTINCT_IDS = """
SELECT DISTINCT printf('s%02d', user_id % 16) AS site,
       CAST(user_id AS VARCHAR) || ':' || json_extract_string(props, '$.k') AS item_id
FROM events
"""


def _rocksdb(spark):
    """Stateful processors need the RocksDB state store (a session setting)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_repeats(spark, sf_dir):
    """Per-id state over several micro-batches; repeats re-emitted when the site allows and the time moved on."""
    _rocksdb(spark)
    # the files are ranges of time and arrive in that order
    stream, base = _entry_files(spark, sf_dir, "t3")
    out = INC.republications(stream)
    q = (out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/sink")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/sink").select("site", "item_id", "is_repeat")


def stream_complete_days(spark, sf_dir):
    """T6 streamed: story rows joined with the sentinels of their days as both arrive; days with an odd number
    of errors never get a sentinel, and their rows come out as incomplete."""
    ev = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    ev = ev.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    files = ev.select("day", "ts", F.format_string("u%04d/%d.html", "user_id", "event_id").alias("path"))
    errors = ev.groupBy("day").agg(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("e"))
    done = errors.filter("e % 2 = 0").selectExpr("day", "CAST(date_add(CAST(day AS date), 1) AS timestamp) AS ts")
    base = scratch_path(spark, f"t6-{uuid.uuid4().hex}")
    for rows, name in ((files, "files"), (done, "done")):
        rows.repartitionByRange(N_FILES, "ts").write.parquet(f"{base}/{name}")
        stamp_in_order(spark, f"{base}/{name}")
    reader = spark.readStream.option("maxFilesPerTrigger", 1)
    rows = INC.complete_rows(reader.schema(files.schema).parquet(f"{base}/files"),
                             reader.schema(done.schema).parquet(f"{base}/done"), "2 days")
    q = (rows.writeStream.format("parquet").option("path", f"{base}/sink")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return (spark.read.parquet(f"{base}/sink").filter("complete").groupBy("day")
            .agg(F.count(F.lit(1)).cast("long").alias("n_files")))


def stream_feed_entries(spark, sf_dir):
    """S1 streamed: feed files read as they arrive, a few per micro-batch; the entries equal those of the batch reader."""
    from feedloom.plans import q_misc as M
    from feedloom.sources import feeds as FD
    base = M.write_atom_files(spark, sf_dir)
    stream = FD.stream_entries(spark, f"{base}/feeds", files_per_trigger=40)
    q = (stream.writeStream.format("parquet").option("path", f"{base}/sink")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return M.atom_rows(FD.over_files(spark.read.parquet(f"{base}/sink"), M.FEED_OF_FILE()))


QUERIES = {
    "stream_new_entries": stream_new_entries,
    "stream_seen_ids": stream_seen_ids,
    "stream_repeats": stream_repeats,
    "stream_complete_days": stream_complete_days,
    "stream_feed_entries": stream_feed_entries,
}

# In order of time: each id's first publication is new; with repeats allowed,
# every later distinct publication time is a repeat.
SQL_REPEATS_STREAM = """
WITH e AS (SELECT printf('s%02d', user_id % 16) AS site,
                  CAST(user_id AS VARCHAR) || ':' || json_extract_string(props, '$.k') AS item_id,
                  ts, user_id % 2 = 0 AS allow FROM events),
k AS (SELECT site, item_id, min(ts) AS first_ts, bool_or(allow) AS allow FROM e GROUP BY site, item_id)
SELECT site, item_id, false AS is_repeat FROM k
UNION ALL
SELECT site, item_id, true FROM (SELECT DISTINCT e.site, e.item_id, e.ts FROM e JOIN k USING (site, item_id)
                                 WHERE k.allow AND e.ts > k.first_ts) r
"""

SQL = {
    "stream_new_entries": SQL_DISTINCT_IDS,
    "stream_seen_ids": SQL_DISTINCT_IDS,
    "stream_repeats": SQL_REPEATS_STREAM,
    "stream_complete_days": SQL_COMPLETE_DAYS,
    "stream_feed_entries": SQL_ATOM,
}


# --------------------------------------------------------- stream_age_policy
def stream_age_policy(spark, sf_dir):
    """T2 streamed: entries arrive as files; each micro-batch is classified
    against the sites' last runs; expired rows land in a side table.  The
    union of both tables equals the batch age_policy."""
    from feedloom.functions import dates
    from feedloom.plans import fixtures as X
    from feedloom.plans.q_entries import _pages
    from feedloom.sources.rules import attach_rules
    pages = _pages(spark, sf_dir)
    e = attach_rules(X.entries_view(pages), X.rules_view(spark, "save_days", "nocache"), on="rule_key")
    e = e.select("feed", "pos", dates.parse_rfc2822(F.col("published")).alias("pub_ts"), "save_days", "nocache")
    base = scratch_path(spark, f"t2-{uuid.uuid4().hex}")
    e.repartitionByRange(N_FILES, "pos").write.parquet(f"{base}/source")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/source")
    writer = INC.age_policy_batch_writer(X.state_view(pages), f"{base}/out", f"{base}/late", X.run_ts())
    q = (stream.writeStream.foreachBatch(writer).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    kept = spark.read.parquet(f"{base}/out").select("feed", "pos", "status")
    # every batch writes both tables, empty or not, so neither can be missing
    late = spark.read.parquet(f"{base}/late").select("feed", "pos", "status")
    return kept.unionByName(late)


QUERIES["stream_age_policy"] = stream_age_policy


def _age_sql():
    from feedloom.plans.q_state import SQL_AGE
    return SQL_AGE


SQL["stream_age_policy"] = _age_sql()


# --------------------------------------------------------- stream_schedule_gate
def stream_schedule_gate(spark, sf_dir):
    """T5 streamed: a user's runs arrive over several micro-batches; equals the batch schedule_gate."""
    from feedloom.plans.q_state import WHEN_RULES, hour_range
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    rule = F.element_at(F.array(*[F.lit(w) for w in WHEN_RULES]), (F.pmod(F.col("user_id"), F.lit(12)) + 1).cast("int"))
    ev = ev.withColumn("rule", rule)
    base = scratch_path(spark, f"t5-{uuid.uuid4().hex}")
    ev.repartitionByRange(N_FILES, "ts").write.parquet(f"{base}/source")
    stamp_in_order(spark, f"{base}/source")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/source")
    write = INC.schedule_batch_writer(f"{base}/runs", f"{base}/out", "user_id", ["ts", "event_id"], "rule", bucket=hour_range())
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").filter("gate <> 'first'").select("event_id", "user_id", "rule", "gate")


QUERIES["stream_schedule_gate"] = stream_schedule_gate


def _gate_sql():
    from feedloom.plans.q_state import SQL as STATE_SQL
    return STATE_SQL["schedule_gate"]


SQL["stream_schedule_gate"] = _gate_sql()
