"""Incremental operators in Structured Streaming form.

The batch forms live in ``feedloom.operators.state``; these run the same
rules over arriving feed entries:

* ``dedup_within_watermark`` - T1 with expiry: an (site, id) pair is emitted
  once while it is younger than the watermark delay (save_days).
* ``seen_set_batch_writer`` - T1 without expiry, for small seen-sets: a
  ``foreachBatch`` sink that anti-joins each micro-batch with the whole
  seen-set folder and writes the new ids as that batch's own partition.
* ``SeenTable`` - T1 without expiry at any size: the seen-set in hash buckets of its keys.
  A micro-batch reads only the buckets it touches, publishes its new ids by
  renaming finished folders, and compacts buckets that hold many small ones;
  a repeated batch publishes the same ids again, in the same place.
* ``republications`` - T3: the last emitted time of each (site, id); a seen
  id is emitted again only when its site allows repeats and it was published
  after the last emission (optional event-time TTL = save_days, by timers).
  State is kept per hash bucket of the ids, so that the state store is asked
  per bucket, not per id.  Rows are consumed chunk by chunk; more than
  ``HELD`` times of a bucket in one batch go to the state store, not to Python.
* ``age_policy_batch_writer`` - T2: the age rule per micro-batch, expired
  rows kept in a side table.
* ``complete_rows`` - T6: story rows joined with the sentinels of their days.
* ``schedule_batch_writer`` - T5: the schedule gate per micro-batch, each site's last run kept between them.
"""

from __future__ import annotations

import uuid
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.session import delete_path, list_folders, path_exists, publish_folder, ship_package


def dedup_within_watermark(stream: DataFrame, keys: list[str], ts_col: str, delay: str) -> DataFrame:
    """T1 (expiring ids): first arrival of each key within the watermark."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(keys)


def seen_set_batch_writer(seen_path: str, keys: list[str]):
    """T1 (ids never expire): ``foreachBatch`` function writing only unseen keys.

    Each start of the stream writes under its own ``run``, so a stream that is
    started anew (its batch numbers begin at 0 again) never overwrites ids; a
    repeated batch of the same run replaces its own partition.
    """
    run = f"r{uuid.uuid4().hex}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        if path_exists(spark, seen_path):  # not before the first batch
            seen = spark.read.parquet(seen_path).filter((F.col("run") != run) | (F.col("batch") != batch_id))
            fresh = fresh.join(seen.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{seen_path}/run={run}/batch={batch_id}")

    return write_batch


class SeenTable:
    """T1 (ids never expire): a set of keys in ``buckets`` folders by the keys' hash.

    A folder ``bucket=b`` holds one folder per batch that added ids to it
    (``run=<run>-<batch>``), or one that a compaction made of them.  A batch
    writes its new ids to a staging folder and publishes each bucket's part by
    renaming it, so readers never see half of it.  Each start of the stream is
    its own run, so a stream that is started anew (its batch numbers begin at 0
    again) never overwrites ids; a repeated batch of the same run leaves out
    what it published itself and replaces it.
    """

    #: Batch folders in a bucket from which on they are rewritten as one.
    COMPACT = 16

    def __init__(self, path: str, keys: list[str], buckets: int = 64):
        self.path, self.keys, self.buckets = path.rstrip("/"), keys, buckets
        self.run = f"r{uuid.uuid4().hex}"

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folders(self, spark, bucket: int) -> list[str]:
        return list_folders(spark, f"{self.path}/bucket={bucket}")

    def read(self, spark) -> DataFrame:
        """All keys; a compaction that was cut short may leave some twice, hence the distinct."""
        return spark.read.parquet(f"{self.path}/bucket=*/*").select(*self.keys).distinct()

    def add(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Add the batch's unseen keys; returns them (every row of an unseen key's first arrival, one per key)."""
        spark, mine = batch.sparkSession, f"run={self.run}-{batch_id:012d}"
        fresh = batch.dropDuplicates(self.keys).withColumn("bucket", self.bucket())
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        known = [f for b in touched for f in self._folders(spark, b) if not f.endswith("/" + mine)]
        if known:
            fresh = fresh.join(spark.read.parquet(*known).select(*self.keys), self.keys, "left_anti")
        stage = f"{self.path}/_stage/{mine}"
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(stage)
        for b in touched:
            publish_folder(spark, f"{stage}/bucket={b}", f"{self.path}/bucket={b}/{mine}")
        self.compact(spark, touched, batch_id)
        added = [f"{self.path}/bucket={b}/{mine}" for b in touched]
        added = [f for f in added if path_exists(spark, f)]
        return spark.read.parquet(*added) if added else fresh.drop("bucket").limit(0)

    def compact(self, spark, buckets: list[int], batch_id: int) -> None:
        """Rewrite the older folders of full buckets as one; the newest stays, its batch may be repeated."""
        for b in buckets:
            mine = f"run={self.run}-{batch_id:012d}"
            old = [f for f in self._folders(spark, b) if not f.endswith("/" + mine)]
            if len(old) < self.COMPACT:
                continue
            stage = f"{self.path}/_stage/compact-{uuid.uuid4().hex}"
            spark.read.parquet(*old).select(*self.keys).distinct().coalesce(1).write.parquet(stage)
            publish_folder(spark, stage, f"{self.path}/bucket={b}/run=compact-{uuid.uuid4().hex}")
            for f in old:
                delete_path(spark, f)


def seen_table_batch_writer(seen: SeenTable, out_path: str | None = None):
    """``foreachBatch`` function that adds each batch's unseen keys to ``seen``; the rows that are
    new go to the batch's own folder under ``out_path``."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = seen.add(batch, batch_id)
        if out_path:
            fresh.write.mode("overwrite").parquet(f"{out_path}/run={seen.run}/batch={batch_id}")

    return write_batch


REPUB_OUT = T.StructType([
    T.StructField("site", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("is_repeat", T.BooleanType()),
])


class Republisher(StatefulProcessor):
    """Per (site, item_id): emits the first arrival and, with repeats allowed, each later publication time
    above the last emitted one.  With ``ttl_ms`` an id is forgotten that long after its last emission
    (event time, by a timer)."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")
        #: Publication times of the running batch, for keys whose rows come in several chunks.
        self.times = handle.getMapState("times", "us bigint", "there boolean")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        first = newest = last
        allow = False
        waiting = None  # the earliest time so far: it is the first arrival, all others are repeats
        spread = False  # whether the key's rows come in several chunks
        rows = (pdf for pdf in rows if not pdf.empty)
        pdf = next(rows, None)
        while pdf is not None:
            later = next(rows, None)
            allow = allow or bool(pdf["allow_repeats"].fillna(False).any())
            us = sorted({int(t.value // 1000) for t in pd.to_datetime(pdf["ts"])})
            new = [u for u in us if last is None or u > last]
            if spread:
                new = [u for u in new if u != waiting and not self.times.containsKey((u,))]
            spread = spread or later is not None
            if spread:  # kept for the next chunk, in the state store
                for u in new:
                    self.times.updateValue((u,), (True,))
            pdf = later
            if not new:
                continue
            newest = max([u for u in (newest, new[-1]) if u is not None])
            repeats = new
            if last is None:
                first = min([u for u in (waiting, new[0]) if u is not None])
                repeats = [u for u in ([waiting] if waiting is not None else []) + new if u != first]
                waiting = first
            if allow and repeats:
                yield self._rows(key, repeats, True)
        if spread:
            self.times.clear()
        if last is None and waiting is not None:
            yield self._rows(key, [waiting], False)
        kept = newest if allow else first
        if kept is not None and kept != last:
            self.last.update((kept,))
            if self.ttl_ms is not None:
                # an id that is already past its span ends with the next watermark
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(max(kept // 1000 + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter([])

    @staticmethod
    def _rows(key, times, is_repeat):
        return pd.DataFrame({"site": key[0], "item_id": key[1], "ts": pd.to_datetime(times, unit="us"), "is_repeat": is_repeat})

    def close(self) -> None:
        pass


class BucketRepublisher(StatefulProcessor):
    """The rule of ``Republisher`` for all ids of a hash bucket: one read and one write of the state per bucket
    and micro-batch.  With ``ttl_ms`` each id has its own end; the bucket's timer stands at the earliest."""

    #: Distinct new times of a bucket in one micro-batch that Python holds; beyond, they go to the state store.
    HELD = 200_000
    #: Rows given out at a time.
    OUT_ROWS = 10_000

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getValueState(
            "ids", "site array<string>, item_id array<string>, us array<bigint>, ends array<bigint>")
        self.times = handle.getMapState("times", "site string, item_id string, us bigint", "there boolean")

    def _known(self) -> dict:
        """Each id's last emitted time and, with a TTL, the event time at which it is forgotten."""
        state = self.ids.get()
        return {(site, item): (us, end) for site, item, us, end in zip(*state)} if state else {}

    def _keep(self, known: dict) -> None:
        if known:
            self.ids.update(tuple(map(list, zip(*((site, item, us, end) for (site, item), (us, end) in known.items())))))
        else:
            self.ids.clear()

    def handleInputRows(self, key, rows, timerValues):
        known = self._known()
        span: dict = {}  # the earliest and the latest new time of each id
        allowed, held, spilled = set(), set(), False
        for pdf in rows:
            us = [t.value // 1000 for t in pd.to_datetime(pdf["ts"])]
            for site, item, u, allow in zip(pdf["site"].tolist(), pdf["item_id"].tolist(), us, pdf["allow_repeats"].eq(True)):
                of = (site, item)
                if allow:
                    allowed.add(of)
                if of not in known or u > known[of][0]:
                    first, newest = span.get(of, (u, u))
                    span[of] = (min(first, u), max(newest, u))
                    held.add((site, item, u))
            if len(held) > self.HELD or spilled:
                self._spill(held)
                spilled = True
        repeats = ((site, item, u, True) for site, item, u in (self.times.keys() if spilled else held)
                   if (site, item) in allowed and ((site, item) in known or u != span[site, item][0]))
        for part in batched(repeats, self.OUT_ROWS):
            yield self._rows(part)
        if spilled:
            self.times.clear()
        for part in batched(((*of, first, False) for of, (first, _) in span.items() if of not in known), self.OUT_ROWS):
            yield self._rows(part)
        changed = {of: newest if of in allowed else first for of, (first, newest) in span.items() if of in allowed or of not in known}
        if changed:
            known |= {of: (u, None) for of, u in changed.items()}
            if self.ttl_ms is not None:
                now = timerValues.getCurrentWatermarkInMs()
                # an id that is already past its span ends with the next watermark
                known |= {of: (u, max(u // 1000 + self.ttl_ms, now + 1)) for of, u in changed.items()}
                # those whose time is over go here, as the timer moves on
                known = {of: (u, end) for of, (u, end) in known.items() if end >= now}
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self._wake(known, now)
            self._keep(known)

    def _wake(self, known: dict, now: int) -> None:
        if known:
            self.handle.registerTimer(max(now + 1, min(end for _, end in known.values())))

    def _spill(self, held: set) -> None:
        for time in held:
            self.times.updateValue(time, (True,))
        held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        known = {of: (u, end) for of, (u, end) in self._known().items() if end >= now and end > fired}
        self._keep(known)
        self._wake(known, now)
        return iter([])

    @staticmethod
    def _rows(part):
        out = pd.DataFrame(part, columns=["site", "item_id", "ts", "is_repeat"])
        return out.assign(ts=pd.to_datetime(out["ts"], unit="us"))

    def close(self) -> None:
        pass


def republications(stream: DataFrame, ttl: str | None = None, ttl_ms: int | None = None,
                   buckets: int | None = 1024) -> DataFrame:
    """T3 over a stream of (site, item_id, ts, allow_repeats); ``allow_repeats`` is the site's.

    Without a TTL ids are remembered forever.  With ``ttl`` (a watermark delay
    such as '7 days', i.e. save_days) and the same span in ``ttl_ms``, the stream
    is watermarked on ``ts`` and an id's state is dropped once event time passes
    its last emission plus the TTL.  The session must use the RocksDB state store.

    The ids are dealt over ``buckets`` groups with one state each (a checkpoint
    keeps its number of buckets); with None each id is a group of its own, which
    pays only if a micro-batch touches few ids out of very many.
    """
    ship_package(stream.sparkSession)
    s = stream.select("site", "item_id", "ts", "allow_repeats")
    if ttl is not None:
        s = s.withWatermark("ts", ttl)
    keep_ms, mode = (None, "None") if ttl is None else (ttl_ms, "EventTime")
    if buckets is None:
        return s.groupBy("site", "item_id").transformWithStateInPandas(Republisher(keep_ms), REPUB_OUT, "append", mode)
    s = s.withColumn("bucket", F.pmod(F.xxhash64("site", "item_id"), F.lit(buckets)))
    return s.groupBy("bucket").transformWithStateInPandas(BucketRepublisher(keep_ms), REPUB_OUT, "append", mode)


def complete_rows(files: DataFrame, sentinels: DataFrame, wait: str) -> DataFrame:
    """T6 streamed: rows (day, ts, ...) with ``complete``: whether their day's sentinel (day, ts) came.

    A row is held until the sentinel comes, in whichever order the two arrive; a
    row whose sentinel is not stamped within ``wait`` of it is given out as
    incomplete once the watermark has passed that limit, and its state goes.
    """
    f = files.withWatermark("ts", wait)
    s = sentinels.select(F.col("day").alias("_day"), F.col("ts").alias("_done")).withWatermark("_done", wait)
    within = F.expr(f"day = _day AND _done >= ts - INTERVAL {wait} AND _done <= ts + INTERVAL {wait}")
    return f.join(s, within, "leftOuter").withColumn("complete", F.col("_done").isNotNull()).drop("_day", "_done")


def age_policy_batch_writer(state: DataFrame, out_path: str, late_path: str, run_ts):
    """T2 in streaming form: each micro-batch is classified with the batch
    rule against the sites' last runs (a stream-static join); kept rows
    ('normal', 'older') go to ``out_path``, expired ones to the side table
    ``late_path`` instead of vanishing silently behind a watermark.  Both are
    written as the batch's own partition with overwrite (idempotent retries).
    """
    from feedloom.operators.state import age_status, with_last_fed

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        tagged = with_last_fed(batch, state).withColumn(
            "status", age_status(F.col("pub_ts"), F.col("last_fed"), run_ts, F.col("save_days"), F.col("nocache")))
        tagged = tagged.drop("last_fed")
        tagged.filter(F.col("status") != "expired").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        tagged.filter(F.col("status") == "expired").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")

    return write_batch


def schedule_batch_writer(state_path: str, out_path: str, site: str, order: list[str], when: str, bucket=None):
    """T5 streamed: ``foreachBatch`` function that gates a site's runs by its schedule rule.

    A run (``order``: its time first, then what tells equal times apart) is
    compared with the site's run before it: in the micro-batch by ordered ranges
    (``bucket``; the hours of the time if none is given), the first of a micro-batch with the site's last run of all
    earlier ones.  Those last runs are one row per site, published by a rename
    under the batch's number; a repeated batch starts from the table before its
    own and replaces what it wrote.  A run that comes later than a younger one of
    an earlier batch has a negative span ('error: negative span'); a null site
    has no earlier run.
    """
    from feedloom.functions.schedule import gate
    from feedloom.operators.entries import previous_row
    ts = order[0]
    if bucket is None:
        bucket = F.date_format(ts, "yyyyMMddHH").cast("long")

    def number(folder: str) -> int:
        return int(folder.rsplit("batch=", 1)[1])

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = sorted((f for f in list_folders(spark, state_path) if "batch=" in f and number(f) < batch_id), key=number)
        rows = previous_row(batch, [site], order, [ts], bucket=bucket)
        lasts = batch.groupBy(site).agg(F.max(ts).alias("last_run"))
        if earlier:
            known = spark.read.parquet(earlier[-1])
            rows = rows.join(known, site, "left").withColumn(f"prev_{ts}", F.coalesce(f"prev_{ts}", "last_run")).drop("last_run")
            lasts = lasts.unionByName(known).groupBy(site).agg(F.max("last_run").alias("last_run"))
        rows.withColumn("gate", gate(F.col(when), F.col(f"prev_{ts}"), F.col(ts))).write.mode("overwrite").parquet(
            f"{out_path}/batch={batch_id}")
        staged = f"{state_path}/_staged-{uuid.uuid4().hex}"
        lasts.write.parquet(staged)
        publish_folder(spark, staged, f"{state_path}/batch={batch_id}")
        for old in earlier[:-1]:  # the table before this one stays for a repeated batch
            delete_path(spark, old)

    return write_batch
