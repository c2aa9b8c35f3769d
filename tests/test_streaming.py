"""Streaming forms against batch models: T1 sink idempotency, T3 state across micro-batches."""

import os
import random
import tempfile
import time
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows
from feedloom.streaming import incremental as INC

SCHEMA = "site string, item_id string, ts timestamp, allow_repeats boolean"


def _scratch(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    return os.path.join(base, f"stream-test-{uuid.uuid4().hex}")


def test_seen_set_writer_is_idempotent_and_never_forgets(spark):
    seen = _scratch(spark)
    write = INC.seen_set_batch_writer(seen, ["site", "item_id"])
    b0 = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "a")], "site string, item_id string")
    write(b0, 0)
    write(b0, 0)  # a retried batch rewrites its own partition
    b1 = spark.createDataFrame([("s", "b"), ("s", "c")], "site string, item_id string")
    write(b1, 1)
    got = rows(spark.read.parquet(seen), ["batch", "site", "item_id"])
    assert got == [(0, "s", "a"), (0, "s", "b"), (1, "s", "c")]


KEYS = "site string, item_id string"


def test_seen_table_is_idempotent_and_never_forgets(spark):
    path = _scratch(spark)
    seen = INC.SeenTable(path, ["site", "item_id"], buckets=4)
    write = INC.seen_table_batch_writer(seen, f"{path}-out")
    b0 = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "a")], KEYS)
    write(b0, 0)
    write(b0, 0)  # a repeated batch publishes the same ids again, once
    write(spark.createDataFrame([("s", "b"), ("s", "c")], KEYS), 1)
    write(spark.createDataFrame([("s", "c")], KEYS), 2)
    assert rows(seen.read(spark)) == [("s", "a"), ("s", "b"), ("s", "c")]
    got = rows(spark.read.option("basePath", f"{path}-out").parquet(*[f"{path}-out/run={seen.run}/batch={i}" for i in (0, 1)]),
               ["batch", "site", "item_id"])
    assert got == [(0, "s", "a"), (0, "s", "b"), (1, "s", "c")]
    # another start of the stream counts its batches from 0 again and still finds every id
    again = INC.SeenTable(path, ["site", "item_id"], buckets=4)
    assert rows(again.add(spark.createDataFrame([("s", "a"), ("s", "z")], KEYS), 0)) == [("s", "z")]
    assert rows(again.read(spark))[-1] == ("s", "z")


def test_seen_table_reads_touched_buckets_only_and_compacts_them(spark, monkeypatch):
    path = _scratch(spark)
    seen = INC.SeenTable(path, ["site", "item_id"], buckets=8)
    every = spark.createDataFrame([("s", str(i)) for i in range(100)], KEYS)
    seen.add(every, 0)
    of = {r.item_id: r.b for r in every.select("item_id", seen.bucket().alias("b")).collect()}
    read = []
    real = INC.list_folders
    monkeypatch.setattr(INC, "list_folders", lambda spark, p: read.append(p) or real(spark, p))
    assert rows(seen.add(spark.createDataFrame([("s", "1"), ("s", "2")], KEYS), 1)) == []
    assert {p.rsplit("bucket=", 1)[1] for p in read} == {str(of["1"]), str(of["2"])}
    # batches that add to one bucket alone: its folders become one, nothing is lost
    monkeypatch.setattr(INC.SeenTable, "COMPACT", 3)
    more = spark.range(2000).selectExpr("'s' AS site", "concat('n', id) AS item_id").withColumn("b", seen.bucket()).filter("b = 5")
    ids = [r.item_id for r in more.limit(8).collect()]
    for i, x in enumerate(ids):
        seen.add(spark.createDataFrame([("s", x)], KEYS), 2 + i)
    assert len(real(spark, f"{path}/bucket=5")) <= 4
    assert {r.item_id for r in seen.read(spark).collect()} == {str(i) for i in range(100)} | set(ids)


def test_a_batch_that_failed_half_way_is_repeated(spark, monkeypatch):
    path = _scratch(spark)
    seen = INC.SeenTable(path, ["site", "item_id"], buckets=8)
    batch = spark.createDataFrame([("s", str(i)) for i in range(40)], KEYS)
    real, done = INC.publish_folder, []

    def fails(spark, staged, path):
        if len(done) == 3:
            raise OSError("lost")
        done.append(path)
        real(spark, staged, path)

    monkeypatch.setattr(INC, "publish_folder", fails)
    try:
        seen.add(batch, 0)
        raise AssertionError("the batch should have failed")
    except OSError:
        pass
    monkeypatch.setattr(INC, "publish_folder", real)
    assert len(rows(seen.add(batch, 0))) == 40  # what was half published counts as new once more
    assert len(rows(seen.read(spark))) == 40 and rows(seen.add(batch, 1)) == []


def republish_model(events):
    """Per key, in arrival order of batches and time order inside a batch."""
    state, out = {}, []
    for batch in events:
        by_key = {}
        for site, item, ts, allow in batch:
            by_key.setdefault((site, item), []).append((ts, allow))
        for key, vals in by_key.items():
            vals.sort()
            allow = any(a for _, a in vals)
            last = state.get(key)
            if last is None:
                out.append((key[0], key[1], vals[0][0], False))
                last = vals[0][0]
            if allow:
                for ts in sorted({t for t, _ in vals}):
                    if ts > last:
                        out.append((key[0], key[1], ts, True))
                        last = ts
            state[key] = last
    return sorted(out)


def test_republications_across_batches(spark):
    t0 = datetime(2024, 1, 1)
    batches = [
        [("s", "a", t0, True), ("s", "a", t0 + timedelta(hours=2), True), ("s", "b", t0, False)],
        [("s", "a", t0 + timedelta(hours=1), True), ("s", "a", t0 + timedelta(hours=5), True),
         ("s", "b", t0 + timedelta(hours=9), False), ("s", "c", t0, True)],
    ]
    base = _scratch(spark)
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{base}/src/part{i}")
        time.sleep(1.1)  # distinct modification times keep the file order
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(f"{base}/src"))
    q = (INC.republications(stream).writeStream.format("parquet").option("path", f"{base}/sink")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = rows(spark.read.parquet(f"{base}/sink"), ["site", "item_id", "ts", "is_repeat"])
    assert got == republish_model(batches)


def test_republications_over_many_batches_and_a_restart(spark):
    rng, t0 = random.Random(8), datetime(2024, 1, 1)
    batches = [[("s" if k % 3 else "t", f"i{rng.randrange(6)}", t0 + timedelta(hours=rng.randrange(60)), bool(k % 3))
                for k in range(30)] for _ in range(5)]
    base = _scratch(spark)

    def run():
        stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(f"{base}/src"))
        q = (INC.republications(stream).writeStream.format("parquet").option("path", f"{base}/sink")
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()

    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{base}/src/part{i}")
        time.sleep(1.1)  # distinct modification times keep the file order
        if i == 2:
            run()  # stops here, and starts again from its checkpoint
    run()
    got = rows(spark.read.parquet(f"{base}/sink"), ["site", "item_id", "ts", "is_repeat"])
    assert got == republish_model(batches)


def test_a_key_in_several_chunks_keeps_its_times_in_the_store():
    import pandas as pd

    class Value:
        held = None
        def exists(self): return self.held is not None
        def get(self): return self.held
        def update(self, v): self.held = v
        def clear(self): self.held = None

    class Times(dict):
        def containsKey(self, k): return k in self
        def updateValue(self, k, v): self[k] = v

    p = INC.Republisher()
    p.last, p.times = Value(), Times()

    def chunk(*hours):
        return pd.DataFrame({"ts": [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h) for h in hours], "allow_repeats": True})

    def emitted(*chunks):
        out = pd.concat(list(p.handleInputRows(("s", "i"), iter(chunks), None)) or [pd.DataFrame({"ts": [], "is_repeat": []})])
        return sorted((t.hour, bool(r)) for t, r in zip(out["ts"], out["is_repeat"]))

    assert emitted(chunk(5, 7, 5), chunk(), chunk(3, 7), chunk(5, 9)) == [(3, False), (5, True), (7, True), (9, True)]
    assert not p.times
    assert emitted(chunk(9, 4)) == [] and emitted(chunk(11), chunk(10, 11)) == [(10, True), (11, True)]


def test_republication_state_is_kept_per_bucket_not_per_id(spark):
    t0 = datetime(2024, 1, 1)
    rng = random.Random(5)
    batches = [[("s" if k % 3 else "t", f"i{rng.randrange(2500)}", t0 + timedelta(minutes=rng.randrange(500)), bool(k % 3))
                for k in range(3000)] + [("s", None, t0 + timedelta(minutes=b), True), (None, "x", t0, None)] for b in range(2)]
    base = _scratch(spark)
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{base}/src/part{i}")
        time.sleep(1.1)  # distinct modification times keep the file order
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(f"{base}/src"))
    q = (INC.republications(stream).writeStream.format("parquet").option("path", f"{base}/sink")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
    got = [tuple(r) for r in spark.read.parquet(f"{base}/sink").select("site", "item_id", "ts", "is_repeat").collect()]

    def known(rows):
        return sorted(r for r in rows if None not in r)

    assert known(got) == republish_model([known(b) for b in batches])
    assert sorted((r for r in got if None in r), key=str) == [
        ("s", None, t0, False), ("s", None, t0 + timedelta(minutes=1), True), (None, "x", t0, False)]


class _Value:
    held = None
    def get(self): return self.held
    def update(self, v): self.held = v
    def clear(self): self.held = None


class _Times(dict):
    def updateValue(self, k, v): self[k] = v


def test_times_of_a_bucket_beyond_what_python_holds_go_to_the_store(monkeypatch):
    import pandas as pd
    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    batches = [[("s" if k % 3 else "t", f"i{k % 3}{rng.randrange(9)}", t0 + timedelta(minutes=rng.randrange(300)), bool(k % 3))
                for k in range(400)] for _ in range(3)]

    def emitted(held):
        monkeypatch.setattr(INC.BucketRepublisher, "HELD", held)
        monkeypatch.setattr(INC.BucketRepublisher, "OUT_ROWS", 7)
        p = INC.BucketRepublisher()
        p.ids, p.times, most, out = _Value(), _Times(), 0, []
        for b in batches:
            chunks = [pd.DataFrame(b[k:k + 50], columns=["site", "item_id", "ts", "allow_repeats"]) for k in range(0, len(b), 50)]
            for part in p.handleInputRows((0,), iter(chunks), None):
                assert 0 < len(part) <= 7
                most = max(most, len(p.times))
                out += [(s, i, t.to_pydatetime(), bool(r)) for s, i, t, r in part.itertuples(index=False)]
            assert not p.times
        return sorted(out), most

    want = republish_model(batches)
    assert emitted(200_000) == (want, 0)
    got, most = emitted(20)
    assert got == want and most > 100


def test_republication_ttl_is_that_of_each_id(spark):
    t0 = datetime(2024, 1, 1)
    base = _scratch(spark)
    for item, day in (("a", 0), ("b", 5), ("z", 20), ("b", 14), ("a", 21), ("z", 22), ("b", 23)):
        spark.createDataFrame([("s", item, t0 + timedelta(days=day), True)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/src")
        time.sleep(1.1)

    def out(buckets):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
        q = (INC.republications(stream, "7 days", 7 * 86_400_000, buckets=buckets).writeStream.format("parquet")
             .option("path", f"{base}/sink{buckets}").option("checkpointLocation", f"{base}/ckpt{buckets}").trigger(availableNow=True).start())
        q.awaitTermination()
        return rows(spark.read.parquet(f"{base}/sink{buckets}"), ["site", "item_id", "ts", "is_repeat"])

    got = out(1)
    assert got == out(None)
    assert ("s", "a", t0 + timedelta(days=21), False) in got and ("s", "z", t0 + timedelta(days=22), True) in got


def test_sentinels_in_time_late_and_missing(spark):
    t0 = datetime(2024, 1, 1)
    day = timedelta(days=1)
    files = [[("d1", t0, "a"), ("d1", t0 + day / 2, "b"), ("d2", t0 + day, "c")],
             [("d3", t0 + 2 * day, "d"), ("d4", t0 + 3 * day, "e")], [("d9", t0 + 30 * day, "z")], [("d10", t0 + 60 * day, "y")]]
    # d1's comes with its rows, d2's a batch later, d3's only after the limit, d4's never
    done = [[("d1", t0 + day)], [("d2", t0 + 2 * day)], [("d9", t0 + 30 * day), ("d3", t0 + 9 * day)], [("x", t0 + 60 * day)]]
    base = _scratch(spark)
    for i in range(4):
        for name, data, schema in (("files", files, "day string, ts timestamp, path string"), ("done", done, "day string, ts timestamp")):
            spark.createDataFrame(data[i], schema).coalesce(1).write.parquet(f"{base}/{name}/p{i}")
        time.sleep(1.1)

    def source(name, schema):
        return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
                .parquet(f"{base}/{name}"))

    out = INC.complete_rows(source("files", "day string, ts timestamp, path string"), source("done", "day string, ts timestamp"), "2 days")
    q = (out.writeStream.format("parquet").option("path", f"{base}/sink").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.path: r.complete for r in spark.read.parquet(f"{base}/sink").collect()}
    assert spark.read.parquet(f"{base}/sink").count() == len(got)
    assert {k: v for k, v in got.items() if k not in "yz"} == {"a": True, "b": True, "c": True, "d": False, "e": False}
    assert got.get("z", True)


def test_dedup_within_watermark_matches_distinct(spark):
    t0 = datetime(2024, 1, 1)
    data = [("s", f"i{k % 7}", t0 + timedelta(minutes=k), False) for k in range(40)]
    base = _scratch(spark)
    spark.createDataFrame(data, SCHEMA).repartition(4).write.parquet(f"{base}/src")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
    q = (INC.dedup_within_watermark(stream, ["site", "item_id"], "ts", "30 days").writeStream.format("parquet")
         .option("path", f"{base}/sink").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = rows(spark.read.parquet(f"{base}/sink"), ["site", "item_id"])
    assert got == sorted({(s, i) for s, i, _, _ in data})


def test_schedule_writer_over_batches_equals_the_batch_form(spark):
    """Runs of sites across a month's end, in micro-batches, a repeated batch and a restart; late runs are told."""
    from feedloom.functions.schedule import gate
    from feedloom.operators.entries import previous_row
    rng = random.Random(3)
    start = datetime(2024, 1, 20)
    rules = ["", None, "mo", "31", "1", "x", "zz", "15"]
    runs = sorted((start + timedelta(hours=rng.randrange(24 * 45)), i) for i in range(160))
    data = [(i, f"s{i % 8}", t, rules[i % 8]) for t, i in runs] + [(900, None, start, "mo"), (901, None, start, "mo")]
    schema = "n bigint, site string, ts timestamp, rule string"
    df = spark.createDataFrame(data, schema)
    want = rows(previous_row(df, ["site"], ["ts", "n"], ["ts"], bucket=F.date_format("ts", "yyyyMMdd").cast("long")).select("n", gate("rule", "prev_ts", "ts").alias("gate"))
                .where("n < 900"), ["n", "gate"])
    base = _scratch(spark)
    cuts = [0, 1, 50, 90, 130, 162]
    for k in range(5):
        write = INC.schedule_batch_writer(f"{base}/runs", f"{base}/out", "site", ["ts", "n"], "rule")  # as after a restart
        part = spark.createDataFrame(data[cuts[k]:cuts[k + 1]], schema)
        write(part, k)
        if k in (0, 3):
            write(part, k)
    out = spark.read.parquet(f"{base}/out")
    assert rows(out.where("n < 900"), ["n", "gate"]) == want
    assert len({g for _, g in want}) >= 4
    late = spark.createDataFrame([(950, "s2", start - timedelta(days=1), "mo")], schema)
    write(late, 5)
    assert spark.read.parquet(f"{base}/out").where("n = 950").first()["gate"] == "error: negative span"
    assert sorted(f for f in os.listdir(f"{base}/runs") if "=" in f) == ["batch=4", "batch=5"]
