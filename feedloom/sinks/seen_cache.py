"""Seen-cache text format (S7 read, S8 write).

The native state is the Parquet ``seen(site, item_id)`` and
``site_state(site, last_fed)`` tables; this module converts to and from the
line format other tools read:

    <tool> v. 1.1
    site|last_fed_epoch|id id id      (v1.1)
    site|id id id                     (v1, last_fed = 0)

The first line of a file is a '<name> v. <version>' header.

Ids and site keys have spaces encoded as '+'.  Lines of any other shape are
rejected with a reason, never fail the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header written, and the header shape accepted on reading.
HEADER = "feedloom v. 1.1"
HEADER_RE = r"^\S+ v\. "


def cache_lines(seen: DataFrame, state: DataFrame, ids_per_line: int | None = None) -> DataFrame:
    """v1.1 lines: (site, last_fed, line).  Ids sorted for a stable text.

    The format has one line per site, so by default a site's ids are
    gathered into one line.  With ``ids_per_line`` a large site is written
    as several lines of about that many ids each (ids hashed to lines; the
    reader here unions lines of the same site), so no task has to hold a
    huge site whole.
    """
    enc = F.replace(F.col("item_id"), F.lit(" "), F.lit("+"))
    keys = ["site"]
    src = seen
    if ids_per_line:
        sizes = seen.groupBy("site").agg(F.count(F.lit(1)).alias("_n"))
        src = (seen.join(sizes, "site")
               .withColumn("_chunk", F.pmod(F.xxhash64("item_id"),
                                            F.ceil(F.col("_n") / F.lit(ids_per_line)).cast("long"))))
        keys = ["site", "_chunk"]
    ids = src.groupBy(*keys).agg(F.array_sort(F.collect_list(enc)).alias("ids"))
    j = ids.join(state.select("site", "last_fed"), "site", "left")
    epoch = F.coalesce(F.unix_seconds("last_fed"), F.lit(0)).cast("long").cast("string")
    line = F.concat_ws("|", F.replace(F.col("site"), F.lit(" "), F.lit("+")), epoch, F.array_join("ids", " "))
    return j.select("site", "last_fed", line.alias("line"))


def parse_cache_lines(lines: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines -> (rows(site, item_id, last_fed_epoch, version), rejects).

    Blank lines and header lines are skipped.  Two fields: v1 (last_fed 0);
    three fields: v1.1 with a numeric epoch; anything else is rejected.
    """
    v = F.col(value_col)
    body = lines.filter((F.trim(v) != "") & ~v.rlike(HEADER_RE))
    parts = F.split(v, r"\|")
    n = F.size(parts)
    epoch_txt = F.trim(F.element_at(parts, 2))
    ok_epoch = epoch_txt.rlike(r"^[+-]?[0-9]+$")
    tagged = body.select(
        v.alias("line"),
        F.trim(F.element_at(parts, 1)).alias("site"),
        F.when(n == 2, F.element_at(parts, 2)).when(n == 3, F.element_at(parts, 3)).alias("ids"),
        F.when(n == 2, F.lit(0)).when((n == 3) & ok_epoch, epoch_txt.cast("long")).alias("last_fed_epoch"),
        F.when(n == 2, F.lit("1")).when(n == 3, F.lit("1.1")).alias("version"),
        F.when((n != 2) & (n != 3), F.concat(F.lit("confused by "), n.cast("string"), F.lit(" parts")))
        .when((n == 3) & ~ok_epoch, F.lit("epoch is not a number")).alias("reason"))
    rows = (tagged.filter(F.col("reason").isNull())
            .select("site", F.explode(F.split(F.trim("ids"), r"\s+")).alias("item_id"),
                    F.col("last_fed_epoch").cast("long").alias("last_fed_epoch"), "version")
            .filter(F.col("item_id") != ""))
    rejects = tagged.filter(F.col("reason").isNotNull()).select(
        F.col("site").alias("feed"), F.lit(None).cast("string").alias("item_id"), F.lit("cache").alias("stage"),
        F.lit("warn").alias("severity"), F.concat(F.col("reason"), F.lit(": "), F.col("line")).alias("reason"))
    return rows, rejects


def read_seen_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read cache text files (a file or a folder of them).

    A file whose first line is not the header is ignored as a whole (and
    reported).  Lines are read in parallel; the header check is a semi join
    on the file name, not a per-file loop.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path) \
        .withColumn("_file", F.input_file_name())
    good_files = raw.filter(F.col("value").rlike(HEADER_RE)).select("_file").distinct()
    lines = raw.join(good_files, "_file", "left_semi")
    rows, rejects = parse_cache_lines(lines)
    bad_files = (raw.select("_file").distinct().join(good_files, "_file", "left_anti")
                 .select(F.lit(None).cast("string").alias("feed"), F.lit(None).cast("string").alias("item_id"),
                         F.lit("cache").alias("stage"), F.lit("error").alias("severity"),
                         F.concat(F.lit("not a cache file: "), F.col("_file")).alias("reason")))
    return rows, rejects.unionByName(bad_files)


def write_seen_cache(seen: DataFrame, state: DataFrame, path: str, n_files: int = 16) -> None:
    """Write the cache as ``n_files`` text files, each a complete cache file.

    Sites are hashed to files; every file gets its own header line first,
    so no task ever has to write the whole cache.
    """
    spark = seen.sparkSession
    lines = cache_lines(seen, state).select(
        F.pmod(F.hash("site"), F.lit(n_files)).alias("part"), F.lit(1).alias("ord"), "site", "line")
    headers = spark.range(n_files).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("ord"),
                                          F.lit("").alias("site"), F.lit(HEADER).alias("line"))
    (lines.unionByName(headers).repartition(n_files, "part")
     .sortWithinPartitions("part", "ord", "site")
     .select("part", "line").write.mode("overwrite").partitionBy("part").text(path))
