"""Output documents and listings.

Per-feed index documents are assembled from one block per item; the
concatenation is an ordered aggregate per (day, feed) - a daily index is
bounded by one feed's items of one day.  Story pages, manifests and
listings are plain relations that the writers partition by day and feed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.common import col_of
from feedloom.operators.entries import short_title
from feedloom.session import delete_path, publish_folder

# Index page layout.
INDEX_HEAD = ('<html>\n<head>\n<meta http-equiv="Content-Type" content="text/html; charset=utf-8">\n'
              '<meta name="viewport" content="width=device-width, initial-scale=1">\n'
              '<title>{day}: {feed}</title>\n'
              '<link rel="stylesheet" type="text/css" title="Feeds" href="../../feeds.css"/>\n'
              '</head>\n\n<body>\n<h1>{day}: {feed}: {title}</h1>\n\n')
ANCHOR = '<p><a name="{n}">&nbsp;</a>'
NEXT_ITEM = '<br>\n<center><i><a href="#{n}">&gt;-&gt;</a></i></center>\n<br>\n'
LAST_ITEM = "<br>\n<center><i>[end]</i></center>\n<br>\n"
CLEAR = '\n<br clear="all">\n'
DOWNLOADED = "\n<hr><i>(Downloaded by feedloom)</i>\n"
INDEX_TAIL = '<p><a name="{n}">&nbsp;</a>\n' + DOWNLOADED + "\n</body>\n</html>\n"
MANIFEST_END = ".EOF."


def _fill(template: str, **cols) -> Column:
    """concat() of a template with {name} holes filled by columns."""
    parts, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        if i:
            parts.append(F.lit(rest[:i]))
        j = rest.index("}", i)
        parts.append(col_of(cols[rest[i + 1:j]]).cast("string"))
        rest = rest[j + 1:]
    return F.concat(*parts)


def item_block(item_no, title, link, anchor, levels, skip_links, content, author, next_item) -> Column:
    """The index text of one item (anchor, title link, next link, content, byline, short title link)."""
    n = col_of(item_no)
    lv = col_of(levels)
    page_link = F.concat(F.lit('<a href="'), n.cast("string"), F.lit(".html"), col_of(anchor), F.lit('">'))
    story_link = F.concat(F.lit('<a href="'), col_of(link), F.lit('">'))
    itemlink = F.when(lv > 1, page_link).when(col_of(skip_links), F.lit(None).cast("string")).otherwise(story_link)
    head = (F.when(lv > 1, F.concat(page_link, F.lit("<b>"), col_of(title), F.lit("</b></a>\n")))
            .when(col_of(skip_links), F.concat(F.lit("\n<b>"), col_of(title), F.lit("</b>\n")))
            .otherwise(F.concat(F.lit("\n"), story_link, col_of(title), F.lit("</a>\n"))))
    nxt = F.when(col_of(next_item).isNull(), F.lit(LAST_ITEM)).otherwise(_fill(NEXT_ITEM, n=next_item))
    by = F.when(col_of(author).isNotNull() & (col_of(author) != ""),
                F.concat(F.lit("\n<br><i>By: "), col_of(author), F.lit("</i><br>"))).otherwise(F.lit(""))
    tail = F.when(itemlink.isNotNull(), F.concat(F.lit("\n<br><center>[["), itemlink, short_title(title),
                                                 F.lit("</a>]]</center>\n\n"))).otherwise(F.lit(""))
    return F.concat(_fill(ANCHOR, n=n), head, nxt, col_of(content), F.lit(CLEAR), by, tail)


def no_content_note(link, title) -> Column:
    """What the index says in the place of a story without content."""
    return F.concat(F.lit('<p>No content for <a href="'), col_of(link), F.lit('">'), F.coalesce(col_of(title), F.lit("")),
                    F.lit("</a>\n"))


def index_documents(blocks: DataFrame, keys=("day", "feed")) -> DataFrame:
    """Rows (keys..., item_no, block, day_name, title) -> one document per key.

    Blocks are ordered by item number inside one aggregate per (day, feed);
    the header fields are constant per key and ride along in the same pass.
    """
    keys = list(keys)
    body = blocks.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "block"))),
                                 lambda s: s["block"]), "").alias("body"),
        F.count(F.lit(1)).alias("n_items"), F.first("day_name").alias("day_name"), F.first("title").alias("title"))
    doc = F.concat(_fill(INDEX_HEAD, day="day_name", feed="feed", title="title"), F.col("body"),
                   _fill(INDEX_TAIL, n="n_items"))
    return body.select(*keys, doc.alias("index_html"), F.col("n_items").cast("long").alias("n_items"))


def index_rows(blocks: DataFrame) -> DataFrame:
    """S10 in rows: (day, feed, seq, block); a document is its blocks in seq order (0: head, then items, last: tail).

    For feeds of any size: only the head and tail fields are aggregated, and
    the rows are sorted by ranges, so one feed's document may span tasks.
    Where the blocks have a flag ``numbered``, notes (without it) count as no
    item, and a feed of notes alone has no document.
    """
    item = F.col("numbered") if "numbered" in blocks.columns else F.lit(True)
    per = blocks.groupBy("day", "feed").agg(F.first("day_name").alias("day_name"), F.first("title").alias("title"),
                                            F.count_if(item).alias("n"), F.max("item_no").alias("last_no"))
    if "numbered" in blocks.columns:
        per = per.filter("n > 0")
        blocks = blocks.join(per.select("day", "feed"), ["day", "feed"], "left_semi")
    ends = per.select("day", "feed", F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), _fill(INDEX_HEAD, day="day_name", feed="feed", title="title").alias("block")),
        F.struct((F.col("last_no") + 2).cast("long").alias("seq"), _fill(INDEX_TAIL, n="n").alias("block")))))
    return ends.unionByName(blocks.select("day", "feed", (F.col("item_no") + 1).cast("long").alias("seq"), "block"))


def write_index_rows(rows: DataFrame, path: str) -> None:
    """Index documents in rows, by day; sorted over the part files of a day."""
    (rows.orderBy("day", "feed", "seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(path))


def assemble_stories(pages: DataFrame, key: str = "story", order: str = "page_no", text: str = "text",
                     sep: str = "\n") -> DataFrame:
    """A4: a multi-page story = its pages' texts in page order (one ordered aggregate per story)."""
    return pages.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]),
                     sep).alias("text"),
        F.count(F.lit(1)).cast("long").alias("n_pages"))


def manifest(files: DataFrame) -> DataFrame:
    """(day, path) of written files -> manifest rows (day, section, path).

    Section 0: each feed directory ('feed/') and the .html files; section 1:
    every other file; section 2: the '.EOF.' end marker.  The writer sorts by
    (section, path), a range-partitioned distributed sort.
    """
    path = F.col("path")
    top = F.substring_index(path, "/", 1)
    rows = F.array(
        F.struct(F.lit(0).alias("section"), F.when(path.contains("/") & (top != ""),
                                                   F.concat(top, F.lit("/"))).alias("path")),
        F.struct(F.when(path.endswith(".html"), F.lit(0)).otherwise(F.lit(1)).alias("section"), path.alias("path")),
        F.struct(F.lit(2).alias("section"), F.lit(MANIFEST_END).alias("path")))
    # one pass over the files; directory and end rows repeat per file, a
    # distinct (partial aggregation) folds them
    return (files.select("day", F.inline(rows)).filter(F.col("path").isNotNull())
            .distinct().select("day", "section", "path"))


def output_files(stories: DataFrame, index: DataFrame, feeds: DataFrame) -> DataFrame:
    """(day, path) of the files a run puts under each feed's folder (``feeds``: feed, dir)."""
    paths = stories.select("day", "feed", F.concat(F.col("page_no").cast("string"), F.lit(".html")).alias("file"))
    paths = paths.unionByName(index.filter("seq = 0").select("day", "feed", F.lit("index.html").alias("file")))
    return paths.join(feeds.select("feed", "dir"), "feed").select("day", F.concat_ws("/", "dir", "file").alias("path"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """One text of paths per day, read in the order of its part files: directories and HTML, other files, '.EOF.' last."""
    (rows.orderBy("day", "section", "path").select("day", "path").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").text(path))


def daily_listing(index_files: DataFrame) -> DataFrame:
    """For each day, the feeds that have an index, sorted by name."""
    return index_files.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("feed")), " ").alias("feeds"),
                                          F.countDistinct("feed").cast("long").alias("n_feeds"))


def message_summary(rejects: DataFrame) -> DataFrame:
    """A5: rejects and warnings counted by severity and stage, with the first reason."""
    return rejects.groupBy("severity", "stage").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                                    F.min("reason").alias("first_reason"))


def message_log(rejects: DataFrame) -> DataFrame:
    """A5: every message of a run by severity and stage, and how often it was given."""
    return rejects.groupBy("severity", "stage", "reason").agg(F.count(F.lit(1)).cast("long").alias("n"))


def write_stories(stories: DataFrame, path: str) -> None:
    """One file per story page, partitioned by day and feed; rewriting a
    day replaces only the (day, feed) partitions present (dynamic overwrite).

    Rows are dealt by ranges, so the files number the tasks and the feeds, not their product."""
    (stories.select("day", "feed", "page_no", "html").repartitionByRange("day", "feed", "page_no")
     .sortWithinPartitions("day", "feed", "page_no")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "feed").parquet(path))


def publish_stories(stories: DataFrame, path: str, day: str) -> None:
    """One day's stories, written beside the output under a hidden name and put in place by one rename, so
    that a listing never shows half a day and a failed write leaves the day as it was."""
    spark = stories.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    write_stories(stories.withColumn("day", F.lit(day)), staged)
    publish_folder(spark, f"{staged}/day={day}", f"{path}/day={day}")
    delete_path(spark, staged)


def _partition_value(name: str) -> Column:
    raw = F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    # partition names escape by %XX only: a plus sign is itself
    return F.when((raw != "") & (raw != "__HIVE_DEFAULT_PARTITION__"), F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """The files that lie in an output tree (day, feed, file, n_bytes), listed by Spark; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.select(_partition_value("day").alias("day"), _partition_value("feed").alias("feed"),
                        F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("n_bytes"))


def drop_days(path: str, days: DataFrame) -> None:
    """T4: delete the day folders of an output tree named by ``days`` (column day); one folder per row."""
    spark = days.sparkSession
    for r in days.select(F.col("day").cast("string").alias("day")).distinct().toLocalIterator():
        delete_path(spark, f"{path}/day={r['day']}")
