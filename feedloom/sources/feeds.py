"""RSS / Atom feed files as entry rows (S1), and writing them.

Reading: each feed file is read as bytes (one feed document per row - a feed
file is small) and decoded by its byte order mark or the encoding of its XML
declaration.  Its items are cut out in document order - a ``<`` within CDATA
sections and comments cuts nothing - and parsed with ``from_xml`` against a
fixed item schema, so ``pos`` is the item's index in its file (row order of
the XML source is not a contract).  RSS 0.9x/2.0 ``<item>`` and RSS 1.0 (RDF)
items share the schema; Atom ``<entry>`` uses ``ATOM_SCHEMA``.  Everything up
to the entries of a file is one projection of its row, so it works on a
stream of files as on a batch (``read_entries``, ``stream_entries``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.common import materialize
from feedloom.operators.decode import decode_bodies
from feedloom.session import ship_package

ITEM_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("guid", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("dc:creator", T.StringType()),
    T.StructField("dc:date", T.StringType()),
    T.StructField("content:encoded", T.StringType()),
])

ATOM_LINK = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in ("href", "rel", "type")])

ATOM_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("link", T.ArrayType(ATOM_LINK)),
    T.StructField("author", T.StructType([T.StructField("name", T.StringType())])),
])

#: Rows of Spark's binary file source.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Sections whose text is no markup, and the sign that stands for their '<' while items are cut (no XML document holds it).
PLAIN_SECTIONS = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->"
HIDDEN = "\u0001"


def declared_charset(body) -> Column:
    """The charset of a feed file: byte order mark, else the XML declaration's encoding, else utf-8."""
    mark = F.hex(F.substring(body, 1, 3))
    head = F.decode(F.substring(body, 1, 200), "ISO-8859-1")
    named = F.lower(F.regexp_extract(head, r"^\s*<\?xml[^>]*\bencoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']", 1))
    return (F.when(mark == "EFBBBF", "utf-8-sig").when(mark.startswith("FEFF") | mark.startswith("FFFE"), "utf-16")
            .when(named != "", named).otherwise("utf-8"))


def feed_docs(files: DataFrame) -> DataFrame:
    """(feed_file, value): the text of each feed file (rows of the binary file source)."""
    d = files.select(F.col("path").alias("feed_file"), F.col("content").alias("body"), declared_charset(F.col("content")).alias("cs"))
    return decode_bodies(d, "body", "cs", "value").select("feed_file", F.coalesce("value", F.lit("")).alias("value"))


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    ship_package(spark)
    return feed_docs(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def _items(docs: DataFrame, tag: str) -> DataFrame:
    """(docs' columns but value, pos, xml): the elements ``tag`` of each document, in order."""
    hidden = F.array_join(F.zip_with(
        F.split("value", PLAIN_SECTIONS, -1),
        F.concat(F.transform(F.regexp_extract_all("value", F.lit(PLAIN_SECTIONS), F.lit(0)),
                             lambda s: F.replace(s, F.lit("<"), F.lit(HIDDEN))), F.array(F.lit(""))),
        lambda text, section: F.concat(text, section)), "")
    plain = F.when(F.contains("value", F.lit("<!")), hidden).otherwise(F.col("value"))
    d = materialize(docs, value=plain)
    found = F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}\b.*?</{tag}\s*>"), F.lit(0))
    keep = [c for c in docs.columns if c != "value"]
    return d.select(*keep, F.posexplode(found).alias("pos", "xml")).select(
        *keep, F.col("pos").cast("long").alias("pos"), F.replace("xml", F.lit(HIDDEN), F.lit("<")).alias("xml"))


def _parsed(docs: DataFrame, atom: bool) -> DataFrame:
    items = _items(docs, "entry" if atom else "item")
    e = F.from_xml("xml", ATOM_SCHEMA if atom else ITEM_SCHEMA, {"ignoreSurroundingSpaces": "false"}).alias("e")
    return items.select(*[c for c in items.columns if c != "xml"], e).select(
        *[c for c in items.columns if c != "xml"], "e.*")


def read_feed_files(spark: SparkSession, path: str, atom: bool = False) -> DataFrame:
    """Feed files -> entries (feed_file, pos, fields...)."""
    return _parsed(read_docs(spark, path), atom)


def doc_title(value) -> Column:
    """The channel's (or Atom feed's) own title, '' when it has none."""
    head = F.regexp_extract(value, r"(?s)<(?:channel|feed)\b[^>]*>(.*?)(?:<item\b|<entry\b|</channel>|</feed>|\z)", 1)
    title = F.regexp_extract(head, r"(?s)<title\b[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(title, r"(?s)\A\s*<!\[CDATA\[(.*)\]\]>\s*\z", "$1"))


def _file_title(value) -> Column:
    name = F.regexp_extract("feed_file", r"([^/]*)$", 1)
    return F.coalesce(F.nullif(doc_title(value), F.lit("")), F.concat(F.lit("["), name, F.lit("]")))


def doc_entries(docs: DataFrame) -> DataFrame:
    """Rows of ``entries.ENTRY_SCHEMA`` (``feed_url``: the file; ``pos``: the place in it) from feed texts, batch or stream."""
    none, no_links = F.lit(None).cast("string"), F.lit(None).cast("array<struct<href:string,rel:string,type:string>>")
    titled = docs.withColumn("feed_title", _file_title("value"))
    rss, atom = _parsed(titled, False), _parsed(titled, True)
    r = rss.select("feed_file", "feed_title", "pos", F.col("guid").alias("id"), "guid", "link", no_links.alias("links"), "title",
                   F.coalesce("author", "`dc:creator`").alias("author"),
                   F.coalesce("pubDate", "`dc:date`").alias("published"), none.alias("updated"),
                   F.col("`content:encoded`").alias("content"), none.alias("summary_detail"), none.alias("summary"),
                   "description")
    links = F.transform("link", lambda x: F.struct(x["_href"].alias("href"), F.coalesce(x["_rel"], F.lit("alternate"))
                                                   .alias("rel"), x["_type"].alias("type")))
    a = atom.withColumn("links", links)
    first = F.get(F.filter("links", lambda x: x["rel"] == "alternate"), F.lit(0))["href"]
    a = a.select("feed_file", "feed_title", "pos", "id", none.alias("guid"), first.alias("link"), "links", "title",
                 F.col("author.name").alias("author"), "published", "updated", "content",
                 none.alias("summary_detail"), "summary", none.alias("description"))
    return r.unionByName(a)


def over_files(items: DataFrame, feed=None) -> DataFrame:
    """The entries of files as those of feeds: ``pos`` counts on over the files of a feed in file name order."""
    items = items.withColumn("feed", F.col("feed_title") if feed is None else feed)
    # one small row per file: how many items the feed's earlier files hold
    n = items.groupBy("feed", "feed_file").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("feed", "feed_file", F.coalesce(F.sum("n").over(
        Window.partitionBy("feed").orderBy("feed_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return items.join(before, ["feed", "feed_file"]).select(
        "feed", F.col("feed_file").alias("feed_url"), (F.col("pos") + F.col("before")).alias("pos"),
        *[c for c in items.columns if c not in ("feed", "feed_file", "feed_title", "pos")])


def read_entries(spark: SparkSession, path: str, feed=None) -> DataFrame:
    """RSS, RDF and Atom files as rows of ``entries.ENTRY_SCHEMA``.

    ``feed`` is a column over ``feed_file`` that names the feed (default: the
    file's title).  Atom: the link is the first alternate one (no rel counts as
    alternate), links keeps them all; dc:creator, dc:date and content:encoded
    stand in for author, pubDate and content.
    """
    return over_files(doc_entries(read_docs(spark, path)), feed)


def stream_entries(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """S1 as a stream: the entries of feed files as they arrive, each numbered within its file (see ``over_files``)."""
    ship_package(spark)
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return doc_entries(feed_docs(reader.load(path)))


def write_feed_files(items: DataFrame, path: str, feed_col: str = "feed") -> None:
    """Write items as RSS channels with Spark's XML source, one folder per feed,
    items in ``pos`` order inside each file.

    Rows are dealt by ranges of (feed, pos), so the files number the tasks and the
    feeds, not their product; a large feed spans several files, whose names keep its order."""
    (items.repartitionByRange(feed_col, "pos").sortWithinPartitions(feed_col, "pos").drop("pos")
     .write.mode("overwrite").partitionBy(feed_col).format("xml")
     .option("rootTag", "channel").option("rowTag", "item").save(path))


def read_feed_titles(spark: SparkSession, path: str) -> DataFrame:
    """Each feed file's channel (or Atom feed) title, '[file]' when it has none."""
    return read_docs(spark, path).select("feed_file", _file_title("value").alias("title"))
