"""Fetched-body decoding (C2) and unmapped-character reports (C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text as T
from feedloom.functions.common import materialize
from feedloom.functions.html import meta_charset
from feedloom.functions.urls import header_charset


#: Bytes of a page in which a meta tag's charset is looked for.
META_BYTES = 4096


def choose_charset(rule_encoding, content_type, body=None) -> F.Column:
    """The site's configured encoding, else the header's last charset, else (with ``body``) that of a
    meta tag near the page's start (H13), else utf-8."""
    cfg = F.coalesce(rule_encoding, F.lit(""))
    hdr = F.coalesce(header_charset(content_type), F.lit(""))
    meta = F.lit("")
    if body is not None:  # markup is ASCII in every charset a meta tag can name
        meta = F.coalesce(meta_charset(F.decode(F.substring(body, 1, META_BYTES), "ISO-8859-1")), F.lit(""))
    return F.lower(F.when(cfg != "", cfg).when(hdr != "", hdr).when(meta != "", meta).otherwise(F.lit("utf-8")))


def decode_bodies(responses: DataFrame, body_col: str = "body", charset_col: str = "charset",
                  out: str = "text") -> DataFrame:
    """BINARY bodies to text.

    Valid UTF-8 declared as UTF-8 stays native (a cast, checked by
    ``is_valid_utf8``); only the other rows go through the Python decoder,
    so the slow path sees only legacy-charset or broken bodies; the others
    reach it as nulls, and the bodies are read once.
    """
    cs = F.col(charset_col)
    as_text = F.col(body_col).cast("string")
    fast = F.coalesce(cs.isin("utf-8", "utf8") & F.is_valid_utf8(as_text), F.lit(False))
    tagged = materialize(responses, _fast=fast)
    slow = T.decode_bytes(F.when(~F.col("_fast"), F.col(body_col)), cs)
    return tagged.withColumn(out, F.when(F.col("_fast"), as_text).otherwise(slow)).drop("_fast")


def unmapped_report(docs: DataFrame, text_col: str = "text", key: str = "doc_id",
                    only_unmapped: bool = True) -> DataFrame:
    """C4: every character the ASCII fold cannot map (or, with ``only_unmapped``
    off, every non-ASCII character with a ``mapped`` flag), counted, with one
    context example.

    The per-character count and example are partial aggregates, so a
    character present in a third of all documents is still spread over all
    tasks.
    """
    # only text with non-ASCII characters is normalised, and only normalised
    # text that still has an unmapped character is scanned for context
    raw = docs.select(key, text_col).filter(F.col(text_col).rlike(r"[^\x00-\x7F]"))
    # the barrier keeps the filter from normalising a second time
    norm = materialize(raw.select(key, T.nfkd(F.col(text_col)).alias("_n")), _n=F.col("_n"))
    cls = T.unmapped_class() if only_unmapped else r"[^\x00-\x7F]"
    norm = norm.filter(F.col("_n").rlike(cls))
    chars, before, after = T.unmapped_chars(F.col("_n"), cls)
    hits = norm.select(key, F.posexplode(F.arrays_zip(chars.alias("c"), before.alias("b"), after.alias("a")))
                       .alias("i", "m"))
    return (hits.groupBy(F.col("m.c").alias("char"))
            .agg(F.count(F.lit(1)).cast("long").alias("n"),
                 F.min_by(F.concat(F.col("m.b"), F.col("m.c"), F.col("m.a")), F.struct(key, "i")).alias("example"))
            .withColumn("code", F.format_string("U+%04X", F.ascii(F.col("char"))))
            .withColumn("mapped", F.array_contains(F.array(*[F.lit(k) for k in T.FOLD_TABLE]), F.col("char"))))
