"""Benchmark decontamination by winnowing.

Of the hashes of every GRAM consecutive words, the smallest of each SLIDE
consecutive ones is a fingerprint, in the documents and in the benchmark.  Two
texts that share WINDOW = GRAM + SLIDE - 1 consecutive words share the
fingerprint of that stretch.  Fingerprints are joined, each match is extended
word by word to both sides (by at most WINDOW - GRAM, all that a window
around it can need), and a stretch of WINDOW words or more is a hit.

An item shorter than a window is one window by itself; its n words are looked
up as an n-word gram of the documents.

Document fingerprints go through a membership bitmap of fixed size before
they leave the task, so what is shuffled are the matches and a few false ones
that the exact join on the words drops.

Defined cases: null and empty texts have no words; an item without words
matches nothing; rows that repeat a doc_id unite their hits (identical rows:
the same result each); an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import IDS, bitmap_of, broadcast_if_small, in_bitmap, map_arrow, table
from feedloom.llm.words import Words, chunks, mix

WINDOW = 10
GRAM = 5
SLIDE = WINDOW - GRAM + 1
SIDE = WINDOW - GRAM


def winnowed(words: Words) -> np.ndarray:
    """Positions of the fingerprints: every smallest gram of SLIDE consecutive ones of a text."""
    g, _ = words.grams(GRAM)
    n = len(g)
    chosen = np.zeros(n, bool)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    m = n - WINDOW + 1
    low = g[:m].copy()
    for j in range(1, SLIDE):
        np.minimum(low, g[j:m + j], out=low)
    inside = np.arange(m) + WINDOW <= words.first[1:][words.doc[:m]]
    for j in range(SLIDE):
        chosen[j:m + j] |= inside & (g[j:m + j] == low)
    return np.flatnonzero(chosen)


def _rows(words: Words, at: np.ndarray, length: int, fp: np.ndarray, side: int) -> list[tuple]:
    """(row of the chunk, fingerprint, word position in the text, words before, the gram, words after)."""
    out = []
    for i, h in zip(at.tolist(), fp.tolist(), strict=True):
        d = int(words.doc[i])
        lo, hi = int(words.first[d]), int(words.first[d + 1])
        out.append((d, h, i - lo, words.text(max(lo, i - side), i), words.text(i, i + length),
                    words.text(i + length, min(hi, i + length + side))))
    return out


def _hash(g: np.ndarray, kind: int) -> np.ndarray:
    return mix(g ^ np.uint64(kind)).view(np.int64)


def _schema(id_type: str) -> str:
    return (f"id {id_type}, kind int, fp bigint, pos int, n_words bigint, before string, gram string, after string")


_COLS = ["id", "kind", "fp", "pos", "n_words", "before", "gram", "after"]


def _batch(ids: pa.Array, base: int, rows: list[tuple], kinds: list[int], n: np.ndarray) -> pa.RecordBatch:
    take = pa.array([base + r[0] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays([
        ids.take(take), pa.array(kinds, pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.int32()), pa.array([int(n[r[0]]) for r in rows], pa.int64()),
        pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.string()),
        pa.array([r[5] for r in rows], pa.string())], names=_COLS)


def item_prints(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of the benchmark: kind 0, or kind n for a whole item of n < WINDOW words."""
    id_type = items.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, _, data, off in chunks(batch.column(1)):
                w = Words(data, off)
                at = winnowed(w)
                rows = _rows(w, at, GRAM, _hash(w.grams(GRAM)[0][at], 0), SIDE)
                kinds = [0] * len(rows)
                for n in range(1, WINDOW):
                    own = np.flatnonzero(w.count == n)
                    if len(own):
                        first = w.first[own]
                        rows += _rows(w, first, n, _hash(w.grams(n)[0][first], n), 0)
                        kinds += [n] * len(own)
                yield _batch(batch.column(0), lo, rows, kinds, w.count)

    return map_arrow(items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, _schema(id_type))


def doc_prints(docs: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray, short: list[int]) -> DataFrame:
    """One row per document (kind -1, n_words) and one per fingerprint that the bitmap lets through."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        known = shared.value
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                w = Words(data, off)
                rows = [(d, None, None, None, None, None) for d in range(hi - lo)]
                kinds = [-1] * (hi - lo)
                for kind, length, at, side in [(0, GRAM, winnowed(w), SIDE)] + [(n, n, None, 0) for n in short]:
                    g, ok = w.grams(length)
                    at = np.flatnonzero(ok) if at is None else at
                    fp = _hash(g[at], kind)
                    hit = in_bitmap(known, fp)
                    new = _rows(w, at[hit], length, fp[hit], side)
                    rows += new
                    kinds += [kind] * len(new)
                yield _batch(batch.column(0), lo, rows, kinds, w.count)

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, _schema(id_type))


def _extent(doc: str, item: str, sign: str) -> str:
    """Equal words outward from the gram: sign '-' leftwards, '' rightwards."""
    return f"""aggregate(sequence(1, {SIDE}), 0, (a, i) -> IF(a = i - 1 AND
        try_element_at({doc}, {sign}i) = try_element_at({item}, {sign}i), i, a))"""


def hits(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item_id, start, stop): stretches of document words inside an occurrence of an item's window."""
    def side(c):
        return F.expr(f"filter(split({c}, ' '), x -> x <> '')")

    d = prints.where("kind >= 0").select("id", "kind", "fp", "gram", "pos", side("before").alias("db"), side("after").alias("da"))
    i = (items.select(F.col("id").alias("item_id"), "kind", "fp", "gram", side("before").alias("ib"), side("after").alias("ia"))
         .distinct())
    j = d.join(i, ["kind", "fp", "gram"])
    j = (j.withColumn("l", F.expr(_extent("db", "ib", "-"))).withColumn("r", F.expr(_extent("da", "ia", "")))
         .withColumn("len", F.expr(f"IF(kind = 0, {GRAM}, kind)"))
         .where(f"l + len + r >= IF(kind = 0, {WINDOW}, kind)"))
    return j.select("id", "item_id", F.expr("pos - l").alias("start"), F.expr("pos + len + r").alias("stop")).distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted as strings)."""
    known = table(item_prints(items, item_id, item_text))
    short = sorted(r["kind"] for r in known.where("kind > 0").select("kind").distinct().collect())  # below WINDOW
    prints = table(doc_prints(docs, id_col, text_col, bitmap_of(known, "fp"), short))
    found = table(hits(prints, known))
    order = Window.partitionBy("id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = (found.select("id", "start", "stop").distinct()
               .withColumn("until", F.coalesce(F.max("stop").over(order), F.lit(0)))
               .groupBy("id").agg(F.sum(F.expr("greatest(0, stop - greatest(start, until))")).alias("n_hit")))
    which = (found.select("id", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"), F.count(F.lit(1)).alias("n_items")))
    per_doc = covered.alias("c").join(which.alias("w"), F.expr("c.id <=> w.id")).select(
        F.col("c.id").alias("hid"), "n_hit", "n_items", "items")
    base = prints.where("kind = -1").select("id", "n_words")
    return base.join(per_doc, F.expr("id <=> hid"), "left").select(
        "id", "n_words", F.expr("coalesce(n_hit, 0L)").alias("n_hit"), F.expr("coalesce(n_items, 0L)").alias("n_items"),
        F.expr("coalesce(items, CAST(array() AS array<string>))").alias("items"))


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without any hit, all their columns."""
    bad = table(contamination(docs, items, id_col).where("n_hit > 0").select(F.col("id").alias("hid")).distinct())
    return docs.alias("d").join(broadcast_if_small(bad, IDS).alias("k"),
                                F.col(f"d.{id_col}").eqNullSafe(F.col("k.hid")), "left_anti")


#: Independent DuckDB form: all windows of all texts, joined as strings.
SQL = """
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
ip AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM ip),
ns AS (SELECT DISTINCT n FROM ig),
dp AS (SELECT doc_id, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM dw, ns WHERE len(w) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dp),
h AS (SELECT DISTINCT doc_id, item_id, dg.n, i FROM dg JOIN ig ON dg.n = ig.n AND dg.g = ig.g),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(dw.w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN dw ON dw.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
