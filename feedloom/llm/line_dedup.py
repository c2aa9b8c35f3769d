"""Line dedup by overlapping three-line windows (DataFrame functions only).

Every three consecutive non-blank lines of a text are a window.  A window's
first occurrence in (id, position) order stays; the lines that any later
occurrence covers go, overlapping occurrences merging into one covered set.

Defined cases: a null text stays null, a text of fewer than three non-blank
lines is left alone; blank lines take no part and stay; lines are compared
without surrounding white space; a later occurrence that overlaps the first
one in the same text spares the lines of the first; rows that repeat an id
(null ids too) count as one document and get the same removals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import table

SPAN = 3
#: White space that does not count when lines are compared.
BLANKS = " \\t\\r\\u000B\\f"

_LINES = f"""filter(transform(split(text, '\\n', -1), (l, i) -> struct(i AS i, trim(BOTH '{BLANKS}' FROM l) AS l)),
                    x -> x.l <> '')"""
_WINDOWS = """transform(IF(size(ls) >= 3, sequence(0, size(ls) - 3), CAST(array() AS array<int>)), k -> struct(
    k AS k, array(ls[k].i, ls[k + 1].i, ls[k + 2].i) AS lines,
    xxhash64(ls[k].l, ls[k + 1].l, ls[k + 2].l) AS h1,
    xxhash64('w', ls[k + 2].l, ls[k].l, ls[k + 1].l) AS h2))"""


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lines): per document with later occurrences, the sorted line numbers they cover."""
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    win = table(thin.select("id", F.expr(_LINES).alias("ls")).where("size(ls) >= 3")
                .select("id", F.explode(F.expr(_WINDOWS)).alias("w")).select("id", "w.*"))
    first = (win.groupBy("h1", "h2").agg(F.min(F.struct("id", "k")).alias("first"),
                                         F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = (win.join(first, ["h1", "h2"])
             .where("struct(id, k) > first")
             .withColumn("o", F.expr("IF(id <=> first.id, greatest(0, first.k + 3 - k), 0)")))
    return (later.select("id", F.explode(F.expr("slice(lines, o + 1, 3 - o)")).alias("line")).distinct()
            .groupBy("id").agg(F.sort_array(F.collect_list("line")).alias("lines")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the repeated lines out of ``text_col``.

    The columns come back under a struct ``row`` beside ``text`` (what is
    left), ``n_lines`` and ``n_removed``, so no column of the input can clash.
    """
    covered = covered_lines(docs, id_col, text_col).select(F.col("id").alias("cid"), F.col("lines").alias("gone"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(id_col).alias("id"), F.col(text_col).alias("src"))
    j = base.join(covered, F.col("id").eqNullSafe(F.col("cid")), "left")
    parts = F.expr("split(src, '\\n', -1)")
    j = j.withColumn("parts", F.when(F.col("gone").isNotNull(), parts))
    left = F.expr("""IF(gone IS NULL, src, array_join(transform(
        array_except(sequence(0, size(parts) - 1), gone), i -> parts[i]), '\\n'))""")
    return j.select("row", "id", left.alias("text"),
                    F.expr("coalesce(CAST(length(src) - length(replace(src, '\\n', '')) + 1 AS bigint), 0L)")
                    .alias("n_lines"),
                    F.expr("CAST(coalesce(size(gone), 0) AS bigint)").alias("n_removed"))


def query(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text (what is left)."""
    return dedup_lines(docs).select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "text")


#: Independent DuckDB form over the same table.
SQL = """
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, i, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM l),
nb AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM b WHERE t <> ''),
w AS (SELECT doc_id, k, t AS a, lead(t) OVER p AS b, lead(t, 2) OVER p AS c FROM nb
      WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
o AS (SELECT *, first_value(doc_id) OVER q AS fd, first_value(k) OVER q AS fk FROM w WHERE c IS NOT NULL
      WINDOW q AS (PARTITION BY a, b, c ORDER BY doc_id, k)),
g AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(k, fk + 3) ELSE k END, k + 3)) AS k
      FROM o WHERE doc_id <> fd OR k <> fk),
gone AS (SELECT nb.doc_id, nb.i FROM g JOIN nb ON nb.doc_id = g.doc_id AND nb.k = g.k),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
                coalesce(string_agg(CASE WHEN gone.i IS NULL THEN l.raw END, chr(10) ORDER BY l.i), '') AS text
         FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
