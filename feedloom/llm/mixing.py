"""Mixing sources to target weights: whole copies, then Pareto order sampling.

Every document of a source is to be taken target / source_size times on
average.  The whole part of that number is certain.  For the fractional part f
the documents are ranked by xi = (u / (1 - u)) / (f / (1 - f)), random odds
over inclusion odds, u being a hash of id and size.  A document with more words
than its source may leave out (source_size less the words still needed) is
certain, since without it the target cannot be reached: such documents rank
before all others.  The ranking is gone down to its end, a document that no
longer fits what the source still needs being skipped; at last the document
that brings the source nearest to its target, if one does, comes in too.

No source is ever sorted in one task.  A round sums the words of the documents
that still fit in a histogram of the ranking (BINS bins, map-side), finds the
bin in which they stop fitting, and ranks that bin's documents alone.  The next
round goes on below the document that did not fit.  Each such document is
larger than the gap it leaves, so the gap shrinks by about half a round.

Defined cases: null texts have size 0 and are never taken; a null source is a
source (the last one); rows equal in id, size and source share one fate, and so
do rows equal in rank; a null id hashes as the empty text; no documents give no
rows; a column of the documents that has the name of a computed one stays, and
the computed one is called ``mix_`` and its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import BROADCAST_ROWS, broadcast_if_small, table

#: Weights repeat over the sources in order; share of all words; most copies of a source.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BINS = 1 << 16

SIZE = "CAST(IF(text IS NULL, 0, regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')) AS bigint)"


def _u(seed: int) -> str:
    return (f"((CAST(conv(substr(md5(concat(coalesce(CAST(doc_id AS string), ''), ':', CAST(size AS string), ':{seed}')),"
            f" 1, 13), 16, 10) AS double) + 0.5D) / 4503599627370496.0D)")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` of all words by weight; a target stops at ``most`` times its
    source and the excess goes to the others by weight until none is above:
    target = min(cap, level x weight) with one common level.  The rows are one
    per source, so the windows over all of them stay small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    lit = "array(" + ", ".join(f"{float(w)}D" for w in weights) + ")"
    t = (sources.withColumn("n", F.row_number().over(by_name))
         .withColumn("w", F.expr(f"{lit}[(n - 1) % {len(weights)}]"))
         .withColumn("cap", F.col("source_size") * F.lit(float(most))))
    fill = Window.orderBy((F.col("cap") / F.col("w")), "n")
    everything = Window.partitionBy()
    t = (t.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("sum_w", F.sum("w").over(everything))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("w_before", F.coalesce(F.sum("w").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("level", (F.col("goal") - F.col("cap_before")) / (F.col("sum_w") - F.col("w_before")))
         .withColumn("level", F.max(F.expr("IF(level * w <= cap, level, NULL)")).over(everything)))
    return t.select("source", F.col("source_size").cast("bigint").alias("source_size"),
                    F.expr("least(cap, coalesce(level * w, cap))").alias("target"))


def _with_pos(rows: DataFrame, seed: int) -> DataFrame:
    """Place of each row in its source's ranking, 0 to 1: certain documents in the lower half, then by xi."""
    return (rows.withColumn("u", F.expr(_u(seed)))
            .withColumn("xi", F.expr("IF(f > 0, (u / (1 - u)) / (f / (1 - f)), NULL)"))
            .withColumn("pos", F.expr("IF(size > source_size - need, 0D, 0.5D) + xi / (1 + xi) / 2")).drop("u", "xi"))


def draw(sized: DataFrame, goals: DataFrame, seed: int = 0) -> DataFrame:
    """Per source: whole copies, the stretches of the ranking that are taken, and the last document.

    ``sized`` is (doc_id, source, size), written; ``goals`` is (source,
    source_size, target).  A stretch (lo, hi, cap) takes the documents of at
    most ``cap`` words that rank between ``lo`` and ``hi``.
    """
    goals = table(goals.withColumn("ratio", F.expr("IF(source_size > 0, target / source_size, 0D)"))
                  .withColumn("whole", F.floor("ratio"))
                  .withColumn("f", F.col("ratio") - F.col("whole"))
                  .withColumn("need", F.expr("CAST(floor(f * source_size) AS bigint)")).drop("ratio"))
    # every table of rows per source below has as many rows as this one at most
    few = goals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def hinted(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    j = sized.where("size > 0").join(
        hinted(goals.where("f > 0").select(F.col("source").alias("s"), "source_size", "f", "need")),
        F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranked = table(_with_pos(j, seed).groupBy("doc_id", "source", "size", "pos")
                   .agg((F.count(F.lit(1)) * F.col("size")).alias("mass"))
                   .select("source", "size", "pos", "mass", F.expr(f"CAST(least(floor(pos * {BINS}), {BINS - 1}) AS int)").alias("bin")))
    cut = goals.select("*", F.col("need").alias("gap"), F.lit(-1.0).alias("lo"), F.lit(0).cast("bigint").alias("least"),
                       F.expr("CAST(array() AS array<struct<lo: double, hi: double, cap: bigint>>)").alias("takes"),
                       F.expr("need > 0").alias("open"))
    first = True
    while first or not cut.where("open").isEmpty():
        rest = ranked.join(hinted(cut.where("open").select(F.col("source").alias("s"), "lo", "gap")),
                           F.col("source").eqNullSafe(F.col("s"))).where("pos > lo AND size <= gap").drop("s")
        bins = rest.groupBy("source", "gap", "bin").agg(F.sum("mass").alias("mass"), F.min("size").alias("least"))
        bins = bins.withColumn("upto", F.sum("mass").over(Window.partitionBy("source").orderBy("bin")))
        edge = table(bins.groupBy("source").agg(
            F.min(F.expr("IF(upto > gap, struct(bin, upto - mass AS before), NULL)")).alias("e"),
            F.sum("mass").alias("all"), F.min("least").alias("least")))
        inside = (rest.join(hinted(edge.where("e IS NOT NULL").select(F.col("source").alias("s"), F.col("e.bin").alias("b"), "e.before")),
                            F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
                  .withColumn("upto", F.col("before") + F.sum("mass").over(Window.partitionBy("source").orderBy("pos"))))
        stop = inside.groupBy(F.col("source").alias("s1")).agg(
            F.min(F.expr("IF(upto > gap, pos, NULL)")).alias("stop"), F.max(F.expr("IF(upto <= gap, upto, before)")).alias("got"))
        found = edge.select(F.col("source").alias("s2"), "all", F.col("least").alias("smallest"))
        cut = (cut.join(hinted(found), F.col("source").eqNullSafe(F.col("s2")), "left")
               .join(hinted(stop), F.col("source").eqNullSafe(F.col("s1")), "left")
               .withColumn("takes", F.expr("IF(all IS NULL, takes, array_append(takes, struct(lo, coalesce(stop, 2D) AS hi, gap AS cap)))"))
               .withColumn("gap", F.expr("gap - IF(all IS NULL, 0L, IF(stop IS NULL, all, got))"))
               .withColumn("least", F.expr("coalesce(smallest, least)"))
               .withColumn("open", F.expr("stop IS NOT NULL AND gap >= least"))
               .withColumn("lo", F.expr("coalesce(stop, lo)")).drop("s1", "s2", "all", "smallest", "stop", "got"))
        cut, first = table(cut), False
    left = (ranked.join(hinted(cut.select(F.col("source").alias("s"), "takes", "gap")), F.col("source").eqNullSafe(F.col("s")))
            .where(f"abs(gap - mass) < gap AND NOT {_TAKEN}"))
    last = left.groupBy(F.col("source").alias("s")).agg(
        F.min_by("pos", F.struct(F.expr("abs(gap - mass)"), "pos")).alias("last"))
    return table(cut.join(hinted(last), F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "gap", "lo", "least", "open"))


_TAKEN = "exists(takes, r -> pos > r.lo AND pos < r.hi AND size <= r.cap)"


def copies(rows: DataFrame, cuts: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` (with doc_id, source, size) and how often each is taken, by the per-source cuts."""
    c = broadcast_if_small(cuts).withColumnRenamed("source", "s")
    j = _with_pos(rows.join(c, F.col("source").eqNullSafe(F.col("s")), "left"), seed)
    extra = F.expr(f"CASE WHEN size = 0 OR f <= 0 THEN 0 WHEN {_TAKEN} OR pos <=> last THEN 1 ELSE 0 END")
    return j.withColumn("copies", F.expr("IF(size > 0, whole, 0L)") + extra).drop(
        "s", "whole", "f", "need", "takes", "last", "pos")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "source").select("doc_id", "source", F.expr(SIZE).alias("size"))


def plan(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The written (doc_id, source, size) of all documents, and the per-source cuts."""
    s = table(sized(docs))
    goals = targets(s.groupBy("source").agg(F.sum("size").alias("source_size")))
    return s, draw(s, goals, seed)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document."""
    s, cuts = plan(docs)
    return copies(s, cuts).select("doc_id", "source", "size", "source_size", "target",
                                  F.col("copies").cast("bigint").alias("copies"),
                                  (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, all their columns, with size, source_size, target, copies and taken."""
    _, cuts = plan(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
                       F.expr(SIZE).alias("size"))
    out = copies(rows, cuts).where("copies > 0")
    has = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return free(f"mix_{name}") if name.lower() in has else name

    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns],
                      *[F.col(c).alias(free(c)) for c in ("size", "source_size", "target")],
                      F.col("copies").cast("bigint").alias(free("copies")),
                      (F.col("copies") * F.col("size")).cast("bigint").alias(free("taken")))


#: Independent DuckDB form: each source's whole ranking is folded in order, document by document.
SQL = """
WITH s AS (SELECT doc_id, source,
    CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size
  FROM documents),
t0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
t1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM t0),
t2 AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
    source_size * 2.0::DOUBLE AS cap FROM t1),
t3 AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS goal, sum(w) OVER () AS sw,
    coalesce(sum(cap) OVER p, 0) AS cb, coalesce(sum(w) OVER p, 0) AS wb FROM t2
  WINDOW p AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t4 AS (SELECT *, (goal - cb) / (sw - wb) AS lv FROM t3),
t5 AS (SELECT source, source_size, least(cap, coalesce((SELECT max(lv) FROM t4 WHERE lv * w <= cap) * w, cap)) AS target
  FROM t4),
t6 AS (SELECT *, CAST(floor(f * source_size) AS BIGINT) AS need FROM (SELECT *,
    floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END
      - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS f FROM t5)),
u AS (SELECT s.doc_id, s.source, s.size, CAST(sum(s.size) AS BIGINT) AS mass, t6.f, t6.need, t6.source_size,
    (CAST(('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || s.size || ':0'), 1, 13)) AS BIGINT)::DOUBLE
      + 0.5) / 4503599627370496.0 AS u
  FROM s JOIN t6 ON s.source IS NOT DISTINCT FROM t6.source WHERE s.size > 0 AND t6.f > 0 GROUP BY ALL),
x AS (SELECT *, (u / (1 - u)) / (f / (1 - f)) AS xi FROM u),
k AS (SELECT *, CASE WHEN size > source_size - need THEN 0::DOUBLE ELSE 0.5::DOUBLE END + xi / (1 + xi) / 2 AS pos FROM x),
g AS (SELECT source, need, list({'pos': pos, 'mass': CAST(mass AS BIGINT), 'gap': 0::BIGINT, 'took': []::DOUBLE[]} ORDER BY pos) AS ranking
  FROM k GROUP BY source, need),
h AS (SELECT source, list_reduce(ranking, lambda a, d: CASE WHEN d.mass <= a.gap
      THEN {'pos': 0::DOUBLE, 'mass': 0::BIGINT, 'gap': a.gap - d.mass, 'took': list_append(a.took, d.pos)} ELSE a END,
    {'pos': 0::DOUBLE, 'mass': 0::BIGINT, 'gap': need, 'took': []::DOUBLE[]}) AS r FROM g),
v AS (SELECT source, unnest(r.took) AS pos FROM h),
z AS (SELECT k.source, min_by(k.pos, {'a': abs(h.r.gap - mass), 'b': k.pos}) AS pos
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source
  WHERE abs(h.r.gap - mass) < h.r.gap AND NOT list_contains(h.r.took, k.pos) GROUP BY k.source),
w AS (SELECT * FROM v UNION ALL SELECT * FROM z),
y AS (SELECT k.doc_id, k.source, k.size FROM k JOIN w ON k.source IS NOT DISTINCT FROM w.source AND k.pos = w.pos)
SELECT s.doc_id, s.source, s.size, t6.source_size, t6.target,
  CAST(CASE WHEN s.size > 0 THEN t6.whole + CASE WHEN y.size IS NULL THEN 0 ELSE 1 END ELSE 0 END AS BIGINT) AS copies,
  CAST(s.size * CASE WHEN s.size > 0 THEN t6.whole + CASE WHEN y.size IS NULL THEN 0 ELSE 1 END ELSE 0 END AS BIGINT) AS taken
FROM s JOIN t6 ON s.source IS NOT DISTINCT FROM t6.source
LEFT JOIN y ON y.doc_id IS NOT DISTINCT FROM s.doc_id AND y.source IS NOT DISTINCT FROM s.source AND y.size = s.size
"""
