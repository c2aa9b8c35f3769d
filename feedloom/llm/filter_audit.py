"""Filter interaction audit by failing-id relations.

Every filter has one stored table of the documents that fail it (a folder of
ids per filter).  What a filter removes after a prefix of other filters is its
id table left-anti joined with the tables of that prefix; what was gone
already is the left-semi join; label losses are the same joins over the ids
that semi-join the labels.  A prefix is a set: 16 sets stand before each of
five filters, so all 120 orders need 80 pairs (filter, set), which meet the id
tables in one join on the id.  Only failing ids move; documents that fail
nothing are counted once per part and survive every prefix.

Filters over whole texts (null: empty; words: ``[^\\x20\\x09-\\x0D]+``):
A under 100 words; B distinct words under 80 %; C capitals over 10 % of code
points; D any of ``#$%&*|``; E equal to the text of a smaller id.

Defined cases: null and empty ``lang`` are the part ''; rows that repeat an id
within a part (null ids too) are one document that fails what any of them
fails; rows with a null id have no smaller id and are nobody's smaller id; a
label counts if any label row of the id says so, labels without a document
and null labels say nothing; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import table

#: Failure conditions within a row; E needs the other rows.
ROW_FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_caps > 10 * n_points",
    "D": "text RLIKE '[#$%&*|]'",
}
COPY_FILTER = "E"
#: Texts held by at least this share of the rows are matched apart from the others; at most 1 / share exist.
HOT_SHARE = 1e-3


def row_facts(docs: DataFrame) -> DataFrame:
    """(part, id, digest, A, B, C, D) of every row, from one pass over the texts."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = docs.select(F.expr("coalesce(lang, '')").alias("part"), F.col("doc_id").alias("id"),
                       F.expr("coalesce(text, '')").alias("text"))
    words = text.select("*", F.expr(r"array_remove(split(text, '[\\x20\\x09-\\x0D]+', -1), '')").alias("words"))
    sizes = words.select("part", "id", "text", F.expr("size(words)").alias("n_words"),
                         F.expr("size(array_distinct(words))").alias("n_distinct"),
                         F.expr("length(text)").alias("n_points"),
                         F.expr(f"length(text) - length(translate(text, '{capitals}', ''))").alias("n_caps"))
    return sizes.select("part", "id", F.expr("unhex(sha2(text, 256))").alias("digest"),
                        *[F.expr(cond).alias(f) for f, cond in ROW_FILTERS.items()])


def later_copies(facts: DataFrame) -> DataFrame:
    """(part, id) of rows whose digest a smaller id has.

    A digest of many rows must not gather them in one task: digests of at
    least HOT_SHARE of the rows (never more than 1 / HOT_SHARE of them) are
    broadcast, the others meet their rows by a shuffle.
    """
    known = facts.where("id IS NOT NULL")
    first = table(known.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"),
                                              F.count(F.lit(1)).alias("n")).where("last > first"))
    most = facts.count() * HOT_SHARE
    hot = F.broadcast(first.where(F.col("n") >= most).select(F.col("digest").alias("h"), "first"))
    rest = first.where(F.col("n") < most).select(F.col("digest").alias("h"), "first")
    seen = known.select("part", "id", "digest").join(hot, F.col("digest") == F.col("h"), "left")
    by_hot = seen.where("first IS NOT NULL AND id > first").select("part", "id")
    others = known.select("part", "id", "digest").join(hot, F.col("digest") == F.col("h"), "left_anti")
    by_rest = others.join(rest, F.col("digest") == F.col("h")).where("id > first").select("part", "id")
    return by_hot.unionByName(by_rest)


def store(relations: dict[str, DataFrame]) -> DataFrame:
    """The id tables of the filters, each (part, id) once, stored together with the filter's name beside it."""
    rows = None
    for name, ids in relations.items():
        one = ids.select(F.lit(name).alias("filter"), "part", "id")
        rows = one if rows is None else rows.unionByName(one)
    return table(rows.distinct())


def audit(population: DataFrame, failing: DataFrame, filters: str, labels: DataFrame) -> DataFrame:
    """One row per part, order of ``filters`` and step.

    ``population`` is (part, id), each once; ``failing`` is (filter, part, id),
    each once; ``labels`` is (id, label), label in good or toxic.
    """
    bit = {f: 1 << n for n, f in enumerate(filters)}
    everything = (1 << len(filters)) - 1
    mask_of = "CASE filter " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in bit.items()) + " END"
    # tag: all failing ids, and those that semi-join a label
    tagged = failing.select(F.lit("all").alias("tag"), "filter", "part", "id")
    for tag in ("good", "toxic"):
        own = labels.where(F.col("label") == tag).select(F.col("id").alias("lid"))
        tagged = tagged.unionByName(
            failing.join(own, F.col("id") == F.col("lid"), "left_semi")
            .select(F.lit(tag).alias("tag"), "filter", "part", "id"))
    key = F.struct("part", "id")
    own = tagged.select(key.alias("k"), "tag", "filter", "part", F.expr(mask_of).alias("own")).repartition("k")
    gone = failing.select(key.alias("g"), F.expr(mask_of).alias("gone")).repartition("g")
    # every set of other filters that may stand before the id's filter
    steps = own.withColumn("before", F.explode(F.expr(f"filter(sequence(0, {everything}), m -> m & own = 0)")))
    met = (F.col("k") == F.col("g")) & (F.col("before").bitwiseAND(F.col("gone")) != 0)

    def counted(rows: DataFrame, out: str) -> DataFrame:
        return rows.groupBy("part", "filter", "before", "tag").agg(F.count(F.lit(1)).alias(out))

    removed = counted(steps.join(gone, met, "left_anti"), "n")
    redundant = counted(steps.where("tag = 'all'").join(gone, met, "left_semi"), "n").withColumn("tag", F.lit("redundant"))
    cell = table(removed.unionByName(redundant).groupBy("part", "filter", "before").agg(
        *[F.sum(F.when(F.col("tag") == t, F.col("n"))).alias(c) for t, c in
          (("all", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"), ("redundant", "redundant"))]))

    orders = ",".join(f"'{''.join(p)}'" for p in permutations(filters))
    bits = " + ".join(f"IF(contains(substr(filter_order, 1, step - 1), '{f}'), {b}, 0)" for f, b in bit.items())
    grid = (population.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
            .select("part", "total", F.explode(F.expr(f"array({orders})")).alias("filter_order"))
            .select("*", F.explode(F.expr(f"sequence(1, {len(filters)})")).alias("step"))
            .select("*", F.expr("substr(filter_order, step, 1)").alias("filter"), F.expr(bits).alias("before")))
    alone = cell.where(F.expr(f"before = {everything} - ({mask_of})")).select(
        "part", "filter", F.col("removed").alias("unique_fails"))
    counts = ["removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    # repartitioned so that the 600 rows of every part and the two windows share few shuffles
    j = (grid.join(cell, ["part", "filter", "before"], "left").join(alone, ["part", "filter"], "left")
         .na.fill(0, counts))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    j = j.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    j = j.withColumn("kept", F.col("total") - F.sum("removed").over(so_far))
    return j.select("part", "filter_order", F.col("step").cast("int").alias("step"),
                    *[F.col(c).cast("bigint").alias(c) for c in ("kept", *counts, "shapley")])


def relations_of(facts: DataFrame) -> dict[str, DataFrame]:
    """The failing (part, id) of each filter."""
    own = {f: facts.where(F.col(f)).select("part", "id") for f in ROW_FILTERS}
    return {**own, COPY_FILTER: later_copies(facts)}


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    facts = table(row_facts(docs))
    failing = store(relations_of(facts))
    marks = labels.select(F.col("doc_id").alias("id"), F.expr(
        "explode(array(IF(quality = 1, 'good', NULL), IF(toxic = 1, 'toxic', NULL)))").alias("label"))
    return audit(facts.select("part", "id").distinct(), failing, "".join(ROW_FILTERS) + COPY_FILTER,
                 marks.where("label IS NOT NULL"))


#: Independent DuckDB form: each document's five flags, counted order by order.
SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
             100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM w),
g AS (SELECT f.*, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
      FROM f LEFT JOIN labels l ON l.doc_id = f.doc_id),
n AS (SELECT part, a, b, c, d, e, good, toxic, count(*) AS n FROM g GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
           FROM letters p, letters q, letters r, letters s, letters t
           WHERE p.x <> q.x AND p.x <> r.x AND p.x <> s.x AND p.x <> t.x AND q.x <> r.x AND q.x <> s.x
             AND q.x <> t.x AND r.x <> s.x AND r.x <> t.x AND s.x <> t.x),
m AS (SELECT *, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END
               || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END
               || CASE WHEN e THEN 'E' ELSE '' END AS fails FROM n),
s AS (SELECT o.filter_order, k.step, substr(o.filter_order, k.step, 1) AS f, substr(o.filter_order, 1, k.step - 1) AS before
      FROM orders o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k),
x AS (SELECT m.part, s.filter_order, s.step, s.f, m.n, m.good, m.toxic, m.fails,
             contains(m.fails, s.f) AS fail, translate(m.fails, s.before, '') <> m.fails AS earlier FROM m, s),
r AS (SELECT part, filter_order, step, f,
             sum(CASE WHEN NOT earlier AND NOT fail THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN NOT earlier AND fail THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN earlier AND fail THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT earlier AND fail AND good THEN n ELSE 0 END) AS good_lost,
             sum(CASE WHEN NOT earlier AND fail AND toxic THEN n ELSE 0 END) AS toxic_lost
      FROM x GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""
