"""Merkle manifest of a dataset: a content-addressed DAG and its descent.

A row's leaf is the SHA-256 of its values; every FANOUT consecutive leaves of a
group (in id order) are hashed into a node, those into theirs, up to the
group's subroot; the subroots give the root the same way.  What is stored is
one record (digest, children) per node, a folder per height: a digest names
its content wherever it stands.

A proof is found by descent: from the root, each rank digit picks a child of
the digest's record and the unselected children are collected.  Leaf requests
that share leading digits go down as one row, so a level has no more rows than
nodes; only the last digit is taken per leaf.  The collected segments,
reversed, lead from the leaf to the root.

Ranks come from one range-partitioned sort and a count per range, so no task
holds a group; a node gathers FANOUT digests at most.  Every level is a table
in the shared folder.

Defined cases: a null value is ``-``; a null id ranks first and is never
tampered with; null groups come first, apart from ''; rows that repeat an id
rank by their leaves, equal rows are equal leaves side by side; a single leaf
is its group's subroot, a single subroot the root, and the proof of nothing is
the hash of the empty string; an empty table gives no rows; further columns
are no part of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import broadcast_if_small, table

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "array<struct<l: string, r: string>>"
#: Ids whose decimal digits' CRC-32 this divides are tampered with.
TAMPERED = 3


def leaf_digest(columns: dict[str, str]) -> str:
    """SQL of a row's leaf: each value as byte count, colon and value, null as a hyphen."""
    parts = [f"coalesce(concat(octet_length(CAST({v} AS string)), ':', CAST({v} AS string)), '-')" for v in columns.values()]
    return f"sha2(concat({', '.join(parts)}), 256)"


def ranked(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the 0-based rank within ``part`` by ``order``, written.

    The rows are sorted once over all parts; a part's rows are then consecutive
    and its rank is their distance from its first row, range by range.
    """
    at = table(rows.repartitionByRange(part, *order).sortWithinPartitions(part, *order)
               .withColumn("at", F.monotonically_increasing_id()))
    ranges = at.groupBy(F.col(part).alias("p"), F.expr("shiftright(at, 33)").alias("range")).agg(
        F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("p").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table(ranges.select("p", "range", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off")))
    j = at.join(broadcast_if_small(offsets), (F.col(part) == F.col("p")) & (F.expr("shiftright(at, 33)") == F.col("range")))
    return j.select(*rows.columns, F.expr("at - lo + off").alias("pos"))


@dataclass
class Tree:
    """tops: (grp, levels, digest), one per group; records[h - 1]: (grp, pos, digest, children) of height h."""
    tops: DataFrame
    records: list[DataFrame]


def grow(leaves: DataFrame) -> Tree:
    """The tree over (grp, pos, digest), pos dense from 0 within grp."""
    sizes = table(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
                  .select("grp", F.expr(f"IF(n = 1, 0, length(conv(n - 1, 10, {FANOUT})))").alias("levels")))
    top = sizes.agg(F.max("levels")).first()[0] or 0
    small = broadcast_if_small(sizes)
    nodes, records = leaves.join(small, "grp").select("grp", "pos", "digest", "levels"), []
    tops = nodes.where("levels = 0")
    for h in range(1, top + 1):
        run = (nodes.where(F.col("levels") >= h)
               .groupBy("grp", F.expr(f"shiftright(pos, {FANOUT_BITS})").alias("up"), "levels")
               .agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("c")))
        nodes = table(run.select("grp", F.col("up").alias("pos"), "levels", F.expr("c.digest").alias("children"))
                      .withColumn("digest", F.expr("sha2(array_join(children, ''), 256)")))
        records.append(nodes)
        tops = tops.unionByName(nodes.where(F.col("levels") == h).drop("children"))
    return Tree(table(tops.select("grp", "levels", "digest")), records)


def _segment(children: str, digit: str) -> str:
    """SQL of the unselected children beside the one picked."""
    return (f"named_struct('l', array_join(slice({children}, 1, CAST({digit} AS int)), ''), "
            f"'r', array_join(slice({children}, CAST({digit} AS int) + 2, {FANOUT}), ''))")


def descend(tree: Tree, above: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(grp, up, children, down): the last records before the leaves, and the segments from the root to them.

    ``above`` is (grp, down): the segments that lead to each group's top.
    ``requests``, (grp, pos), confines the descent to their digits; without it
    every leaf is requested.  Groups of a single leaf have no record.
    """
    start = tree.tops.join(above, "grp").select("grp", "levels", F.lit(0).cast("bigint").alias("pos"), "digest", "down")
    front = None
    for h in range(len(tree.records), 0, -1):
        here = start.where(F.col("levels") == h).drop("levels")
        front = here if front is None else front.unionByName(here)
        stored = tree.records[h - 1].select(F.col("digest").alias("name"), "children").dropDuplicates(["name"])
        met = front.join(stored, F.col("digest") == F.col("name"))
        if h == 1:
            return met.select("grp", F.col("pos").alias("up"), "children", "down")
        met = met.select("grp", "pos", "down", "children", F.posexplode("children").alias("digit", "digest"))
        front = met.select("grp", F.expr(f"shiftleft(pos, {FANOUT_BITS}) + digit").alias("pos"), "digest",
                           F.expr(f"array_append(down, {_segment('children', 'digit')})").alias("down"))
        if requests is not None:
            wanted = requests.select("grp", F.expr(f"shiftright(pos, {FANOUT_BITS * (h - 1)})").alias("pos")).distinct()
            front = front.join(wanted, ["grp", "pos"], "left_semi")
        front = table(front)
    return start.limit(0).selectExpr("grp", "pos AS up", "array(digest) AS children", "down")


def proofs(tree: Tree, leaves: DataFrame, above: DataFrame, every: bool = True) -> DataFrame:
    """``leaves`` (grp, pos, digest and more) with ``path``: the segments from the leaf to the root.

    ``every`` says that ``leaves`` are all leaves of the tree.
    """
    runs = descend(tree, above, None if every else leaves.select("grp", "pos")).select(
        F.col("grp").alias("g"), "up", "children", "down")
    asked = leaves.withColumn("run", F.expr(f"shiftright(pos, {FANOUT_BITS})"))
    met = asked.join(runs, (F.col("grp") == F.col("g")) & (F.col("run") == F.col("up")))
    digit = f"pos & {FANOUT - 1}"
    # the record that the digits lead to must hold the leaf itself
    segment = f"IF(get(children, CAST(({digit}) AS int)) = digest, {_segment('children', f'({digit})')}, NULL)"
    inner = met.select(*leaves.columns, F.expr(f"concat(array({segment}), reverse(down))").alias("path"))
    single = (tree.tops.where("levels = 0").join(above, "grp")
              .select(F.col("grp").alias("g"), F.expr("reverse(down)").alias("path")))
    return inner.unionByName(leaves.join(single, F.col("grp") == F.col("g")).select(*leaves.columns, "path"))


def folded(leaf: str) -> str:
    """SQL of the root that a leaf and its ``path`` give."""
    return f"aggregate(path, {leaf}, (d, s) -> sha2(concat(s.l, d, s.r), 256))"


@dataclass
class Manifest:
    """leaves: (grp, id, digest, pos, other); groups: the tree per group; whole: the tree over subroots; root: its digest."""
    leaves: DataFrame
    groups: Tree
    whole: Tree
    subroots: DataFrame
    root: str | None


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS,
             other: str | None = None) -> Manifest:
    """The manifest of ``docs``; ``other``, an SQL expression over the row, is kept beside each leaf."""
    thin = docs.select(F.expr(f"IF(`{group_col}` IS NULL, '', concat('=', `{group_col}`))").alias("grp"),
                       F.col(id_col).alias("id"), F.expr(leaf_digest({c: f"`{c}`" for c in columns})).alias("digest"),
                       F.expr(other or "CAST(NULL AS string)").alias("other"))
    leaves = table(ranked(table(thin), "grp", ["id", "digest"]))
    groups = grow(leaves)
    tops = groups.tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    subroots = table(ranked(tops, "grp", ["of"]))
    whole = grow(subroots)
    root = whole.tops.select("digest").first()
    return Manifest(leaves, groups, whole, subroots, root[0] if root else None)


def leaf_proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """grp, id, digest, other, subroot and path of every leaf, or of those whose id is among ``requests`` (id)."""
    start = m.whole.tops.select("grp", F.expr(f"CAST(array() AS {SEGMENT})").alias("down"))
    of_group = proofs(m.whole, m.subroots, start).select(
        F.col("of").alias("grp"), F.col("digest").alias("subroot"), F.expr("reverse(path)").alias("down"))
    of_group = table(of_group)
    leaves = m.leaves
    if requests is not None:
        leaves = table(leaves.join(requests.select(F.col("id").alias("rid")), F.col("id") == F.col("rid"), "left_semi"))
    paths = proofs(m.groups, leaves, of_group.select("grp", "down"), requests is None)
    return paths.join(broadcast_if_small(of_group.select("grp", "subroot")), "grp")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per document."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = leaf_digest({c: f"`{c}`" for c in COLUMNS if c != "text"}
                          | {"text": f"translate(text, '{capitals}', '{capitals.lower()}')"})
    tampered = f"IF(crc32(CAST(doc_id AS string)) % {TAMPERED} = 0, {changed}, NULL)"
    m = manifest(docs, other=tampered)
    p = leaf_proofs(m).withColumn("root", F.lit(m.root).cast("string"))
    return p.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
                    F.expr("sha2(array_join(transform(path, s -> concat(s.l, s.r)), ''), 256)").alias("proof_sha256"),
                    F.expr(folded("coalesce(other, digest)")).alias("folded_root")).withColumn(
                        "verified", F.expr("folded_root = root"))


#: Independent DuckDB form: all levels by grouping, each proof by the positions of its nodes.
SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR i IN range(8)]),
             lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS crc
  FROM documents),
leaf AS (
  SELECT row_id, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295::BIGINT) % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS other
  FROM v),
grp AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS g FROM leaf GROUP BY lang),
rk AS (SELECT leaf.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r
       FROM leaf JOIN grp ON leaf.lang IS NOT DISTINCT FROM grp.lang),
node AS (
  SELECT rk.g, 0 AS lvl, r AS pos, leaf AS digest, n FROM rk JOIN grp ON grp.g = rk.g
  UNION ALL
  SELECT g, lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
  FROM node WHERE n > 1 GROUP BY g, lvl, pos // 8, n),
sub AS (SELECT g, lvl AS height, digest FROM node WHERE n = 1),
up AS (
  SELECT 0 AS lvl, g AS pos, digest, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
  FROM up WHERE n > 1 GROUP BY lvl, pos // 8, n),
top AS (SELECT digest AS root FROM up WHERE n = 1),
runs AS (
  SELECT g, lvl, pos // 8 AS run, list(digest ORDER BY pos) AS c FROM node WHERE n > 1 GROUP BY g, lvl, pos // 8
  UNION ALL
  SELECT -1, lvl, pos // 8, list(digest ORDER BY pos) FROM up WHERE n > 1 GROUP BY lvl, pos // 8),
place AS (
  SELECT rk.row_id, rk.g AS g, lvl, lvl AS k, r // CAST(pow(8, lvl) AS BIGINT) AS pos
  FROM rk JOIN (SELECT DISTINCT g, lvl FROM runs WHERE g >= 0) q ON q.g = rk.g
  UNION ALL
  SELECT rk.row_id, -1, q.lvl, q.lvl + sub.height, rk.g // CAST(pow(8, q.lvl) AS BIGINT)
  FROM rk JOIN sub ON sub.g = rk.g, (SELECT DISTINCT lvl FROM runs WHERE g = -1) q),
seg AS (
  SELECT row_id, k, coalesce(array_to_string(c[:pos % 8], ''), '') AS l, coalesce(array_to_string(c[pos % 8 + 2:], ''), '') AS r
  FROM place JOIN runs ON runs.g = place.g AND runs.lvl = place.lvl AND runs.run = place.pos // 8),
fold AS (
  SELECT row_id, 0::BIGINT AS k, coalesce(other, leaf) AS d FROM rk
  UNION ALL
  SELECT fold.row_id, fold.k + 1, sha256(seg.l || d || seg.r) FROM fold JOIN seg ON seg.row_id = fold.row_id AND seg.k = fold.k),
last AS (SELECT row_id, arg_max(d, k) AS folded FROM fold GROUP BY row_id),
proof AS (SELECT row_id, string_agg(l || r, '' ORDER BY k) AS p FROM seg GROUP BY row_id)
SELECT doc_id, leaf, sub.digest AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM rk JOIN sub ON sub.g = rk.g JOIN last ON last.row_id = rk.row_id LEFT JOIN proof ON proof.row_id = rk.row_id, top
"""
