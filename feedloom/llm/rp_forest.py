"""Near-duplicate vectors by a forest of random-projection trees with spill.

Vectors are compared only within equal labels (and lengths); equal vectors are
one node (their smallest id).

1. While a group has more than COARSE rows it is split in Spark: its vectors,
   less their mean, are projected on some random orthogonal directions, and a
   row goes to the cell of the direction and sign on which it lies furthest, and
   to every other one within a margin of that.  The margin is MARGIN standard
   deviations of how far the projections of a pair at the threshold differ, so
   nearly every such pair shares a cell whatever the data.  All numbers of
   directions are counted out first and the one that moves and compares the
   least is taken.  A group that no number thins (a dense cloud) stays whole and
   is compared block by block.  The groups are gone through in as many waves as
   the rows have copies by two, and a wave's shuffle files go when it is written.
2. In a task equal vectors are folded, and a group of more than LEAF nodes grows
   trees of the same kind of split without spill, TREES at least and more until
   a pair at the threshold is missed by all of them in MISSED of the cases.  How
   often a split parts such a pair is measured on its own rows, and a split that
   parts too many for what it saves is not made.  Leaves are compared exactly:
   in single precision, and in double precision what lies near the threshold.
   A pair counts in the first tree, and in the first group, that it shares.
3. Per node the number of linked rows and a spanning set of links leave the
   task; components of those links are the result's.

Defined cases: a null label or id, a null or zero vector, and one with null or
non-finite components link with nothing and are their own component; repeated
rows count as copies of each other; no vectors give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import broadcast_if_small, map_arrow, sorted_runs, table
from feedloom.llm.components import connected_components

THRESHOLD = 0.93
TREES = 8
LEAF = 256
COARSE = 1 << 16
BLOCK = 1 << 15
MARGIN = 2.0
#: Share of the pairs at the threshold that a task's trees may miss, and the least that one tree may keep.
MISSED, KEPT = 1e-4, 0.25
#: Directions of a split at most: its cells are the bits of two longs.
DIRECTIONS = 64
TILE = 1024
#: Found pairs that a task holds before it counts them.
HELD = 1 << 18
#: Vectors with more copies than this and a MANY-th of the rows are folded before they are dealt; at most MANY are.
COPIES, MANY = 64, 10_000

_GROUP = ["label", "dim", "node"]
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _spread(dim: int, threshold: float) -> float:
    """Standard deviation, over directions, of the projected difference of a pair at the threshold."""
    return math.sqrt((2 - 2 * threshold) / dim)


def _rotation(dim: int, *seed: int) -> np.ndarray:
    """Up to DIRECTIONS random orthogonal directions, as columns."""
    return np.linalg.qr(np.random.default_rng([*seed, dim]).standard_normal((dim, min(dim, DIRECTIONS))))[0]


def _numbers(dim: int) -> list[int]:
    """The numbers of directions that a split may have."""
    most = min(dim, DIRECTIONS)
    return [k for k in (2, 4, 8, 16, 32) if k < most] + [most]


def _flat(column: pa.Array) -> np.ndarray:
    """The vectors of a column of lists of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    """The unit vectors of the rows, summed in one order: equal rows give equal units whatever stands beside them."""
    x = x.astype(np.float64)
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * x[:, i]
    with np.errstate(all="ignore"):
        return np.nan_to_num(x / np.sqrt(total)[:, None], posinf=0, neginf=0)


def _inside(units: np.ndarray, centre: np.ndarray, rotation: np.ndarray, margin: float) -> np.ndarray:
    """(rows, cells): the cells of each row.  Summed in one order, as above."""
    out = np.empty((len(units), 2 * rotation.shape[1]), bool)
    for lo in range(0, len(units), 1024):
        x = units[lo:lo + 1024] - centre
        p = np.zeros((len(x), rotation.shape[1]))
        for i, r in enumerate(rotation):
            p += x[:, i, None] * r
        p = np.concatenate([p, -p], 1)
        out[lo:lo + 1024] = p >= p.max(1)[:, None] - margin
    return out


def _by_group(batch: pa.RecordBatch):
    """(group number, its rows, their units) of the rows of a batch that have a group number."""
    column = batch.column(batch.schema.get_field_index("g"))
    has = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(has):
        g = column.take(pa.array(has)).to_numpy()
        order = np.argsort(g, kind="stable")
        emb = batch.column(batch.schema.get_field_index("emb"))
        for at in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
            yield int(g[at[0]]), has[at], _units(_flat(emb.take(pa.array(has[at]))))


def _centres(rows: DataFrame) -> DataFrame:
    """(g, centre): the mean unit vector of each group of rows (g, emb)."""
    def run(batches):
        total, n = {}, defaultdict(int)
        for b in batches:
            for g, at, x in _by_group(b):
                total[g] = total.get(g, 0) + x.sum(0)
                n[g] += len(at)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([n[g] for g in total], pa.int64()),
                                          pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["g", "n", "total"])

    return (map_arrow(rows.select("g", "emb"), run, "g bigint, n bigint, total array<double>")
            .select("g", "n", F.posexplode("total")).groupBy("g", "pos").agg((F.sum("col") / F.sum("n")).alias("c"))
            .groupBy("g").agg(F.expr("transform(array_sort(collect_list(struct(pos, c))), x -> x.c)").alias("centre")))


def _tallies(rows: DataFrame, threshold: float, rotations: dict[int, np.ndarray]) -> DataFrame:
    """(g, k, cell, n): rows of each cell for every number k of directions, of rows (g, centre, emb)."""
    def run(batches):
        n = {}
        for b in batches:
            centres = b.column(b.schema.get_field_index("centre"))
            for g, at, x in _by_group(b):
                dim = x.shape[1]
                centre = centres[int(at[0])].values.to_numpy(zero_copy_only=False)
                for k in _numbers(dim):
                    inside = _inside(x, centre, rotations[dim][:, :k], MARGIN * _spread(dim, threshold))
                    n[g, k] = n.get((g, k), 0) + inside.sum(0)
        got = [(g, k, c, m) for (g, k), counts in n.items() for c, m in enumerate(counts.tolist()) if m]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in
                                          enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["g", "k", "cell", "n"])

    return (map_arrow(rows.select("g", "centre", "emb"), run, "g bigint, k int, cell int, n bigint")
            .groupBy("g", "k", "cell").agg(F.sum("n").alias("n")))


def _dealt(rows: DataFrame, how: DataFrame, threshold: float, rotations: dict[int, np.ndarray]) -> DataFrame:
    """rows with those of the groups in ``how`` (k, blocks, centre) dealt to their cells or marked for blocks.

    ``lower`` has a bit for each cell before the row's own that the row is in as well, level by level."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    names = [*rows.columns, "put"]

    def run(batches):
        for b in batches:
            cells: list[list[int]] = [[]] * b.num_rows
            bits = np.zeros((b.num_rows, 2), np.uint64)
            ks, centres = (b.column(b.schema.get_field_index(c)) for c in ("k", "centre"))
            for _, at, x in _by_group(b):
                dim, k = x.shape[1], ks[int(at[0])].as_py()
                if k:
                    centre = centres[int(at[0])].values.to_numpy(zero_copy_only=False)
                    inside = _inside(x, centre, rotations[dim][:, :k], MARGIN * _spread(dim, threshold))
                    r, c = np.nonzero(inside)
                    for i, own in zip(at.tolist(), np.split(c, np.cumsum(inside.sum(1))[:-1]), strict=True):
                        cells[i] = own.tolist()
                    np.bitwise_or.at(bits, (at[r], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
            keep = b.select(names)
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(cells, pa.list_(pa.int32())), *(pa.array(bits[:, i].view(np.int64)) for i in (0, 1))],
                names=[*names, "cells", "lo", "hi"])

    got = map_arrow(rows.join(broadcast_if_small(how.withColumnRenamed("blocks", "put")), _GROUP, "left"), run,
                    schema + ", put int, cells array<int>, lo bigint, hi bigint")
    below = "~shiftleft(-1L, cell % 64)"
    return got.withColumn("cell", F.explode_outer("cells")).select(
        *(c for c in rows.columns if c not in ("node", "lower", "blocks")),
        F.expr("IF(cell IS NULL, node, concat(node, lpad(hex(cell), 2, '0')))").alias("node"),
        F.expr(f"""IF(cell IS NULL, lower, concat(lower, IF(cell < 64, array(lo & {below}, 0L), array(lo, hi & {below}))))""").alias("lower"),
        F.expr("coalesce(put, blocks)").alias("blocks")).select(rows.columns)


def coarse_groups(rows: DataFrame, threshold: float, coarse: int = COARSE, block: int = BLOCK) -> tuple[DataFrame, float]:
    """The rows (label, dim, emb, ...) in overlapping groups (node) that pairs at the threshold share, with lower and blocks; how often a row comes."""
    out = rows.withColumns({"node": F.lit(""), "lower": F.expr("CAST(array() AS array<bigint>)"), "blocks": F.lit(0)})
    sizes = table(out.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("size")))
    first = moved = sizes.agg(F.sum("size")).first()[0] or 0
    level = 0
    while True:
        big = sizes.where(F.col("size") > coarse)
        if big.limit(1).count() == 0:
            return out, moved / max(first, 1)
        big = broadcast_if_small(table(big.withColumn("g", F.monotonically_increasing_id())))
        rotations = {r[0]: _rotation(r[0], level) for r in big.select("dim").distinct().collect()}
        of = out.where("blocks = 0").join(big.select(*_GROUP, "g"), _GROUP)
        centres = broadcast_if_small(table(_centres(of)))
        tallies = table(_tallies(of.join(centres, "g"), threshold, rotations))
        costs = tallies.groupBy("g", "k").agg(F.expr(f"sum(n * IF(n > {coarse}, 1 + n / {coarse}D, 1D))").alias("cost"), F.sum("n").alias("to"))
        best = costs.groupBy("g").agg(F.expr("min_by(struct(k, cost, to), struct(cost, k))").alias("b"))
        how = table(big.join(best, "g").join(centres, "g").withColumn("thins", F.expr(f"b.cost < 0.7D * size * ceil(size / {block}D)")).select(
            *_GROUP, "g", "size", F.expr("IF(thins, b.k, 0)").alias("k"), "centre",
            F.expr(f"IF(thins, 0, CAST(ceil(size / {block}D) AS int))").alias("blocks"), F.expr(f"IF(thins, b.to, size * ceil(size / {block}D)) - size").alias("more")))
        moved += int(how.agg(F.sum("more")).first()[0])
        sizes = table(tallies.join(broadcast_if_small(how.select("g", "k", *_GROUP)), ["g", "k"]).select(
            "label", "dim", F.expr("concat(node, lpad(hex(cell), 2, '0'))").alias("node"), F.col("n").alias("size")))
        out = _dealt(out, how.select(*_GROUP, "g", "k", "centre", "blocks"), threshold, rotations)
        level += 1


def _furthest(p: np.ndarray) -> np.ndarray:
    """The direction and sign on which each row of projections lies furthest, as a number."""
    best = abs(p).argmax(1)
    return 2 * best + (p[np.arange(len(p)), best] < 0)


def _parted(x: np.ndarray, at: np.ndarray, rotation: np.ndarray, spread: float, rng: np.random.Generator,
            kept: float) -> tuple[list[np.ndarray], float] | None:
    """The rows ``at`` by their furthest direction, and the share of pairs at the threshold that stay together."""
    pieces = [at[lo:lo + 8192] for lo in range(0, len(at), 8192)]
    centre = sum(x[i].sum(0, dtype=np.float64) for i in pieces) / len(at)
    centre = centre.astype(x.dtype)
    some = x[at[rng.integers(len(at), size=512)]] - centre
    k = min(rotation.shape[1], max(2, math.ceil(0.75 * len(at) / LEAF)))
    for k in dict.fromkeys((k, max(1, k // 4), max(1, k // 16))):
        p = some @ rotation[:, :k]
        cells = [_furthest(v) for v in (p, p + spread * rng.standard_normal(p.shape))]
        keep, shares = (cells[0] == cells[1]).mean(), np.bincount(cells[0]) / len(some)
        if kept * keep >= KEPT and (shares * shares).sum() <= 0.2 * keep:
            cell = np.concatenate([_furthest((x[i] - centre) @ rotation[:, :k]) for i in pieces])
            order = np.argsort(cell, kind="stable")
            return np.split(at[order], np.flatnonzero(np.diff(cell[order])) + 1), kept * keep
    return None


def _leaves(x: np.ndarray, rng: np.random.Generator, spread: float) -> tuple[list[np.ndarray], np.ndarray]:
    """The leaves of one tree over the rows of x, and for each row what share of its pairs at the threshold they keep."""
    out, kept, todo, rotations = [], np.ones(len(x)), [(np.arange(len(x)), 0, 1.0)], {}
    while todo:
        at, depth, share = todo.pop()
        parts = None
        if len(at) > LEAF:
            if depth not in rotations:
                rotations[depth] = _rotation(x.shape[1], int(rng.integers(1 << 31))).astype(x.dtype)
            parts = _parted(x, at, rotations[depth], spread, rng, share)
        if parts:
            todo += [(p, depth + 1, parts[1]) for p in parts[0]]
        else:
            kept[at] = share
            out.append(at)
    return out, kept


def _roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of m rows the smallest row that it reaches over the links a - b."""
    root = np.arange(m)
    while True:
        u, v = root[a], root[b]
        if (u == v).all():
            return root
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not ((up := root[root]) == root).all():
            root = up


class Links:
    """The linked pairs of some vectors, counted as they are found: ``n`` has for each row the copies of the rows
    linked to it, ``root`` the smallest row that it reaches."""

    def __init__(self, raw: np.ndarray, copies: np.ndarray, threshold: float, met: tuple = (), lower: np.ndarray | None = None):
        self.raw, self.copies, self.threshold, self.lower = raw, copies.astype(np.float64), threshold, lower
        self.x = np.empty(raw.shape, np.float32)
        for lo in range(0, len(raw), 4096):
            self.x[lo:lo + 4096] = _units(raw[lo:lo + 4096])
        #: How far a product in single precision may be off.
        self.slack = 1.2e-7 * (raw.shape[1] + 8)
        #: Rows with an equal code have been compared.
        self.codes = list(met)
        self.n, self.root = np.zeros(len(raw)), np.arange(len(raw))
        #: Pairs to count, and pairs that tie their rows together.
        self.found, self.ties, self.held = [], [], 0

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether the pairs are linked, in double precision."""
        out = np.empty(len(r), bool)
        for lo in range(0, len(r), 65536):
            own = slice(lo, lo + 65536)
            out[own] = (_units(self.raw[r[own]]) * _units(self.raw[c[own]])).sum(1) >= self.threshold
        return out

    def tile(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compare the rows a with the rows b, which are the same array or have none in common."""
        s = self.x[a] @ self.x[b].T
        at = np.flatnonzero(s.ravel() >= self.threshold - self.slack)
        if len(at) > s.size // 8:
            return self.dense(a, b, s)
        r, c = np.divmod(at, len(b))
        keep = np.ones(len(at), bool) if a is not b else r < c
        near, r, c = s.ravel()[at][keep] < self.threshold + self.slack, a[r[keep]], b[c[keep]]
        for code in self.codes:
            if not len(r):
                return
            keep = code[r] != code[c]
            near, r, c = near[keep], r[keep], c[keep]
        if self.lower is not None and len(r):
            keep = ~(self.lower[r] & self.lower[c]).any(1)
            near, r, c = near[keep], r[keep], c[keep]
        if near.any():
            near[near] = ~self.exact(r[near], c[near])
            r, c = r[~near], c[~near]
        if len(r):
            self.found.append((r, c))
            self.tied(r, c)

    def dense(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        """The same where many pairs are linked: counted by rows and columns, and tied by one row and what shares its links."""
        mask = s >= self.threshold - self.slack
        if a is b:
            mask &= np.tri(len(a), k=-1, dtype=bool).T
        for code in self.codes:
            mask &= code[a][:, None] != code[b]
        for bits in self.lower.T if self.lower is not None else ():
            mask &= (bits[a][:, None] & bits[b]) == 0
        near = np.nonzero(mask & (s < self.threshold + self.slack))
        mask[near] = self.exact(a[near[0]], b[near[1]])
        counted = mask.astype(np.float64)
        self.n[a] += counted @ self.copies[b]
        self.n[b] += self.copies[a] @ counted
        best = counted.sum(1).argmax()
        star = mask[best].copy()
        via = mask & star
        some = np.flatnonzero(via.any(1))
        ends = np.flatnonzero(star)
        self.tied(np.repeat(a[best], len(ends)), b[ends])
        self.tied(a[some], b[via[some].argmax(1)])
        mask[some] &= ~star
        rest = np.nonzero(mask)
        self.tied(a[rest[0]], b[rest[1]])

    def tied(self, r: np.ndarray, c: np.ndarray) -> None:
        self.ties.append((r, c))
        self.held += len(r)
        if self.held > HELD:
            self.count()

    def leaf(self, at: np.ndarray) -> None:
        if len(at) <= TILE:
            return self.tile(at, at)
        codes = [code[at] for code in self.codes]
        code = max(codes, key=lambda c: np.unique(c, return_counts=True)[1].max(), default=np.arange(len(at)))
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        tiles = [(at[lo:lo + TILE], code[lo], code[min(lo + TILE, len(at)) - 1]) for lo in range(0, len(at), TILE)]
        for i, (a, first, _) in enumerate(tiles):
            for b, _, last in tiles[i:]:
                if first != last:  # else all of both have been compared
                    self.tile(a, b)

    def count(self) -> None:
        m = len(self.n)
        if self.found:
            r, c = (np.concatenate(x) for x in zip(*self.found, strict=True))
            self.n += np.bincount(r, self.copies[c], m) + np.bincount(c, self.copies[r], m)
        if self.ties:
            r, c = (np.concatenate(x) for x in zip(*self.ties, strict=True))
            away = np.flatnonzero(self.root != np.arange(m))
            self.root = _roots(m, np.concatenate([away, r]), np.concatenate([self.root[away], c]))
        self.found, self.ties, self.held = [], [], 0


def linked(raw: np.ndarray, copies: np.ndarray, threshold: float, met: tuple = (), lower: np.ndarray | None = None, seed: int = 0) -> Links:
    """The pairs of rows that the forest finds at the threshold, but for those with an equal code in ``met`` or a common bit in ``lower``."""
    out, rng, miss, tree = Links(raw, copies, threshold, met, lower), np.random.default_rng(seed), np.ones(len(raw)), 0
    while miss.any() and (tree < TREES or miss.mean() > MISSED):
        code = np.empty(len(raw), np.int32)
        leaves, kept = _leaves(out.x, rng, _spread(raw.shape[1], threshold))
        for i, at in enumerate(leaves):
            code[at] = i
            out.leaf(at)
        out.codes.append(code)
        miss *= 1 - kept
        tree += 1
    out.count()
    return out


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """Spanning links (a, b), and per node (b null) its hashes, its rows and the linked rows that this group has to count."""
    id_type = rows.schema["id"].dataType.simpleString()
    keys = [*_GROUP, "bi", "bj"]

    def run(batches):
        for t in sorted_runs(batches, keys):
            h1, h2 = t["h1"].to_numpy(), t["h2"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            copies = np.add.reduceat(t["copies"].to_numpy(), first)
            t = t.take(pa.array(first))
            ids, lower = t["id"].combine_chunks(), _flat(t["lower"].combine_chunks())
            met = (t["blk"].to_numpy(),) if t["bi"][0].as_py() != t["bj"][0].as_py() else ()
            got = linked(_flat(t["emb"].combine_chunks()), copies, threshold, met, lower if lower.any() else None)
            n = np.rint(got.n).astype(np.int64)
            away, some = np.flatnonzero(got.root != np.arange(len(first))), np.flatnonzero((n > 0) | (copies > 1))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([ids.take(pa.array(away)), ids.take(pa.array(some))]),
                pa.concat_arrays([ids.take(pa.array(got.root[away])), pa.nulls(len(some), ids.type)]),
                *(pa.array(np.concatenate([np.zeros(len(away), np.int64), x[some]]))
                  for x in (h1[first], h2[first], copies, n))], names=["a", "b", "h1", "h2", "copies", "n"])

    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys, "h1", "h2", "id"), run,
                     f"a {id_type}, b {id_type}, h1 bigint, h2 bigint, copies bigint, n bigint")


def _passing(df: DataFrame) -> DataFrame:
    """``df`` as a table; the shuffle files of its making go with the write."""
    conf = df.sparkSession.conf
    was = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        return table(df)
    finally:
        conf.unset(_CLEAN) if was is None else conf.set(_CLEAN, was)


def _nodes(base: DataFrame) -> DataFrame:
    """(label, dim, h1, h2, id, copies, emb): the usable rows, a vector with very many copies as one row."""
    fine = base.where("fine")
    most = COPIES + base.count() // MANY
    heavy = table(fine.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min_by("row", "id").alias("only")).where(f"copies > {most}"))
    return (fine.join(F.broadcast(heavy), ["h1", "h2"], "left").where("only IS NULL OR row = only")  # MANY rows at most
            .select("label", F.size("emb").alias("dim"), "h1", "h2", "id", F.expr("coalesce(copies, 1L)").alias("copies"), "emb"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, coarse: int = COARSE, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id) per row."""
    fine = f"""{id_col} IS NOT NULL AND {label_col} IS NOT NULL AND {vec_col} IS NOT NULL
        AND NOT exists({vec_col}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))
        AND exists({vec_col}, x -> x <> 0)"""
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("emb"),
                          F.expr(f"coalesce({fine}, false)").alias("fine"))
    base = table(base.withColumns({"h1": F.xxhash64("label", "emb"), "h2": F.xxhash64("emb", F.lit("v"), "label"),
                                   "row": F.monotonically_increasing_id()}))
    rows, times = coarse_groups(_nodes(base), threshold, coarse, block)
    rows = (rows.withColumn("blk", F.expr("CAST(pmod(h1, greatest(blocks, 1)) AS int)"))
            .withColumn("other", F.explode(F.expr("sequence(0, greatest(blocks, 1) - 1)")))
            .select(*_GROUP, F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk",
                    "h1", "h2", "id", "copies", "lower", "emb"))
    waves = max(1, math.ceil(times / 2))
    got = reduce(DataFrame.union, [_passing(_compared(
        rows.where(f"pmod(xxhash64(label, dim, node, bi, bj, 'wave'), {waves}) = {w}") if waves > 1 else rows, threshold)) for w in range(waves)])
    near = got.where("b IS NULL AND n > 0").groupBy(F.col("a").alias("to")).agg(F.sum("n").alias("near"))
    comp = connected_components(got.where("b IS NOT NULL"), "a", "b").select(F.col("id").alias("to"), "component")
    several = got.where("b IS NULL AND copies > 1").groupBy("h1", "h2").agg(F.min("a").alias("least"), F.max("copies").alias("copies"))
    links = near.join(comp, "to", "left")
    return (base.select("id", "fine", "h1", "h2").join(several, ["h1", "h2"], "left").withColumn("to", F.coalesce("least", "id"))
            .join(links, "to", "left").withColumn("links", F.expr("IF(fine, coalesce(copies, 1L) - 1 + coalesce(near, 0L), 0L)"))
            .select("id", F.col("links").alias("n_links"), F.expr("IF(links > 0, coalesce(component, to), id)").alias("component_id")))


def query(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors).select(F.col("id").alias("vec_id"), "n_links", "component_id",
                                        F.expr("id <=> component_id").alias("kept"))


#: Independent DuckDB form: every pair of equal labels, and components by least reachable id.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a AS id, b AS reach FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.reach = p.a),
c AS (SELECT id, min(reach) AS low FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(c.low, e.vec_id), e.vec_id) AS component_id,
  coalesce(least(c.low, e.vec_id), e.vec_id) IS NOT DISTINCT FROM e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""
