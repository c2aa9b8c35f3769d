"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

1. Each text becomes its set of five-word shingles; texts with equal sets are
   one node (their smallest id), so copies are never compared with each other.
2. TREES signatures of DEEPEST MinHash values per node are paths in TREES
   prefix tries.  The matched prefix is shortened from DEEPEST until the
   chance to meet a pair at the threshold in some tree reaches RECALL.
3. The rows of each tree are sorted by prefix, so equal prefixes are runs.  A
   run is read once against its leaders (nodes unlike all leaders before):
   a node is linked to the leaders that its whole signature resembles, one of
   each group that the links so far tie together, which keeps any pair at the
   threshold in one candidate class with fewer links than the run has rows.  Long runs are
   dealt into salted parts whose leaders then meet in a second pass.
4. Components of those links are candidate classes.  Within a class all pairs
   are compared exactly by their shingles, blocks of BLOCK nodes against
   blocks; counts and a spanning set of links leave the task, never the pairs.

Memory of a task is bounded by a block pair, or the leaders of a run.

Defined cases: null texts and texts without a word have no shingle and link
with nothing; a text of one to four words has one shingle, all of them; rows
with null id link with nothing; repeated rows count as copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import IDS, bitmap_of, broadcast_if_small, in_bitmap, map_arrow, sorted_runs, table
from feedloom.llm.components import connected_components
from feedloom.llm.words import Words, chunks, mix, shingles

K = 5
THRESHOLD = 0.8
TREES = 16
DEEPEST = 6
RECALL = 0.999
#: Resemblance estimated from the whole signature: from LEADS on a node needs no leader of its own, from MEETS on it
#: is linked.  A pair at the threshold whose one side is led at LEADS is at least LEADS - 0.2 like that leader.
LEADS = 0.9
MEETS = 0.45
#: Rows of one prefix that go to one part, and nodes that are compared with as many others in one task.
PART = 4096
BLOCK = 512

_A = mix(np.arange(1, TREES * DEEPEST + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + TREES * DEEPEST, dtype=np.uint64))


def depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability ``recall``."""
    d = deepest
    while d > 1 and 1 - (1 - threshold ** d) ** trees < recall:
        d -= 1
    return d


def minhashes(values: np.ndarray) -> np.ndarray:
    """TREES x DEEPEST MinHash values (their upper 32 bits) of a set of shingle hashes."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        np.minimum(low, ((values[at:at + 1024, None] ^ _B) * _A).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _fold(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set, whatever its order."""
    return (int(mix(values).sum(dtype=np.uint64).view(np.int64)),
            int(mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, h1, h2, sig): number of shingles, key of their set and its MinHash values; n = 0: none."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column(1)):
                value, first = shingles(Words(data, off), K)
                sets = [value[first[i]:first[i + 1]] for i in range(hi - lo)]
                keys = [_fold(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([minhashes(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["id", "n", "h1", "h2", "sig"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                     f"id {id_type}, n bigint, h1 bigint, h2 bigint, sig binary")


def _prefixes(nodes: DataFrame, d: int) -> DataFrame:
    """One row per node and tree: the hash of the tree's number and first d values."""
    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, TREES, DEEPEST)
            h = np.repeat(mix(np.arange(TREES, dtype=np.uint64))[None], len(sig), 0)
            for j in range(d):
                h = mix(h * np.uint64(31) + sig[:, :, j])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(sig)), TREES))),
                                              pa.array(h.ravel().view(np.int64))], names=["id", "prefix"])

    return map_arrow(nodes.select("id", "sig"), run,
                     f"id {nodes.schema['id'].dataType.simpleString()}, prefix bigint")


def _linked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) links from nodes to leaders of their run, and (a, prefix, sig) of the leaders of long runs."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        last, lead_id, lead_sig, used = None, [], np.zeros((0, TREES * DEEPEST), np.uint32), 0
        tied = np.zeros(0, np.int64)  # of each leader: the links given so far join those with equal numbers
        for t in sorted_runs(batches, keys, PART):
            key = tuple(t[k][0].as_py() for k in keys)
            if key != last:
                last, lead_id, used = key, [], 0
            ids = t["id"].to_pylist()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(len(ids), -1)
            a, b, new = [], [], []
            for i, node in enumerate(ids):
                best = 0.0
                if used:
                    est = (lead_sig[:used] == sig[i]).mean(1)
                    best = est.max()
                    near = np.flatnonzero(est >= MEETS)
                    groups, at = np.unique(tied[near], return_index=True)
                    for j in near[at].tolist():
                        a.append(node)
                        b.append(lead_id[j])
                    if len(groups) > 1:
                        tied[:used][np.isin(tied[:used], groups)] = groups[0]
                if best < LEADS:
                    if used == len(lead_sig):
                        more = max(16, used)
                        lead_sig = np.concatenate([lead_sig, np.zeros((more, sig.shape[1]), np.uint32)])
                        tied = np.concatenate([tied, np.zeros(more, np.int64)])
                    lead_sig[used] = sig[i]
                    tied[used] = groups[0] if used and len(groups) else used
                    used += 1
                    lead_id.append(node)
                    new.append(i)
            lead = pa.array(new if t["long"][0].as_py() else [], pa.int64())
            n, none = len(lead), pa.nulls(len(a), pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(a, t["id"].type), t["id"].combine_chunks().take(lead)]),
                pa.concat_arrays([pa.array(b, t["id"].type), pa.nulls(n, t["id"].type)]),
                pa.concat_arrays([pa.nulls(len(a), pa.int64()), t["prefix"].combine_chunks().take(lead)]),
                pa.concat_arrays([none, t["sig"].combine_chunks().take(lead).cast(pa.binary())])],
                names=["a", "b", "prefix", "sig"])

    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys, "id"), run,
                     f"a {id_type}, b {id_type}, prefix bigint, sig binary")


def candidate_links(nodes: DataFrame, d: int) -> DataFrame:
    """(a, b): links that keep every pair at the threshold (in all but 1 - RECALL of cases) in one component."""
    pre = table(_prefixes(nodes, d))
    n = pre.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    rows = (pre.join(n, "prefix").withColumn("long", F.col("rows") > PART)
            .withColumn("salt", F.expr(f"IF(long, pmod(xxhash64(id), CAST(ceil(rows / {PART}) AS bigint)), 0L)"))
            .join(nodes.select("id", "sig"), "id").select("prefix", "salt", "long", "id", "sig"))
    first = table(_linked(rows, ["prefix", "salt"]))
    again = first.where("b IS NULL").select("prefix", F.lit(False).alias("long"), F.col("a").alias("id"), "sig")
    second = _linked(again, ["prefix"])
    return first.where("b IS NOT NULL").select("a", "b").union(second.where("b IS NOT NULL").select("a", "b"))


def _resemble(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether |l & r| / |l | r| >= threshold for each pair; exact counts by products of 0/1 matrices."""
    nl, nr = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    both = np.zeros((len(left), len(right)), np.float32)
    value = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate([nl, nr]))
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    col = np.cumsum(new) - 1
    often = np.bincount(col) > 1  # a shingle of one text only is in no intersection
    keep = often[col]
    col, row = (np.cumsum(often) - 1)[col[keep]], row[keep]
    width = max(256, (1 << 21) // max(1, len(left) + len(right)))
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(left) + len(right), width), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        both += m[:len(left)] @ m[len(left):].T
    return both >= threshold * (nl[:, None] + nr[None, :] - both) - 1e-6


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): links of a spanning set, and per node (b null) how many rows it is linked with."""
    id_type = rows.schema["id"].dataType.simpleString()
    keys = ["class", "bi", "bj"]

    def run(batches):
        for t in sorted_runs(batches, keys):
            ids, copies = t["id"].to_pylist(), np.array(t["copies"].to_pylist())
            sets = []
            for lo, hi, data, off in chunks(t["text"].combine_chunks()):
                value, first = shingles(Words(data, off), K)
                sets += [value[first[i]:first[i + 1]] for i in range(hi - lo)]
            blk, bi, bj = np.array(t["blk"].to_pylist()), t["bi"][0].as_py(), t["bj"][0].as_py()
            li, ri = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            m = _resemble([sets[i] for i in li], [sets[i] for i in ri], threshold)
            count = np.zeros(len(ids), np.int64)
            if bi == bj:
                np.fill_diagonal(m, False)
                count[li] = m @ copies[ri]
            else:
                count[li] = m @ copies[ri]
                count[ri] = m.T @ copies[li]
            a, b = [], []
            parent = list(range(len(ids)))

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            # a row's links all join one tree; a vertex already in it adds no link
            for i, x in enumerate(li.tolist()):
                linked = ri[m[i]]
                for y in linked.tolist():
                    rx, ry = root(x), root(y)
                    if rx != ry:
                        parent[max(rx, ry)] = min(rx, ry)
                        a.append(ids[x])
                        b.append(ids[y])
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([
                pa.array(a + [ids[i] for i in some.tolist()], t["id"].type),
                pa.array(b + [None] * len(some), t["id"].type),
                pa.array([0] * len(a) + count[some].tolist(), pa.int64())], names=["a", "b", "n"])

    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys, "id"), run,
                     f"a {id_type}, b {id_type}, n bigint")


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, class_id) per row: other rows at the threshold, smallest id reachable over links."""
    return _classed(docs, id_col, text_col, threshold).select("id", "n_links", "class_id")


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of similarity_classes with the key (h1, h2) of their shingle set."""
    sigs = table(signatures(docs, id_col, text_col))
    full = sigs.where("n > 0 AND id IS NOT NULL")
    sets = table(full.groupBy("h1", "h2").agg(F.min_by(F.struct("id", "sig"), "id").alias("r"),
                                              F.count(F.lit(1)).alias("copies"))
                 .select("h1", "h2", "r.id", "r.sig", "copies"))
    links = candidate_links(sets, depth(threshold))
    classes = connected_components(links, "a", "b").select("id", F.col("component").alias("class"))
    members = table(classes.join(sets.select("id", "h1", "h2", "copies"), "id"))
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    members = (members.join(size, "class").withColumn("blocks", F.expr(f"CAST(ceil(size / {BLOCK}) AS int)"))
               .withColumn("blk", F.expr("CAST(pmod(xxhash64(id), blocks) AS int)")))
    texts = _texts_of(docs, members, id_col, text_col)
    pairs = (members.join(texts, "id").dropDuplicates(["id"])
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("class", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"),
                     "blk", "id", "copies", "text"))
    checked = table(_verified(pairs, threshold))
    n_links = checked.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("near"))
    comp = connected_components(checked.where("b IS NOT NULL"), "a", "b")
    of_set = (sets.select("h1", "h2", "id", "copies").join(n_links, "id", "left").join(comp, "id", "left")
              .select("h1", "h2", F.expr("copies - 1 + coalesce(near, 0)").alias("n_links"),
                      F.coalesce("component", "id").alias("class_id")))
    linked = of_set.where("n_links > 0")
    return sigs.select("id", "n", "h1", "h2").join(linked, ["h1", "h2"], "left").select(
        "id", "h1", "h2", F.expr("IF(n > 0 AND id IS NOT NULL, coalesce(n_links, 0L), 0L)").alias("n_links"),
        F.expr("IF(n > 0 AND id IS NOT NULL, coalesce(class_id, id), id)").alias("class_id"))


def _texts_of(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows whose id a fixed-size bitmap of the members lets through."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(members.select(F.xxhash64("id").alias("h")), "h"))

    def run(batches):
        for b in batches:
            keep = in_bitmap(bits.value, b.column(2).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(keep)).select(["id", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    return map_arrow(rows.where("id IS NOT NULL AND text IS NOT NULL"), run,
                     f"id {docs.schema[id_col].dataType.simpleString()}, text string")


def query(docs: DataFrame) -> DataFrame:
    return similarity_classes(docs).withColumnRenamed("id", "doc_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is the smallest of their class, all their columns.

    Rows that repeat an id are one document if their shingles are the same: one
    stays.  Otherwise each different text of an id is a document of its own,
    the smaller by a hash of the text.  Rows without an id all stay.
    """
    all_rows = table(_classed(docs, id_col, text_col))
    again = table(all_rows.where("id IS NOT NULL").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.expr("min(struct(h1, h2)) <> max(struct(h1, h2))").alias("differ")).where("n > 1"))
    kinds = again.agg(F.count(F.lit(1)).alias("n"), F.max("differ").alias("differ")).first()
    if kinds["differ"]:
        return _representatives_by_text(docs, id_col, text_col)
    gone = table(all_rows.where("NOT id <=> class_id").select(F.col("id").alias("gid")).distinct())
    out = docs.alias("d").join(broadcast_if_small(gone, IDS).alias("k"), F.col(f"d.{id_col}") == F.col("k.gid"), "left_anti")
    if not kinds["n"]:
        return out
    again = broadcast_if_small(again, IDS).alias("k")
    one = out.alias("d").join(again, F.col(f"d.{id_col}") == F.col("k.id"), "left_anti")
    more = out.alias("d").join(again, F.col(f"d.{id_col}") == F.col("k.id"), "left_semi")
    return one.union(more.dropDuplicates([id_col]))


def _representatives_by_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Representatives where one id has different texts: the rows' id is (id, hash of the text)."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.when(F.col(id_col).isNotNull(), key).alias("key"), F.col(text_col).alias("text"))
    gone = table(similarity_classes(rows, "key", "text").where("NOT id <=> class_id")
                 .select(F.col("id").alias("gone")).distinct())
    kept = rows.join(broadcast_if_small(gone, IDS), F.col("key") == F.col("gone"), "left_anti").select("key", "row")
    one = kept.where("key IS NULL").union(kept.where("key IS NOT NULL").dropDuplicates(["key"]))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
