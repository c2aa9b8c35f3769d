"""Language-model scores of documents by Stupid Backoff, counted over all documents.

For each pair of consecutive words (v, w) of a document d, with the document's
own counts taken out of the pair's and the context's counts,

    S = c'(v w) / c'(v)     if another document has the pair,
        ALPHA x c(w) / N    otherwise;

a first word has ALPHA x c(w) / N.  The score is the sum of ln S; words of no
other context keep a probability because unigrams count the whole corpus.

The n-grams are exploded in numpy into tables of (v, w, document, count), kept
in columns, one block per group of documents and hash bucket of v, and meet
the counts of their bucket in one shuffle.  What the pairs leave open goes to
the buckets of w in a second one, where the unigram counts are; a third sums
per document.  A context that a bounded sample (SAMPLE documents) shows to be
frequent is dealt out by pair instead, its total then coming from the
second shuffle: that changes where it is counted, not the result.  Buckets
grow in number with spark.sql.shuffle.partitions, so a block stays small.

Words are told apart by 48 bits of their hash.

Defined cases: null and empty texts have no words and score 0; rows that
repeat an id are documents of their own; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import map_arrow, sorted_runs, table
from feedloom.llm.words import Words, chunks, mix

ALPHA = 0.4
SAMPLE = 2000
#: Bytes of text (and documents) of a group.
GROUP = 8 << 20
MOST_DOCS = 1 << 16
BUCKETS_PER_PARTITION = 2
#: Requests of a bucket whose sums are gathered before they are sent on.
PENDING = 1 << 20

_48 = np.uint64((1 << 48) - 1)
#: Stands for "end of the document" as a next word: it counts for the context and has no score.
_END = np.uint64(0)

HEAD, PAIRS, WORDS, SUMS, OPEN = range(5)
_ROW = "p int, kind int, batch bigint, blob binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns one after the other, each with its type and length.

    64-bit words take 6 bytes a value, other integers (none is negative) the fewest that hold the largest.
    """
    out = [np.array([len(columns)], np.uint8).tobytes()]
    for c in columns:
        six = c.dtype == np.uint64
        if not six and c.dtype.kind in "iu":
            top = int(c.max()) if len(c) else 0
            c = c.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
        out.append(np.array([ord("6" if six else c.dtype.char)], np.uint8).tobytes())
        out.append(np.array([len(c)], np.uint32).tobytes())
        if six:
            out += [(c & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (c >> np.uint64(32)).astype(np.uint16).tobytes()]
        else:
            out.append(c.tobytes())
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(blob[0]):
        kind, n = chr(blob[at]), int(np.frombuffer(blob, np.uint32, 1, at + 1)[0])
        at += 5
        if kind == "6":
            low = np.frombuffer(blob, np.uint32, n, at).astype(np.uint64)
            out.append(low | (np.frombuffer(blob, np.uint16, n, at + 4 * n).astype(np.uint64) << np.uint64(32)))
            at += 6 * n
        else:
            out.append(np.frombuffer(blob, np.dtype(kind), n, at))
            at += n * np.dtype(kind).itemsize
    return out


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def _totals(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of n over equal keys, for each row."""
    order = np.argsort(key)
    first = _runs(key[order])
    total = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, n.dtype)
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(total, np.diff(np.append(first, len(key))))
    return out


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(words) % np.uint64(buckets)).astype(np.int32)


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) * np.uint64(31) + w)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
        pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
        names=["p", "kind", "batch", "blob"])


def _deal(p: np.ndarray, buckets: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket, in their order."""
    order = np.argsort(p, kind="stable")
    cut = np.searchsorted(p[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cut[b] < cut[b + 1]:
            at = order[cut[b]:cut[b + 1]]
            yield b, [c[at] for c in columns]


def _group(ids: pa.Array, words: list[np.ndarray], docs: list[np.ndarray], n_words: np.ndarray, batch: int,
           buckets: int, hot: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """The blocks of one group of documents."""
    h, doc = np.concatenate(words), np.concatenate(docs)
    sink = pa.BufferOutputStream()
    head = pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64())], names=["id", "n_words"])
    with pa.ipc.new_stream(sink, head.schema) as out:
        out.write_batch(head)
    yield batch % buckets, HEAD, batch, sink.getvalue().to_pybytes()
    if not len(h):
        return
    vocabulary, local, n = np.unique(h, return_inverse=True, return_counts=True)
    for b, (w, c) in _deal(_bucket(vocabulary, buckets), buckets, [vocabulary, n.astype(np.uint32)]):
        yield b, WORDS, batch, _pack(w, c)
    # the next word, 0 at the end of a document; then the distinct (v, w, document) and their counts
    follow = np.zeros(len(h), np.uint64)
    same = doc[1:] == doc[:-1]
    follow[:-1][same] = local[1:][same].astype(np.uint64) + np.uint64(1)
    key = (local.astype(np.uint64) << np.uint64(40)) | (follow << np.uint64(16)) | doc.astype(np.uint64)
    key, count = np.unique(key, return_counts=True)
    v = vocabulary[(key >> np.uint64(40)).astype(np.int64)]
    w = np.append(_END, vocabulary)[((key >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.int64)]
    d = (key & np.uint64(0xFFFF)).astype(np.uint16)
    p = _bucket(v, buckets)
    some = np.isin(v, hot)
    p[some] = (_pair_hash(v[some], w[some]) % np.uint64(buckets)).astype(np.int32)
    own = np.zeros(len(v), np.uint32)  # how often the document has the context, for those dealt out by pair
    own[some] = _totals(v[some] * np.uint64(MOST_DOCS) + d[some], count[some])
    for b, (bv, bw, bd, bc, bo, apart) in _deal(p, buckets, [v, w, d, count.astype(np.uint32), own, some]):
        first = _runs(bv)
        follower, which = np.unique(bw, return_inverse=True)
        yield b, PAIRS, batch, _pack(bv[first], np.diff(np.append(first, len(bv))), follower, which, bd, bc, bo[apart])
    # first words have no context
    begin = np.flatnonzero(np.append(True, ~same))
    order = np.argsort(h[begin], kind="stable")
    yield from _open(h[begin][order], np.zeros(len(begin), np.uint16), doc[begin][order].astype(np.uint16),
                     np.ones(len(begin), np.int64), np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64),
                     [batch], buckets)


def _open(word, block, doc, m, r, o, batches, buckets) -> Iterator[tuple[int, int, int, bytes]]:
    """Requests to the unigrams: m occurrences to back off, r to divide by the context, which the document has o times."""
    names = np.array(batches, np.int64)
    for b, (w, k, d, mm, rr, oo) in _deal(_bucket(word, buckets), buckets, [word, block, doc, m, r, o]):
        first = _runs(w)
        yield b, OPEN, 0, _pack(w[first], np.diff(np.append(first, len(w))), k, d, mm, rr, oo[rr > 0], names)


def exploded(docs: DataFrame, id_col: str, text_col: str, buckets: int, hot: np.ndarray) -> DataFrame:
    """Blocks of the documents' words and pairs by bucket."""
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            lo, words, at, n_words = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
            size = 0
            for first, last, data, off in chunks(b.column(1)):
                w = Words(data, off)
                words.append(w.hash & _48)
                at.append(w.doc + (first - lo))
                n_words.append(w.count)
                size += len(data)
                if size >= GROUP or last == b.num_rows or last - lo + 4096 > MOST_DOCS:
                    rows = list(_group(b.column(0).slice(lo, last - lo), words, at, np.concatenate(n_words),
                                       (part << 24) + number, buckets, hot))
                    yield _rows(rows)
                    number += 1
                    lo, words, at, n_words, size = last, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, _ROW)


def _sums(block: np.ndarray, doc: np.ndarray, s: np.ndarray, m: np.ndarray, batches: list[int],
          buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Partial sums (ln S without ln N, occurrences that lack ln N) by group of documents."""
    key = (block.astype(np.int64) << 16) | doc.astype(np.int64)
    u, inv = np.unique(key, return_inverse=True)
    total, lack = np.bincount(inv, s), np.bincount(inv, m)
    of = u >> 16
    for k in np.unique(of).tolist():
        a, z = np.searchsorted(of, [k, k + 1])
        yield batches[k] % buckets, SUMS, batches[k], _pack(u[a:z] & 0xFFFF, total[a:z], lack[a:z].astype(np.int64))


def _pairs_met(rows: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Pairs against the counts of their bucket; other kinds of rows pass."""
    def run(batches):
        for t in sorted_runs(batches, ["p"]):
            keep = [r for r in zip(*(t[c].to_pylist() for c in ("p", "kind", "batch", "blob")), strict=True)
                    if r[1] != PAIRS]
            blocks = [(r["batch"], _unpack(r["blob"])) for r in t.filter(pa.compute.equal(t["kind"], PAIRS)).to_pylist()]
            if blocks:
                names = [b for b, _ in blocks]
                v = np.concatenate([np.repeat(c[0], c[1]) for _, c in blocks])
                w = np.concatenate([c[2][c[3]] for _, c in blocks])
                doc = np.concatenate([c[4].astype(np.uint16) for _, c in blocks])
                n = np.concatenate([c[5].astype(np.int32) for _, c in blocks])
                k = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(c[3]) for _, c in blocks])
                late = np.concatenate([c[6] for _, c in blocks])
                blocks.clear()
                pair = _totals(_pair_hash(v, w), n) - n
                context = _totals(v, n)
                own = _totals(mix(v + (k.astype(np.uint64) << np.uint64(48))) + doc.astype(np.uint64), n)
                word, apart = w != _END, np.isin(v, hot)
                met = word & (pair > 0)
                s = np.zeros(len(v))
                s[met] = n[met] * np.log(pair[met])
                near = met & ~apart
                s[near] -= n[near] * np.log((context - own)[near])
                keep += _sums(k[met], doc[met], s[met], np.zeros(int(met.sum())), names, buckets)
                back, far = word & ~met, met & apart
                ask = np.concatenate([w[back], v[far]])
                order = np.argsort(ask, kind="stable")
                zero = np.zeros(len(ask), np.int64)
                m, r, o = zero.copy(), zero.copy(), zero.copy()
                m[:back.sum()], r[back.sum():] = n[back], n[far]
                o[back.sum():] = late[met[apart]]
                if len(ask):
                    keep += _open(ask[order], np.concatenate([k[back], k[far]])[order].astype(np.uint32),
                                  np.concatenate([doc[back], doc[far]])[order], m[order], r[order], o[order], names, buckets)
            for lo in range(0, len(keep), 256):
                yield _rows(keep[lo:lo + 256])

    return map_arrow(rows.repartition("p").sortWithinPartitions("p"), run, _ROW)


def _words_met(rows: DataFrame, buckets: int) -> DataFrame:
    """Requests against the unigram counts of their bucket (counts sort first); heads pass.

    Sums of a bucket are gathered over its blocks, PENDING rows at a time.
    """
    def run(batches):
        last, word, count = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        tables: list[list[np.ndarray]] = []
        asked: list[tuple[np.ndarray, ...]] = []

        def answers():
            batch, doc, s, m = (np.concatenate(c) for c in zip(*asked, strict=True))
            names, k = np.unique(batch, return_inverse=True)
            asked.clear()
            return _rows(list(_sums(k, doc, s, m, names.tolist(), buckets)))

        for t in sorted_runs(batches, ["p", "kind"], 64):
            p, kind = t["p"][0].as_py(), t["kind"][0].as_py()
            if p != last:
                if asked:
                    yield answers()
                last, word, count, tables = p, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
            if kind == WORDS:
                tables += [_unpack(x) for x in t["blob"].to_pylist()]
                continue
            if tables:
                word, inv = np.unique(np.concatenate([c[0] for c in tables]), return_inverse=True)
                count = np.bincount(inv, np.concatenate([c[1] for c in tables])).astype(np.int64)
                tables = []
            if kind == HEAD:
                yield from t.select(["p", "kind", "batch", "blob"]).to_batches()
                continue
            for of, x in zip(t["batch"].to_pylist(), t["blob"].to_pylist(), strict=True):
                if kind == SUMS:  # all sums of a group of documents meet in one bucket, and go on as one
                    d, s, m = _unpack(x)
                    asked.append((np.full(len(d), of, np.int64), d, s, m))
                    if sum(len(a[1]) for a in asked) >= PENDING:
                        yield answers()
                    continue
                w, size, k, d, m, r, o, names = _unpack(x)
                c = np.repeat(count[np.searchsorted(word, w)], size)
                m, r = m.astype(np.int64), r.astype(np.int64)
                s = m * np.log(ALPHA * c)
                s[r > 0] -= r[r > 0] * np.log(c[r > 0] - o)
                asked.append((names.astype(np.int64)[k], d, s, m))
                if sum(len(a[1]) for a in asked) >= PENDING:
                    yield answers()
        if asked:
            yield answers()

    # counts (2) must come before what asks for them (4); heads and sums pass
    return map_arrow(rows.repartition("p").sortWithinPartitions("p", "kind"), run, _ROW)


def _documents(rows: DataFrame, id_type: str) -> DataFrame:
    """(id, n_words, s, m) of every document: its group's head and partial sums."""
    def run(batches):
        last, head, s, m = None, None, None, None

        def done():
            return pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array(s), pa.array(m)],
                                              names=["id", "n_words", "s", "m"])

        for t in sorted_runs(batches, ["batch"], 256):
            for batch, kind, blob in zip(t["batch"].to_pylist(), t["kind"].to_pylist(), t["blob"].to_pylist(), strict=True):
                if batch != last:
                    if last is not None:
                        yield done()
                    last = batch
                if kind == HEAD:
                    head = pa.ipc.open_stream(blob).read_next_batch()
                    s, m = np.zeros(head.num_rows), np.zeros(head.num_rows)
                else:
                    d, ds, dm = _unpack(blob)
                    s[d] += ds
                    m[d] += dm
        if last is not None:
            yield done()

    return map_arrow(rows.where(f"kind IN ({HEAD}, {SUMS})").repartition("batch").sortWithinPartitions("batch", "kind"),
                     run, f"id {id_type}, n_words bigint, s double, m double")


def frequent_words(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> np.ndarray:
    """Words with over a quarter of a bucket's share in a bounded sample; they only decide where pairs are counted."""
    step = max(1, docs.count() // SAMPLE)

    def run(batches):
        for b in batches:
            for _, _, data, off in chunks(b.column(1)):
                u, n = np.unique(Words(data, off).hash & _48, return_counts=True)
                top = np.argsort(-n, kind="stable")[:256]
                yield pa.RecordBatch.from_arrays([pa.array(u[top].view(np.int64)), pa.array(n[top], pa.int64()),
                                                  pa.array(np.full(len(top), n.sum() / max(1, len(top))))],
                                                 names=["w", "n", "of"])

    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        f"pmod(xxhash64(id), {step}) = 0").drop("id").select(F.lit(1).alias("one"), "text")
    got = table(map_arrow(sample, run, "w bigint, n bigint, of double"))
    total = got.agg(F.sum("of")).first()[0] or 0.0
    rows = got.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") > total / (4 * buckets)).orderBy(
        F.desc("n"), "w").limit(4 * buckets).collect()  # a share over 1 / (4 buckets) leaves at most that many
    return np.array([r["w"] for r in rows], np.int64).view(np.uint64)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, n_words, score, per_word): sum of ln S, and that over the number of words (null without words)."""
    spark = docs.sparkSession
    buckets = buckets or BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = frequent_words(docs, id_col, text_col, buckets)
    met = _words_met(_pairs_met(exploded(docs, id_col, text_col, buckets, hot), buckets, hot), buckets)
    out = table(_documents(met, docs.schema[id_col].dataType.simpleString()))
    total = out.agg(F.sum("n_words")).first()[0] or 1
    return out.select("id", "n_words", F.expr(f"s - m * ln({total}D)").alias("score")).withColumn(
        "per_word", F.expr("IF(n_words > 0, score / n_words, NULL)"))


def query(docs: DataFrame) -> DataFrame:
    return scored(docs).select(F.col("id").alias("doc_id"), "n_words", F.round("score", 4).alias("score"),
                               F.round("per_word", 6).alias("per_word"))


#: Independent DuckDB form: count tables joined to exploded n-grams.
SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
d AS (SELECT r, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') END AS w FROM t),
x AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM d),
p AS (SELECT r, i, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, w FROM x),
c1 AS (SELECT w, count(*) AS n FROM x GROUP BY w),
o1 AS (SELECT r, w, count(*) AS n FROM x GROUP BY r, w),
c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT r, v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY r, v, w),
s AS (SELECT p.r, CASE WHEN p.v IS NOT NULL AND c2.n > o2.n THEN ln((c2.n - o2.n) / (cv.n - ov.n))
    ELSE ln(0.4 * cw.n / (SELECT count(*) FROM x)) END AS s
  FROM p JOIN c1 cw ON cw.w = p.w LEFT JOIN c1 cv ON cv.w = p.v LEFT JOIN o1 ov ON ov.r = p.r AND ov.w = p.v
  LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w LEFT JOIN o2 ON o2.r = p.r AND o2.v = p.v AND o2.w = p.w),
z AS (SELECT r, sum(s) AS score FROM s GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(z.score, 0.0), 4) AS score,
  round(z.score / nullif(len(d.w), 0), 6) AS per_word FROM d LEFT JOIN z ON z.r = d.r
"""
